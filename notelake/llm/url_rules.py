"""URL rules by a sort-merge range join.

A host is written backwards, label by label (``a.example.com`` becomes
``com.example.a.``), so a rule for a host and its subdomains is one interval of
the sorted keys, and intervals nest or are disjoint. Pages and rules are swept
in the order of their keys: a stack holds the rules whose interval is open,
pushed when a key reaches it and popped when a key has left it. Of the rules on
the stack whose path the page's path starts with, the longest (host and path)
wins. Within one host's rules the path is looked up by the distinct lengths of
their paths.

The rules are counted. Up to ``max_swept`` are sent to every task and swept
beside its own sorted pages, without a shuffle. Beyond it pages are dealt out
by ranges of keys (and paths, so that a host with many pages is split), each
rule goes to the ranges that its interval meets, and these are swept.

Defined results: a null URL or one without ``://`` has an empty host and path,
which no rule fits; equal rules count once, and of a block and an allow rule
with one host and path, allow wins; a rule with a null host or path is ignored;
repeated rows are judged one by one; an empty table gives no rows; only page_id
and url are read.
"""

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.sources.scratch import materialize

#: The production rules: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"
#: Rules that the sweep may send to every task: some tens of MB at most.
MAX_SWEPT = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.example.com`` -> ``com.example.a.``, so a label, which has no dot in it, is never part of another; an empty host gives an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def _canonical(rules: DataFrame) -> DataFrame:
    r = rules.where("host is not null and path is not null and host <> ''").select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    return r.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))  # "allow" sorts first


class Sweep:
    """The open rule intervals over a rising sequence of host keys."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def _reach(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._reach(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, paths, sizes = self.stack[-1]
        paths[path] = verdict
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def page(self, key: str, path: str) -> tuple[str | None, str | None, int]:
        """(rule, verdict, open intervals) of the longest rule."""
        self._reach(key)
        best: tuple = (-1, -1, None, None)
        for _, host, paths, sizes in self.stack:
            for n in sizes:
                if n <= len(path) and path[:n] in paths:
                    best = max(best, (len(host) + n, len(host), host + path[:n], paths[path[:n]]), key=lambda x: x[:2])
                    break
        return best[2], best[3], len(self.stack)


_FIELDS = "page_id long, host string, path string, rule string, verdict string, n_open long"


def _judged(page_id: list, host: list, path: list, found: list, default: str) -> pa.RecordBatch:
    columns = (page_id, host, path, [x[0] for x in found], [x[1] or default for x in found], [x[2] for x in found])
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split(" ")[0] for f in _FIELDS.split(", ")])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, max_swept: int = MAX_SWEPT) -> DataFrame:
    """page_id, host, path, rule, verdict and n_open (rules' hosts that hold the page's) for each row of ``pages``."""
    host, path = split_url(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keyed, rules = keyed.withColumn("key", host_key(F.col("host"))), _canonical(rules).withColumn("key", host_key(F.col("host")))
    if rules.count() > max_swept:
        return _by_ranges(keyed, rules, default)
    table = sorted(tuple(r) for r in rules.select("key", "host", "path", "verdict").collect())  # counted above
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules_, at, sweep_ = sent.value, 0, Sweep()
        for b in batches:
            found, columns = [], [c.to_pylist() for c in b.columns]
            for key, path in zip(columns[3], columns[2], strict=True):
                while at < len(rules_) and rules_[at][0] <= key:
                    sweep_.rule(*rules_[at])
                    at += 1
                found.append(sweep_.page(key, path))
            yield _judged(*columns[:3], found, default)

    return keyed.sortWithinPartitions("key").mapInArrow(sweep, _FIELDS)


def _by_ranges(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The sweep for rule sets too large for every task."""
    spark = keyed.sparkSession
    dealt = keyed.repartitionByRange("key", F.xxhash64("path")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "url-ranges")
    # A row for each partition: its number follows the shuffle's settings, not the data.
    ends = dealt.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
    sent = spark.sparkContext.broadcast([[r[k] for r in ends] for k in range(3)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lows, highs = sent.value
        for b in batches:
            at, to = [], []
            for k, key in enumerate(b.column(0).to_pylist()):
                first = bisect.bisect_left(highs, key)  # the first range that ends at the key or behind it
                while first < len(parts) and (lows[first] <= key or lows[first].startswith(key)):
                    at.append(k)
                    to.append(parts[first])
                    first += 1
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(c.take(pa.array(at, pa.int64())) for c in b.columns)], names=["part", "key", "host", "path", "verdict"])

    placed = rules.select("key", "host", "path", "verdict").mapInArrow(place, "part int, key string, host string, path string, verdict string")
    both = placed.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict").unionByName(
        dealt.select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep_, now = Sweep(), None
        for b in batches:
            ids, hosts, paths, found = [], [], [], []
            for part, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    sweep_, now = Sweep(), part
                if not kind:
                    sweep_.rule(key, host, path, verdict)
                    continue
                found.append(sweep_.page(key, path))
                ids.append(page_id)
                hosts.append(host)
                paths.append(path)
            yield _judged(ids, hosts, paths, found, default)

    return both.repartition("part").sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, _FIELDS)


def sql(rules=RULES, default: str = DEFAULT) -> str:
    """DuckDB SQL for the query's columns."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return rf"""
with rules(verdict, host, path) as (values {values}),
u as (select row_number() over () as r, page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
k as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
open_ as (select k.r, rules.*, k.path as page_path from k join rules on k.host = rules.host or ends_with(k.host, '.' || rules.host)),
best as (select r, arg_max(host || path, length(host || path)) as rule, arg_max(verdict, length(host || path)) as verdict from open_ where starts_with(page_path, path) group by r),
depth as (select r, count(distinct host) as n_open from open_ group by r)
select page_id, k.host, k.path, rule, coalesce(verdict, '{default}') as verdict, coalesce(n_open, 0)::bigint as n_open from k left join best using (r) left join depth using (r)"""
