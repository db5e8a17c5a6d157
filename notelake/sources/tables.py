"""The logical tables of a fleet's notes as views over the driver's Parquet tables.

Each table is a list of expressions that Spark and DuckDB read alike, so the
oracles see the very rows that the queries see.
"""

import re

from pyspark.sql import DataFrame, SparkSession

_NOTE = [
    "o_orderkey as memory_id", "o_orderkey % 10 as bucket", "concat('d', cast(o_custkey % 20 as string)) as device_id", "concat('d', cast(o_custkey % 23 as string)) as origin_device",
    "case when o_custkey % 5 = 0 then 'global' else concat('s', cast(o_custkey % 5 as string)) end as site",
    "concat('Pump P-', cast(o_custkey % 100 as string), ' ', lower(o_orderpriority), ' reading ', cast(o_orderkey % 50 as string), case when o_orderkey % 8 = 0 then ' bearing replaced, normal' else ' vibration high' end) as text",
    "case when o_orderkey % 4 = 0 then concat('Pump [identity removed] ', lower(o_orderpriority)) when o_orderkey % 4 = 1 then '' end as shared_text",
    "case o_orderkey % 8 when 0 then 'announcement' when 1 then 'reference' when 2 then 'photo' else 'observation' end as kind",
    "case when o_custkey % 7 = 0 then null else concat('P-', cast(o_custkey % 100 as string)) end as asset",
    "case o_orderkey % 3 when 0 then 'private' when 1 then 'shared' else 'redacted' end as scope",
    "case o_custkey % 7 when 0 then 'equipment_fault' when 1 then 'safety_hazard' when 2 then 'procedure_fix' when 3 then 'routine_reading' when 4 then 'personal_health' when 5 then 'people_hr' else 'scratch_note' end as category",
    "case substring(o_orderpriority, 1, 1) when '1' then 2 when '2' then 1 when '3' then 1 else 0 end as priority",
    "case o_orderstatus when 'O' then 'active' when 'F' then 'superseded' else 'deleted' end as status",
    "case o_orderkey % 6 when 0 then 'private' when 1 then 'pending' when 2 then 'synced' when 3 then 'conflict' when 4 then 'failed' else 'synced' end as sync_state",
    "case o_orderkey % 5 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' end as review",
    "case when o_orderkey % 5 in (1, 2) then concat('sup', cast(o_custkey % 3 as string)) end as reviewed_by", "case when o_orderkey % 5 = 2 then 'unclear' end as review_reason",
    "case when o_orderkey % 5 in (1, 2) then o_orderdate end as reviewed_at", "case o_custkey % 4 when 0 then 'trainee' when 1 then 'supervisor' when 2 then 'visitor' else 'technician' end as role",
    "cast(o_orderkey % 7 + 1 as int) as rev", "cast(o_orderkey % 4 as int) as base_rev", "case when o_orderkey % 10 < 6 then 'local' else 'replica' end as shard",
    "o_orderdate as created_at", "o_orderdate as updated_at", "case when o_orderkey % 8 = 0 then o_orderdate + interval '3' day end as expires_at",
    "o_orderkey % 11 = 0 as withdrawn", "case when o_orderkey % 13 = 0 then 'peer1' end as via_peer", "case o_orderkey % 17 when 0 then '99' when 1 then null when 2 then 'x' else '1' end as schema_text",
    "case when o_orderkey % 5 <> 0 then o_orderkey - 1 end as supersedes", "case when o_orderstatus = 'F' then o_orderkey + 1 end as superseded_by", "concat('worker', cast(o_custkey % 31 as string)) as author", "case when o_orderkey % 2 = 0 then 'resolves' else 'updates' end as relation", "o_totalprice as amount",
    "concat(substring(o_orderpriority, 3, 3), ',', lower(o_orderstatus), ',pump') as tag_text",
]
_PLACES = "memory_id text shared_text kind asset scope category priority status sync_state review rev base_rev site device_id updated_at withdrawn via_peer tag_text".split()

TABLES: dict[str, tuple[str, list[str], str | None]] = {
    "notes": ("orders", _NOTE, None),
    "local_notes": ("orders", _NOTE, "o_orderkey % 10 < 5"),
    "replica_notes": ("orders", [e.replace("cast(o_orderkey % 7 + 1 as int)", "cast(o_orderkey % 7 + 1 - o_orderkey % 2 as int)") for e in _NOTE], "o_orderkey % 10 between 4 and 7"),
    "cloud_notes": ("orders", [e.replace("cast(o_orderkey % 7 + 1 as int)", "cast(o_orderkey % 7 + o_orderkey % 3 as int)").replace("' vibration high'", "case when o_orderkey % 3 = 0 then ' vibration normal' else ' vibration high' end") for e in _NOTE], "o_orderkey % 10 <> 3"),
    "base_notes": ("orders", [e.replace("' vibration high'", "case when o_orderkey % 7 < 3 then ' vibration low' else ' vibration high' end").replace("',pump'", "',old'") for e in _NOTE], "o_orderkey % 10 < 8"),
    "outbox": (
        "events",
        [
            "event_id as seq", "concat('d', cast(user_id % 20 as string)) as device_id", "user_id * 7 % 300 as memory_id", "case event_type when 'view' then 'upsert' when 'click' then 'upsert' when 'error' then 'delete' when 'purchase' then 'retract' else 'review' end as op",
            "cast(event_id % 3 as int) as priority", "cast(user_id % 5 as int) as base_rev", "case event_id % 7 when 0 then 'done' when 1 then 'conflict' when 2 then 'failed' when 3 then 'cancelled' else 'pending' end as state",
            "cast(event_id % 6 as int) as attempts", "ts as created_at", "ts as updated_at", "value",
        ],
        None,
    ),
    "activity": ("events", ["event_id as id", "ts", "event_type as type", "case when event_type = 'error' then 'error' when value > 20 then 'warn' else 'info' end as level", "concat(event_type, ' by ', cast(user_id as string)) as message", "props as data", "concat('d', cast(user_id % 20 as string)) as device_id", "value"], None),
    "sync_runs": (
        "events",
        [
            "event_id as run_id", "concat('d', cast(user_id % 20 as string)) as device_id", "case when event_type = 'click' then 'manual' else 'auto' end as run_trigger", "case when event_type = 'error' then 'failed' when event_type = 'signup' then 'running' else 'ok' end as status",
            "cast(event_id % 4 as int) as pushed", "cast(event_id % 3 as int) as pulled", "case when event_id % 5 = 4 then 1 else 0 end as merged", "case when event_id % 11 = 10 then 1 else 0 end as conflicts", "case when event_id % 13 = 12 then 1 else 0 end as failed", "case when event_id % 9 = 8 then 2 else 0 end as removed", "cast(user_id as bigint) * 100 as bytes_up", "event_id % 1000 as bytes_down", "ts as started_at", "cast(event_id % 2 as int) as waiting",
        ],
        None,
    ),
    "conflict_log": (
        "events",
        [
            "event_id as id", "props as data", "concat('{\"text\":\"', event_type, '\",\"rev\":', cast(event_id % 7 as string), '}') as base_payload", "concat('{\"text\":\"mine ', event_type, '\",\"rev\":', cast(event_id % 8 as string), '}') as local_payload",
            "case when event_id % 5 <> 0 then concat('{\"text\":\"theirs\",\"rev\":', cast(event_id % 9 as string), '}') end as cloud_payload", "case when event_id % 3 = 0 then '[\"text\",\"tags\"]' when event_id % 3 = 1 then '[\"status\"]' end as fields",
        ],
        None,
    ),
    "heartbeats": ("events", ["event_id as id", "concat('d', cast(user_id % 20 as string)) as device_id", "ts", "event_type <> 'error' as online"], None),
    "revisions": ("lineitem", ["l_orderkey as memory_id", "l_linenumber as line", "l_shipdate as ts", "concat(l_returnflag, l_linestatus) as flags", "l_quantity as quantity", "l_partkey as part", "l_suppkey as supp"], None),
    "devices": ("supplier", ["concat('d', cast(s_suppkey as string)) as device_id", "case s_suppkey % 3 when 0 then 'trainee' when 1 then 'technician' else 'guest' end as role", "s_nationkey as site_id", "s_suppkey % 4 = 0 as trusted", "cast(floor(s_acctbal / 100) as int) as streak"], None),
    "reviews": ("labels", ["doc_id as decision_id", "concat('d', cast(doc_id % 20 as string)) as device_id", "quality = 1 as approved"], None),
    "media": ("events", ["event_id as photo_id", "user_id as memory_id", "case event_type when 'view' then 'active' when 'error' then 'deleted' else 'active' end as status", "concat('d', cast(user_id % 20 as string)) as device_id", "case when user_id % 5 = 0 then 'global' else concat('s', cast(user_id % 5 as string)) end as site", "ts as created_at", "case event_id % 3 when 0 then 'local' when 1 then 'replica' else 'queued' end as held", "value as score", "cast(event_id % 640 as int) as width", "cast(event_id % 480 as int) as height", "cast(event_id % 4 as int) as faces"], None),
}
_DRIVER = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table, or a driver table by its own name."""
    if name in _DRIVER:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, exprs, where = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return (df.where(where) if where else df).selectExpr(*exprs)


def with_tables(sql: str) -> str:
    """DuckDB SQL with the logical tables it names put in front as CTEs."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} as (select {', '.join(TABLES[n][1])} from {TABLES[n][0]}" + (f" where {TABLES[n][2]}" if TABLES[n][2] else "") + ")" for n in used]
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
