"""Benchmark decontamination by template windows.

Words are canonicalised: numbers, units behind a number and capitalised words
within a sentence become typed placeholders, everything else is lower-cased.
Windows of ``WINDOW`` template words are hashed and joined with the benchmark's
windows. What the case and the surroundings leave open is read in every way, on
both sides: capitalised words as they stand, all as names (at a sentence start
too), none as a name, and the window in plain words. Along a diagonal (document
position less item position) the names are lined up: where each name of the item
stands for one name in the document, all windows count, so a re-parameterised
question is caught and a chance likeness of templates is not. On other diagonals
windows without a name count, and those in which no value is changed count
towards ``RUN``. Numbers may differ from place to place, as equal numbers often
play two roles; but a number that the item repeats before the same word is held
like a name. Diagonals are held against each other too: beside the one with
most windows only those count that agree with it, of others the windows without
such values.

The tasks that read the texts keep only windows whose hash is in the benchmark.
That set and the benchmark's words are sent to them when either has at most
``max_sent`` entries (both are counted); beyond it all windows go to the join.

A document is contaminated by an item when the windows that count, wherever they
stand, together cover at least ``COVER`` of its words, or ``RUN`` words. A window with fewer than ``LITERAL``
different plain words is compared without placeholders. An item shorter than the window
is one window of its own length; items of fewer than ``SHORTEST`` words match
nothing.

Defined results: a null text has no words and is clean; a null item text
matches nothing; rows that repeat a doc_id are judged one by one, and equal
item texts under several ids are all named; empty tables give no rows or only
clean ones; columns other than doc_id, text and item_id are not read, and are
carried by ``drop_contaminated``.
"""

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.shingles import window_hashes
from notelake.llm.words import CHUNK, chunks, gather, split_words, strings
from notelake.sources.scratch import materialize

WINDOW, LITERAL, SHORTEST = 8, 4, 4
COVER, RUN = 0.5, 40
MAX_SENT = 1_000_000
# Words that are numbers, and units, in English, German, French and Spanish; words that mostly mean something else (one as an article, once, an) are left out.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split()
)
UNITS = frozenset(
    "% $ € £ mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres percent dollar dollars cent cents euro euros degree degrees mph kph watt watts volt volts hz "
    "zoll meile meilen gramm kilogramm pfund sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois année années degré degrés "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_][^\W_]*(?:['’-][^\W_]+)*|[$€£%]|[.!?\n]")
_WORD, _NUMBER, _UNIT, _NAME, _MARK = range(5)
_KINDS = {"<number>": _NUMBER, "<unit>": _UNIT, "<name>": _NAME}
_HOLDERS = np.array([0, *(xxhash.xxh3_64_intdigest(k) for k in _KINDS), 0], dtype=np.uint64)


def _kind(token: str, low: str) -> int:
    """The kind of a token by itself; _NAME and _UNIT still depend on what stands before."""
    if token in ".!?\n":
        return _MARK
    if token[0].isdigit() or low in NUMBER_WORDS:
        return _NUMBER
    if low in UNITS:
        return _UNIT
    return _NAME if token[0].isupper() and token[1:].islower() else _WORD


class Vocabulary(dict):
    """Token -> code, with the kind and the hash of each code.

    ``known`` limits the hashes to the words of the benchmark: any other word
    gets the hash 0, and no window that holds it as a plain word can match.
    """

    def __init__(self, known: frozenset[str] | None = None, size: int = 300_000):
        super().__init__()
        self.known, self.size = known, size
        self.kinds, self.hashes = list(range(5)), [0] * 5  # codes 0 to 4: a kind without a known word
        self.table = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = _kind(token, low)
        if self.known is not None and low not in self.known:
            code = kind
        else:
            code = len(self.kinds)
            self.kinds.append(kind)
            self.hashes.append(xxhash.xxh3_64_intdigest(low) or 1)
        if len(self) < self.size or code > 4:  # what is not kept is looked up again
            self[token] = code
        return code

    def arrays(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, hashes and places of the words among ``codes``, and which are capitalised wherever they stand; ``ends`` bound the texts."""
        if len(self.kinds) != len(self.table[0]):
            self.table = np.array(self.kinds, dtype=np.int8), np.array(self.hashes, dtype=np.uint64)
        kinds = self.table[0][codes]
        before, after = np.empty_like(kinds), np.empty_like(kinds)
        before[1:], after[:-1] = kinds[:-1], kinds[1:]
        full = ends[1:] > ends[:-1]
        before[ends[:-1][full]], after[ends[1:][full] - 1] = _MARK, _MARK
        out = kinds.copy()
        out[(kinds == _NAME) & (before == _MARK)] = _WORD
        out[(kinds == _UNIT) & (before != _NUMBER) & (after != _NUMBER)] = _WORD
        keep = np.flatnonzero(kinds != _MARK)
        return out[keep], self.table[1][codes[keep]], keep, (kinds == _NAME)[keep]


def canonical(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Kinds, hashes, capitals and values (lower-cased) of a text's words."""
    tokens = _TOKEN.findall(text)
    vocabulary = Vocabulary()
    codes = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    kinds, hashes, keep, capital = vocabulary.arrays(codes, np.array([0, len(codes)]))
    return kinds, hashes, capital, [tokens[i].lower() for i in keep]


def readings(kinds: np.ndarray, capital: np.ndarray) -> list[np.ndarray]:
    """The kinds as they stand, with every capitalised word as a name, with none as a name, and with plain words only."""
    return [kinds, np.where(capital, _NAME, kinds), np.where(kinds == _NAME, _WORD, kinds), np.full_like(kinds, _WORD)]


def template_windows(kinds: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window, and whether its placeholders count."""
    if len(kinds) < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    plain, salt = window_hashes(hashes, size), np.uint64(size * 2)
    if not kinds.any():
        return plain + salt + np.uint64(1), np.zeros(len(plain), bool)
    filled = window_hashes(np.where(kinds == _WORD, hashes, _HOLDERS[kinds]), size)
    holders = np.concatenate(([0], np.cumsum(kinds != _WORD)))
    typed = holders[size:] > holders[:-size]
    at = np.flatnonzero(typed)
    if len(at):  # a window says enough by itself if it has LITERAL different plain words
        words = np.sort(np.lib.stride_tricks.sliding_window_view(np.where(kinds == _WORD, hashes, np.uint64(0)), size)[at], axis=1)
        different = (words[:, 1:] != words[:, :-1]).sum(axis=1) + (words[:, 0] != 0)
        typed[at] = different >= LITERAL
    return np.where(typed, filled + salt, plain + salt + np.uint64(1)), typed


_ITEM = "item_id long, n_item long, size int, q long, hash long, values array<string>, slots array<int>, roles array<array<struct<at:int,of:string>>>"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each window of each item and each way to read it, written once.

    slots are the places in the window that hold a placeholder. roles are the
    values to hold against the other windows, with their places: as the text
    stands (null if the row has others), and with every capitalised word as a
    name. A number that is followed by the same word at two places of the item
    is held with that word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kinds, hashes, capital, values = canonical(text or "")
                size = min(WINDOW, len(kinds))
                if size < SHORTEST:
                    continue
                follows = [f"{v} {w}" for v, w in zip(values, [*values[1:], ""], strict=True)]
                twice = {x for x, n in Counter(x for x, k in zip(follows, kinds, strict=True) if k == _NUMBER).items() if n > 1}
                ways = []
                for own in readings(kinds, capital):
                    of = [v if k == _NAME else x if k == _NUMBER and x in twice else None for v, x, k in zip(values, follows, own, strict=True)]
                    found, typed = template_windows(own, hashes, size)
                    slots = [[j for j in range(size) if t and own[q + j] != _WORD] for q, t in enumerate(typed.tolist())]
                    ways.append((found.view(np.int64).tolist(), slots, [[(j, of[q + j]) for j in x if of[q + j] is not None] for q, x in enumerate(slots)]))
                for q in range(len(kinds) - size + 1):
                    base, wide = ways[0][2][q], ways[1][2][q]
                    seen = set()
                    for way in (0, 2, 3, 1):
                        h, slots = ways[way][0][q], ways[way][1][q]
                        if h not in seen:
                            seen.add(h)
                            rows.append((item, len(kinds), size, q, h, values[q : q + size], slots, [None if way == 1 else base, wide]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("of", pa.string())]))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["item_id", "n_item", "size", "q", "hash", "values", "slots", "roles"])

    return materialize(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, _ITEM), "item-windows")


class Reader:
    """Finds the windows of many texts that may stand in the benchmark; each different word is looked at once."""

    def __init__(self, wanted: tuple[np.ndarray, frozenset[str]] | None, sizes: list[int]):
        self.hashes, self.words = wanted or (None, None)
        self.sizes, self.vocabulary, self.codes = sizes, Vocabulary(self.words), {}

    def _tokens(self, found: pa.DictionaryArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words, the codes of the tokens of every place, and where each place begins."""
        if len(self.vocabulary) > self.vocabulary.size or len(self.codes) > self.vocabulary.size:
            self.vocabulary, self.codes = Vocabulary(self.words), {}
        code, known, words = self.vocabulary.__getitem__, self.codes, strings(found.dictionary)
        for w in words:
            if w not in known:
                known[w] = array("i", map(code, _TOKEN.findall(w))).tobytes()
        own = [known[w] for w in words]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        return words, *gather(np.frombuffer(b"".join(own), dtype=np.int32), sizes, np.asarray(found.indices))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, list[str]]]]:
        """The number of words of each text, and (text, place, hash, words) of the windows."""
        found, bounds = split_words(pc.fill_null(texts, ""))
        words, codes, starts = self._tokens(found)
        ends = starts[bounds]  # of the texts, in tokens
        kinds, hashes, keep, capital = self.vocabulary.arrays(codes, ends)
        first = np.searchsorted(keep, ends)  # of the texts, in words
        possible = np.flatnonzero((hashes != 0) | (kinds != _WORD) | capital)
        text = np.searchsorted(first, possible, side="right") - 1
        # Runs of possible words: only windows within one may match.
        fresh = np.concatenate(([True], (np.diff(possible) != 1) | (np.diff(text) != 0)))[: len(possible)]
        run = np.cumsum(fresh) - 1
        stay = np.bincount(run, minlength=1)[run] >= min(self.sizes, default=WINDOW)
        at, text, run = possible[stay], text[stay], run[stay]
        kinds, hashes, capital = kinds[at], hashes[at], capital[at]
        hits: set[tuple[int, int, int]] = set()
        ways = [own for k, own in enumerate(readings(kinds, capital)) if not k or (own != kinds).any()]
        for own in ways if len(at) else ():
            sums = np.cumsum([(own == _WORD) & (hashes == 0), own != kinds], axis=1)
            foreign, other = np.concatenate((np.zeros((2, 1), sums.dtype), sums), axis=1)
            for size in self.sizes:
                if len(at) < size:
                    continue
                fits = (foreign[size:] == foreign[:-size]) & (run[size - 1 :] == run[: len(run) - size + 1])
                if own is not ways[0]:  # only what this reading changes
                    fits &= other[size:] != other[:-size]
                fit = np.flatnonzero(fits)
                if not len(fit):
                    continue
                lo, hi = fit[0], fit[-1] + size
                h = template_windows(own[lo:hi], hashes[lo:hi], size)[0][fit - lo]
                if self.hashes is not None:
                    hit = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h
                    fit, h = fit[hit], h[hit]
                hits.update(zip(fit.tolist(), [size] * len(fit), h.view(np.int64).tolist(), strict=True))
        place = keep[at]
        spoken = np.searchsorted(starts, place, side="right") - 1  # a token's word
        number, within = np.asarray(found.indices)[spoken], place - starts[spoken]
        low = lambda i: _TOKEN.findall(words[number[i]])[within[i]].lower()
        rows = [(int(text[i]), int(at[i] - first[text[i]]), h, [low(j) for j in range(i, i + size)]) for i, size, h in sorted(hits)]
        return np.diff(first), rows


def document_windows(docs: DataFrame, sizes: list[int], wanted: tuple[np.ndarray, frozenset[str]] | None) -> DataFrame:
    """rid, doc_id, key (md5 of the text) and n_tokens with null hash once for each document, and p, hash and values for its windows under every reading.

    ``wanted`` are the sorted window hashes and the words of the benchmark;
    without it every window is returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["rid", "doc_id", "key", "n_tokens", "p", "hash", "values"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value, sizes)
        for b in chunks(batches, 3, CHUNK if wanted is not None else CHUNK // 32):
            n, rows = reader.read(b.column(3))
            heads = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), *(pa.nulls(len(n), t) for t in types[4:])]
            yield pa.RecordBatch.from_arrays(heads, names=names)
            for lo in range(0, len(rows), 20_000):
                text, p, h, values = zip(*rows[lo : lo + 20_000], strict=True)
                at = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays([*(x.take(at) for x in heads[:4]), *(pa.array(x, t) for x, t in zip((p, h, values), types[4:], strict=True))], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.md5("text").alias("key"), "text")
    return materialize(rows.mapInArrow(run, "rid long, doc_id long, key string, n_tokens long, p long, hash long, values array<string>"), "document-windows")


def _covered(qs):
    """Words of the item under its windows that begin at the sorted places ``qs``."""
    return F.aggregate(
        qs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000).cast("long").alias("last")),
        lambda a, q: F.struct((a["n"] + F.least(F.col("size").cast("long"), q - a["last"])).alias("n"), q.alias("last")),
        lambda a: a["n"],
    )


def matches(windows: DataFrame, items: DataFrame) -> DataFrame:
    """rid, item_id, n_item, covered, literal (covered, with the unchanged windows of other diagonals) and changed (a value differs from the item's) for each document and item that meet."""
    hits = windows.where("hash is not null").select("rid", "p", "hash", F.col("values").alias("mine")).join(items, "hash")
    # Words outside the slots must be equal: a hash alone proves nothing.
    same = F.forall(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.array_contains("slots", j) | (F.get("mine", j) == F.get("values", j)))
    pairs = F.transform("role", lambda x: F.struct(x["of"].alias("of"), F.get("mine", x["at"]).alias("to")))
    hits = hits.where((F.size("mine") == F.col("size")) & same).select("*", F.posexplode("roles").alias("family", "role")).where("role is not null")
    places = {"qs": F.lit(True), "nameless": F.size("role") == 0, "kept": F.col("mine") == F.col("values"), "moved": F.col("mine") != F.col("values"), "nameless_moved": (F.size("role") == 0) & (F.col("mine") != F.col("values"))}
    gathered = [F.collect_set(F.when(test, F.col("q"))).alias(name) for name, test in places.items()]
    lines = hits.withColumn("pairs", pairs).groupBy("rid", "item_id", "n_item", "size", "family", (F.col("p") - F.col("q")).alias("diagonal")).agg(*gathered, F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    whole = _consistent(F.col("pairs"))
    counted, changed = F.when(whole, F.col("qs")).otherwise(F.col("nameless")), F.size(F.when(whole, F.col("moved")).otherwise(F.col("nameless_moved"))) > 0
    line = F.struct((-F.size(counted)).alias("n"), "diagonal", counted.alias("counted"), F.when(whole, F.col("pairs")).otherwise(F.slice("pairs", 1, 0)).alias("pairs"))
    flat = lambda name: F.array_distinct(F.flatten(F.collect_set(name))).alias(name)
    families = lines.withColumn("line", line).withColumn("changed", changed).groupBy("rid", "item_id", "n_item", "size", "family").agg(F.sort_array(F.collect_list("line")).alias("lines"), flat("nameless"), flat("kept"), F.max("changed").alias("changed"))
    families = families.withColumn("counted", F.array_union(_agreeing(F.col("lines")), "nameless"))
    union = lambda name: F.sort_array(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name)
    found = families.withColumn("literal", F.array_union("counted", "kept")).groupBy("rid", "item_id", "n_item", "size").agg(union("counted"), union("literal"), F.max("changed").alias("changed"))
    return found.select("rid", "item_id", "n_item", _covered("counted").alias("covered"), _covered("literal").alias("literal"), "changed")


def _consistent(pairs: Column) -> Column:
    """Whether every slot value of the item stands for one value."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["of"])))


def _agreeing(lines: Column) -> Column:
    """The windows of the diagonals that agree on every value: the one with most windows, then each that does not clash with those before it."""
    start = F.struct(F.slice(lines, 1, 1)[0]["pairs"].alias("pairs"), F.array().cast("array<bigint>").alias("counted"))

    def step(a: Column, x: Column) -> Column:
        joint = F.array_union(a["pairs"], x["pairs"])
        both = F.struct(joint.alias("pairs"), F.concat(a["counted"], x["counted"]).alias("counted"))
        return F.when(_consistent(joint), both).otherwise(a)

    return F.aggregate(lines, start, step, lambda a: a["counted"])


def judge(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN, max_sent: int = MAX_SENT) -> DataFrame:
    """rid, doc_id, key, n_tokens, contaminated, n_items, items (sorted ids, comma-joined), cover and reparameterised for each row of ``docs``."""
    items = item_windows(benchmark)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # WINDOW - SHORTEST + 1 at most
    hashes, words = items.select("hash").distinct(), items.select(F.explode("values").alias("word")).distinct()
    wanted = None
    if 0 < items.count() <= max_sent and words.count() <= max_sent:
        wanted = np.sort(hashes.toArrow()["hash"].to_numpy().view(np.uint64)), frozenset(words.toArrow()["word"].to_pylist())
    windows = document_windows(docs, sizes, wanted)
    enough = (F.col("covered") / F.col("n_item") >= cover) | (F.col("literal") >= run)
    share = F.when(F.col("literal") >= run, F.col("literal")).otherwise(F.col("covered")) / F.col("n_item")
    bad = matches(windows, items).where(enough).withColumn("cover", share)
    bad = bad.groupBy("rid").agg(F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("items"), F.countDistinct("item_id").alias("n_items"), F.max("cover").alias("cover"), F.max("changed").alias("reparameterised"))
    heads = windows.where("hash is null").select("rid", "doc_id", "key", "n_tokens")
    return heads.join(bad, "rid", "left").select(
        "rid", "doc_id", "key", "n_tokens", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN, max_bad: int = 200_000) -> DataFrame:
    """The clean rows of ``docs`` with their own columns; up to ``max_bad`` contaminated ones (counted) are sent to the tasks, so that no text is shuffled."""
    bad = judge(docs, benchmark, cover, run).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    bad = materialize(bad, "contaminated")
    if bad.count() <= max_bad:
        bad = F.broadcast(bad)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.md5("text").alias("own_key"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti").select("row.*")
