"""Token ids in bit-plane shuffled, zstandard-compressed shard files.

``write_tokens`` sorts documents by doc_id over range partitions, encodes each
whole text and streams the ids of each partition into one shard file. A shard
is a run of fixed-size blocks (the last may be shorter); a block's ids are
transposed into byte or bit planes, and each plane is compressed alone, so a
plane of high bits, which hardly changes, costs next to nothing. The footer has
the chunk index (offset, number of ids, checksum and plane sizes of each block)
and the document table. ``read_tokens`` decodes the shards of a manifest, one
per task, and cuts the stream back into documents.

Defined results: a null text is empty, so its only id is the end id; a null
doc_id sorts first; rows that repeat a doc_id are all written, ordered by text,
and go to several shards where they are many; an empty table gives an empty manifest and no rows; only doc_id and text are
read, so other columns cannot clash.
"""

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.words import chunks, split_words, strings
from notelake.sources.files import open_input, open_output, unique_name
from notelake.sources.scratch import materialize, scratch_path

MAGIC = b"IDPLANE1"
BLOCK = 65_536
END_ID = 0
#: Entries after which a worker's cache of pieces begins anew; it only saves time, so what it does not hold changes no result.
CACHE = 600_000
#: Characters of the text that take part in dealing out the rows.
LEAD = 32
MANIFEST = "part long, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids from the lowest up; planes above the highest used one are left out."""
    top = int(ids.max(initial=0)).bit_length()
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, : max(1, -(-top // 8))]
    if not bits:
        return [octets[:, k].tobytes() for k in range(octets.shape[1])]
    planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [planes[k].tobytes() for k in range(max(1, top))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of ``to_planes``."""
    octets = np.zeros((n, 4), dtype=np.uint8)
    if bits:
        rows = np.zeros((32, n), dtype=np.uint8)
        for k, p in enumerate(planes):
            rows[k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
        octets[:] = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, dtype=np.uint8)
    return octets.reshape(-1).view("<u4")


class ShardWriter:
    """Streams documents' ids into one shard file; holds one block and the index."""

    def __init__(self, uri: str, bits: bool, block: int, level: int = 3):
        self.uri, self.bits, self.block = uri, bits, block
        self.file, self.zip = open_output(uri), zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held, self.n_ids = 0, [], 0, 0
        self.blocks, self.docs = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, n))
        self.n_ids += n
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        cut = len(ids) if last else len(ids) - len(ids) % self.block
        for lo in range(0, cut, self.block):
            part = ids[lo : min(lo + self.block, cut)]
            planes = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            self.blocks.append((self.at, len(part), zlib.crc32(part.tobytes()), [len(p) for p in planes]))
            self._put(b"".join(planes))
        self.held, self.n_held = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> int:
        self._flush(True)
        sizes = [s for b in self.blocks for s in b[3]]
        nulls = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        index = struct.pack("<BQQQ", self.bits, self.block, len(self.blocks), len(self.docs)) + b"".join(
            np.asarray(x, dtype=t).tobytes()
            for x, t in (
                ([b[0] for b in self.blocks], "<u8"),
                ([b[1] for b in self.blocks], "<u4"),
                ([b[2] for b in self.blocks], "<u4"),
                ([len(b[3]) for b in self.blocks], "<u1"),
                (sizes, "<u4"),
                ([d or 0 for d, _ in self.docs], "<i8"),
                (nulls, "<u1"),
                ([n for _, n in self.docs], "<u8"),
            )
        )
        packed = self.zip.compress(index)
        self._put(packed)
        self._put(struct.pack("<Q", len(packed)) + MAGIC)
        self.file.close()
        return self.at


class ShardReader:
    """Reads a shard by its chunk index: whole, or any run of ids."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        n = struct.unpack("<Q", tail[:8])[0]
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, size - 16 - n))
        self.bits, self.block, blocks, docs = struct.unpack_from("<BQQQ", index)
        at = struct.calcsize("<BQQQ")

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.offsets, self.counts, self.sums, planes = take(blocks, "<u8"), take(blocks, "<u4"), take(blocks, "<u4"), take(blocks, "<u1")
        self.sizes = np.split(take(int(planes.sum()), "<u4"), np.cumsum(planes)[:-1]) if blocks else []
        self.doc_ids, self.nulls, self.n_ids = take(docs, "<i8"), take(docs, "<u1"), take(docs, "<u8")

    def read_block(self, k: int) -> np.ndarray:
        data, at, planes, unzip = self.file.read_at(int(self.sizes[k].sum()), int(self.offsets[k])), 0, [], zstandard.ZstdDecompressor()
        for n in self.sizes[k]:
            planes.append(unzip.decompress(data[at : at + int(n)]))
            at += int(n)
        ids = from_planes(planes, int(self.counts[k]), bool(self.bits))
        if zlib.crc32(ids.tobytes()) != int(self.sums[k]):
            raise ValueError(f"block {k}: checksum differs")
        return ids

    def read_range(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard; decodes only the blocks that hold them."""
        parts, k = [], start // self.block
        while n > 0 and k < len(self.counts):
            lo = start - k * self.block
            part = self.read_block(k)[lo : lo + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) in file order, a block at a time."""
        held, k, start = np.zeros(0, dtype="<u4"), 0, 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.n_ids.tolist(), strict=True):
            parts, need = [], n
            while True:
                parts.append(held[:need])
                held, need = held[need:], need - len(parts[-1])
                if not need:
                    break
                held, k = self.read_block(k), k + 1
            yield None if null else doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)
            start += n


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """A byte-level BPE tokenizer that encodes each different piece of a chunk of texts once.

    The pre-tokenizer never joins what stands before a single space, or before
    a single line end, with it. So a text cut at spaces and line ends is the
    ids of its pieces, end to end, where a piece keeps the space or line end in
    front of it. A piece of Latin letters with ASCII marks behind them is two
    words of the library's BPE model; other new pieces go through the whole
    tokenizer, many in one text, a line each. Texts with other runs of white
    space or with a special token go through it whole.
    """

    #: Where the split of white space depends on what stands beside it: runs of three, and pairs and ends other than line ends.
    SPACES = r"\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    RUNS = "[{0}]{{3}}|[{1}][{0}]|[{0}][{1}]|[{0}]{{2}}$|^[{1}]|[{1}]$".format(r"\s" + SPACES, r" \t\r\f" + SPACES)
    #: Latin letters, then ASCII marks other than the apostrophe: the split rule gives these two parts.
    SIMPLE = r"^(?P<line>\n?)(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
    LINES = 4096

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.letters, self.known = Tokenizer.from_str(model), _byte_letters(), {"": b""}
        kind = json.loads(model)
        byte_level = kind["normalizer"] is None and kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        line = self._library(["\n"])[0]
        self.by_piece, self.line = byte_level and kind["model"]["type"] == "BPE" and len(line) == 1, line[:1]
        self.model = self.tokenizer.model
        special = "|".join(re.escape(t["content"]) for t in kind["added_tokens"])
        self.whole = f"{self.RUNS}|{special}" if special else self.RUNS

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words that the pre-tokenizer does not split."""
        out = [self.known.get(w) for w in words]
        new = [k for k, ids in enumerate(out) if ids is None]
        spelled = "\n".join([words[k] for k in new]).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        for k, letters in zip(new, spelled, strict=False):
            out[k] = self.known[words[k]] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return out

    def _lines(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of each of ``words`` behind ``lead``; none has white space at its ends."""
        out = []
        for lo in range(0, len(words), self.LINES):
            part = words[lo : lo + self.LINES]
            ids = self._library([lead + ("\n" + lead).join(part)])[0]
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(part) - 1:
                raise ValueError("a piece of a text holds a line end")
            out += [x[bool(k) :].tobytes() for k, x in enumerate(np.split(ids, ends))]
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece with what stands in front of it; '' only stands for the start."""
        line, letters, marks = pc.extract_regex(pieces, self.SIMPLE).flatten()
        ended, lone = pc.equal(line, "\n"), pc.equal(letters, "")
        body = pc.if_else(lone, marks, letters)
        word = pc.if_else(pc.equal(body, ""), "", pc.binary_join_element_wise(pc.if_else(ended, "", " "), body, ""))
        parts = [pc.if_else(ended, self.line.tobytes(), b"").cast(pa.large_binary())]
        for part in (word, pc.if_else(lone, "", marks)):
            found = part.dictionary_encode()
            parts.append(pa.array(self._words(strings(found.dictionary)), pa.large_binary()).take(found.indices))
        own = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        odd = pc.is_null(own)
        rest = strings(pieces.filter(odd))
        if rest:
            ids = dict(zip([p for p in rest if p[0] != "\n"], self._lines([p for p in rest if p[0] != "\n"], " "), strict=True))
            ended = [p for p in rest if p[0] == "\n"]
            ids.update(zip(ended, [self.line.tobytes() + x for x in self._lines([p[1:] for p in ended], "")], strict=True))
            own = pc.replace_with_mask(own, odd, pa.array([ids[p] for p in rest], pa.large_binary()))
        return own

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (unsigned 32 bits, little-endian); null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self._library(texts.to_pylist())
        if len(self.known) > CACHE:
            self.known = {"": b""}
        whole = np.asarray(pc.match_substring_regex(texts, self.whole)).astype(bool)
        rest = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        # With a line end in front, the first word is a piece like any other; its id is cut off again.
        found, bounds = split_words(pc.replace_substring(pc.binary_join_element_wise("\n", rest, ""), "\n", " \n"))
        ids = self._pieces(found.dictionary).take(found.indices)
        at = np.frombuffer(ids.buffers()[1], dtype="<i8")[bounds] // 4
        flat = np.frombuffer(ids.buffers()[2], dtype="<u4")
        out = [flat[lo + 1 : hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if whole.any():
            rows = np.flatnonzero(whole)
            for k, x in zip(rows.tolist(), self._library(texts.take(pa.array(rows)).to_pylist()), strict=True):
                out[k] = x
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's encoder for a tokenizer's JSON text."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, bits: bool = False, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """Write the shards and return their manifest, a row for each shard. ``docs`` needs doc_id and text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size does not follow the data
    folder, end = scratch_path(spark, "token-shards"), struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in chunks(batches, 1):
            for doc, ids in zip(b.column(0).to_pylist(), encoder(model.value).encode_all(b.column(1)), strict=True):
                if out is None:
                    out = ShardWriter(unique_name(folder, f"-{TaskContext.get().partitionId():06d}.ids"), bits, block)
                out.add(doc, ids.tobytes() + end)
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [out.uri], "n_docs": [len(out.docs)], "n_ids": [out.n_ids], "n_bytes": [size]})

    # The start of the text splits the rows of a hot doc_id over partitions; what the driver samples stays short.
    order = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange(order, F.substring("text", 1, LEAD).asc_nulls_first()).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all shards before each one; it has a row for each write task, and their numbers follow the order."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """From the files of a manifest: doc_id, start, n_tokens and ids_crc32 for each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list = []
                for doc, start, ids in ShardReader(path).documents():
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, manifest.count())
    return with_starts(manifest).select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
