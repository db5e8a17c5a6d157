"""Zstandard-compressed WARC archives: a dictionary in front, one frame per record.

An archive starts with a skippable frame that holds the dictionary, and every
record is a frame of its own, so any record can be decoded from its offset.
``write_archives`` aggregates the digests first. Only those that repeat are
joined back, and where they are few enough (they are counted) they are sent to
the tasks, so no payload is shuffled. Then each task streams its rows to files
of bounded size. ``read_archives`` loads the dictionary, decodes frame by frame
and checks headers, lengths and digests; what is wrong is told in ``problem``.

Defined results: a null html is an empty payload; of records with equal
payloads of at least ``min_revisit`` bytes one is the response and the others
revisit it: that with the largest page_id (null counts as less than any other),
of these that with the largest url, and of rows equal in all that any one;
payloads below ``min_revisit`` are all responses; a null url is left out of the
header; repeated rows are each written, under record ids of their own; an empty
table writes no archive; only page_id, url and html are read.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.sources.files import open_input, open_output, unique_name
from notelake.sources.scratch import materialize, scratch_path

SKIPPABLE = 0x184D2A5D
MIN_REVISIT = 0
#: Repeated digests that may be sent to every task.
MAX_SENT = 200_000
FILE_BYTES = 64 << 20
#: Payloads and bytes from the front of a file's rows that its dictionary is trained on.
TRAIN_ROWS, TRAIN_BYTES, DICT_BYTES = 200, 2 << 20, 32 << 10
_EOL = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, payload binary, problem string"


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str, own: str = "") -> str:
    """The response of a digest is named by it alone, so that revisits can refer to it; ``own`` tells others apart."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{own and ':' + own}>"


def _page_id(record_id: str) -> int | None:
    text = record_id.removeprefix("<urn:page:").split(":")[0]
    return int(text) if text else None


def _quoted(url: str) -> str:
    """A URL on one header line."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisits: bool = False, response_id: int | None = None, own: str = "") -> bytes:
    """One WARC record; a revisit of the page ``response_id`` has the HTTP header without the payload."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, own)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    if revisits:
        head += [f"WARC-Refers-To: {_record_id(response_id, digest)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _EOL * 2 + block + _EOL * 2


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b"WARC/1.1")[-DICT_BYTES:].ljust(8, b"\n")


class ArchiveWriter:
    """Writes one .warc.zst file."""

    def __init__(self, uri: str, samples: list[bytes]):
        self.uri, self.file, self.n = uri, open_output(uri), 0
        words = make_dictionary(samples)
        self.zip = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
        self.at = self.file.write(struct.pack("<II", SKIPPABLE, len(words)) + words)

    def add(self, record: bytes) -> None:
        self.at += self.file.write(self.zip.compress(record))
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        return self.uri, self.n, self.at


def frames(uri: str, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each frame behind the dictionary; reads ``chunk`` bytes at a time."""
    with open_input(uri) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no leading skippable frame")
        words = f.read(size)
        if len(words) < size:
            raise ValueError(f"{uri}: the dictionary is cut short")
        if words[:4] == zstandard.FRAME_HEADER:  # a dictionary may itself be compressed
            words = zstandard.ZstdDecompressor().decompress(words)
        unzip, at, data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), 8 + size, f.read(chunk)
        while data:
            frame, parts, start = unzip.decompressobj(), [], at
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    rest = frame.unused_data
                    at += len(data) - len(rest)
                    data = rest or f.read(chunk)
                    break
                at += len(data)
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{uri}: the frame at {start} is cut short")
            yield start, b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of a record and, in ``problem``, the first rule it breaks (null if none)."""
    out = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"))
    head, gap, rest = data.partition(_EOL * 2)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"problem": "no WARC header"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            return out | {"problem": f"bad header line: {line[:40]}"}
        fields[name.lower()] = value.strip()
    needed = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if n not in fields]
    if needed:
        return out | {"problem": f"no {needed[0]}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != _EOL * 2:
        return out | {"problem": "block length differs"}
    http, gap, payload = rest[:-4].partition(_EOL * 2)
    sizes = [x.split(b":")[1].strip() for x in http.split(_EOL)[1:] if x.lower().startswith(b"content-length:")]
    if not gap or not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        return out | {"problem": "bad HTTP header"}
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    out |= {"page_id": _page_id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(sizes[0]), "payload_digest": digest, "record_type": kind}
    if kind == "revisit":
        if "warc-refers-to" not in fields or payload:
            return out | {"problem": "bad revisit"}
        return out | {"refers_to": _page_id(fields["warc-refers-to"])}
    if len(payload) != int(sizes[0]):
        return out | {"problem": "payload length differs"}
    return out | {"payload": payload, "problem": None if base32_sha1(payload) == digest else "payload digest differs"}


def _planned(rows: DataFrame, min_revisit: int, max_sent: int) -> DataFrame:
    """page_id, url, payload, revisits, response_id and named (whether the record is the response that others may refer to)."""
    keyed = rows.withColumn("digest", F.sha1("payload"))
    per = keyed.where(F.length("payload") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.struct(F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("known"))).alias("top"))
    repeated = per.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", F.col("n").alias("ties"), "top")).alias("best")).where("n > 1")
    repeated = materialize(repeated.select("digest", F.col("best.page_id").alias("newest"), F.col("best.ties").alias("ties"), F.col("best.top").alias("top")), "warc-repeated")
    sent = F.broadcast(repeated) if repeated.count() <= max_sent else repeated
    joined = keyed.join(sent, "digest", "left").withColumn("first", F.col("ties").isNotNull() & F.col("page_id").eqNullSafe(F.col("newest")))
    repeats = F.col("ties").isNotNull() & ~F.col("first")
    plain = joined.where(~F.col("first") | (F.col("ties") == 1)).select("page_id", "url", "payload", repeats.alias("revisits"), F.when(repeats, F.col("newest")).alias("response_id"), ((F.length("payload") >= min_revisit) & ~repeats).alias("named"))
    if repeated.where("ties > 1").isEmpty():
        return plain
    # Rows that tie for the response: equal ones are counted before they are numbered.
    tied = joined.where(F.col("first") & (F.col("ties") > 1)).groupBy("page_id", "url", "digest", "top").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    best = F.struct(F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("known")) == F.col("top")
    copies = tied.select("page_id", "url", "payload", best.alias("best"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    chosen = F.col("best") & (F.col("copy") == 1)
    return plain.unionByName(copies.select("page_id", "url", "payload", (~chosen).alias("revisits"), F.when(~chosen, F.col("page_id")).alias("response_id"), chosen.alias("named")))


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, max_sent: int = MAX_SENT) -> DataFrame:
    """Write the archives and return their manifest: path, n_records, n_bytes."""
    folder = scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    planned = _planned(rows, min_revisit, max_sent)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, front, held, own, n = None, [], 0, uuid.uuid4().hex[:16], 0

        def opened() -> ArchiveWriter:
            new = ArchiveWriter(unique_name(folder, ".warc.zst"), front)
            for r in front:
                new.add(r)
            return new

        for b in batches:
            for *row, named in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += 1
                record = record_bytes(*row, own="" if named else f"{own}-{n}")
                if out is None:
                    front.append(record)
                    held += len(record)
                    if len(front) >= TRAIN_ROWS or held >= TRAIN_BYTES:
                        out, front, held = opened(), [], 0
                else:
                    out.add(record)
                if out and out.at >= file_bytes:
                    yield _manifest(out)
                    out = None
        if front:
            out = opened()
        if out:
            yield _manifest(out)

    return materialize(planned.mapInArrow(write, MANIFEST), "warc-manifest")


def _manifest(out: ArchiveWriter) -> pa.RecordBatch:
    path, n, size = out.close()
    return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the manifest's archives (see ``RECORD``); a file is one task. ``payloads`` false leaves the payload out after checking it."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    types = dict(page_id=pa.int64(), url=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), offset=pa.int64(), payload=pa.binary(), problem=pa.string())

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for offset, data in frames(path):
                    r = parse_record(data) | {"offset": offset}
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 5000 or held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)
