import base64
import hashlib
import struct
from collections import Counter

import pytest

from notelake.llm import warc_zst as w

PAGES = "page_id long, url string, html string, digest string, payload string, newest long"
CASES = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" + "x" * i) for i in range(20)] + [(30 + i, "http://h/same", "<p>same</p>") for i in range(9)]
CASES += [(None, "a", "b"), (None, "a", "b"), (7, "q", "z"), (None, "q", "z"), (50, None, None), (51, "http://x\r\ny", ""), (52, "", "日本 é\r\n\r\n"), (53, "u", "y" * 300_000), (54, "t", "tie"), (54, "t", "tie")]


def expected():
    ids: dict = {}
    for page, _, html in CASES:
        ids.setdefault(html or "", []).append(page)
    out = Counter()
    for page, _, html in CASES:
        b, top = (html or "").encode(), max((x for x in ids[html or ""] if x is not None), default=None)
        head = (page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        first = page == top and not any(k[:3] == head for k in out)  # of rows that tie one is the response
        out[(*head, "response" if first else "revisit", None if first else top, None)] += 1
    return out


@pytest.mark.parametrize("size, sent", [(w.FILE_BYTES, w.MAX_SENT), (1, 0)])
def test_round_trip(spark, size, sent):
    pages = spark.createDataFrame([(*c, "d", "p", 1) for c in CASES], PAGES).repartition(3)
    manifest = w.write_archives(pages, file_bytes=size, max_sent=sent)
    records = w.read_archives(manifest).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in records) == expected()
    full = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response"}
    assert full[53] == b"y" * 300_000 and full[52].decode() == CASES[-4][2] if CASES[-4][0] == 52 else True
    ids = [line for r in manifest.collect() for _, d in w.frames(r.path) for line in d.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(CASES)
    for path in [r.path for r in manifest.collect()]:
        with w.open_input(path) as f:
            assert struct.unpack("<I", f.read(4))[0] == w.SKIPPABLE


def test_validation():
    good = w.record_bytes(5, "http://x", b"hello")
    assert w.parse_record(good)["problem"] is None
    for bad, problem in (
        (good[:-1], "block length differs"),
        (good.replace(b"hello", b"jello"), "payload digest differs"),
        (good.replace(b"Content-Length: 5\r", b"Content-Length: 6\r"), "payload length differs"),
        (good.replace(b"WARC/1.1", b"WORC/1.1"), "no WARC header"),
        (good.replace(b"WARC-Date: ", b"X-Date: "), "no warc-date"),
        (good.replace(b"WARC-Date: ", b"WARC-Type: "), "bad header line: WARC-Type: 2020-01-01T00:00:00Z"),
        (b"", "no WARC header"),
    ):
        assert w.parse_record(bad)["problem"] == problem


def test_damaged_archives(tmp_path):
    path = str(tmp_path / "a.warc.zst")
    out = w.ArchiveWriter(path, [b"x"])
    out.add(w.record_bytes(1, "u", b"p"))
    out.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    (tmp_path / "cut").write_bytes(data[:-3])
    (tmp_path / "plain").write_bytes(b"WARC/1.1\r\n")
    with pytest.raises(ValueError, match="cut short"):
        list(w.frames(str(tmp_path / "cut")))
    with pytest.raises(ValueError, match="no leading skippable frame"):
        list(w.frames(str(tmp_path / "plain")))
    assert [len(d) > 0 for _, d in w.frames(path, chunk=7)] == [True]


def test_empty_table(spark):
    assert w.read_archives(w.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "long enough"), (4, "v", "long enough")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in w.read_archives(w.write_archives(pages, min_revisit=5)).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
