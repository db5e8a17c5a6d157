import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from notelake.llm import token_planes as t
from tests.llm.conftest import rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = t.Encoder(open(PATH, encoding="utf-8").read())


def plain(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [0, 1, 255, 50_256, 2**32 - 1])
def test_planes_round_trip(bits, top):
    ids = np.random.default_rng(top).integers(0, top + 1, 1003).astype("<u4")
    assert (t.from_planes(t.to_planes(ids, bits), len(ids), bits) == ids).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'s<>|1é日 ᠎"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(spark, docs, bits):
    manifest = t.write_tokens(docs, PATH, bits=bits, block=1000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in t.read_tokens(manifest).collect())
    want, start = [], 0
    for doc, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain(text or ""), 0]
        want.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    reader = t.ShardReader(t.with_starts(manifest).orderBy("start").first().path)
    whole = np.concatenate([ids for *_, ids in reader.documents()])
    assert (reader.read_range(1500, 2700) == whole[1500:4200]).all()


def test_empty_table(spark, empty):
    assert t.read_tokens(t.write_tokens(empty, PATH)).count() == 0
