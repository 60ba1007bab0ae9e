"""Packing: ids against the public tokenizer, gapless sequences, fill against the bound."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1é!'s \n\t 　\x1c.,漢😀")), max_size=40))
def test_ids_are_the_tokenizers(tokenizer, text):
    got = np.frombuffer(packing.token_bytes(text, RANKS), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins(lengths):
    bins, offsets, n = packing.best_two_fit(np.array(lengths, dtype=np.int64), 50)
    for b in range(n):
        at = sorted((o, x) for o, x, own in zip(offsets, lengths, bins) if own == b)
        assert [o for o, _ in at] == list(np.cumsum([0, *[x for _, x in at]])[:-1]) and sum(x for _, x in at) <= 50
    assert not lengths or n <= 2 * sum(lengths) / 50 + 1


def test_two_replace_one():
    # Greedy fills 60 and leaves 40; 30 gives way to 25 + 15.
    bins, _, n = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert n == 2 and bins[0] == bins[2] == bins[3] != bins[1]


def test_pack(spark, tokenizer):
    texts = [None, "", "one two", "x y " * 3000, "a " * 2047, "a" + " a" * 2046, "b" + " a" * 2047, "one two", "word\n\n two  x "]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, length int, offset string")
    df = df.union(df.where("doc_id = 2"))
    rows = packing.pack_documents(df, with_ids=True).collect()
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(docs[i], key=lambda r: r.piece)
        if i == 2:
            assert [r.ids for r in own] == [want, want]
            continue
        assert sum([r.ids for r in own], []) == want and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].length == len(want) - 2048 * (len(own) - 1)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0
