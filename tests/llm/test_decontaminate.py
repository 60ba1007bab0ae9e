"""Decontamination: Hamming guarantee, brute force over all windows, edge rows."""

import re
from collections import Counter

import numpy as np

from quire.llm import decontaminate as dc
from quire.llm.hashing import ALNUM_BYTES, SPACE_BYTES, hash_words
from quire.plans.registry import QUERIES, table

SF = "/root/testdata/sf0.01"
DOC, ITEM = "doc_id long, text string, similarity int, item_id string", "item_id long, text string"


def test_words_hash_alike_anywhere():
    texts = ["é one two", "", "two  one\n", "x" * 300 + " one", "a,b"]
    w = hash_words([t.encode() for t in texts], SPACE_BYTES ^ True)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(w.first).tolist() == [len(s) for s in split]
    seen = {}
    for word, h in zip(sum(split, []), w.hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_all_within_radius_are_found():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 50, dtype=np.uint64)
    near = items.copy()
    for k in range(50):
        for b in rng.choice(64, dc.RADIUS, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    windows, found = dc.Table.of(5, items, np.arange(50)).search(near)
    assert set(zip(windows.tolist(), found.tolist())) >= {(k, k) for k in range(50)}
    assert all(int(near[w] ^ items[i]).bit_count() <= dc.RADIUS for w, i in zip(windows, found))


def shingle_weights(words):
    k = min(5, len(words))
    out = Counter()
    for i in range(len(words) - k + 1 if k else 0):
        out[tuple(words[i : i + k])] += sum(len(w.encode()) for w in words[i : i + k])
    return out


def brute(docs, items):
    norm = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    out = {}
    for d, t in docs:
        words = norm(t)
        for i, item in items:
            want = norm(item)
            w = shingle_weights(want)
            got = max((dc.weighted_jaccard(shingle_weights(words[a : a + len(want)]), w) for a in range(len(words)) if set(words[a : a + 5]) & set(want)), default=0)
            if want and got >= 0.8:
                out[d, i] = round(got, 9)
    return out


def test_against_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").where("doc_id < 60").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    passage = re.sub("^[^ ]+ ", "Changed ", items[3][1]).upper().replace(" ", " - ")
    docs += [(1000, f"before it {passage} and after"), (1001, items[5][1]), (1002, items[5][1][:60])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOC)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.find_items(df, spark.createDataFrame(items, ITEM)).collect()}
    assert got == brute(docs, items) and (1000, 3) in got and got[1001, 5] == 1.0 and (1002, 5) not in got


def test_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "Three words here"), (4, "Three words here"), (5, " ".join(f"w{i}" for i in range(600)))], ITEM)
    long = "filler text " * 30_000 + "three WORDS here. " + " ".join(f"w{i}" for i in range(600))
    texts = [None, "", "...", long, long, "three words here"]
    docs = spark.createDataFrame([(i, t, 0, "y") for i, t in enumerate(texts)], DOC)
    got = Counter((r.doc_id, r.item_id) for r in dc.find_items(docs, items).collect())
    assert got == {(3, 4): 2, (3, 5): 1, (4, 4): 2, (4, 5): 1, (5, 4): 2}
    assert dc.find_items(docs.limit(0), items).count() == 0 and dc.find_items(docs, items.limit(0)).count() == 0


def test_query_finds_verbatim_items(spark):
    import quire.llm.queries  # noqa: F401

    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, SF).collect()}
    assert got and got >= {(d, i) for d, t in docs for i, x in items if x in t}


def test_edited_items_against_brute_force():
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    items = [(i, " ".join(draw(n))) for i, n in enumerate([*[15] * 30, *[20] * 30, *[30] * 30, *[50] * 10])]
    docs = []
    for i, t in items:
        ws = t.split()
        at = int(rng.choice([0, 1, len(ws) - 1, int(rng.integers(len(ws)))]))
        ws[at : at + int(rng.integers(2))] = draw(1)
        docs.append((i, " ".join(draw(30) + ws + draw(int(rng.integers(30))))))
    index = dc.Index([t for _, t in items])
    words = hash_words([t.encode() for _, t in docs], ALNUM_BYTES)
    got = {(t, i): round(s, 9) for t, i, s, *_ in index.matches(words, 0.8)}
    want = brute(docs, items)
    assert len(want) > 40 and got == want


def edited(rng, n, k):
    """k items of n words, and documents that hold each with one to a few words changed, put in or taken out."""
    draw = lambda m: [f"w{i}" for i in rng.integers(0, 10**6, m)]
    items, docs = [], []
    for i in range(k):
        ws = draw(n)
        items.append((i, " ".join(ws)))
        for _ in range(int(rng.integers(1, 2 + n // 50))):
            at = int(rng.choice([0, 1, len(ws) - 1, int(rng.integers(len(ws)))]))
            ws[at : at + int(rng.integers(2))] = draw(int(rng.integers(2)))
        docs.append((i, " ".join(draw(int(rng.integers(30))) + ws + draw(int(rng.integers(30))))))
    return items, docs


def test_fingerprints_alone_find_nine_of_ten_at_every_length():
    rng = np.random.default_rng(6)
    for n in (6, 10, 15, 17, 20, 25, 30, 40, 50, 60, 100, 200, 400):
        items, docs = edited(rng, n, 100 if n < 100 else 30)
        index = dc.Index([t for _, t in items], by_shingles=False)
        got = {(t, i) for t, i, *_ in index.matches(hash_words([t.encode() for _, t in docs], ALNUM_BYTES), 0.8)}
        want = {(d, i) for (d, t), (i, item) in zip(docs, items) for _ in brute([(d, t)], [(i, item)])}
        assert len(want) >= 10 and len(got & want) >= 0.9 * len(want), (n, len(got & want), len(want))


def test_long_items_are_weighed_in_one_slide():
    rng = np.random.default_rng(7)
    items, docs = edited(rng, 300, 3)
    index = dc.Index([t for _, t in items])
    words = hash_words([t.encode() for _, t in docs], ALNUM_BYTES)
    assert {(t, i): round(s, 9) for t, i, s, *_ in index.matches(words, 0.8)} == brute(docs, items)
    # Repeated shingles, windows cut by the end of the text, gaps between windows.
    ws = [f"a{int(i)}" for i in rng.integers(0, 4, 400)]
    index = dc.Index([" ".join(ws[20:90])])
    n, want = index.items[0]
    words = hash_words([" ".join(ws).encode()], ALNUM_BYTES)
    ats = sorted({*range(30), 31, 200, 201, *range(320, 400)})
    sizes = words.end - words.start
    for at, m, got in index._weigh(0, ats, words.hashes, sizes, 400):
        assert m == min(n, 400 - at)
        assert abs(got - dc.weighted_jaccard(dc.weights(words.hashes[at : at + m], sizes[at : at + m]), want)) < 1e-12
