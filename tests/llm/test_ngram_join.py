"""The n-gram join against all pairs, on chains, copies, frequent shingles and edge rows."""

import re

import numpy as np
import pytest

from quire.llm import ngram_join as nj
from quire.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_shingles string, key string"


def shingle_set(text, size=4):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, percent=85):
    ids = [i for i, _ in rows]
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            k = len(sets[x] & sets[y])
            if k and 100 * k >= percent * (len(sets[x]) + len(sets[y]) - k):
                root[find(x)] = find(y)
    least = {}
    for x, i in enumerate(ids):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(sets[x]), least[find(x)]) for x, i in enumerate(ids))


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    rows = []

    def put(ws):
        rows.append((len(rows), " ".join(ws)))

    common = list(rng.choice(words, 30))
    for n in (3, 5, 7, 9, 14, 25, 40, 45, 60, 120, 150, 300, 700):
        base = list(rng.choice(words, n))
        for _ in range(int(rng.integers(6, 16))):
            ws = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, n // 40)))):
                ws[int(rng.integers(len(ws)))] = str(rng.choice(words))
            if rng.random() < 0.3:
                ws += list(rng.choice(words, max(1, n // 25)))
            put(ws)
            if rng.random() < 0.2:
                put(w.upper() for w in ws)
        # A chain: each differs a little from the one before.
        for _ in range(8):
            base[int(rng.integers(len(base)))] = str(rng.choice(words))
            put(base)
        # Unlike documents around a passage that many share.
        for _ in range(6):
            put(common + list(rng.choice(words, n)))
    return rows


@pytest.mark.parametrize("seed,frequent", [(0, 64), (1, 4), (2, 2)])
def test_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    out = nj.similar_components(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_keys_meet_for_every_similar_pair():
    """The prefix claim itself: similar sets share an index key, whatever the frequencies."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(6, 700))
        pool = rng.choice(2**62, 2 * n + 60, replace=False).astype(np.uint64)
        x = np.sort(pool[:n])
        need = nj.need(n, 85)
        drop = int(rng.integers(0, n - need + 1))
        y = np.sort(np.concatenate([x[rng.permutation(n)[drop:]], pool[n : n + int(rng.integers(0, max(1, n - need - drop + 1)))]]))
        k = len(np.intersect1d(x, y))
        if 100 * k < 85 * (len(x) + len(y) - k):
            continue
        df = {}

        def keys(s):
            out = set()
            for b in nj.bands(len(s), 85):
                tokens, counted = nj.band_tokens(s, b, 85)
                other = set(nj.band_tokens(y if s is x else x, b, 85)[0].tolist()) if b in nj.bands(len(y if s is x else x), 85) else set()
                shared = []
                for t in tokens.tolist():
                    if t in other:
                        # Sometimes very frequent, sometimes rare; alike for both sets.
                        df.setdefault(t, int(rng.choice([2, 3, 100, 5000])))
                    elif rng.random() < 0.3:
                        df.setdefault(t, int(rng.choice([2, 90])))
                    if t in df:
                        shared.append((df[t], t))
                out |= set(nj.keys_of_set(len(s), b, counted, shared, 85))
            return out

        assert keys(x) & keys(y), (trial, n)


def test_edges(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, " \n\t "), (4, "one two"), (2, "ONE  two"), (8, "one two three"), (7, long), (6, long + " end"), (1, long)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows + [rows[3]]], SCHEMA)
    got = sorted(map(tuple, nj.similar_components(df).collect()))
    assert got == sorted([(5, 0, 5), (3, 0, 3), (9, 0, 9), (4, 1, 2), (4, 1, 2), (2, 1, 2), (8, 1, 8), (7, 59997, 1), (6, 59998, 1), (1, 59997, 1)])
    assert nj.similar_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, int(x)) for x in rng.integers(201, 300, 80)] + [(400, 400), (501, 500), (500, 501)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, **{b: 200 for a, b in links if a == 200}, 500: 500, 501: 500}
