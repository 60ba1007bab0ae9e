"""The trie against plain Python, with containers that burst, and edge rows."""

import hashlib
import random
import zlib

import pytest

from quire.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, cid string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def plain(rows, rebuild=False):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    seqs = {c: tuple(x[2:] for x in sorted(own)) for c, own in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in seqs}
        seqs = {c: seqs.get(c // 100 * 100, ())[: h[c]] + s[h[c] :] for c, s in seqs.items()}
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own) if seqs[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, rebuild=False, **kw):
    seqs = turn_trie.turn_sequences(frame(spark, rows))
    got = turn_trie.prefix_trie(turn_trie.rebuilt(seqs) if rebuild else seqs, **kw)
    return sorted(map(tuple, got.collect()), key=str)


def mixed(seed, n=120):
    rng = random.Random(seed)
    words = ["", "a", "bé", "漢字漢", None]
    rows = []
    for c in [*range(n), 1000, 1001, 1099, 1150]:
        for t in range(rng.choice([0, 1, 2, 3, 3, 7])):
            rows.append((c, t, rng.choice(["u", None]), rng.choice(words)))
    return rows + [(5, None, "z", "first"), (5, 0, "u", "tie"), (5, 0, "u", "aa"), (5, 0, "t", "zz"), (None, 1, "u", "nobody"), (1150, 0, "u", "x")]


@pytest.mark.parametrize("burst", [1, 7, 4096])
def test_against_plain(spark, burst):
    rows = mixed(burst)
    assert run(spark, rows, rebuild=True, burst=burst) == plain(rows, rebuild=True)


def test_copies_and_long_heads(spark):
    # Copies are one sequence; the others share 40 turns, so one burst passes them all at once.
    head = [(t, "u", f"turn {t}") for t in range(40)]
    rows = [(c, *x) for c in range(300) for x in head] + [(c, *x) for c in range(300, 330) for x in head]
    rows += [(c, 40 + k, "a", f"{c} {k}") for c in range(300, 330) for k in range(2)] + [(900 + c, 0, "u", "other") for c in range(3)]
    seqs = turn_trie.distinct_sequences(turn_trie.turn_sequences(frame(spark, rows)))
    placed, heads = turn_trie.burst_containers(seqs, 5)
    assert len(heads) == 2 and sorted(h.first().deep for h in heads) == [0, 40] and placed.groupBy("cid").count().agg({"count": "max"}).first()[0] <= 5
    assert run(spark, rows, burst=5) == run(spark, rows) == plain(rows)


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "x")]) == []
    one = [(7, 3, None, None)]
    assert run(spark, one) == plain(one)
    # 7 has one turn, which its rebuilding drops or keeps; -250 belongs to -200 by the remainder's sign.
    assert run(spark, [(1, 0, "u", "x" * 200_000), (1, 0, "u", "x" * 200_000)], rebuild=True)[0][:2] == (1, 0)
    own = [(c, t, "u", "same") for c in (-200, -250, 3) for t in range(7)]
    got = run(spark, own, rebuild=True)
    assert {r[1]: r[3] for r in got}[0] == 3
    turnless = run(spark, [(c, 0, "u", "x") for c in range(1, 100)], rebuild=True)
    assert turnless[0][:2] == (1, 0) and turnless[0][3] == 99
    h = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6]
    ends = hashlib.sha256(",".join(map(str, h)).encode()).hexdigest()
    assert [r[7] for r in turnless if r[1] == 0] == [ends]


def test_many_equal_ids(spark):
    rows = [(c, 0, "u", "x") for c in range(9000)]
    assert run(spark, rows) == plain(rows)
