"""Line dedup against plain Python, its runs and their plans, and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, _lost int, h string"
TRIM = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(TRIM))


def plain(rows, min_chars, min_docs):
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    holders = {k: v - {None} for k, v in holders.items()}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 3, "h") for i, t in rows], SCHEMA)
    got = line_dedup.drop_repeated_lines(df, **kw)
    assert got.columns == ["doc_id", "text", "_lost", "h", "n_lines", "n_dropped", "kept_text"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (4, 3)])
def test_against_plain(spark, batches, fanout):
    rng = random.Random(batches)
    words = ["ab", "É", "Aé", "漢字", "x\ty", "\x0b", " "]
    pool = ["".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(60)]
    texts = ["\n".join(rng.choice(pool).swapcase() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(150)]
    rows = [*enumerate([*texts, None, "", "\n\n"]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (None, texts[0])]
    got = run(spark, rows, min_chars=3, min_docs=4, batches=batches, fanout=fanout)
    assert got == plain(rows, 3, 4) and any(r[2] for r in got)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, 1, 0, "")]
    line = "A line that is more than forty characters long."
    rows = [(i, f" {line.upper()}\t\nown {i}") for i in range(4)]
    assert all(r[2] == 0 for r in run(spark, rows))
    rows.append((9, line + "\n" + line))
    got = run(spark, rows)
    assert [r[1:] for r in got] == [*[(2, 1, f"own {i}") for i in range(4)], (2, 0, line + "\n" + line)]
    # 39 code points of two bytes each are too few, 40 are enough.
    short = [(i, "é" * 39 + "\n" + "é" * 40) for i in range(5)]
    assert [r[2] for r in run(spark, short)] == [1, 1, 1, 1, 0]
    # One very long text, each of its lines lost.
    many = [f"line number {k} of a very long text, {'x' * 20}" for k in range(20_000)]
    got = run(spark, [(i, "\n".join(many)) for i in range(5)] + [(5, "x" * 500_000)])
    assert [(r[1], r[2]) for r in got] == [(20_000, 20_000)] * 4 + [(20_000, 0), (1, 0)]


def test_runs_meet_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, fanout=3)
        batch = lambda a, b: spark.range(a, b).select(F.col("id").alias("h"), F.col("id").alias("g"), F.lit(2).cast("long").alias("n"), (100 - F.col("id")).alias("last"))
        assert runs.add(batch(0, 50)).count() == 50
        fresh = runs.add(batch(30, 60))
        assert sorted(r.h for r in fresh.collect()) == list(range(50, 60))
        anti = runs.firsts[0][1].df.join(runs.firsts[0][0].df, ["h", "g"], "left_anti")
        assert "Exchange" not in anti._jdf.queryExecution().executedPlan().toString()
        merged = runs._merged(runs.firsts[0], "keeper")
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert runs.add(batch(0, 60)).count() == 0
        assert [len(level) for level in runs.firsts] == [0, 1]
        assert runs.frequent(5).count() == 20 and runs.frequent(4).count() == 60 and runs.frequent(4).where("keeper = 100 - h").count() == 60
        runs.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
