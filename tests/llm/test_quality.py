"""Line-first cleaning against plain Python, and edge rows."""

import random
import re

from quire.llm import quality

SCHEMA = "doc_id long, text string, n_words string, kept int, extra string"


def plain(text, window=5):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + window)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3, "e") for i, t in enumerate(texts)], SCHEMA)
    rows = quality.clean_lines(df).orderBy("doc_id").collect()
    return rows


def test_counts(spark):
    rng = random.Random(0)
    words = ["a", "bé", "c.", "#d", "e|", "漢字"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n", "\n\n", "\x0b", "\r"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [None, "", " \n ", "one", "x " * 40, "line one here.\nline one here.\n line one here."]
    rows = run(spark, texts)
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [plain(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert rows[0].extra == "e" and "kept" in rows[0]


def test_lines(spark):
    good = "This is a plain sentence of some length, and it ends well."
    bad = ["Home | News | Sport | About", "BUY!! NOW!! CHEAP!! PILLS!!", "Please accept cookies to go on with this site.", " ".join(f"w{i}" for i in range(30))]
    rows = run(spark, [good + " " + good.upper(), *[good + "\n" + b for b in bad], *[b + " more" * 3 + " one two three four five six" for b in bad[:3]]])
    assert [r.cleaned for r in rows[1:5]] == [good] * 4 and [r.n_failed_lines for r in rows[:5]] == [0, 1, 1, 1, 1]
    assert [r.kept for r in rows] == [True, True, True, True, False, False, False, False]


def test_edges(spark):
    rows = run(spark, [None, "", "word " * 50_000, "x" * 300_000, "word " * 50_000])
    assert [(r.base_failed, r.kept, r.cleaned) for r in rows[:2]] == [(True, False, "")] * 2
    assert rows[2][:1] != rows[4][:1] and rows[2][5:] == rows[4][5:] and rows[2].n_repeat_words == 50_000 and rows[3].n_words == 1
    assert run(spark, []) == []
