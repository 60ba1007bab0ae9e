"""Language identification: gradients, whole texts, held-out accuracy and edge rows."""

import numpy as np
import pytest

from quire.llm import language as lg
from quire.plans.registry import QUERIES, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    en = ["the quick brown fox jumps over the lazy dog and then sleeps " * 3, "this is what they have thought about the weather"] * 4
    de = ["der schnelle braune fuchs springt über den faulen hund " * 3, "das ist nicht was ich über das wetter gedacht habe"] * 4
    return lg.train(en + de, ["en"] * 8 + ["de"] * 8, steps=80)


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    embed, recur = rng.normal(0, 0.3, (256, 24)), rng.normal(0, 0.3, (8, 24))
    x = rng.integers(97, 101, (6, 3))
    goal = rng.normal(size=(6, 3, 8))
    loss = lambda: float((lg._scan(embed, recur, x).astype(np.float64) * goal).sum())
    _, kept = lg._scan(embed, recur, x, keep=True)
    d_embed, d_recur = lg._back(embed, recur, x, kept, goal)
    for grad, w in ((d_embed, embed), (d_recur, recur)):
        for i in [(97, 3), (98, 12), (99, 20)] if w is embed else [(0, 1), (3, 11), (5, 22)]:
            old, e = w[i], 1e-3
            w[i] = old + e
            up = loss()
            w[i] = old - e
            down = loss()
            w[i] = old
            assert grad[i] == pytest.approx((up - down) / 2 / e, rel=0.05, abs=0.01)


def test_scoring_runs_the_trained_network(model):
    data = np.frombuffer("über das wetter gedacht ".encode() * 4, np.uint8)[: 3 * 21].reshape(3, 21).T.copy()
    length = np.array([21, 13, 1])
    got = lg.position_logits(model, data, length)
    for j, n in enumerate(length):
        x = data[:n, j : j + 1]
        f = lg._scan(model.embed[0], model.recur[0], x)
        b = lg._scan(model.embed[1], model.recur[1], x[::-1])[::-1]
        want = np.concatenate([f, b, np.ones((n, 1, 1), np.float32)], axis=2) @ model.out
        assert np.allclose(got[:n, :, j], want[:, 0], atol=1e-4)


def test_edges(spark, model):
    texts = [None, "", "123 456", "the dog thought about the weather", "ich habe den hund nicht", "the fox " * 20_000, "x"]
    df = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(texts * 2)], "doc_id long, text string, lang_pred string, score double")
    rows = lg.identify(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:6]] == ["und", "und", "und", "en", "de", "en"]
    assert [(r.lang_pred, r.score) for r in rows[:7]] == [(r.lang_pred, r.score) for r in rows[7:]]
    assert all(0 <= r.score <= 1 for r in rows)
    assert lg.identify(df.limit(0), model).count() == 0
    empty = lg.fit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in lg.identify(df, empty).collect()] == ["und"] * 14


def test_query_on_held_out_rows(spark):
    import quire.llm.queries  # noqa: F401

    got = QUERIES["op9_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_every_language_is_learnt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lg, "train", lambda texts, labels: seen.append((texts, labels)))
    rows = [(i, f"text {i}" if i % 100 else "long " * 9000, f"l{i % 100}") for i in range(1000)]
    lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts, labels = seen[0]
    assert set(labels) == {f"l{i}" for i in range(100)} and max(map(len, texts)) <= lg.LONGEST
    assert max(labels.count(x) for x in set(labels)) <= lg.SAMPLE


def test_a_language_of_short_texts_is_learnt(spark):
    texts = ["the weather is what they have thought about"] * 8 + ["кот", "дом", "лес"] * 3 + ["", ""]
    labels = ["en"] * 8 + ["ru"] * 9 + ["xx"] * 2
    model = lg.train(texts, labels, steps=80)
    assert model.languages == ["en", "ru"]
    df = spark.createDataFrame([(0, "лес и дом"), (1, "thought about the weather"), (2, "кот")], "doc_id long, text string")
    assert [r.lang_pred for r in lg.identify(df, model).orderBy("doc_id").collect()] == ["ru", "en", "ru"]
