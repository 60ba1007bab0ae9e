"""Toxicity: dictionaries, calibration, held-out rows and edge rows."""

import zlib

from quire.llm import toxicity as tx
from quire.plans.registry import QUERIES, table

SF = "/root/testdata/sf0.1"


def test_dictionary_words_gain():
    # Invented words of three syllables; toxic texts differ by one stem with many endings.
    parts = ["ba", "ne", "ti", "lo", "mur", "sen", "kal", "vi"]
    vocabulary = [a + b + c for a in parts for b in parts for c in parts]
    plain = [" ".join(vocabulary[i % 512] for i in range(s, s + 300 * 7, 7)) for s in range(40)]
    toxic = [p.replace("ti", "ti zorkle") for p in plain[:20]] + [f"{w} zorkl{w[:2]} {w}" for w in vocabulary[:60]]
    gains = tx.Gains(*tx.dictionaries(toxic, plain))
    assert gains["zorkle"] > 2 and gains["zorkleish"] > 2
    assert sum(gains[w] >= 2 for w in vocabulary) <= 2


def test_edges(spark):
    schema = "doc_id long, text string, score double, predicted string"
    texts = [None, "", "12 !!", "word", "long " * 50_000, "word"]
    docs = spark.createDataFrame([(i, t, 2.0, "p") for i, t in enumerate(texts)], schema)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert model.weights == ()
    assert [(r.score, r.predicted) for r in tx.score_documents(docs, model).collect()] == [(0.0, 0)] * 6
    model = tx.Model(*tx.dictionaries(["zorkle a", "b zorkle"] * 3, ["word c"]), (0.1,) * 11)
    rows = tx.score_documents(docs, model).collect()
    assert rows[0].score == rows[1].score == rows[2].score and rows[3].score == rows[5].score
    assert tx.score_documents(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    import quire.llm.queries  # noqa: F401

    got = QUERIES["op4_toxicity"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 10_000
    rows = got.join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits / sum(r.predicted for r in held) > 0.9 and hits / sum(r.toxic for r in held) > 0.7


def test_fit_keeps_texts_in_tasks(spark, monkeypatch):
    parts = ["ba", "ne", "ti", "lo", "mur", "sen", "kal", "vi"]
    vocabulary = [a + b + c for a in parts for b in parts for c in parts]
    plain = [" ".join(vocabulary[i % 512] for i in range(s, s + 60 * 7, 7)) for s in range(60)]
    toxic = [p.replace("ti", "ti Zorkle") + f" zorkl{k} ÄÖ" for k, p in enumerate(plain)]
    rows = [(i, t, int(i >= 60)) for i, t in enumerate([*plain, *toxic])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[5][:2]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    # The words of the table are those of the texts in memory.
    texts = spark.createDataFrame([(bool(y), t) for _, t, y in rows], "toxic boolean, text string")
    assert tx._contents(*tx.learnt_words(texts)) == tx.dictionaries(toxic, plain)

    brought = []
    frame = type(docs)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: brought.append(collect(self)) or brought[-1])
    model = tx.fit(docs, labels)
    assert len(model.weights) == 11 and tx.score(toxic[0], model) > tx.score(plain[0], model)
    assert not {t for _, t, _ in rows} & {v for got in brought for r in got for v in r if isinstance(v, str)}
