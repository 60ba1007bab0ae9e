"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample. The network
reads a window of bytes in both directions, labels every position, and a document's
probabilities are pooled from all positions of all its windows: their logarithms are
averaged, weighted by whether the position is part of a letter. Windows follow each
other without overlap and cover the whole text, in batches of equal length, so that
a long text costs what many short ones cost.

Gates use the hard sigmoid ``clip(0.25 x + 0.5, 0, 1)`` and the candidate state
``clip(x, -1, 1)``: the same network shape at a third of the cost of exponentials.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SAMPLE = 600  # texts of each language
SAMPLE_TOTAL = 64 * SAMPLE  # texts of all languages, at least one of each
LONGEST = 20_000  # characters of a text in the sample
HIDDEN = 8
WINDOW = 64
BATCH = 2048  # windows of a batch in scoring
STEPS = 500
TRAIN_BATCH = 128
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Weights; gates are stacked as update, reset, candidate. ``languages`` is empty if nothing was learnt."""

    languages: list[str]
    embed: tuple[np.ndarray, np.ndarray]  # forward and backward: (256, 3H), input and bias
    recur: tuple[np.ndarray, np.ndarray]  # (H, 3H)
    out: np.ndarray  # (2H + 1, L)


def _letter_bytes() -> np.ndarray:
    """Whether a byte can be part of a letter: A-Z, a-z, and all beyond ASCII."""
    b = np.arange(256)
    return ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)


LETTER_BYTES = _letter_bytes()


def _hard(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _scan(embed: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: bool = False):
    """Hidden states of a direction: x is (T, B) bytes in reading order; result (T, B, H)."""
    steps, batch = x.shape
    n = recur.shape[0]
    h = np.zeros((batch, n), np.float32)
    states = np.empty((steps, batch, n), np.float32)
    kept = []
    gates_in, cand_in = np.ascontiguousarray(embed[:, : 2 * n]), np.ascontiguousarray(embed[:, 2 * n :])
    u_gates, u_cand = np.ascontiguousarray(recur[:, : 2 * n]), np.ascontiguousarray(recur[:, 2 * n :])
    for t in range(steps):
        a = gates_in[x[t]]
        a += h @ u_gates
        zr = _hard(a)
        z, r = zr[:, :n], zr[:, n:]
        c = cand_in[x[t]]
        c += (r * h) @ u_cand
        np.clip(c, -1, 1, out=c)
        if keep:
            kept.append((h, z, r, c))
        # h' = h + z (c - h)
        step = c - h
        step *= z
        h = h + step
        states[t] = h
    return (states, kept) if keep else states


def _run(embed: np.ndarray, recur: np.ndarray, x: np.ndarray, head: np.ndarray, out: np.ndarray) -> None:
    """Add a direction's share to the scores ``out`` (T, L, B); x is (T, B) in reading order.

    The same steps as ``_scan`` with the windows along the last axis and all buffers
    made once: scoring keeps no states but the current one.
    """
    n, batch = recur.shape[0], x.shape[1]
    table, u_gates, u_cand = np.ascontiguousarray(embed.T), np.ascontiguousarray(recur[:, : 2 * n].T), np.ascontiguousarray(recur[:, 2 * n :].T)
    # The hard sigmoid's scale goes into the weights.
    table, u_gates, head = table.copy(), u_gates * np.float32(0.25), np.ascontiguousarray(head.T)
    table[: 2 * n] = table[: 2 * n] * np.float32(0.25) + np.float32(0.5)
    h, rh, share = np.zeros((n, batch), np.float32), np.empty((n, batch), np.float32), np.empty((head.shape[0], batch), np.float32)
    given, gates, cand = np.empty((3 * n, batch), np.float32), np.empty((2 * n, batch), np.float32), np.empty((n, batch), np.float32)
    for t in range(len(x)):
        np.take(table, x[t], axis=1, out=given, mode="clip")
        np.matmul(u_gates, h, out=gates)
        gates += given[: 2 * n]
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[n:], h, out=rh)
        np.matmul(u_cand, rh, out=cand)
        cand += given[2 * n :]
        np.clip(cand, -1, 1, out=cand)
        cand -= h
        cand *= gates[:n]
        h += cand
        np.matmul(head, h, out=share)
        out[t] += share


def _reverse(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of each column's own length turned round; padding stays at the end."""
    rows = np.arange(len(x)).reshape(-1, *[1] * (x.ndim - 1))
    at = length - 1 - rows
    return np.take_along_axis(x, np.where(at >= 0, at, rows), axis=0)


def position_logits(model: Model, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(T, L, B) scores of every position of windows x (T, B), each of its own length."""
    n, k = model.recur[0].shape[0], model.out.shape[1]
    full = bool((length == len(x)).all())
    out = np.empty((len(x), k, x.shape[1]), np.float32)
    out[:] = model.out[2 * n][None, :, None]
    _run(model.embed[0], model.recur[0], x, model.out[:n], out)
    back = np.zeros_like(out)
    _run(model.embed[1], model.recur[1], x[::-1] if full else _reverse(x, length), model.out[n : 2 * n], back)
    out += back[::-1] if full else _reverse(back, length)
    return out


def log_probabilities(logits: np.ndarray, axis: int = -1) -> np.ndarray:
    logits -= logits.max(axis=axis, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=axis, keepdims=True))
    return logits


def _init(languages: list[str], rng: np.random.Generator) -> list[np.ndarray]:
    n, k = HIDDEN, len(languages)
    parts = []
    for _ in range(2):
        parts += [rng.normal(0, 0.3, (256, 3 * n)).astype(np.float32), rng.normal(0, 0.3, (n, 3 * n)).astype(np.float32)]
    return [*parts, rng.normal(0, 0.1, (2 * n + 1, k)).astype(np.float32)]


def _back(embed, recur, x, kept, d_states):
    """Gradients of a direction, back through time."""
    n = recur.shape[0]
    d_embed, d_recur = np.zeros_like(embed), np.zeros_like(recur)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c = kept[t]
        d_h = d_h + d_states[t]
        d_z = d_h * (c - h) * ((z > 0) & (z < 1)) * np.float32(0.25)
        d_c = d_h * z * (np.abs(c) < 1)
        d_rh = d_c @ recur[:, 2 * n :].T
        d_r = d_rh * h * ((r > 0) & (r < 1)) * np.float32(0.25)
        d_a = np.concatenate([d_z, d_r], axis=1)
        np.add.at(d_embed, x[t], np.concatenate([d_a, d_c], axis=1))
        d_recur[:, : 2 * n] += h.T @ d_a
        d_recur[:, 2 * n :] += (r * h).T @ d_c
        d_h = d_h * (1 - z) + d_rh * r + d_a @ recur[:, : 2 * n].T
    return d_embed, d_recur


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Fit on texts by Adam; every batch holds random windows of all languages alike.

    Texts of fewer than 8 bytes say little and are left out, but for languages that have no
    others; a window repeats what is shorter than it.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    own = [[d for d, y in zip(data, labels) if y == lang and len(d)] for lang in languages]
    by = [[d for d in texts if len(d) >= 8] or texts for texts in own]
    languages, by = [x for x, d in zip(languages, by) if d], [d for d in by if d]
    if not languages:
        return Model([], (), (), np.zeros((0, 0)))
    w = _init(languages, rng)
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    n, k = HIDDEN, len(languages)
    for step in range(1, steps + 1):
        y = rng.integers(0, k, TRAIN_BATCH)
        x = np.zeros((WINDOW, TRAIN_BATCH), np.uint8)
        for j, lang in enumerate(y):
            d = by[lang][rng.integers(len(by[lang]))]
            a = rng.integers(0, max(1, len(d) - WINDOW + 1))
            part = d[a : a + WINDOW]
            x[:, j] = np.resize(part, WINDOW)
        model = Model(languages, (w[0], w[2]), (w[1], w[3]), w[4])
        f, kept_f = _scan(w[0], w[1], x, keep=True)
        b, kept_b = _scan(w[2], w[3], x[::-1], keep=True)
        states = np.concatenate([f, b[::-1], np.ones((*f.shape[:2], 1), np.float32)], axis=2)
        p = np.exp(log_probabilities(states @ model.out))
        d_logits = p
        d_logits[:, np.arange(TRAIN_BATCH), y] -= 1
        d_logits *= LETTER_BYTES[x][:, :, None]
        d_logits /= np.float32(TRAIN_BATCH * WINDOW)
        d_out = states.reshape(-1, 2 * n + 1).T @ d_logits.reshape(-1, k)
        d_states = d_logits @ model.out[: 2 * n].T
        g_f = _back(w[0], w[1], x, kept_f, d_states[:, :, :n])
        g_b = _back(w[2], w[3], x[::-1], kept_b, d_states[::-1, :, n:])
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((g**2).sum()) for g in (*g_f, *g_b, d_out)))
        for i, g in enumerate((*g_f, *g_b, d_out)):
            g = g / max(1.0, norm)
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, (w[0], w[2]), (w[1], w[3]), w[4])


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and probability of every text, from all its bytes."""
    known = [bool(t) and _LETTER.search(t) is not None and bool(model.languages) for t in texts]
    data = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, known)]
    k = len(model.languages)
    total = np.zeros((len(texts), max(1, k)))
    n_full = np.array([len(d) // WINDOW for d in data], np.int64)
    # Full windows of all texts, in one array; the rest of each text is a shorter window.
    full = np.frombuffer(b"".join(d[: n * WINDOW] for d, n in zip(data, n_full)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), n_full)
    rest = [(i, d[n * WINDOW :]) for i, (d, n) in enumerate(zip(data, n_full)) if len(d) % WINDOW]

    def pool(x: np.ndarray, length: np.ndarray, own: np.ndarray) -> None:
        logp = log_probabilities(position_logits(model, x, length), axis=1)
        weight = LETTER_BYTES[x] & (np.arange(len(x))[:, None] < length[None, :])
        sums = np.einsum("tlb,tb->lb", logp, weight.astype(np.float32))
        for c in range(k):
            total[:, c] += np.bincount(own, sums[c], len(texts))

    for a in range(0, len(full), BATCH):
        part = np.ascontiguousarray(full[a : a + BATCH].T)
        pool(part, np.full(part.shape[1], WINDOW), owner[a : a + BATCH])
    for a in range(0, len(rest), BATCH):
        some = rest[a : a + BATCH]
        x = np.zeros((WINDOW, len(some)), np.uint8)
        for j, (_, d) in enumerate(some):
            x[: len(d), j] = np.frombuffer(d, np.uint8)
        pool(x, np.array([len(d) for _, d in some]), np.array([i for i, _ in some]))

    letters = np.array([int(LETTER_BYTES[np.frombuffer(d, np.uint8)].sum()) for d in data])
    said, scores = [], []
    for i, ok in enumerate(known):
        if not ok:
            said.append(UNKNOWN)
            scores.append(0.0)
            continue
        # The mean over positions, sharpened by the square root of their number, at most 16.
        mean = total[i] / max(1, letters[i]) * min(16.0, np.sqrt(max(1, letters[i])))
        p = np.exp(mean - mean.max())
        best = int(np.argmax(p))
        said.append(model.languages[best])
        scores.append(float(p[best] / p.sum()))
    return said, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows outside the held-out third: ``sample`` of each language, chosen by a hash of the id.

    Every language is learnt; many share ``SAMPLE_TOTAL`` texts alike. Texts of up to
    ``LONGEST`` characters come first, longer ones are cut to that. Rows with a null
    language and a null or empty text are left out. Without such rows everything is ``und``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    rows = rows.where(F.length("_text") > 0)
    n_langs = rows.agg(F.count_distinct("_lang")).first()[0]
    sample = max(1, min(sample, SAMPLE_TOTAL // max(1, n_langs)))
    by_hash = Window.partitionBy("_lang").orderBy(F.col("_n") > LONGEST, F.xxhash64("_id"), "_id")
    picks = rows.select("_id", "_lang", F.length("_text").alias("_n")).withColumn("_rank", F.row_number().over(by_hash))
    picks = picks.where(F.col("_rank") <= sample).select("_id", "_lang").distinct()
    # At most SAMPLE_TOTAL ids, or one of each language.
    texts = rows.join(F.broadcast(picks), ["_id", "_lang"]).select("_id", F.substring("_text", 1, LONGEST), "_lang").collect()
    texts = sorted(map(tuple, texts), key=lambda r: (r[2], str(r[0]), r[1]))
    return train([r[1] for r in texts], [r[2] for r in texts])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` (string) and ``score`` (double, 0 to 1).

    Columns of those names are replaced. A null text, or one without a letter, is
    ``und`` with score 0. Only the text decides: equal texts get equal results.
    """
    docs = docs.drop("lang_pred", "score")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_col)
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few hundred texts at a time bound the arrays; the results don't depend on it.
            said, scores = [], []
            for a in range(0, batch.num_rows, 512):
                s, p = classify(batch.column(at).slice(a, 512).to_pylist(), model)
                said += s
                scores += p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, kinds[0]), pa.array(scores, kinds[1])], schema.names)

    return docs.mapInArrow(run, schema)
