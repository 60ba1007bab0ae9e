"""Toxicity by compression distance: which of two zstandard dictionaries shortens the text more.

A window is a word behind a fixed passage that both dictionaries hold. Its two
compressed lengths, under the dictionary of toxic text and that of ordinary text,
differ by its gain in bytes. A document is judged by how many of its windows reach
each of some gains, weighed and calibrated on labelled documents that the
dictionaries have not seen. Equal windows have equal gains, so each Python worker
remembers them; whole texts are scored.

The toxic dictionary holds the words of toxic documents whose beginnings are far
more frequent there; the ordinary one holds the most frequent words of ordinary
documents and, in a few rounds, those of them that the toxic dictionary would
shorten most. Frequency counts distinct left neighbours of a word, so that copies
of a document count once.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` of each class for the
dictionaries and again for the weights, texts up to ``LONGEST`` characters), chosen
by a hash of the id. Its texts stay in tasks: the driver gets the dictionaries' words
and the features of the rows for the weights. Scoring covers every row.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.hashing import sliced
from quire.session import materialize

SAMPLE = 2000
LONGEST = 20_000
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 16_000, 60_000, 12_000
HARD_ROUNDS = 2
POOL = 20_000  # about so many ordinary words are tried for hard ones
STEMS = range(3, 9)
MIN_CONTEXTS, MIN_RATIO = 5, 15
GAINS = (1, 2, 3, 5)
THRESHOLD = 0.7
CACHED_WORDS = 250_000

_WORD = re.compile(r"[^\W\d_]+")
_CARRIER = b"0123456789abcdefghijklmnopqrstuvwxyz9876543210"
#: Stands before and after every word of a dictionary and a window, so that a match starts at the word's beginning.
_MARK = b"\x02\x03\x04"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) % 3 == 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibrated weights; ``weights`` is empty if nothing could be learnt."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes):
    import zstandard as zstd

    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=15, search_log=5, min_match=3, target_length=64,
        strategy=zstd.STRATEGY_BTOPT, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)


class Gains(dict):
    """Bytes that the toxic dictionary saves on a word against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        window = _CARRIER + _MARK + word.encode("utf-8", "replace") + _MARK
        gain = self[word] = len(self.ordinary(window)) - len(self.toxic(window))
        return gain


@functools.lru_cache(maxsize=2)
def _gains(toxic: bytes, ordinary: bytes) -> Gains:
    return Gains(toxic, ordinary)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(text: str | None, gains: Gains) -> list[float]:
    """Counts and shares of windows by gain, the largest gain and the length."""
    ws = words_of(text)
    got = np.fromiter(map(gains.__getitem__, ws), np.int64, len(ws))
    n = max(1, len(ws))
    out = [1.0, math.log1p(len(ws)), float(min(8, max(0, got.max(initial=0))))]
    for g in GAINS:
        k = int((got >= g).sum())
        out += [math.log1p(k), math.log1p(100 * k / n)]
    return out


def score(text: str | None, model: Model) -> float:
    if not model.weights:
        return 0.0
    z = float(np.dot(features(text, _gains(model.toxic, model.ordinary)), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _contexts(texts: list[str]) -> dict[str, set[str]]:
    seen: dict[str, set[str]] = defaultdict(set)
    for text in texts:
        ws = words_of(text)
        for before, word in zip(["", *ws], ws):
            seen[word].add(before)
    return seen


def _beginnings(seen: dict[str, set[str]]) -> Counter:
    """Contexts by beginning of word; whole words carry a space."""
    out: Counter = Counter()
    for word, before in seen.items():
        for k in STEMS:
            if len(word) >= k:
                out[word[:k]] += len(before)
        out[word + " "] += len(before)
    return out


def _content(words: list[str], most: int) -> bytes:
    """The first words that fit ``most`` bytes, the first one last: near content is cheapest to refer to."""
    held, size = [], 0
    for w in words:
        data = w.encode("utf-8", "replace")
        size += len(data) + len(_MARK)
        if size > most:
            break
        held.append(data)
    return _MARK.join([b"", *held[::-1], b""])


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The two dictionaries' contents from a few texts of either class; :func:`learnt_words` counts those of a table."""
    seen_t, seen_o = _contexts(toxic), _contexts(ordinary)
    count_t, count_o = _beginnings(seen_t), _beginnings(seen_o)
    total_t, total_o = max(1, sum(map(len, seen_t.values()))), max(1, sum(map(len, seen_o.values())))
    marked = {
        p for p, n in count_t.items()
        if n >= MIN_CONTEXTS and n / total_t > MIN_RATIO * (count_o[p] + 0.5) / total_o
    }
    by_count = lambda seen: sorted(seen, key=lambda w: (-len(seen[w]), w))
    lexicon = [w for w in by_count(seen_t) if w + " " in marked or any(w[:k] in marked for k in STEMS)]
    plain = [w for w in by_count(seen_o) if w not in set(lexicon)]
    return _contents(lexicon, plain, plain[:: max(1, len(plain) // POOL)])


def _contents(lexicon: list[str], plain: list[str], pool: list[str]) -> tuple[bytes, bytes]:
    """The dictionaries of words in their order; ``pool`` are the ordinary ones that hard words are sought among."""
    dict_t = _content(lexicon, TOXIC_BYTES) + _CARRIER
    common, hard = _content(plain, ORDINARY_BYTES), b""
    for _ in range(HARD_ROUNDS):
        gains = Gains(dict_t, common + hard + _CARRIER)
        gained = sorted((w for w in pool if gains[w] >= 1), key=lambda w: (-gains[w], w))
        hard += _content(gained, HARD_BYTES)
    return dict_t, common + hard + _CARRIER


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of texts (toxic, text) with their left neighbours, equal ones of a batch once."""
    names = ["toxic", "word", "before"]
    for batch in sliced(batches):
        found: set[tuple[bool, str, str]] = set()
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            ws = words_of(text)
            found.update((toxic, word, before) for before, word in zip(["", *ws], ws))
        columns = zip(*found) if found else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.bool_(), pa.string(), pa.string()))], names)


def learnt_words(texts: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Words for :func:`_contents` from rows (toxic, text): as many as fit the dictionaries, and the pool."""
    words = texts.select("toxic", "text").mapInArrow(_neighbours, "toxic boolean, word string, before string").distinct()
    words = materialize(words.groupBy("toxic", "word").agg(F.count("*").alias("n")))
    of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    totals = words.agg(of(True), of(False)).first()
    total_t, total_o = (max(1, n or 0) for n in totals)
    stems = F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[-1]), F.length("word")))
    stems = F.when(F.length("word") >= STEMS[0], F.transform(stems, lambda k: F.col("word").substr(F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    begun = words.select("*", F.explode(F.concat(stems, F.array(F.concat("word", F.lit(" "))))).alias("start"))
    marked = begun.groupBy("start").agg(of(True).alias("t"), of(False).alias("o"))
    marked = marked.where((F.col("t") >= MIN_CONTEXTS) & (F.col("t") / total_t > MIN_RATIO * (F.col("o") + 0.5) / total_o))
    lexicon = materialize(begun.where("toxic").join(marked, "start", "left_semi").select("word", "n").distinct())
    by_count = lambda some: some.orderBy(F.desc("n"), "word").select("word")
    # Each word takes a byte and its mark at least.
    fits = lambda most: most // (len(_MARK) + 1) + 1
    plain = by_count(words.where("not toxic").join(lexicon.select("word"), "word", "left_anti")).toArrow().column(0)
    first = [r.word for r in by_count(lexicon).limit(fits(TOXIC_BYTES)).collect()]
    return first, plain[: fits(ORDINARY_BYTES)].to_pylist(), plain.take(pa.array(range(0, len(plain), max(1, len(plain) // POOL)), pa.int64())).to_pylist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights whose best F1 on the rows is reached at a score of ``THRESHOLD``."""
    w = _logistic(x, y)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows outside the held-out third; see the module for the bounds.

    Repeated labels of an id count as toxic if one of them is; null labels are left
    out. Without rows of both classes the model scores 0 everywhere.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    part = (F.floor(fold(F.col("_id")) / 3) % 2).alias("_part")
    picks = None
    for y in (0, 1):
        for p in (0, 1):
            rows = known.select("_id", "_y", part).where((F.col("_y") == y) & (F.col("_part") == p))
            rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
            picks = rows if picks is None else picks.unionByName(rows)
    # At most 4 * sample ids.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= LONGEST)
    rows = materialize(texts.join(F.broadcast(picks), "_id").select("_id", "_text", (F.col("_y") == 1).alias("toxic"), "_part").distinct())
    if rows.groupBy("toxic", "_part").count().count() < 4:
        return Model(b"", b"", ())
    dict_t, dict_o = _contents(*learnt_words(rows.where("_part = 0").select("toxic", F.col("_text").alias("text"))))
    weighed = rows.where("_part = 1").orderBy(F.col("_id").cast("string"), "_text")
    weighed = weighed.select("toxic", "_text").mapInArrow(_features_pass(dict_t, dict_o), "toxic boolean, features array<double>").collect()
    x = np.array([r.features for r in weighed])
    y = np.array([float(r.toxic) for r in weighed])
    return Model(dict_t, dict_o, tuple(calibrate(x, y).tolist()))


def _features_pass(toxic: bytes, ordinary: bytes):
    """Rows (toxic, text) with the text's features in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [features(t.as_py(), _gains(toxic, ordinary)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["toxic", "features"])

    return run


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from a score of 0.7).

    Columns of those names are replaced. Null and empty texts, and texts without a
    letter, get the score of no words. Only the text decides: equal texts get equal
    scores.
    """
    docs = docs.drop("score", "predicted")
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_col)
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [score(t.as_py(), model) for t in batch.column(at)]
            said = [int(s >= THRESHOLD) for s in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kinds[0]), pa.array(said, kinds[1])], schema.names)

    return docs.mapInArrow(run, schema)
