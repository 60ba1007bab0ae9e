"""Whitening of embeddings by a covariance weighted with multiplicities.

Entries become whole numbers on a grid, so equal vectors meet exactly. Identical
vectors are grouped and everything after works on the distinct ones: exact sums, a
centred matrix product per task, summed by Spark, one eigenproblem of the dimension's
size, and the projections. The rows then get the results of their vector by a join.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize

#: Entries beyond this on the grid fit no long after the shift.
LARGEST = 2.0**62
#: Fewer vectors than this can hold such a share of all rows each; only they are broadcast.
HOT_SHARE = 1000
#: A component counts if its variance is more than this part of the largest one.
LEAST_SHARE = 1e-13


def on_grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of every entry, as longs; null for vectors that hold no such number."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    ok = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * F.lit(float(scale)) < F.lit(LARGEST), F.lit(False)))
    # Not a number is greater than every number in this comparison.
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(scaled, lambda c: c.cast("long") + F.lit(shift)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit where nothing can overflow, whole Python numbers otherwise."""
    big = max([n * int(np.abs(x).max(initial=0)), *map(abs, sums)])
    if big < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row; null where one fits no long."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _sums(distinct: DataFrame, weight: Column) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            x, w = _matrix(b.column(0)), np.asarray(b.column(1))
            bound = int(np.abs(x).max(initial=0)) * int(w.sum())
            part = (w[:, None] * x).sum(axis=0) if bound < 2**62 else (w[:, None].astype(object) * x).sum(axis=0)
            row = [int(w.sum()), *map(int, part)]
            total = [a + c for a, c in zip(total, row)] if total else row
        numbers = [decimal.Decimal(v) for v in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(numbers, pa.decimal128(38, 0))], ["i", "s"])

    parts = distinct.select("x", weight.cast("long").alias("w")).mapInArrow(run, "i int, s decimal(38,0)")
    rows = dict(parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)")).collect())
    n, *sums = [int(rows[i]) for i in range(len(rows))]
    return n, sums


def _gram(vectors: DataFrame, dims: int, centre) -> np.ndarray:
    """Weighted sum of outer products of the centred vectors: one product a batch, summed by cell.

    ``vectors`` has the vector and its weight ``w``; ``centre`` centres a matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                d = centre(_matrix(b.column(0)))
                total += d.T @ (np.asarray(b.column(1))[:, None] * d)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    cells = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dims, dims))
    for i, j, v in cells:
        out[i, j] = out[j, i] = v
    return out


@dataclass
class Whitening:
    """A fit: weight ``n``, exact sums, unit components in columns, their variances and shares of all variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def apply(self, distinct: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of the distinct vectors with ``deviation`` and ``whitened`` (one number a component)."""
        n, sums, scaled = self.n, self.sums, self.axes / np.sqrt(self.variances)
        schema = T.StructType([
            *[distinct.schema[c] for c in columns],
            T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = deviations(_matrix(b.column("x")), n, sums)
                y = (d.astype(np.float64) / n) @ scaled
                ends = pa.array(np.arange(len(y) + 1) * scaled.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))
                arrays = [*[b.column(c) for c in columns], pa.array(_squares(d), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "deviation", "whitened"])

        return distinct.select(*columns).mapInArrow(run, schema)


def fit(distinct: DataFrame, weight: Column, components: int = 16) -> Whitening:
    """Fit on distinct vectors ``x`` of one length, each counted ``weight`` times."""
    n, sums = _sums(distinct, weight)

    def centre(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, sums).astype(np.float64) / n

    vectors = distinct.select("x", weight.cast("double").alias("w"))
    covariance = _gram(vectors, len(sums), centre) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[:1].max(initial=0), 0) * LEAST_SHARE).sum())
    trace = np.trace(covariance)
    return Whitening(n, sums, axes[:, :kept], values[:kept], values[:kept] / trace if kept else values[:0])


def identity_error(whitened: DataFrame, weight: Column, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    dims = model.axes.shape[1]
    pairs = whitened.select("whitened", weight.cast("double").alias("w"))
    means = {i: m for i, m in pairs.select("w", F.posexplode("whitened")).groupBy("pos").agg(F.sum(F.col("w") * F.col("col"))).collect()}
    mean = np.array([means[i] for i in range(dims)]) / model.n
    covariance = _gram(pairs, dims, lambda y: y - mean) / model.n
    return float(np.abs(covariance - np.eye(dims)).max(initial=0))


def whiten(
    rows: DataFrame, vector_col: str = "embedding", keys: tuple[str, ...] = ("vec_id",), components: int = 16,
    by_count: bool = False, scale: int = 64, shift: int = 1_000_000,
) -> DataFrame:
    """``keys`` of every row with a usable vector, and per component: component (from 1), n, deviation,
    whitened, explained, identity_error.

    Rows are dropped whose vector is null or holds null or non-finite entries, or numbers
    that fit no long on the grid. The fit list is each distinct vector once, or as often
    as it occurs with ``by_count``; ``n`` is its size. ``deviation`` is null where the exact
    number fits no long. Components without variance are not returned: all vectors equal
    (one row too) or of length 0 give no row. Vectors of other lengths are fitted by
    themselves, one fit a length. Repeated rows stay repeated; an empty table gives an
    empty one. Other columns are not carried.
    """
    spark = rows.sparkSession
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], on_grid(F.col(vector_col), scale, shift).alias("x"))
    named = named.where(F.size("x") > 0)
    distinct = materialize(named.groupBy("x").agg(F.count("*").alias("count")))
    lengths = sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect())
    weight = F.col("count") if by_count else F.lit(1)
    facts, results = [], []
    for size in lengths:
        own = distinct.where(F.size("x") == size)
        model = fit(own, weight, components)
        if not len(model.variances):
            continue
        done = materialize(model.apply(own, ["x", "count"]))
        error = identity_error(done, weight, model)
        facts.append((size, model.n, [float(v) for v in model.explained], error))
        results.append(done)
    out_keys = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    if not results:
        results = [distinct.limit(0).select("x", "count", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))]
    all_done = results[0]
    for more in results[1:]:
        all_done = all_done.unionByName(more)
    # Vectors of very many rows are dealt over several tasks, and their results copied to each.
    total = distinct.agg(F.sum("count")).first()[0] or 0
    copies = F.ceil(F.col("count") / F.lit(max(1, total // HOT_SHARE))).cast("int")
    dealt = all_done.select("x", "deviation", "whitened", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt"))
    hot = F.broadcast(distinct.select("x", copies.alias("_copies")).where("_copies > 1"))
    salt = F.pmod(F.xxhash64(*[c for c in named.columns if c != "x"]), F.coalesce("_copies", F.lit(1))).cast("int")
    joined = named.join(hot, "x", "left").withColumn("_salt", salt).join(dealt, ["x", "_salt"])
    fact = F.broadcast(spark.createDataFrame(facts, "size int, n long, _explained array<double>, identity_error double"))
    each = joined.join(fact, F.size("x") == F.col("size")).select(
        *named.columns, "n", "deviation", "_explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        *out_keys, (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("_explained", "_at").alias("explained"), "identity_error",
    )
