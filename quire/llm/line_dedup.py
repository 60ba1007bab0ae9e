"""Repeated lines, found by levelled sorted runs of line hashes; functions only.

Documents come in batches from the largest ids down. A run holds the line keys of
one batch, dealt and sorted by their 128-bit hash; a new batch is merge-anti-joined
with the runs, so what it meets for the first time is kept by the largest document
of that very batch. Runs of a level are merged into one of the next as soon as
there are ``fanout`` of them. All runs are bucketed alike: merging and anti-joining
moves no row between tasks.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import BucketedTable, materialize

HASH = ["h", "g"]
#: At most so many keys can hold a thousandth of all key occurrences each; only they are broadcast.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashed(placed: DataFrame, min_chars: int) -> DataFrame:
    """Rows with a ``_line`` of at least ``min_chars`` code points: its hash ``h, g`` instead."""
    keyed = placed.withColumn("_line", line_key(F.col("_line"))).where(F.length("_line") >= min_chars)
    return keyed.select(
        *[c for c in placed.columns if c != "_line"],
        F.xxhash64("_line").alias("h"), F.xxhash64(F.lit(1), F.col("_line")).alias("g"),
    )


class LineRuns:
    """Runs by level: counts of documents (``h, g, n``) and first holders (``h, g, keeper``).

    ``add`` takes a batch of ``h, g, n, last``; a batch holds whole documents, none of
    an earlier batch, and its ids are smaller than those of all earlier batches.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.counts: list[list[BucketedTable]] = []
        self.firsts: list[list[BucketedTable]] = []
        self.stale: list[BucketedTable] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch as a run of its own; the keys that no run had, with their holder.

        The result can be read until the next batch is added.
        """
        self._clear()
        own = BucketedTable.write(batch.select(*HASH, "n", "last"), HASH)
        fresh = own.df
        for run in self._all(self.firsts):
            fresh = fresh.join(run.df, HASH, "left_anti")
        new = BucketedTable.write(fresh.select(*HASH, F.col("last").alias("keeper")), HASH, own.buckets, laid=True)
        self._push(self.counts, own, "n")
        self._push(self.firsts, new, "keeper")
        return new.df

    def _push(self, levels: list[list[BucketedTable]], run: BucketedTable, value: str) -> None:
        for level in range(len(levels) + 1):
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            # Full: its runs become one of the next level.
            run = BucketedTable.write(self._merged(levels[level], value), HASH, run.buckets, laid=True)
            self.stale += levels[level]
            levels[level] = []

    def _clear(self) -> None:
        for run in self.stale:
            run.drop()
        self.stale = []

    @staticmethod
    def _all(levels: list[list[BucketedTable]]) -> list[BucketedTable]:
        return [run for level in levels for run in level]

    @staticmethod
    def _merged(runs: list[BucketedTable], value: str) -> DataFrame:
        """One sorted merge of all runs: counts add up, a key has one holder."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed(value, "_other"), HASH, "full_outer")
            if value == "n":
                return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("_other", F.lit(0))).alias("n"))
            return both.select(*HASH, F.coalesce(value, "_other").alias(value))

        return functools.reduce(two, [run.df.select(*HASH, value) for run in runs])

    def frequent(self, min_docs: int) -> DataFrame:
        """``h, g, n, keeper`` of the keys that at least ``min_docs`` documents hold."""
        counts = self._merged(self._all(self.counts), "n").where(F.col("n") >= min_docs)
        return counts.join(self._merged(self._all(self.firsts), "keeper"), HASH)

    def drop(self) -> None:
        self._clear()
        for run in self._all(self.counts) + self._all(self.firsts):
            run.drop()


def frequent_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``h, g, n, keeper`` of the line keys of at least ``min_chars`` code points in at least ``min_docs`` documents.

    Rows of one id are one document; rows without an id count for no key and keep none.
    """
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shares = [k / batches for k in range(1, batches)]
    bounds = named.agg(F.percentile_approx("id", shares, 10000).alias("b")).first()["b"] if shares else []
    edges = [None, *sorted(set(bounds or [])), None]
    runs = LineRuns(docs.sparkSession, fanout)
    for low, high in reversed(list(zip(edges, edges[1:]))):
        inside = F.lit(True) if low is None else F.col("id") > low
        if high is not None:
            inside &= F.col("id") <= high
        placed = named.where(inside).select("id", F.explode(lines(F.col("text"))).alias("_line"))
        held = _hashed(placed, min_chars).groupBy(*HASH, "id").agg(F.lit(1).alias("one"))
        runs.add(held.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("last")))
    out = materialize(runs.frequent(min_docs))
    runs.drop()
    return out


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All rows with ``n_lines`` and ``n_dropped`` (long) and ``kept_text``; columns of these names are replaced.

    A key of at least ``min_chars`` code points that is found in at least ``min_docs``
    documents loses all its lines but those of the document with the largest id.
    Every line of that key stays there, and in all rows of that id. Rows without an
    id lose such lines. A null or empty text is one empty line; an empty table gives
    an empty one. ``docs`` is read once a batch and twice at the end. Ids are numbers.
    """
    frequent = frequent_lines(docs, min_chars, min_docs, batches, fanout, id_col, text_col)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    copies = F.ceil(F.col("n") / F.lit(max(1, total // HOT_SHARE))).cast("int")
    dealt = frequent.select(*HASH, "keeper", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt"))
    # Fewer than HOT_SHARE keys have two copies or more.
    hot = F.broadcast(frequent.select(*HASH, copies.alias("_copies")).where("_copies > 1"))
    row = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")]
    placed = docs.select(*row, F.posexplode(lines(F.col(text_col))).alias("_at", "_line"))
    salt = F.pmod(F.xxhash64("_id", "_text"), F.coalesce("_copies", F.lit(1))).cast("int")
    held = _hashed(placed, min_chars).join(hot, HASH, "left").withColumn("_salt", salt).drop("_copies")
    lost = held.join(dealt, [*HASH, "_salt"]).where(~F.col("keeper").eqNullSafe(F.col("_id")))
    drops = lost.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_at")).alias("_lost"))
    # One byte a line up to the last lost one, so that each line finds its own in one step.
    gap = "repeat('0', x - coalesce(get(_lost, i - 1), -1) - 1)"
    drops = drops.withColumn("_map", F.expr(f"cast(array_join(transform(_lost, (x, i) -> concat({gap}, '1')), '') AS binary)"))

    # The columns of the table wait in one struct, whatever their names.
    wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), *row)
    same = F.col("w._id").eqNullSafe(F.col("d._id")) & F.col("w._text").eqNullSafe(F.col("d._text"))
    joined = wide.alias("w").join(drops.alias("d"), same, "left").select("row", "text", "_lost", "_map")
    all_lines = lines(F.col("text"))
    stay = F.filter(all_lines, lambda x, i: F.coalesce(F.substring("_map", i + 1, 1) != F.lit(b"1"), F.lit(True)))
    done = joined.select(
        "row",
        F.size(all_lines).cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
    )
    return done.select("row.*", "n_lines", "n_dropped", "kept_text")
