"""Running aggregates that survive a huge group.

A window sends every row of a key to one task. That is the right plan while
groups are small: windows over the same key and order share one shuffle. It is
the wrong plan when one page holds a third of all tokens. So the groups are
counted first (a partial aggregation, no data is moved), and only groups above
``max_group_rows`` take the other way, which is exact too:

each big group is cut into chunks of consecutive rows; a window runs inside each
(key, chunk), a chunk is reduced to one row, the chunk rows are scanned per key,
and the carried value is joined back. Only chunk rows meet in one task.

``chunk`` must not decrease along ``order`` inside a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

# kind of a running value, its column, and whether the current row is left out
Spec = tuple[str, Column] | tuple[str, Column, bool]

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Skew:
    """When a group is too big for one task, and how it is cut."""

    max_group_rows: int = 5_000_000
    chunk_rows: int = 1_000_000

    def chunk(self, position: Column) -> Column:
        """Chunk number of a dense position."""
        return F.floor(position / F.lit(self.chunk_rows)).cast("bigint")


DEFAULT_SKEW = Skew()


def scan_groups(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[DataFrame, "WindowScan"], DataFrame],
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """``build(rows, scan)`` over small groups by windows, over big ones by chunks."""
    keys = list(keys)
    hot = materialize(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > skew.max_group_rows).select(*keys)
    )
    if hot.isEmpty():
        return build(df, WindowScan())
    same = [df[k].eqNullSafe(hot[k]) for k in keys]
    cold_rows = df.join(hot, same, "left_anti")
    hot_rows = materialize(df.join(hot, same, "left_semi"))
    return build(cold_rows, WindowScan()).unionByName(build(hot_rows, ChunkScan()))


class WindowScan:
    """Running values by plain windows, one group per task."""

    def running(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, **specs: Spec) -> DataFrame:
        """Add running columns, each ``name=(kind, value[, exclusive])``.

        ``sum``, ``min``, ``max`` run over the rows up to this one; ``last`` is
        the latest non-null value; ``lag`` the previous row's value, null
        included. ``exclusive`` leaves the current row out.
        """
        w = Window.partitionBy(*keys).orderBy(*order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        out = {}
        for name, spec in specs.items():
            kind, value = spec[0], spec[1]
            frame = before if len(spec) > 2 and spec[2] else upto
            if kind == "lag":
                out[name] = F.lag(value).over(w)
            elif kind == "last":
                out[name] = F.last(value, ignorenulls=True).over(frame)
            elif kind == "sum":
                out[name] = F.coalesce(F.sum(value).over(frame), F.lit(0))
            else:
                out[name] = _FOLDS[kind](value).over(frame)
        return df.withColumns(out)

    def clamped_depth(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                      delta: Column, out: str = "depth", underflow: str | None = None) -> DataFrame:
        """Running sum of ``delta`` (-1, 0, 1) that never falls below zero.

        With ``s`` the plain running sum the clamped one is
        ``s - least(0, running minimum of s)``. ``underflow`` names a flag column:
        the row tried to go below zero.
        """
        w = Window.partitionBy(*keys).orderBy(*order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        summed = df.withColumn("_delta", delta.cast("bigint")).withColumn("_s", F.sum("_delta").over(upto))
        low = {"_m": F.min("_s").over(upto)}
        if underflow:
            low["_mp"] = F.min("_s").over(before)
        deep = summed.withColumns(low).withColumn(out, F.col("_s") - F.least(F.lit(0), F.col("_m")))
        if underflow:
            was = F.col("_s") - F.col("_delta") - F.least(F.lit(0), F.coalesce("_mp", F.lit(0)))
            deep = deep.withColumn(underflow, (F.col("_delta") < 0) & (was == 0))
        return deep.drop("_delta", "_s", "_m", "_mp")


class ChunkScan(WindowScan):
    """The same values chunk by chunk, for groups too big for one task.

    Each scan is written out: later scans read it twice, and recomputing a chain
    of scans would double its work at every step.
    """

    def running(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, **specs: Spec) -> DataFrame:
        keys, order = list(keys), list(order)
        base = df.withColumn("_chunk", chunk.cast("bigint"))
        ordered = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        position = F.struct(*order)
        local, totals, carries, final = {}, [], [], []
        for name, spec in specs.items():
            kind, value = spec[0], spec[1]
            frame = before if len(spec) > 2 and spec[2] else upto
            v, l, t, c = (f"_{p}_{name}" for p in "vltc")
            base = base.withColumn(v, F.struct(value.alias("v")) if kind == "lag" else value)
            if kind in _FOLDS:
                fold = _FOLDS[kind]
                local[l] = fold(v).over(frame)
                totals.append(fold(v).alias(t))
                carries.append(fold(t).over(across).alias(c))
                final.append(
                    (F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))) if kind == "sum"
                    else (F.least(l, c) if kind == "min" else F.greatest(l, c))
                )
            elif kind == "last":
                local[l] = F.last(v, ignorenulls=True).over(frame)
                totals.append(F.max_by(v, F.when(F.col(v).isNotNull(), position)).alias(t))
                carries.append(F.last(t, ignorenulls=True).over(across).alias(c))
                final.append(F.coalesce(l, c))
            else:
                local[l] = F.lag(v).over(ordered)
                totals.append(F.max_by(v, position).alias(t))
                carries.append(F.last(t).over(across).alias(c))
                final.append(F.coalesce(l, c)["v"])
            final[-1] = final[-1].alias(name)
        rows = materialize(base.withColumns(local))
        summary = rows.groupBy(*keys, "_chunk").agg(*totals).select(*keys, "_chunk", *carries)
        kept = [F.col(f"_d.{c}") for c in df.columns if c not in specs]
        return materialize(_carry_join(rows, summary, keys).select(*kept, *final))

    def clamped_depth(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                      delta: Column, out: str = "depth", underflow: str | None = None) -> DataFrame:
        keys, order = list(keys), list(order)
        base = df.withColumn("_chunk", chunk.cast("bigint")).withColumn("_delta", delta.cast("bigint"))
        w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        rows = materialize(
            base.withColumn("_s", F.sum("_delta").over(upto)).withColumns(
                {"_m": F.min("_s").over(upto), "_mp": F.min("_s").over(before)}
            )
        )
        across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        summary = (
            rows.groupBy(*keys, "_chunk")
            .agg(F.sum("_delta").alias("_t"), F.min("_s").alias("_low"))
            .withColumn("_carry", F.coalesce(F.sum("_t").over(across), F.lit(0)))
            .withColumn("_floor", F.min(F.col("_low") + F.col("_carry")).over(across))
            .select(*keys, "_chunk", "_carry", "_floor")
        )
        s = F.col("_d._s") + F.col("_s._carry")
        floor = F.least(F.lit(0), F.col("_s._floor"))
        kept = [F.col(f"_d.{c}") for c in df.columns if c not in (out, underflow)]
        made = [(s - F.least(floor, F.col("_d._m") + F.col("_s._carry"))).alias(out)]
        if underflow:
            was = s - F.col("_d._delta") - F.least(floor, F.col("_d._mp") + F.col("_s._carry"))
            made.append(((F.col("_d._delta") < 0) & (was == 0)).alias(underflow))
        return materialize(_carry_join(rows, summary, keys).select(*kept, *made))


def _carry_join(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in [*keys, "_chunk"]:
        same = same & F.col(f"_d.{k}").eqNullSafe(F.col(f"_s.{k}"))
    return rows.alias("_d").join(summary.alias("_s"), same, "left")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """1-based row number per key; ``order`` tells the rows of a key apart, or ties are equal rows.

    Small groups are numbered by a window, groups above ``max_group_rows`` by range.
    """

    def build(rows: DataFrame, scan: WindowScan) -> DataFrame:
        if isinstance(scan, ChunkScan):
            return range_ranks(rows, keys, order, out, skew)
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    return scan_groups(df, keys, build, skew)


def range_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Row numbers of groups of any size, whatever their order looks like.

    All rows are dealt by sampled ranges of ``keys, order`` and sorted there. A row's
    number is its place in its range plus what the earlier ranges hold of its key: one
    count for each key and range, which are few for a large group.
    """
    keys, sorting = list(keys), [*keys, *order]
    tasks = max(2, -(-df.count() // skew.chunk_rows))
    dealt = df.repartitionByRange(tasks, *sorting).sortWithinPartitions(*sorting)
    # The number of a row within its task is in the lower 33 bits, the task above them.
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_d._range") == F.col("_s._range")
    for k in keys:
        same = same & F.col(f"_d.{k}").eqNullSafe(F.col(f"_s.{k}"))
    number = F.col("_d._at") - F.col("_s._first") + F.col("_s._before") + 1
    return placed.alias("_d").join(offsets.alias("_s"), same).select(*[F.col(f"_d.{c}") for c in df.columns if c != out], number.alias(out))
