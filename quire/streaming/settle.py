"""Observed file states turned into settled change events.

A state counts once it was seen twice in a row. It is reported when it differs
from the last report, or, while it is not ``current``, when its times repeat once
and differ from the last report. An error row (NULL state) clears the streaks.
Rows count in the order of ``seq``; a row whose ``seq`` is not above that of the rows
before it is stale and dropped. The stream and the batch form give the same events
for the same rows, if none comes so late that the stream has passed it by.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.scan import DEFAULT_SKEW, Skew, scan_groups

CURRENT = "current"
# A row of the keyed input is an observation, an outside report, or a close.
OBSERVE, RECORD, FORGET = "observe", "record", "forget"
EVENTS = "key string, ts timestamp, seq bigint, state string, disk_mtime bigint, disk_size bigint"
_STATE = (
    "last_state string, last_mtime bigint, last_size bigint, cand_state string, cand_mtime bigint, cand_size bigint, "
    "state_streak int, same_streak int, resync boolean, max_seq bigint, closed_seq bigint"
)
_START = (CURRENT, 0, 0, None, 0, 0, 0, 0, False, -1, -1)


# --- batch -------------------------------------------------------------------


def settle_batch(obs: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Events of ``key, ts, seq, state, disk_mtime, disk_size`` rows, by windows only.

    With a column ``kind`` rows may be outside reports and closes too, see
    :func:`settle`. Of rows of the same key and ``seq`` the first by ``ts`` counts.
    """
    order, keys = ["seq"], ["key", "_life"]
    chunk = skew.chunk(F.col("seq"))
    whole = F.struct("state", "disk_mtime", "disk_size")
    observed, record = F.col("kind") == OBSERVE, F.col("kind") == RECORD

    def lives(rows: DataFrame, scan: Any) -> DataFrame:
        # A close begins a new life of its key.
        return scan.running(rows, ["key"], order, chunk, _life=("sum", F.when(F.col("kind") == FORGET, 1).otherwise(0).cast("bigint")))

    def build(rows: DataFrame, scan: Any) -> DataFrame:
        one = scan.running(rows, keys, order, chunk, _prev=("lag", F.struct("kind", whole.alias("whole"))))
        prev = F.col("_prev")
        seen = observed & F.coalesce((prev["kind"] == OBSERVE) & (F.col("state") == prev["whole"]["state"]), F.lit(False))
        one = one.withColumns({"_settled": seen, "_same": seen & F.coalesce(whole.eqNullSafe(prev["whole"]), F.lit(False))})
        told = F.when(F.col("_settled") | record, F.struct(record.alias("record"), F.col("state").alias("state")))
        two = scan.running(one, keys, order, chunk, _before=("last", told, True))
        before = F.col("_before")
        # After an outside report the next settled row is news in any case.
        changed = F.col("_settled") & (F.coalesce(before["record"], F.lit(False)) | ~F.coalesce(before["state"], F.lit(CURRENT)).eqNullSafe(F.col("state")))
        again = F.col("_settled") & (F.col("state") != CURRENT) & F.col("_same")
        two = two.withColumns({"_changed": changed, "_again": again})
        anchor = F.when(F.col("_changed") | F.col("_again") | record, whole)
        return scan.running(two, keys, order, chunk, _anchor=("last", anchor, True))

    mixed = "kind" in obs.columns
    obs = obs if mixed else obs.withColumn("kind", F.lit(OBSERVE))
    rest = ["ts", "kind", "state", "disk_mtime", "disk_size"]
    rows = obs.groupBy("key", "seq").agg(F.min_by(F.struct(*rest), "ts").alias("r")).select("key", "seq", "r.*")
    rows = scan_groups(rows, ["key"], lives, skew) if mixed else rows.withColumn("_life", F.lit(0).cast("bigint"))
    marked = scan_groups(rows, keys, build, skew)
    news = F.col("_again") & ~whole.eqNullSafe(F.col("_anchor"))
    return marked.where(F.col("_changed") | news).select("key", "ts", "seq", "state", "disk_mtime", "disk_size")


def drop_stale(events: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Events whose sequence is above every earlier one of their key.

    ``events`` has ``arrival``, the order in which they came.
    """
    marked = scan_groups(
        events, ["key"],
        lambda rows, scan: scan.running(
            rows, ["key"], ["arrival"], skew.chunk(F.col("arrival")), _max=("max", F.col("seq"), True)),
        skew,
    )
    return marked.where("_max IS NULL OR seq > _max").drop("_max")


def current_status(events: DataFrame) -> DataFrame:
    """Latest state of each key; keys that are current again are absent.

    Works on a stream too (complete mode): it keeps one row per key.
    """
    last = events.groupBy("key").agg(F.max_by(F.struct("state", "disk_mtime", "disk_size", "seq"), "seq").alias("r"))
    return last.select("key", "r.*").where(F.col("state") != CURRENT)


# --- stream ------------------------------------------------------------------


def _in_sequence(rows: Iterator[Row], order: list[str]) -> list[Row]:
    """The rows of one key in one micro-batch, in order; the source's limit a trigger bounds them."""
    held = list(rows)
    return held if len(held) < 2 else sorted(held, key=lambda row: tuple((row[c] is not None, row[c]) for c in order))


class Settle(StatefulProcessor):
    """Keyed state: last report, candidate, two streaks, resync mark, sequences.

    ``idle_ms`` removes the state of keys without rows for so long, should their close
    never come.
    """

    def __init__(self, idle_ms: int | None = None):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("settle", _STATE, self._idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # No state is None, which saves asking whether there is one.
        state = self._state.get() or _START
        events = []
        for row in _in_sequence(rows, ["seq", "ts"]):
            state, emitted = advance(state, row)
            if emitted:
                events.append(Row(key=key[0], ts=row.ts, seq=row.seq, state=row.state, disk_mtime=row.disk_mtime, disk_size=row.disk_size))
        self._state.update(state)
        return iter(events)

    def close(self) -> None:
        pass


class DropStale(StatefulProcessor):
    """Keyed state: the largest sequence so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._most = handle.getValueState("most", "seq bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self._most.get()
        before = most = known[0] if known else None
        kept = []
        for row in _in_sequence(rows, ["arrival"]):
            # Like the batch form: a row without a sequence is kept until there is one.
            if most is None or (row.seq is not None and row.seq > most):
                most = row.seq
                kept.append(Row(key=key[0], arrival=row.arrival, seq=row.seq))
        if most != before:
            self._most.update((most,))
        return iter(kept)

    def close(self) -> None:
        pass


def advance(state: tuple, row: Any) -> tuple[tuple, bool]:
    """State after one row, and whether the row is an event."""
    (last_s, last_m, last_z, cand_s, cand_m, cand_z, streak, same, resync, max_seq, closed) = state
    if row.seq <= max_seq or row.seq <= closed:
        return state, False
    if row.kind == FORGET:
        # The key starts over; rows from before the close are late and dropped.
        return (*_START[:9], row.seq, row.seq), False
    if row.kind == RECORD:
        return (row.state, row.disk_mtime, row.disk_size, None, 0, 0, 0, 0, True, row.seq, closed), False
    if row.state is None:
        return (last_s, last_m, last_z, None, 0, 0, 0, 0, resync, row.seq, closed), False
    seen = (row.state, row.disk_mtime, row.disk_size)
    if streak > 0 and row.state == cand_s:
        streak, same = streak + 1, same + 1 if seen == (cand_s, cand_m, cand_z) else 1
    else:
        streak, same = 1, 1
    emit = streak >= 2 and (
        resync or row.state != last_s or (row.state != CURRENT and same >= 2 and seen != (last_s, last_m, last_z)))
    if emit:
        last_s, last_m, last_z = seen
        resync = False
    # Streaks above two say no more than two.
    return (last_s, last_m, last_z, *seen, min(streak, 2), min(same, 2), resync, row.seq, closed), emit


def settle(obs: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Settled events of a stream of ``key, ts, seq, kind, state, disk_mtime, disk_size`` rows.

    ``kind`` is ``observe``, ``record`` (an outside report replaces the last one
    and forces the next settled row out) or ``forget`` (a closed key starts over).
    The state of a key without rows for ``idle_ms`` is forgotten, if that is given; such
    a stream wakes by the clock, so it needs a trigger that keeps running.
    The state store must be RocksDB.
    """
    mode = "None" if idle_ms is None else "ProcessingTime"
    # Times travel as numbers, whatever the time zone of a worker.
    settled = obs.withColumn("ts", F.unix_micros("ts")).groupBy("key").transformWithState(
        statefulProcessor=Settle(idle_ms), outputStructType=EVENTS.replace("ts timestamp", "ts bigint"), outputMode="append", timeMode=mode)
    return settled.withColumn("ts", F.timestamp_micros("ts"))


def drop_stale_stream(events: DataFrame) -> DataFrame:
    """``key, arrival, seq`` of a stream, without rows whose sequence is not above all earlier ones of their key."""
    return events.groupBy("key").transformWithState(
        statefulProcessor=DropStale(), outputStructType="key string, arrival bigint, seq bigint", outputMode="append", timeMode="None")


class StatusTable:
    """The newest state of every key under ``path``, kept up by micro-batches.

    Keys are dealt into buckets. A batch rewrites the buckets of its keys only, as the
    version of its epoch; a reader takes the newest version of every bucket. An epoch
    that is repeated reads the versions before it and writes the same files again.
    """

    ROW = "key string, state string, disk_mtime bigint, disk_size bigint, seq bigint"

    def __init__(self, path: str, buckets: int = 64):
        self.path, self.buckets = path, buckets

    def _versions(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(f"{self.ROW}, bucket int, epoch bigint").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """A ``foreachBatch`` writer."""
        spark = batch.sparkSession
        new = newest(batch).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        versions = self._versions(spark)
        if versions is not None:
            # At most as many numbers as there are buckets.
            changed = [r[0] for r in new.select("bucket").distinct().collect()]
            new = newest(new.unionByName(_latest(versions.where(F.col("bucket").isin(changed) & (F.col("epoch") < epoch)))), "bucket")
        new.withColumn("epoch", F.lit(epoch)).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """``key, state, disk_mtime, disk_size, seq`` of every key that is not current."""
        versions = self._versions(spark)
        if versions is None:
            return spark.createDataFrame([], self.ROW)
        return _latest(versions).drop("bucket").where(F.col("state") != CURRENT)


def _latest(versions: DataFrame) -> DataFrame:
    """Rows of each bucket's newest version."""
    last = versions.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return versions.join(last, ["bucket", "epoch"], "left_semi").drop("epoch")


def newest(states: DataFrame, *more: str) -> DataFrame:
    """Newest row of each key."""
    last = states.groupBy("key", *more).agg(F.max_by(F.struct("state", "disk_mtime", "disk_size", "seq"), "seq").alias("r"))
    return last.select("key", *more, "r.*")


def as_observations(obs: DataFrame, kind: Column | None = None) -> DataFrame:
    """Plain observations as keyed input rows."""
    return obs.withColumn("kind", F.lit(OBSERVE) if kind is None else kind)
