"""Session helpers: where intermediate results go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session, configuring it if needed.

    The folder comes from ``spark.checkpoint.dir``. Only a local master with
    nothing configured falls back to a temporary folder: on a cluster that would
    be a machine-local path, so it is refused instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="quire-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with its lineage cut.

    The result survives the loss of executors. It reports no partitioning; what is
    joined again and again belongs in a :class:`BucketedTable`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back, its lineage cut.

    Like :func:`materialize`, but compressed and read by column: for the wide rows of
    walks, whose paths and ids repeat. Columns need names of their own and a type.
    """
    return WrittenRows.write(df).df


@dataclass(frozen=True)
class WrittenRows:
    """A plain table in the checkpoint folder, until it is dropped."""

    spark: SparkSession
    name: str

    @classmethod
    def write(cls, df: DataFrame) -> WrittenRows:
        spark = df.sparkSession
        name = f"{_database(spark)}.w{uuid.uuid4().hex}"
        with _shuffles_freed(spark):
            df.write.format("parquet").option("compression", "zstd").saveAsTable(name)
        return cls(spark, name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@dataclass(frozen=True)
class BucketedTable:
    """A table in the checkpoint folder whose files are dealt by hash of ``keys``.

    Joins and groupings of two such tables on exactly these keys need no exchange, as
    long as both have the same number of buckets.
    """

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    buckets: int

    @classmethod
    def write(cls, df: DataFrame, keys: Sequence[str], buckets: int | None = None, laid: bool = False, parts: int = 1) -> BucketedTable:
        """Write ``df``, one file a bucket; ``laid`` says that its rows are dealt that way already.

        With ``parts``, a part of the keys is dealt at a time, which bounds the shuffle files, and a bucket has so many files.
        """
        spark = df.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"{_database(spark)}.t{uuid.uuid4().hex}"
        part_of = F.pmod(F.hash(F.lit(parts), *keys), F.lit(parts))
        for part in range(parts):
            some = df if parts == 1 else df.where(part_of == part)
            rows = some if laid else some.repartition(n, *keys)
            with _shuffles_freed(spark):
                rows.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
        return cls(spark, name, tuple(keys), n)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _database(spark: SparkSession) -> str:
    """The database of bucketed tables, whose folder lies in the checkpoint folder."""
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    name = "quire_" + folder.rsplit("/", 1)[-1].replace("-", "_").lower()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}/tables'")
    return name
