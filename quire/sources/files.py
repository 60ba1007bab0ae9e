"""Files as rows: listings, raw search input, and observation streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas


def read_files(spark: SparkSession, glob: str, content: bool = False) -> DataFrame:
    """``path, size, mtime`` of each file, and its bytes only if asked for.

    Without ``content`` the column is pruned from the scan, so no file is opened.
    """
    files = spark.read.format("binaryFile").load(glob)
    cols = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*cols, *([F.col("content")] if content else []))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One object table from Parquet with its fixed schema."""
    return spark.read.schema(getattr(schemas, name.upper())).parquet(path)


def read_disk_obs(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.DISK_OBS, **options: str) -> DataFrame:
    """Unbounded observations of file state from a growing directory."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def read_disk_obs_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a Kafka topic with JSON values (needs the Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.DISK_OBS).alias("o")).select("o.*")
