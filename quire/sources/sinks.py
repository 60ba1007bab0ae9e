"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """Write ``df`` as Parquet or JSON, optionally partitioned by columns of few values."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)



def write_dumps(df: DataFrame, path: str) -> None:
    """Write dumps (``doc_id, value``: a document's text) packed, many documents a file.

    Corpora of small dumps would be slowed down by a file and a folder for each.
    """
    df.select("doc_id", "value").write.parquet(path)
