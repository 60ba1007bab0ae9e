"""Connected components of a link table, without any node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


ROWS_PER_TASK = 50_000


def compacted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the checkpoint folder, read by few tasks if it has few rows, and its row count.

    Loops shuffle such tables again and again; tasks without rows would write most of the files.
    """
    out = materialize(df)
    rows = out.count()
    return out.coalesce(rows // ROWS_PER_TASK + 1), rows


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of every linked node's component: columns node, component.

    ``links`` may repeat, turn round or join a node with itself. Large-star and
    small-star steps alternate until nothing changes; each is a minimum per node,
    combined before the shuffle, and a join back, so that a node with very many
    links is never gathered. The number of steps grows with the logarithm of the
    longest chain. Nodes are of an ordered type without nulls.
    """
    edges, _ = compacted(_edges(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    state = _state(edges)
    while True:
        large, _ = compacted(_star(edges, large=True))
        edges, _ = compacted(_star(large, large=False))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and checksums of the distinct links: equal ones mean equal tables, but for a chance of 2**-120."""
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(7))
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two)).first())


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    turned = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return turned.where(F.col("a") != F.col("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of a node's neighbourhood: the larger ones, or the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        out = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        joined = edges.join(low, "a")
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()
