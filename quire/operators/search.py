"""Literal search in texts, file contents and table cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import literal_hits


def find_literal(
    df: DataFrame, keys: list[str], text: str, query: str, case_sensitive: bool = True, latin1_only: bool = True
) -> DataFrame:
    """``keys, start, end, line``: every non-overlapping hit of ``query``.

    With ``latin1_only`` (byte-oriented text) a query with a character above
    U+00FF finds nothing.
    """
    if latin1_only and any(ord(c) > 0xFF for c in query):
        df = df.where("false")
    hits = df.select(*keys, F.explode(literal_hits(F.col(text), query, case_sensitive)).alias("h"))
    return hits.select(*keys, "h.start", "h.end", "h.line")


def find_in_spans(
    df: DataFrame, keys: list[str], cols: list[str], query: str, case_sensitive: bool = False
) -> DataFrame:
    """``keys, col, start, end``: hits in the displayed cells of a table, any script."""
    cells = df.unpivot(keys, cols, "col", "cell")
    return find_literal(cells, [*keys, "col"], "cell", query, case_sensitive, latin1_only=False).drop("line")
