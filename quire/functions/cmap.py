"""Character-code maps: from map text to one row per code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.values import unicode_display, unicode_glyph

MAX_RANGE_SPAN = 65_536
MAX_MAPPINGS = 131_072

_CHAR_BLOCK = r"(?s)beginbfchar(.*?)endbfchar"
_RANGE_BLOCK = r"(?s)beginbfrange(.*?)endbfrange"
_HEX = r"<([0-9A-Fa-f\s]*)>"
_PAIR = r"(?s)<([0-9A-Fa-f\s]+)>\s*(<[^>]*>|\[[^\]]*\])"
_TRIPLE = r"(?s)<[0-9A-Fa-f\s]+>\s*<[0-9A-Fa-f\s]+>\s*(?:<[^>]*>|\[[^\]]*\])"
_TRIPLE_PARTS = r"(?s)<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(<[^>]*>|\[[^\]]*\])"


def _digits(h: Column) -> Column:
    return F.regexp_replace(h, r"[<>\s]", "")


def _code(h: Column) -> Column:
    return F.conv(_digits(h), 16, 10).try_cast("bigint")


def _missing_end(text: Column, word: str) -> Column:
    count = lambda w: F.size(F.split(text, w, -1)) - 1
    return count(f"begin{word}") > count(f"end{word}")


def cmap_mappings(df: DataFrame, keys: list[str], text: str = "cmap") -> DataFrame:
    """One row per mapped code: ``keys, code, unicode, glyph, ord``.

    ``ord`` is the declaration order, single pairs before ranges, so that the
    last declaration of a code can win. Malformed maps give no rows here; see
    :func:`cmap_errors`. Maps that are only large give all their rows.
    """
    errors = cmap_errors(df, keys, text).where("NOT large")
    usable = df.join(errors.select(*keys), keys, "left_anti")
    # Comments do not carry codes.
    body = usable.withColumn("_t", F.regexp_replace(text, r"%[^\r\n]*", ""))
    pairs = (
        body.select(*keys, F.posexplode(F.regexp_extract_all("_t", F.lit(_CHAR_BLOCK), F.lit(1))))
        .select(*keys, F.col("pos").alias("_b"), F.posexplode(
            F.regexp_extract_all("col", F.lit(_PAIR), F.lit(0))))
        .select(
            *keys,
            F.struct(F.lit(0).alias("kind"), F.col("_b").alias("block"), F.col("pos").alias("item"),
                     F.lit(0).cast("bigint").alias("k")).alias("ord"),
            _code(F.regexp_extract("col", _PAIR, 1)).alias("code"),
            # An array target counts by its first item.
            F.upper(_digits(F.regexp_extract(F.regexp_extract("col", _PAIR, 2), _HEX, 1))).alias("hex"),
        )
    )
    rows = _range_rows(body, keys)
    items = F.regexp_extract_all("third", F.lit(_HEX), F.lit(1))
    # Two steps, so that no span needs one array for all its codes.
    span, step = F.col("high") - F.col("low"), F.lit(MAX_RANGE_SPAN).cast("bigint")
    parts = rows.select(*keys, "block", "item", "low", "high", "third", F.explode(F.sequence(F.lit(0).cast("bigint"), span, step)).alias("_k0"))
    spread = parts.select(
        *keys, "block", "item", "low", "third", F.explode(F.sequence("_k0", F.least(F.col("_k0") + step - 1, span))).alias("k")
    )
    listed = spread.where(F.col("third").startswith("[") & (F.col("k") < F.size(items))).withColumn(
        "hex", F.upper(_digits(F.element_at(items, (F.col("k") + 1).cast("int"))))
    )
    counted = spread.where(~F.col("third").startswith("[")).withColumn(
        "hex", _advance(F.upper(_digits(F.col("third"))), F.col("k"))
    )
    ranges = listed.unionByName(counted).where("hex IS NOT NULL").select(
        *keys,
        F.struct(F.lit(1).alias("kind"), F.col("block"), F.col("item"), F.col("k")).alias("ord"),
        (F.col("low") + F.col("k")).alias("code"),
        "hex",
    )
    return pairs.unionByName(ranges).select(
        *keys,
        "code",
        unicode_display(F.col("hex")).alias("unicode"),
        unicode_glyph(F.col("hex")).alias("glyph"),
        "ord",
    )


def _range_rows(body: DataFrame, keys: list[str]) -> DataFrame:
    return (
        body.select(*keys, F.posexplode(F.regexp_extract_all("_t", F.lit(_RANGE_BLOCK), F.lit(1))))
        .select(*keys, F.col("pos").alias("block"), F.posexplode(
            F.regexp_extract_all("col", F.lit(_TRIPLE), F.lit(0))))
        .select(
            *keys,
            "block",
            F.col("pos").alias("item"),
            _code(F.regexp_extract("col", _TRIPLE_PARTS, 1)).alias("low"),
            _code(F.regexp_extract("col", _TRIPLE_PARTS, 2)).alias("high"),
            F.regexp_extract("col", _TRIPLE_PARTS, 3).alias("third"),
        )
    )


def _advance(base: Column, k: Column) -> Column:
    """``base`` (hex of 16-bit units) plus ``k``, NULL when it overflows.

    The carry runs upward through the units, so the addition is one on the whole
    number. Up to three units fit a long; longer targets add to the last three.
    """
    head_len = F.greatest(F.lit(0), F.char_length(base) - 12)
    head, tail = F.left(base, head_len), F.substr(base, head_len + 1)
    width = F.char_length(tail)
    total = F.conv(tail, 16, 10).cast("bigint") + k
    out = F.lpad(F.hex(total), 12, "0")
    # Overflow out of three units into a longer head cannot be represented here;
    # a carry needs 2^48 codes in one range, and a range spans at most 2^16.
    fits = F.char_length(F.regexp_replace(F.hex(total), "^0+", "")) <= width
    return F.when((width > 0) & fits, F.concat(head, F.right(out, width)))


def cmap_errors(df: DataFrame, keys: list[str], text: str = "cmap") -> DataFrame:
    """One row per map with a finding: ``keys, error, large``; ``large`` maps are usable."""
    body = df.withColumn("_t", F.regexp_replace(text, r"%[^\r\n]*", ""))
    unclosed = body.select(
        *keys,
        F.when(_missing_end(F.col("_t"), "bfchar"), "bfchar: missing endbfchar")
        .when(_missing_end(F.col("_t"), "bfrange"), "bfrange: missing endbfrange")
        .alias("error"),
        F.lit(0).alias("_rank"),
    ).where("error IS NOT NULL")
    span = F.col("high") - F.col("low") + 1
    third = _digits(F.col("third"))
    ranges = _range_rows(body, keys).select(
        *keys,
        F.when(span < 1, F.format_string("bfrange: range high %d < low %d", "high", "low"))
        .when(
            span > MAX_RANGE_SPAN,
            F.format_string(f"bfrange: range span %d exceeds cap {MAX_RANGE_SPAN}", span),
        )
        .when(
            ~F.col("third").startswith("[") & (F.char_length(third) % 4 != 0),
            F.format_string(
                "bfrange: base hex length %d not multiple of 2",
                F.ceil(F.char_length(third) / 2).cast("bigint"),
            ),
        )
        .alias("error"),
        F.struct("block", "item").alias("_at"),
        F.when(~F.col("third").startswith("["), span)
        .otherwise(
            F.least(span, F.size(F.regexp_extract_all("third", F.lit(_HEX), F.lit(1))).cast("bigint"))
        )
        .alias("_n"),
    )
    bad = (
        ranges.groupBy(*keys)
        .agg(
            F.min_by("error", F.when(F.col("error").isNotNull(), F.col("_at"))).alias("error"),
            F.sum("_n").alias("_n"),
        )
        .select(*keys, F.coalesce("error", F.when(
            F.col("_n") > MAX_MAPPINGS, F.lit(f"CMap mappings exceed cap {MAX_MAPPINGS}"))).alias("error"),
            F.lit(1).alias("_rank"))
        .where("error IS NOT NULL")
    )
    n_pairs = F.aggregate(
        F.regexp_extract_all("_t", F.lit(_CHAR_BLOCK), F.lit(1)),
        F.lit(0),
        lambda acc, b: acc + F.size(F.regexp_extract_all(b, F.lit(_PAIR), F.lit(0))),
    )
    many = body.where(n_pairs > MAX_MAPPINGS).select(
        *keys, F.lit(f"CMap mappings exceed cap {MAX_MAPPINGS}").alias("error"), F.lit(2).alias("_rank")
    )
    return (
        unclosed.unionByName(bad)
        .unionByName(many)
        .groupBy(*keys)
        .agg(F.min_by("error", "_rank").alias("error"))
        .withColumn("large", F.col("error").contains(" exceed"))
    )
