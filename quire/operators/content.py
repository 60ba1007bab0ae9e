"""Content streams: tokens to operations, marked content, colour use.

Tokens are ordered by ``(stream_idx, tok_idx)`` inside a page. Every running
value goes through :mod:`quire.operators.scan`, so a page of any length is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import decode_name
from quire.operators.scan import DEFAULT_SKEW, Skew, WindowScan, scan_groups
from quire.session import materialize

STREAM = ["doc_id", "page_num", "stream_idx"]
PAGE = ["doc_id", "page_num"]

# Operators that open and close a structural block.
OPEN_OPS = ["q", "BT", "BMC", "BDC"]
CLOSE_OPS = ["Q", "ET", "EMC"]
_OPENERS, _CLOSERS = ["<<", "["], [">>", "]"]
# Operators that are operands, not ends of an operand list.
_OPERAND_WORDS = [*_OPENERS, *_CLOSERS, "true", "false", "null"]


# --- operations --------------------------------------------------------------


def assign_ops(tokens: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Tokens with ``op_group`` (and ``is_comment``), the operation each is part of.

    Operands gather up to the operator that ends them. Brackets are operands, as
    is any operator inside them. A comment stands alone and cuts pending operands
    off. ``BI`` runs through the next ``EI``.
    """
    return scan_groups(tokens, STREAM, lambda rows, scan: _assign_ops(rows, scan, skew), skew)


def _assign_ops(tokens: DataFrame, scan: WindowScan, skew: Skew) -> DataFrame:
    chunk = skew.chunk(F.col("tok_idx"))
    is_op = F.col("type") == "operator"
    marker = F.when(is_op & F.col("value").isin("BI", "EI"), F.col("value"))
    marked = scan.running(tokens, STREAM, ["tok_idx"], chunk, _last=("last", marker, True))
    marked = marked.withColumn("_inline", F.coalesce(F.col("_last") == "BI", F.lit(False))).drop("_last")
    delta = (
        F.when(F.col("_inline") | ~is_op, 0)
        .when(F.col("value").isin(_OPENERS), 1)
        .when(F.col("value").isin(_CLOSERS), -1)
        .otherwise(0)
    )
    deep = scan.clamped_depth(marked, STREAM, ["tok_idx"], chunk, delta, "_nest")
    plain = is_op & ~F.col("_inline") & ~F.col("value").isin(_OPENERS + _CLOSERS) & (F.col("_nest") == 0)
    comment = (F.col("type") == "comment") & ~F.col("_inline")
    ends = (
        (plain & (F.col("value") != "BI"))
        | (F.col("_inline") & is_op & (F.col("value") == "EI"))
        | comment
    )
    flagged = deep.select(
        *tokens.columns,
        comment.alias("is_comment"),
        ends.alias("_ends"),
        (plain & (F.col("value") == "BI")).alias("_starts_inline"),
    )
    return scan.running(
        flagged, STREAM, ["tok_idx"], chunk, op_group=("sum", F.col("_ends").cast("bigint"), True)
    )


def format_ops(tokens: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """One row per operation: ``operator, n_tokens, line_start, line_end, indent``.

    ``first_tok`` orders the rows of a stream; ``operator`` is '' for a comment
    and for operands that never met theirs. The tokens of an operation are rows of
    :func:`op_tokens`.
    """
    return scan_groups(
        tokens, STREAM, lambda rows, scan: indent(_ops(_assign_ops(rows, scan, skew)), scan, skew), skew
    )


def op_tokens(tokens: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Every token with ``first_tok``, the operation of :func:`format_ops` that it is written in.

    One row a token, since an operation may hold any number of them: an array of
    texts, or a whole inline image.
    """
    grouped = assign_ops(tokens, skew)
    key = [*STREAM, "op_group", "is_comment"]
    first = grouped.groupBy(*key).agg(F.min("tok_idx").alias("first_tok"))
    return grouped.join(first, key).select(*STREAM, "first_tok", "tok_idx", "type", "value", "line")


def _ops(grouped: DataFrame) -> DataFrame:
    return (
        grouped.groupBy(*STREAM, "op_group", "is_comment")
        .agg(
            F.min("tok_idx").alias("first_tok"),
            F.count(F.lit(1)).alias("n_tokens"),
            F.min("line").alias("line_start"),
            F.max("line").alias("line_end"),
            F.max("_starts_inline").alias("_inline"),
            F.max(F.when(F.col("_ends") & ~F.col("is_comment"), F.col("value"))).alias("_op"),
        )
        .select(
            *STREAM,
            "first_tok",
            F.when(F.col("_inline"), "BI").otherwise(F.coalesce("_op", F.lit(""))).alias("operator"),
            "n_tokens",
            "line_start",
            "line_end",
        )
    )


def indent(ops: DataFrame, scan: WindowScan, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Nesting of each operation: openers indent after, closers dedent before."""
    opens = F.col("operator").isin(OPEN_OPS)
    delta = F.when(opens, 1).when(F.col("operator").isin(CLOSE_OPS), -1).otherwise(0)
    deep = scan.clamped_depth(ops, STREAM, ["first_tok"], skew.chunk(F.col("first_tok")), delta, "_d")
    return deep.withColumn("indent", F.when(opens, F.col("_d") - 1).otherwise(F.col("_d"))).drop("_d")


def op_params(tokens: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Flat operands: ``doc_id, page_num, stream_idx, op_group, pos, value, operator``."""
    grouped = assign_ops(tokens, skew).where("NOT is_comment")
    ends = grouped.where("_ends").select(*STREAM, "op_group", F.col("value").alias("operator"))
    operands = grouped.where("NOT _ends").select(*STREAM, "op_group", F.col("tok_idx").alias("pos"), "value")
    return operands.join(ends, [*STREAM, "op_group"])


def classify_do(params: DataFrame, resources: DataFrame) -> DataFrame:
    """Type and target of each ``Do``: ``..., op_group, name, resource_type, object_ref``.

    The first name operand found in the page's resources decides; a resource that
    is neither image nor form leaves the operator unclassified.
    """
    names = params.where("operator = 'Do' AND value LIKE '/%'").select(
        *STREAM, "op_group", "pos", F.substr("value", F.lit(2)).alias("name")
    )
    hit = names.join(resources, [*PAGE, "name"], "left")
    found = F.when(F.col("subtype").isNotNull() | F.col("ref_id").isNotNull(), F.col("pos"))
    return (
        hit.groupBy(*STREAM, "op_group")
        .agg(F.min_by(F.struct("name", "subtype", "ref_id"), found).alias("r"))
        .select(
            *STREAM,
            "op_group",
            F.col("r.name").alias("name"),
            F.when(F.col("r.subtype").isin("Image", "Form"), F.col("r.subtype")).alias("resource_type"),
            F.when(F.col("r.subtype").isin("Image", "Form"), F.col("r.ref_id")).alias("object_ref"),
        )
    )


# --- marked content ----------------------------------------------------------


def _position_chunk(skew: Skew) -> Column:
    """Chunks of a page in stream order, then token order."""
    return F.col("stream_idx").cast("bigint") * F.lit(1 << 32) + skew.chunk(F.col("tok_idx"))


def _with_breaks(tokens: DataFrame, undecoded: DataFrame | None) -> DataFrame:
    """Add one pseudo operator per undecodable stream: it drops pending operands."""
    kept = tokens.where("type <> 'comment'").select(*STREAM, "tok_idx", "type", "value", "line", "col")
    if undecoded is None:
        return kept
    return kept.unionByName(
        undecoded.select(
            *STREAM,
            F.lit(-1).cast("bigint").alias("tok_idx"),
            F.lit("operator").alias("type"),
            F.lit("").alias("value"),
            F.lit(0).cast("bigint").alias("line"),
            F.lit(0).cast("bigint").alias("col"),
        )
    )


def marked_balance(
    tokens: DataFrame, undecoded: DataFrame | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Per content stream: ``opens, closes, depth_at_end, min_depth``.

    The depth carries across the streams of a page. ``min_depth`` is -1 when a
    close had nothing to close.
    """
    delta = F.when(F.col("value").isin("BMC", "BDC"), 1).when(F.col("value") == "EMC", -1)
    events = tokens.where((F.col("type") == "operator") & delta.isNotNull())
    order = ["stream_idx", "tok_idx"]
    deep = scan_groups(
        events, PAGE,
        lambda rows, scan: scan.clamped_depth(rows, PAGE, order, _position_chunk(skew), delta, "_d", "_under"),
        skew,
    )
    opens = F.col("value") != "EMC"
    per_stream = deep.groupBy(*STREAM).agg(
        F.count_if(opens).alias("opens"),
        F.count_if(~opens).alias("closes"),
        F.max_by("_d", "tok_idx").alias("_end"),
        F.min(F.when(F.col("_under"), -1).when(~opens, F.col("_d"))).alias("_low"),
    )
    streams = tokens.select(*STREAM).distinct()
    if undecoded is not None:
        streams = streams.unionByName(undecoded.select(*STREAM)).distinct()
    filled = streams.join(per_stream, STREAM, "left")
    carried = scan_groups(
        filled, PAGE,
        lambda rows, scan: scan.running(
            rows, PAGE, ["stream_idx"], skew.chunk(F.col("stream_idx")),
            _start=("last", F.col("_end"), True), depth_at_end=("last", F.col("_end")),
        ),
        skew,
    )
    start = F.coalesce("_start", F.lit(0))
    return carried.select(
        *STREAM,
        F.coalesce("opens", F.lit(0)).alias("opens"),
        F.coalesce("closes", F.lit(0)).alias("closes"),
        F.coalesce("depth_at_end", F.lit(0)).alias("depth_at_end"),
        F.least(start, F.coalesce("_low", start)).alias("min_depth"),
    )


def _operand_len(reversed_tokens: Column) -> Column:
    """Tokens in the operand object a list ends with, read from the back."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        is_op = t["type"] == "operator"
        depth = s["depth"] + (
            F.when(is_op & t["value"].isin(_CLOSERS), 1)
            .when(is_op & t["value"].isin(_OPENERS), -1)
            .otherwise(0)
        )
        return F.when(s["done"], s).otherwise(
            F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth <= 0).alias("done"))
        )

    return F.aggregate(reversed_tokens, state, step, lambda s: s["n"])


def _open_dict(tokens: Column) -> Column:
    """Index of the outermost ``<<`` still open at the end, -1 when none is."""
    state = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("i"))

    def step(s: Column, t: Column) -> Column:
        is_op = t["type"] == "operator"
        stack = (
            F.when(is_op & t["value"].isin(_OPENERS), F.array_append(s["open"], s["i"]))
            .when(
                is_op & t["value"].isin(_CLOSERS) & (F.size(s["open"]) > 0),
                F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1),
            )
            .otherwise(s["open"])
        )
        return F.struct(stack.alias("open"), (s["i"] + 1).alias("i"))

    left_open = F.aggregate(tokens, state, step, lambda s: s["open"])
    dicts = F.filter(left_open, lambda i: F.element_at(tokens, i + 1)["value"] == "<<")
    return F.coalesce(F.try_element_at(dicts, F.lit(1)), F.lit(-1))


def _inline_mcid(prop: Column) -> Column:
    """``struct<type,value>`` of the top-level /MCID of an inline dictionary."""
    none = F.lit(None).cast("string")
    state = F.struct(
        F.lit(0).alias("depth"), F.lit(True).alias("expect"), F.lit("").alias("key"),
        F.lit(False).alias("done"), none.alias("type"), none.alias("value"),
    )

    def step(s: Column, t: Column) -> Column:
        is_op = t["type"] == "operator"
        opening, closing = is_op & t["value"].isin(_OPENERS), is_op & t["value"].isin(_CLOSERS)
        top = s["depth"] == 1
        found = top & ~closing & ~s["expect"] & (s["key"] == "/MCID")
        depth = (
            F.when(s["depth"] == 0, F.when(opening, 1).otherwise(0))
            .when(top, F.when(~closing & ~s["expect"] & opening, 2).otherwise(1))
            .otherwise(s["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0))
        )
        is_key = top & s["expect"] & (t["type"] == "name")
        expect = (
            F.when(is_key, False)
            .when(top & ~s["expect"] & ~closing & ~opening, True)
            .when((s["depth"] > 1) & (depth == 1), True)
            .otherwise(s["expect"])
        )
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.alias("depth"),
                expect.alias("expect"),
                F.when(is_key, t["value"]).otherwise(s["key"]).alias("key"),
                (found | (top & closing)).alias("done"),
                F.when(found, t["type"]).alias("type"),
                F.when(found, t["value"]).alias("value"),
            )
        )

    return F.aggregate(prop, state, step, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value")))


def _bdc_operands(tokens: DataFrame, undecoded: DataFrame | None, scan: WindowScan, skew: Skew) -> DataFrame:
    """Each BDC with its operand tokens in order."""
    cols = [*STREAM, "tok_idx", "type", "value", "line", "col"]
    all_tokens = _with_breaks(tokens, undecoded)
    ends = (F.col("type") == "operator") & ~F.col("value").isin(_OPERAND_WORDS)
    seg = scan.running(
        all_tokens, PAGE, ["stream_idx", "tok_idx"], _position_chunk(skew),
        _seg=("sum", ends.cast("bigint"), True),
    ).withColumn("_ends", ends)
    bdc = seg.where("_ends AND value = 'BDC'").select(*cols, "_seg")
    parts = (
        seg.where("NOT _ends")
        .join(bdc.select(*PAGE, "_seg"), [*PAGE, "_seg"], "left_semi")
        .groupBy(*PAGE, "_seg")
        .agg(F.array_sort(F.collect_list(F.struct("stream_idx", "tok_idx", "type", "value", "line", "col"))).alias("ops"))
    )
    empty = F.array().cast("array<struct<stream_idx:int,tok_idx:bigint,type:string,value:string,line:bigint,col:bigint>>")
    return bdc.join(parts, [*PAGE, "_seg"], "left").withColumn("ops", F.coalesce("ops", empty)).drop("_seg")


def read_bdc(
    tokens: DataFrame,
    properties: DataFrame | None = None,
    undecoded: DataFrame | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """One row per BDC: ``has_row, tag, mcid, error`` and the place of its tag.

    ``has_row`` is false when the property list has no MCID. ``properties`` has
    ``doc_id, page_num, name, mcid, error``: the named property lists of a page,
    with ``mcid`` as stored, NULL when the list has none.
    """
    return scan_groups(
        tokens, PAGE, lambda rows, scan: _read_bdc(rows, properties, undecoded, scan, skew), skew
    )


def _read_bdc(
    tokens: DataFrame,
    properties: DataFrame | None,
    undecoded: DataFrame | None,
    scan: WindowScan,
    skew: Skew,
) -> DataFrame:
    if undecoded is not None:
        undecoded = undecoded.join(tokens.select(*PAGE).distinct(), PAGE, "left_semi")
    b = _bdc_operands(tokens, undecoded, scan, skew)
    ops = F.col("ops")
    n = F.size(ops)
    last_len = _operand_len(F.reverse(ops))
    closed_start = n - last_len
    ends_in_dict = F.try_element_at(ops, closed_start + 1)["value"] == "<<"
    b = b.withColumn(
        "_prop_at",
        F.when(F.coalesce(ends_in_dict, F.lit(False)), closed_start).otherwise(
            F.when(_open_dict(ops) >= 0, _open_dict(ops)).otherwise(closed_start)
        ),
    )
    head = F.slice(ops, F.lit(1), F.col("_prop_at"))
    b = b.withColumn("_tag_len", F.when(F.col("_prop_at") > 0, _operand_len(F.reverse(head)))).withColumn(
        "_prop", F.slice(ops, F.col("_prop_at") + 1, n - F.col("_prop_at"))
    )
    b = b.withColumn("_tag", F.try_element_at(ops, F.col("_prop_at") - F.col("_tag_len") + 1)).withColumn(
        "_p", F.try_element_at(F.col("_prop"), F.lit(1))
    ).withColumn("_first", F.try_element_at(ops, F.lit(1)))
    b = b.withColumn(
        "_stage",
        F.when(n == 0, "none")
        .when(F.col("_prop_at") == 0, "one")
        .when((F.col("_tag_len") != 1) | (F.col("_tag")["type"] != "name"), "no_tag")
        .when((F.col("_p")["type"] == "operator") & (F.col("_p")["value"] == "<<"), "inline")
        .when((F.size("_prop") == 1) & (F.col("_p")["type"] == "name"), "named")
        .otherwise("bad"),
    )
    b = b.withColumn("_m", F.when(F.col("_stage") == "inline", _inline_mcid(F.col("_prop"))))
    b = b.withColumn(
        "_name", F.when(F.col("_stage") == "named", decode_name(F.substr(F.col("_p")["value"], F.lit(2))))
    )
    if properties is None:
        b = b.select("*", F.lit(None).cast("string").alias("_pm"), F.lit(None).cast("string").alias("_pe"),
                     F.lit(False).alias("_known"))
    else:
        props = properties.select(
            *PAGE, F.col("name").alias("_name"), F.col("mcid").cast("string").alias("_pm"),
            F.col("error").alias("_pe"), F.lit(True).alias("_known"))
        b = b.join(props, [*PAGE, "_name"], "left")
    known = F.coalesce("_known", F.lit(False))
    stage, m = F.col("_stage"), F.col("_m")
    raw = F.when(stage == "inline", m["value"]).when(stage == "named", F.col("_pm"))
    integer = (
        F.when(stage == "inline", (m["type"] == "number") & raw.rlike(r"^[+-]?\d+$"))
        .otherwise(raw.rlike(r"^[+-]?\d+$"))
    )
    value = F.when(integer, raw.try_cast("bigint"))
    unclosed = (stage == "inline") & (_open_dict(F.col("_prop")) == 0)
    error = (
        F.when(stage == "none", F.lit("BDC has 0 of its 2 operands (a tag and a property list)"))
        .when(stage == "one", F.lit("BDC has 1 of its 2 operands (a tag and a property list)"))
        .when(
            stage == "no_tag",
            F.format_string(
                'BDC operand "%s" before the property list is not a tag name; property list not read',
                F.col("_tag")["value"],
            ),
        )
        .when(
            stage == "bad",
            F.format_string('BDC property list operand "%s" is not a dictionary or a name', F.col("_p")["value"]),
        )
        .when(
            (stage == "named") & ~known,
            F.format_string("property list /%s not found in /Resources /Properties", "_name"),
        )
        .when((stage == "named") & F.col("_pe").isNotNull(), F.col("_pe"))
        .when(value < 0, F.format_string("/MCID %d is negative", value))
        .when((stage == "inline") & ~integer, F.format_string("/MCID %s is not an integer", raw))
        .when((stage == "named") & ~integer, F.format_string("/MCID in property list /%s is not an integer", "_name"))
        .when(unclosed, F.lit("property-list dictionary has no closing >>"))
    )
    mcid = F.when(stage.isin("inline", "named") & (value >= 0), value).otherwise(F.lit(-1))
    no_mcid = stage.isin("inline", "named") & raw.isNull() & (
        (stage == "inline") | (known & F.col("_pe").isNull())
    )
    lone_name = (stage == "one") & (n == 1) & (F.col("_first")["type"] == "name")
    place = F.when(stage == "none", F.struct("stream_idx", "line", "col")).otherwise(
        F.when(
            stage == "one",
            F.struct(F.col("_first")["stream_idx"].alias("stream_idx"), F.col("_first")["line"].alias("line"), F.col("_first")["col"].alias("col")),
        ).otherwise(
            F.struct(F.col("_tag")["stream_idx"].alias("stream_idx"), F.col("_tag")["line"].alias("line"), F.col("_tag")["col"].alias("col"))
        )
    )
    tag = F.when(lone_name, F.col("_first")["value"]).when(
        ~stage.isin("none", "one", "no_tag"), F.col("_tag")["value"]
    )
    return b.select(
        *PAGE,
        "stream_idx",
        "tok_idx",
        (~no_mcid).alias("has_row"),
        F.regexp_replace(F.coalesce(tag, F.lit("")), "^/", "").alias("tag"),
        mcid.alias("mcid"),
        F.when(~no_mcid, error).alias("error"),
        place["stream_idx"].alias("at_stream"),
        place["line"].alias("at_line"),
        place["col"].alias("at_col"),
    )


def mcid_rows(
    tokens: DataFrame,
    properties: DataFrame | None = None,
    undecoded: DataFrame | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """BDC rows that carry an MCID, with ``depth`` and the enclosing ``parent_mcid``.

    The innermost enclosing MCID is found without pairing rows: at nesting level
    ``k`` of MCID-bearing sequences it is the latest one opened at that level.
    """
    return scan_groups(
        tokens, PAGE, lambda rows, scan: _mcid_rows(rows, properties, undecoded, scan, skew), skew
    )


def _mcid_rows(
    tokens: DataFrame,
    properties: DataFrame | None,
    undecoded: DataFrame | None,
    scan: WindowScan,
    skew: Skew,
) -> DataFrame:
    order, chunk = ["stream_idx", "tok_idx"], _position_chunk(skew)
    # Read for the events and, more than once, for the operands.
    tokens = materialize(tokens)
    delta = F.when(F.col("value").isin("BMC", "BDC"), 1).when(F.col("value") == "EMC", -1)
    events = (
        tokens.where((F.col("type") == "operator") & delta.isNotNull())
        .select(*STREAM, "tok_idx", "value")
        .join(_read_bdc(tokens, properties, undecoded, scan, skew), [*STREAM, "tok_idx"], "left")
    )
    deep = scan.clamped_depth(events, PAGE, order, chunk, delta, "depth", "_under")
    opens = F.col("value") != "EMC"
    carries = opens & F.coalesce(F.col("has_row") & (F.col("mcid") >= 0), F.lit(False))
    # Opens and the closes that end them meet at the level the open reached.
    level = F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1)
    leveled = deep.where("NOT _under").withColumn("_level", level).withColumn("_carries", carries)
    paired = scan.running(
        leveled, [*PAGE, "_level"], order, chunk, _opened=("last", F.when(opens, F.col("_carries")))
    )
    step = F.when(opens & F.col("_carries"), 1).when(~opens & F.coalesce("_opened", F.lit(False)), -1).otherwise(0)
    stacked = scan.running(paired, PAGE, order, chunk, _k=("sum", step.cast("bigint"))).where(opens)
    # At nesting k, an open asks what is on top of k - and gives itself as k + 1.
    carried = F.col("_carries")
    ask = F.struct((F.col("_k") - carried.cast("int")).alias("at"), F.lit(None).cast("bigint").alias("give"), F.lit(True).alias("ask"))
    give = F.struct(F.col("_k").alias("at"), F.col("mcid").alias("give"), F.lit(False).alias("ask"))
    both = stacked.withColumn("_r", F.explode(F.when(carried, F.array(ask, give)).otherwise(F.array(ask))))
    both = both.select("*", F.col("_r.at").alias("_at"), F.col("_r.give").alias("_give"), F.col("_r.ask").alias("_ask"))
    found = scan.running(both.drop("_r"), [*PAGE, "_at"], order, chunk, _parent=("last", F.col("_give")))
    return found.where("_ask AND has_row").select(
        *PAGE,
        "stream_idx",
        "tok_idx",
        "tag",
        "mcid",
        "depth",
        F.when(F.col("_at") > 0, F.col("_parent")).alias("parent_mcid"),
        "error",
        "at_stream",
        "at_line",
        "at_col",
    )


# --- colour ------------------------------------------------------------------

# Operators and names that set a device colour.
DEVICE_COLOR_OPS = ["rg", "RG", "k", "K", "g", "G"]
DEVICE_COLOR_NAMES = ["/DeviceRGB", "/DeviceCMYK", "/DeviceGray"]
MAX_NAMED_PARTS = 3


def uses_device_color(docs: DataFrame, tokens: DataFrame, unread: DataFrame) -> DataFrame:
    """``doc_id, used, reason``; ``used`` is NULL when an unread part may decide.

    ``tokens`` are those of the pages and of the forms they list. ``unread`` has ``doc_id, ord, part``: what could
    not be read, in reading order.
    """
    op, value = F.col("type") == "operator", F.col("value")
    hits = (
        tokens.where(
            (op & value.isin(DEVICE_COLOR_OPS)) | ((F.col("type") == "name") & value.isin(DEVICE_COLOR_NAMES))
        )
        .select("doc_id")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    named = first_k(unread, ["doc_id"], "ord", "part", MAX_NAMED_PARTS)
    reason = F.concat(
        F.lit("no device colour found in what was read, but could not read "), F.col("first"),
        F.when(F.col("n") > MAX_NAMED_PARTS, F.format_string(" and %d more", F.col("n") - MAX_NAMED_PARTS)).otherwise(""),
    )
    return docs.select("doc_id").join(hits, "doc_id", "left").join(named, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("_hit"), True).when(F.col("n") > 0, F.lit(None)).otherwise(False).alias("used"),
        F.when(F.col("_hit").isNull() & (F.col("n") > 0), reason).alias("reason"),
    )


def first_k(df: DataFrame, keys: list[str], order: str, value: str, k: int) -> DataFrame:
    """``keys, n, first``: group size and its first ``k`` values as one text.

    The row-number filter runs before the shuffle on each partition, so a huge
    group ships ``k`` rows per partition.
    """
    top = (
        df.select(*keys, order, value)
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order, value)))
        .where(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("string").alias("v")))).alias("_top"))
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(top, keys).select(
        *keys, "n", F.array_join(F.transform("_top", lambda x: x["v"]), ", ").alias("first")
    )
