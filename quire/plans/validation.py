"""Rule profiles over a corpus.

A rule gives findings ``(doc_id, rule_id, obj_id, message)`` and, separately,
the documents it could not decide ``(doc_id, rule_id, reason)``. Not evaluated
is neither a pass nor a failure. Severity belongs to the rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.documents import info_vs_xmp
from quire.operators.objects import forbidden_actions, non_embedded_fonts
from quire.operators.scan import DEFAULT_SKEW, Skew
from quire.operators.structure import duplicate_keys, labels_by_key
from quire.session import materialize

PDFA = "pdfa-1b"
UA = "pdfua-1-structural"

# The rule registry, in order (id, profile, severity, clause).
RULES = [
    ("font-embedding", PDFA, "error", "ISO 19005-1:2005, 6.3.4"),
    ("no-encryption", PDFA, "error", "ISO 19005-1:2005, 6.1.3"),
    ("output-intent", PDFA, "error", "ISO 19005-1:2005, 6.2.2"),
    ("no-js-launch", PDFA, "error", "ISO 19005-1:2005, 6.6.1"),
    ("xmp-metadata", PDFA, "error", "ISO 19005-1:2005, 6.7.2/6.7.3"),
    ("document-id", PDFA, "error", "ISO 19005-1:2005, 6.1.3"),
    ("marked", UA, "warning", "ISO 14289-1:2014, 7.1"),
    ("struct-tree-root", UA, "warning", "ISO 14289-1:2014, 7.1"),
    ("lang", UA, "warning", "ISO 14289-1:2014, 7.2"),
    ("marked-content-balance", UA, "warning", "ISO 14289-1:2014, 7.1; ISO 32000-1:2008, 14.6.1"),
    ("mcid-unique", UA, "warning", "ISO 14289-1:2014, 7.1; ISO 32000-1:2008, 14.7.4.2"),
    ("mcid-in-parent-tree", UA, "error", "ISO 14289-1:2014, 7.1; ISO 32000-1:2008, 14.7.4.4"),
    ("mcid-not-nested", UA, "warning", "ISO 14289-1:2014, 7.1; ISO 32000-1:2008, 14.7.4.1"),
    ("struct-elem-type", UA, "error", "ISO 14289-1:2014, 7.1; ISO 32000-1:2008, 14.7.2"),
]
ENCRYPTED_MESSAGE = "document is encrypted (PDF/A forbids encryption)"
PAGE = ["doc_id", "page_num"]


def rule_table(spark: SparkSession, profile: str) -> DataFrame:
    """The rules of a profile: fourteen rows at most, so joins may broadcast it."""
    rows = [(i, *r) for i, r in enumerate(RULES) if r[1] == profile]
    if not rows:
        raise ValueError(f"unknown profile {profile!r}; known: {PDFA}, {UA}")
    return spark.createDataFrame(rows, "rule_order int, rule_id string, profile string, severity string, spec_ref string")


def _finding(df: DataFrame, rule: str, message: Column, obj: Column | None = None) -> DataFrame:
    target = F.lit(None).cast("string") if obj is None else obj
    return df.select("doc_id", F.lit(rule).alias("rule_id"), target.alias("obj_id"), message.alias("message"))


def _unevaluated(df: DataFrame, rule: str, reason: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule_id"), reason.alias("reason"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- archive rules -----------------------------------------------------------


def font_embedding(entries: DataFrame) -> DataFrame:
    fonts = non_embedded_fonts(entries)
    return _finding(fonts, "font-embedding", F.concat(F.lit("font /"), "label", F.lit(" is not embedded")), F.col("obj_id"))


def no_encryption(docs: DataFrame) -> DataFrame:
    return _finding(
        docs.where("encrypted"), "no-encryption",
        F.lit("document is encrypted (/Encrypt present; PDF/A forbids encryption)"))


def output_intent(intents: DataFrame, color: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``intents`` lists documents that declare one; ``color`` is ``uses_device_color``."""
    asked = color.join(intents.select("doc_id").distinct(), "doc_id", "left_anti")
    text = "document uses device color but declares no /OutputIntent (device-independent color / OutputIntent required)"
    return (
        _finding(asked.where("used"), "output-intent", F.lit(text)),
        _unevaluated(asked.where("used IS NULL"), "output-intent", F.col("reason")),
    )


def no_js_launch(entries: DataFrame, catalogs: DataFrame) -> DataFrame:
    rows = forbidden_actions(entries, catalogs)
    direct = F.col("where") == "OpenAction"
    return _finding(
        rows, "no-js-launch",
        F.when(direct, F.concat("kind", F.lit(" action present in catalog /OpenAction (forbidden in PDF/A)")))
        .otherwise(F.concat("kind", F.lit(" action present (forbidden in PDF/A)"))),
        F.when(~direct, F.col("obj_id")))


def xmp_metadata(docs: DataFrame, xmp: DataFrame, info: DataFrame) -> DataFrame:
    present = xmp.where(F.trim("xmp") != "")
    missing = docs.select("doc_id").join(present.select("doc_id"), "doc_id", "left_anti")
    return _union(
        _finding(missing, "xmp-metadata", F.lit("XMP metadata packet is missing (/Metadata)")),
        _finding(info_vs_xmp(info, present), "xmp-metadata", F.col("message")))


def document_id(docs: DataFrame) -> DataFrame:
    return _finding(docs.where("NOT has_file_id"), "document-id", F.lit("document /ID is missing from the trailer"))


# --- accessibility rules -----------------------------------------------------


def marked(header: DataFrame) -> DataFrame:
    bad = header.where(~F.coalesce("marked", F.lit(False)))
    return _finding(bad, "marked", F.lit("document is not marked as tagged (/MarkInfo /Marked true absent)"))


def struct_tree_root(header: DataFrame) -> DataFrame:
    text = "document has no structure tree root (/StructTreeRoot absent, null or a reference to a missing object)"
    return _finding(header.where("NOT has_tree"), "struct-tree-root", F.lit(text))


def lang(header: DataFrame) -> DataFrame:
    return _finding(
        header.where("lang = ''"), "lang", F.lit("document /Lang is missing (no default natural language)"))


def _first_bad(streams: DataFrame) -> DataFrame:
    """First undecodable stream of each page that has one."""
    return streams.where("error IS NOT NULL").groupBy(*PAGE).agg(F.min("stream_idx").alias("_bad"))


def _location(streams: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with ``loc``: where their tag stands."""
    named = streams.select(*PAGE, F.col("stream_idx").alias("at_stream"), F.col("ref").alias("_ref"))
    loc = F.concat(
        F.lit("stream "), F.coalesce("_ref", F.lit("?")), F.lit(" line "), F.col("at_line").cast("string"),
        F.lit(" col "), F.col("at_col").cast("string"))
    return rows.join(named, [*PAGE, "at_stream"], "left").withColumn("loc", loc).drop("_ref")


def marked_content_balance(pages: DataFrame, streams: DataFrame, balance: DataFrame) -> DataFrame:
    """``pages`` has ``doc_id, page_num, ref, error``; ``streams`` has ``doc_id,
    page_num, stream_idx, ref, error``; ``balance`` is ``marked_balance``.

    Nothing is judged from a page's first undecodable stream on.
    """
    page = F.col("page_num")
    unread = _finding(
        pages.where("error IS NOT NULL"), "marked-content-balance",
        F.format_string("page %d content could not be read (%s); marked content not checked", page, "error"), F.col("ref"))
    undecoded = _finding(
        streams.where("error IS NOT NULL"), "marked-content-balance",
        F.format_string(
            "content stream %s of page %d could not be decoded (%s); its marked content was not checked", "ref", page, "error"),
        F.col("ref"))
    refs = pages.select(*PAGE, F.col("ref").alias("page_ref"), F.col("error").alias("page_error"))
    judged = balance.join(streams.select(*PAGE, "stream_idx", "ref"), [*PAGE, "stream_idx"]).join(
        _first_bad(streams), PAGE, "left").join(refs, PAGE)
    under = _finding(
        judged.where("min_depth < 0 AND (_bad IS NULL OR stream_idx < _bad)"), "marked-content-balance",
        F.format_string("page %d: EMC with no open marked-content sequence (in content stream %s)", page, "ref"), F.col("page_ref"))
    ends = judged.where("_bad IS NULL AND page_error IS NULL").groupBy(*PAGE, "page_ref").agg(
        F.max_by("depth_at_end", "stream_idx").alias("open")).where("open > 0")
    left_open = _finding(
        ends, "marked-content-balance",
        F.format_string("page %d: %d marked-content sequence(s) still open at the end of the page's content", page, "open"),
        F.col("page_ref"))
    return _union(unread, undecoded, under, left_open)


def mcid_unique(streams: DataFrame, mcids: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``mcids`` is ``mcid_rows``; each repeated number lists all its places."""
    # Counted and listed: read twice.
    placed = materialize(_location(streams, mcids.where("mcid >= 0")))
    dup = duplicate_keys(
        placed, [*PAGE, "mcid"], ["stream_idx", "tok_idx"], F.col("loc"), skew)
    return _finding(
        dup, "mcid-unique",
        F.format_string("page %d: MCID %d marks %d BDC sequences: %s", "page_num", "mcid", "n", "labels"))


def mcid_not_nested(streams: DataFrame, mcids: DataFrame) -> DataFrame:
    nested = _location(streams, mcids.where("mcid >= 0 AND parent_mcid IS NOT NULL")).join(_first_bad(streams), PAGE, "left")
    return _finding(
        nested.where("_bad IS NULL OR stream_idx < _bad"), "mcid-not-nested",
        F.format_string("page %d: MCID %d (%s) is nested inside MCID %d", "page_num", "mcid", "loc", "parent_mcid"))


def mcid_in_parent_tree(
    pages: DataFrame, streams: DataFrame, mcids: DataFrame, errors: DataFrame, slots: DataFrame,
    incomplete: DataFrame | None = None, skew: Skew = DEFAULT_SKEW,
) -> tuple[DataFrame, DataFrame]:
    """Content that reaches no structure element.

    ``pages`` has ``doc_id, page_num, ref, error, struct_parents``; ``errors`` and
    ``slots`` come from ``page_parent_tree``; ``incomplete`` has ``doc_id,
    message``: parent trees not read in full, whose documents are not evaluated.
    """
    rule = "mcid-in-parent-tree"
    if incomplete is not None:
        skip = incomplete.select("doc_id").distinct()
        pages, streams, mcids = (t.join(skip, "doc_id", "left_anti") for t in (pages, streams, mcids))
    unread = _finding(
        pages.where("error IS NOT NULL"), rule,
        F.format_string("page %d content could not be read (%s); its MCIDs were not checked against the ParentTree", "page_num", "error"),
        F.col("ref"))
    undecoded = _finding(
        streams.where("error IS NOT NULL"), rule,
        F.format_string(
            "content stream %s of page %d could not be decoded (%s); its MCIDs were not checked against the ParentTree",
            "ref", "page_num", "error"), F.col("ref"))
    causes = pages.select(*PAGE, F.col("ref").alias("page_ref"), "struct_parents").join(
        errors.select(*PAGE, F.col("error").alias("_tree_error")), PAGE, "left").withColumn(
        "cause", F.coalesce("_tree_error", F.when(F.col("struct_parents").isNull(), F.lit("page has no /StructParents"))))
    placed = materialize(_location(streams, mcids))
    unreadable = _finding(
        placed.where("mcid < 0"), rule,
        F.format_string("page %d: BDC at %s has no readable MCID (%s); not checked against the ParentTree", "page_num", "loc", "error"))
    readable = placed.where("mcid >= 0").join(causes, PAGE)
    page_wide = readable.where("cause IS NOT NULL").select(*PAGE, "page_ref", "cause", "mcid").distinct()
    listed = labels_by_key(
        page_wide, [*PAGE, "page_ref", "cause"], ["mcid"], F.col("mcid").cast("string"), 1, skew)
    whole = _finding(
        listed, rule, F.format_string("page %d: MCIDs %s not reachable: %s", "page_num", "labels", "cause"), F.col("page_ref"))
    good = slots.where("error IS NULL AND element IS NOT NULL").select(*PAGE, "mcid").distinct()
    broken = slots.where("error IS NOT NULL").groupBy(*PAGE, "mcid").agg(F.first("error").alias("slot_error"))
    lost = readable.where("cause IS NULL").join(good, [*PAGE, "mcid"], "left_anti").select(
        *PAGE, "mcid", "struct_parents", "page_ref", "stream_idx", "tok_idx", "loc")
    lost = labels_by_key(
        lost, [*PAGE, "mcid", "struct_parents", "page_ref"], ["stream_idx", "tok_idx"], F.col("loc"), 1, skew
    ).join(broken, [*PAGE, "mcid"], "left")
    single = _finding(
        lost, rule,
        F.concat(
            F.format_string("page %d: MCID %d (%s) has no structure element in ParentTree key %d", "page_num", "mcid", "labels", "struct_parents"),
            F.coalesce(F.concat(F.lit(": "), "slot_error"), F.lit(""))),
        F.col("page_ref"))
    found = _union(unread, undecoded, unreadable, whole, single)
    if incomplete is None:
        return found, _unevaluated(pages.where("false"), rule, F.lit(""))
    return found, _unevaluated(
        incomplete, rule,
        F.concat(F.lit("the ParentTree could not be read in full, so its entries are unknown: "), "message"))


def struct_elem_type(tree: DataFrame) -> DataFrame:
    """``tree`` is ``struct_tree``: elements with no usable /S."""
    owner = F.when(F.col("owner_id") == "", "the structure tree root").otherwise(F.col("owner_id"))
    at = F.concat(F.lit("/K index "), F.col("idx").cast("string"), F.lit(" of "), owner)
    name = F.when(F.col("ref_id").isNotNull(), F.concat(F.lit("structure element "), "ref_id")).otherwise(
        F.concat(F.lit("direct structure element at "), at))
    return _finding(
        tree.where("kind = 'element' AND s_error IS NOT NULL"), "struct-elem-type",
        F.concat(name, F.lit(" has no usable /S ("), "s_error", F.lit(")")), F.col("ref_id"))


# --- running a profile -------------------------------------------------------


def validate(
    docs: DataFrame, profile: str, findings: list[DataFrame], unevaluated: list[DataFrame] | None = None,
    sealed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``problems, outcomes, summary`` of every document under a profile.

    ``findings`` and ``unevaluated`` are the outputs of the rule functions. A rule
    not evaluated for a document gives one info problem and no findings there.
    ``sealed`` lists documents that could not be opened because they are
    encrypted: under the archive profile they get that single problem.
    """
    rules = F.broadcast(rule_table(docs.sparkSession, profile))
    spark = docs.sparkSession
    skipped = _union(*unevaluated) if unevaluated else spark.createDataFrame([], "doc_id string, rule_id string, reason string")
    found = _union(*findings).join(rules.select("rule_id"), "rule_id", "left_semi")
    skipped = skipped.join(rules.select("rule_id"), "rule_id", "left_semi")
    found = found.join(skipped.select("doc_id", "rule_id").distinct(), ["doc_id", "rule_id"], "left_anti")
    opened = docs.select("doc_id")
    grid_rules = rules.select("rule_id", "rule_order", "severity")
    if sealed is not None:
        shut = sealed.select("doc_id").distinct()
        opened = opened.join(shut, "doc_id", "left_anti")
        found = found.join(shut, "doc_id", "left_anti")
        skipped = skipped.join(shut, "doc_id", "left_anti")
        if profile == PDFA:
            found = found.unionByName(_finding(shut, "no-encryption", F.lit(ENCRYPTED_MESSAGE)))
    found, skipped = materialize(found), materialize(skipped)
    hits = found.join(rules, "rule_id").select("doc_id", "rule_order", "rule_id", "severity", "message", "obj_id", "spec_ref")
    notes = skipped.join(rules, "rule_id").select(
        "doc_id", "rule_order", "rule_id", F.lit("info").alias("severity"),
        F.concat(F.lit('rule "'), "rule_id", F.lit('" could not be evaluated: '), "reason").alias("message"),
        F.lit(None).cast("string").alias("obj_id"), "spec_ref")
    problems = hits.unionByName(notes)
    # Every document meets every rule of the profile: at most eight rows each.
    listed = F.array(*[F.lit(r[0]) for r in RULES if r[1] == profile])
    grid = opened.select("doc_id", F.explode(listed).alias("rule_id"))
    if sealed is not None and profile == PDFA:
        grid = grid.unionByName(sealed.select("doc_id").distinct().withColumn("rule_id", F.lit("no-encryption")))
    counts = found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("_n"))
    missed = skipped.select("doc_id", "rule_id", F.lit(True).alias("_skip")).distinct()
    outcomes = (
        grid.join(grid_rules, "rule_id").join(counts, ["doc_id", "rule_id"], "left").join(missed, ["doc_id", "rule_id"], "left")
        .select("doc_id", "rule_order", "rule_id", "severity", F.col("_skip").isNull().alias("evaluated"), F.coalesce("_n", F.lit(0)).alias("findings")))
    return problems, outcomes, rule_summary(docs, problems)


def rule_summary(docs: DataFrame, problems: DataFrame) -> DataFrame:
    """``doc_id, errors, warnings, info``, zero rows included."""
    tally = problems.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))])
    return docs.select("doc_id").join(tally, "doc_id", "left").na.fill(0)


def gate(summary: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``doc_id, exit_code``: 1 on an error problem or an error rule not evaluated."""
    undecided = outcomes.where("NOT evaluated AND severity = 'error'").select("doc_id").distinct().withColumn("_open", F.lit(True))
    fails = (F.col("errors") > 0) | F.col("_open").isNotNull()
    return summary.join(undecided, "doc_id", "left").select("doc_id", fails.cast("int").alias("exit_code"))
