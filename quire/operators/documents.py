"""Document-level questions: metadata, attachments, file state, recency, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import decode_name, normalize_text, xmp_value
from quire.operators.graph import NODE, NodeReader, first_sight, lookup_left
from quire.operators.objects import int_of, name_of
from quire.session import materialize

# Information keys; the last two are dates and stay raw.
INFO_TEXT_KEYS = ["Title", "Author", "Subject", "Keywords", "Creator", "Producer"]
INFO_DATE_KEYS = ["CreationDate", "ModDate"]
# Information keys and the XMP properties that must agree.
INFO_XMP_PAIRS = [
    ("Title", "dc:title"),
    ("Author", "dc:creator"),
    ("Subject", "dc:description"),
    ("Keywords", "pdf:Keywords"),
    ("Creator", "xmp:CreatorTool"),
    ("Producer", "pdf:Producer"),
]


def _no_path() -> Column:
    return F.array().cast("array<string>")


# --- metadata ----------------------------------------------------------------


def metadata(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Non-empty information entries, flat: ``doc_id, key, value``.

    Text keys are decoded, date keys are given as stored.
    """
    info = docs.where("info_id IS NOT NULL").select("doc_id", F.col("info_id").alias("obj_id"))
    rows = entries.where((F.size("path") == 1) & F.col("key").isin(INFO_TEXT_KEYS + INFO_DATE_KEYS))
    text = F.col("key").isin(INFO_TEXT_KEYS)
    stored = F.regexp_replace("value_raw", r"^\((.*)\)$", "$1")
    return (
        rows.join(info, ["doc_id", "obj_id"], "left_semi")
        .where("value_type = 'string'")
        .select("doc_id", "key", F.when(text, F.col("value")).otherwise(stored).alias("value"))
        .where("value <> ''")
    )


def info_map(info: DataFrame) -> DataFrame:
    """One map per document; at most eight keys each."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return info.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("info"))


def quote_ascii(s: Column) -> Column:
    r"""Double-quoted text with non-ASCII characters as \uXXXX or \UXXXXXXXX."""
    plain = s
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))

    def unit(c: Column) -> Column:
        cp = F.ascii(c)
        code = F.lower(F.hex(cp))
        return (
            F.when(cp < 0x80, c)
            .when(cp > 0xFFFF, F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))
            .otherwise(F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
        )

    spelled = F.array_join(F.transform(F.split(plain, ""), unit), "")
    body = F.when(plain.rlike(r"[^\x00-\x7F]"), spelled).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def info_vs_xmp(info: DataFrame, xmp: DataFrame) -> DataFrame:
    """Entries that differ from their XMP property: ``doc_id, key, info, xmp, message``.

    ``info`` has ``doc_id, key, value``; ``xmp`` has ``doc_id, xmp``. A side that
    is empty or ambiguous is skipped; dates are never compared.
    """
    pairs = F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(p).alias("prop"), normalize_text(xmp_value(F.col("xmp"), p)).alias("xv"))
        for k, p in INFO_XMP_PAIRS])
    theirs = xmp.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*").where("xv <> ''")
    ours = info.select("doc_id", "key", normalize_text(F.col("value")).alias("iv")).where("iv <> ''")
    both = ours.join(theirs, ["doc_id", "key"]).where("iv <> xv")
    return both.select(
        "doc_id", "key", F.col("iv").alias("info"), F.col("xv").alias("xmp"),
        F.concat(F.lit("/Info /"), "key", F.lit(" ("), quote_ascii(F.col("iv")), F.lit(") differs from XMP "), "prop",
                 F.lit(" ("), quote_ascii(F.col("xv")), F.lit(")")).alias("message"))


# --- name trees and attachments ----------------------------------------------


def name_tree(entries: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Values of a name tree: ``doc_id, ord, ref_id, obj_id, at``.

    ``roots`` has ``doc_id, obj_id``. A node is read once, where a depth-first reader
    meets it first, so every walk ends; malformed parts are skipped, and nodes below ``max_depth`` if it is given.
    """
    reader = NodeReader(entries)
    kid = F.coalesce("target_type", "value_type") == "dict"
    links = reader.array("Kids").all().where(kid).select(
        *NODE, F.col("item_obj").alias("to_obj_id"), F.col("item_at").alias("to_at"), F.array("idx").alias("step"))
    starts = roots.select("doc_id", "obj_id", _no_path().alias("at"), F.array().cast("array<bigint>").alias("label"))
    met = first_sight(links, starts, ["obj_id", "at"], max_steps=max_depth).withColumnRenamed("label", "ord")
    found = reader.items(met, "Names", resolve=True).where(
        (F.col("idx") % 2 == 1) & (F.coalesce("target_type", "value_type").isin("dict", "stream")))
    return found.select(
        "doc_id", F.concat("ord", F.array(F.lit(-1).cast("bigint"), "idx")).alias("ord"), "ref_id",
        F.col("item_obj").alias("obj_id"), F.col("item_at").alias("at"))


def merge_sources(first: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of both, each referenced file once, the first source winning.

    Both have ``doc_id, ref_id, ord`` and more. Rows without a reference are never
    merged.
    """
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    rest = [c for c in both.columns if c not in ("doc_id", "ref_id")]
    named = both.where("ref_id IS NOT NULL").groupBy("doc_id", "ref_id").agg(
        F.min_by(F.struct(*rest), F.struct("source", order)).alias("_r")).select("doc_id", "ref_id", "_r.*")
    return both.where("ref_id IS NULL").unionByName(named)


def embedded_files(entries: DataFrame, specs: DataFrame) -> DataFrame:
    """Facts of each file specification.

    ``specs`` has ``doc_id, ref_id, obj_id, at``. Rows carry a warning instead of
    being dropped when a part is broken.
    """
    reader = NodeReader(entries)
    d = reader.keys(specs, ["UF", "F", "AFRelationship", "EF"])
    text = lambda k: F.when(F.col(k)["value_type"] == "string", F.nullif(F.col(k)["value"], F.lit("")))
    d = d.select(
        *NODE, F.col("ref_id").alias("filespec_ref"), F.coalesce(text("UF"), text("F"), F.lit("")).alias("name"),
        F.coalesce(name_of("AFRelationship"), F.lit("")).alias("relationship"), F.col("EF").isNotNull().alias("_ef"),
        F.coalesce(F.col("EF")["ref_id"], "obj_id").alias("_eo"),
        F.when(F.col("EF")["ref_id"].isNull(), F.array_append("at", F.lit("EF"))).otherwise(_no_path()).alias("_ea"))
    ef = reader.keys(d.where("_ef").select("doc_id", F.col("_eo").alias("obj_id"), F.col("_ea").alias("at")).distinct(), ["F", "UF"]).select(
        "doc_id", F.col("obj_id").alias("_eo"), F.col("at").alias("_ea"),
        F.coalesce(F.col("F")["ref_id"], F.col("UF")["ref_id"]).alias("file_ref"))
    d = materialize(d.join(ef, ["doc_id", "_eo", "_ea"], "left"))
    streams = d.where("file_ref IS NOT NULL").select("doc_id", F.col("file_ref").alias("obj_id"), _no_path().alias("at")).distinct()
    body = reader.keys(streams, ["Subtype", "Params", "Length"])
    params = reader.keys(
        body.where("Params IS NOT NULL").select(
            "doc_id", F.col("obj_id").alias("file_ref"), F.coalesce(F.col("Params")["ref_id"], "obj_id").alias("obj_id"),
            F.when(F.col("Params")["ref_id"].isNull(), F.array(F.lit("Params"))).otherwise(_no_path()).alias("at")),
        ["Size", "CheckSum", "ModDate"],
    ).select("doc_id", "file_ref", int_of("Size").alias("_size"), F.col("CheckSum")["value_raw"].alias("checksum"),
             F.col("ModDate")["value_raw"].alias("mod_date"))
    body = body.select("doc_id", F.col("obj_id").alias("file_ref"), name_of("Subtype").alias("_sub"), int_of("Length").alias("_len"))
    kinds = reader.roots.select("doc_id", F.col("ref_id").alias("file_ref"), F.col("target_type").alias("_kind"))
    key = ["doc_id", "file_ref"]
    joined = lookup_left(d, kinds.join(body, key, "left").join(params, key, "left"), key)
    warning = (
        F.when(F.col("file_ref").isNull(), "filespec has no /EF embedded-file stream")
        .when(F.col("_kind").isNull() | (F.col("_kind") == "null"), "embedded-file stream could not be resolved")
        .when(F.col("_kind") != "stream", "embedded-file target is not a stream")
    )
    ok = warning.isNull()
    declared = F.when(F.col("_size") >= 0, F.col("_size")).otherwise(F.lit(0))
    length = F.when(F.col("_len") >= 0, F.col("_len")).otherwise(F.lit(0))
    return joined.select(
        "doc_id", "filespec_ref", "name", "relationship", "file_ref",
        F.when(ok, F.coalesce(decode_name(F.col("_sub")), F.lit(""))).otherwise("").alias("mime"),
        F.when(ok, F.when(F.coalesce(declared, F.lit(0)) != 0, declared).otherwise(F.coalesce(length, F.lit(0)))).otherwise(F.lit(0)).cast("bigint").alias("size"),
        F.when(ok, F.col("checksum")).alias("checksum"), F.when(ok, F.col("mod_date")).alias("mod_date"), warning.alias("warning"))


def select_unique(requests: DataFrame, rows: DataFrame, usable: Column) -> DataFrame:
    """Exactly one row by name, or why not: ``doc_id, name, status, n, ref_id``.

    ``requests`` has ``doc_id, name``; ``rows`` has ``doc_id, name, ref_id``.
    ``status`` is ``ok``, ``none``, ``several`` or ``unusable``; nothing is ever
    picked silently.
    """
    found = rows.groupBy("doc_id", "name").agg(
        F.count(F.lit(1)).alias("_n"), F.max(usable).alias("_ok"), F.min("ref_id").alias("_ref"))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "none").when(n > 1, "several").when(~F.col("_ok"), "unusable").otherwise("ok")
    return requests.join(found, ["doc_id", "name"], "left").select(
        "doc_id", "name", status.alias("status"), n.alias("n"), F.when(status == "ok", F.col("_ref")).alias("ref_id"))


# --- files on disk -----------------------------------------------------------


def disk_status(baseline: DataFrame, listing: DataFrame) -> DataFrame:
    """State of each file since it was loaded: ``path, state, loaded_mtime, disk_mtime, disk_size``.

    Both inputs have ``path, size, mtime``. An older time is a change too. Times
    are milliseconds, 0 when the file is missing.
    """
    now = listing.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    ms = lambda c: F.unix_millis(F.col(c))
    gone = F.col("_size").isNull()
    return baseline.join(now, "path", "left").select(
        "path",
        F.when(gone, "missing").when((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "current")
        .otherwise("changed").alias("state"),
        ms("mtime").alias("loaded_mtime"),
        F.coalesce(ms("_mtime"), F.lit(0)).alias("disk_mtime"),
        F.coalesce("_size", F.lit(0)).alias("disk_size"))


def recents(events: DataFrame, k: int, user: str = "user_id", item: str = "item", ts: str = "ts") -> DataFrame:
    """The ``k`` latest distinct items of each user, most recent first."""
    last = events.groupBy(user, item).agg(F.max(ts).alias("last_ts"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last_ts"), item))
    return last.withColumn("rank", rank).where(F.col("rank") <= k)


def stage_budget(stages: DataFrame, limit: int) -> DataFrame:
    """Streams over budget, or not fully measured.

    ``stages`` has ``doc_id, obj_id, stage, filter, size`` (NULL: unmeasured). A
    stage of unknown size leaves the later ones unmeasured: they do not convict.
    """
    first_gap = F.min(F.when(F.col("size").isNull(), F.col("stage")))
    gaps = stages.groupBy("doc_id", "obj_id").agg(
        first_gap.alias("_gap"), F.min_by("filter", F.when(F.col("size").isNull(), F.col("stage"))).alias("first_unmeasured"))
    measured = F.col("_gap").isNull() | (F.col("stage") < F.col("_gap"))
    return stages.join(gaps, ["doc_id", "obj_id"]).groupBy("doc_id", "obj_id").agg(
        F.coalesce(F.max(measured & (F.col("size") > limit)), F.lit(False)).alias("over_budget"),
        (F.max("_gap").isNull()).alias("measured"),
        F.max("first_unmeasured").alias("first_unmeasured"))
