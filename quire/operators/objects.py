"""Projections and lookups over object tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clamp_display
from quire.functions.values import display_steps, path_join

OBJ = ["doc_id", "obj_id"]
TREE_VALUE_CAP = 80


# --- views over entries ------------------------------------------------------


def root_rows(entries: DataFrame) -> DataFrame:
    """The row of each object's own value."""
    return entries.where(F.size("path") == 0)


def edges(entries: DataFrame) -> DataFrame:
    """One row per stored reference."""
    return entries.where("ref_id IS NOT NULL").select(
        "doc_id",
        F.col("obj_id").alias("src_id"),
        F.col("ref_id").alias("dst_id"),
        path_join(display_steps(F.col("path"))).alias("path"),
        F.col("path").alias("ord"),
    )


def pivot_keys(entries: DataFrame, keys: list[str], at: list[str] | None = None) -> DataFrame:
    """One row per object with the named entries of its dictionary as structs.

    ``at`` is the path of a dictionary inside the object, the object itself by
    default. A column is NULL when the entry is absent.
    """
    parent = F.array(*[F.lit(p) for p in at]) if at else F.array().cast("array<string>")
    value = F.struct("value_type", "value_raw", "value", "num", "ref_id")
    return (
        entries.where((F.size("path") == len(at or []) + 1) & (F.col("parent_path") == parent))
        .where(F.col("key").isin(keys))
        .groupBy(*OBJ)
        .agg(*[F.max(F.when(F.col("key") == k, value)).alias(k) for k in keys])
    )


def name_of(value: str) -> Column:
    """The text of a pivoted entry when it is a name."""
    return F.when(F.col(value)["value_type"] == "name", F.col(value)["value"])


def int_of(value: str) -> Column:
    """A pivoted entry when it is an integer number."""
    v = F.col(value)
    return F.when(
        (v["value_type"] == "number") & v["value_raw"].rlike(r"^[+-]?\d+$"),
        v["value_raw"].try_cast("bigint"),
    )


def dereference(rows: DataFrame, entries: DataFrame, ref: str = "ref_id") -> DataFrame:
    """Follow one reference: adds ``target_type``, ``target_value`` and ``dangling``.

    A direct value (NULL reference) passes through; a dangling one has no target
    and says so, so that a reader may keep the reference itself.
    """
    targets = root_rows(entries).select(
        "doc_id", F.col("obj_id").alias(ref), F.col("value_type").alias("target_type"), F.col("value").alias("target_value"))
    return rows.join(targets, ["doc_id", ref], "left").withColumn(
        "dangling", F.col(ref).isNotNull() & F.col("target_type").isNull())


# --- classification ----------------------------------------------------------


def classify_value(entries: DataFrame) -> DataFrame:
    """``node_type, value_type, has_children, child_count`` of every value.

    A container counts its entries, a reference has -1, a scalar 0.
    """
    counts = (
        entries.where(F.size("path") > 0)
        .groupBy(*OBJ, F.col("parent_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    container = F.col("value_type").isin("dict", "stream", "array")
    ref = F.col("ref_id").isNotNull()
    return entries.join(counts, [*OBJ, "path"], "left").select(
        *OBJ,
        "path",
        F.when(ref, "ref").when(container, F.col("value_type")).otherwise("scalar").alias("node_type"),
        F.when(ref, "reference").when(container, "").otherwise(F.col("value_type")).alias("value_type"),
        (ref | container).alias("has_children"),
        F.when(ref, F.lit(-1)).when(container, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))
        .cast("bigint").alias("child_count"),
    )


# Keys that are their own label.
KEY_LABELS = [
    "Pages", "Page", "Resources", "Contents",
    "MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "XObject",
]
# Labels by /Type and by /Subtype.
TYPE_LABELS = ["Pages", "Page", "Catalog"]
SUBTYPE_LABELS = {"Image": "Image", "Form": "Form XObject"}


def semantic_label(
    key: Column, type_name: Column, subtype: Column, base_font: Column,
    value_type: Column, text: Column,
) -> Column:
    """Label by key, then type, then subtype, then key, then the scalar itself."""
    font = F.when(base_font.isNotNull(), F.concat(F.lit("Font: "), base_font)).otherwise("Font")
    by_subtype = F.coalesce(
        *[F.when(subtype == k, F.lit(v)) for k, v in SUBTYPE_LABELS.items()]
    )
    container = value_type.isin("dict", "stream", "array")
    return F.coalesce(
        F.when(key.isin(KEY_LABELS), key),
        F.when((key == "Font") | (type_name == "Font"), font),
        F.when(type_name.isin(TYPE_LABELS), type_name),
        by_subtype,
        F.when(key != "", key),
        F.when(container, F.lit("")).otherwise(clamp_display(text, TREE_VALUE_CAP)),
    )


def children(entries: DataFrame, objects: DataFrame, path: list[str] | None = None) -> DataFrame:
    """One level below each listed object, with its position among its siblings.

    ``objects`` has ``doc_id, obj_id``. Rows come flat; order by ``key, idx``.
    """
    parent = F.array(*[F.lit(p) for p in path]) if path else F.array().cast("array<string>")
    level = entries.where((F.size("path") == len(path or []) + 1) & (F.col("parent_path") == parent))
    return level.join(objects.select(*OBJ).distinct(), OBJ, "left_semi")


def object_detail(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Flat property rows of the listed objects: shown value, stored value, target.

    The display falls back to the stored form when nothing was decoded. The
    stored form is given only where it adds something.
    """
    rows = children(entries, objects)
    shown = F.coalesce("value", "value_raw", F.lit(""))
    return rows.select(
        *OBJ,
        "key",
        "idx",
        "value_type",
        shown.alias("display"),
        F.when(
            (F.col("value_raw") != shown) & (F.col("value_raw") != F.concat(F.lit("("), shown, F.lit(")"))),
            F.col("value_raw"),
        ).alias("raw"),
        F.col("ref_id").alias("target"),
    )


def stream_facts(entries: DataFrame) -> DataFrame:
    """``length`` (NULL when unreadable) and ``filters`` of each stream object.

    A length behind a reference is followed.
    """
    streams = root_rows(entries).where("value_type = 'stream'").select(*OBJ)
    facts = pivot_keys(entries, ["Length", "Filter"])
    roots = root_rows(entries).select(
        "doc_id", F.col("obj_id").alias("_length_ref"), F.col("value_raw").alias("_raw")
    )
    listed = (
        entries.where((F.size("path") == 2) & (F.col("parent_path")[0] == "Filter"))
        .groupBy(*OBJ)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("_filters"))
    )
    joined = streams.join(facts, OBJ, "left").withColumn("_length_ref", F.col("Length")["ref_id"])
    followed = joined.join(roots, ["doc_id", "_length_ref"], "left")
    raw = F.coalesce(F.col("_raw"), F.col("Length")["value_raw"])
    return followed.join(listed, OBJ, "left").select(
        *OBJ,
        F.when(raw.rlike(r"^\d+$"), raw.try_cast("bigint")).alias("length"),
        F.coalesce(
            F.col("_filters"),
            F.when(F.col("Filter")["value_type"] == "name", F.array(F.col("Filter")["value"])),
            F.array().cast("array<string>"),
        ).alias("filters"),
    )


# --- finding objects ---------------------------------------------------------

_NUMERIC = r"^(\d+)(?:\s+(\d+)(?:\s+[Rr])?)?$"
_WORD = r"^[A-Za-z][A-Za-z0-9]*$"


def parse_query(query: Column) -> Column:
    """``struct<kind, num, gen, value, exact>`` of a search box text."""
    trimmed = F.trim(query)
    body = F.when(
        trimmed.startswith("(") & trimmed.endswith(")") & (F.char_length(trimmed) > 1),
        F.trim(F.substr(trimmed, F.lit(2), F.char_length(trimmed) - 2)),
    ).otherwise(trimmed)
    name = F.trim(F.substr(body, F.lit(2)))
    numeric, slash = body.rlike(_NUMERIC), body.startswith("/")
    kind = (
        F.when(trimmed == "", "empty")
        .when(numeric, "numeric")
        .when(slash & name.rlike(_WORD), "type")
        .when(~slash & body.rlike(_WORD), "type")
        .otherwise("invalid")
    )
    gen = F.regexp_extract(body, _NUMERIC, 2)
    return F.struct(
        kind.alias("kind"),
        F.when(numeric, F.regexp_extract(body, _NUMERIC, 1).try_cast("bigint")).alias("num"),
        F.when(numeric & (gen != ""), gen.try_cast("bigint")).alias("gen"),
        F.when(kind == "type", F.lower(F.when(slash, name).otherwise(body))).alias("value"),
        (slash & (kind == "type")).alias("exact"),
    )


def find_object(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Every index row a query matches, with its tier (0 exact, 1 prefix).

    ``queries`` has ``query``; ``index`` has ``doc_id, obj_num, gen, type_name,
    reachable``. Both joins are equi-joins: a prefix query meets the prefixes of
    the type names, of which there are few.
    """
    parsed = queries.select("query", parse_query(F.col("query")).alias("q")).select("query", "q.*")
    numeric = (
        parsed.where("kind = 'numeric'")
        .withColumnRenamed("gen", "_gen")
        .join(index, F.col("num") == F.col("obj_num"))
        .where("_gen IS NULL OR _gen = gen")
        .select("query", *index.columns, F.lit(0).alias("tier"))
    )
    names = index.where("type_name <> ''").select("type_name").distinct()
    prefixes = names.select(
        "type_name",
        F.explode(F.sequence(F.lit(1), F.char_length("type_name"))).alias("_n"),
    ).select("type_name", F.lower(F.left("type_name", "_n")).alias("_prefix"))
    hits = (
        parsed.where("kind = 'type'")
        .join(prefixes, F.col("value") == F.col("_prefix"))
        .withColumn("tier", F.when(F.lower("type_name") == F.col("value"), 0).otherwise(1))
        .where("NOT exact OR tier = 0")
        .select("query", "type_name", "tier")
    )
    typed = index.join(hits, "type_name").select("query", *index.columns, "tier")
    return numeric.unionByName(typed)


MAX_RESULTS = 8


def rank_objects(queries: DataFrame, index: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """The first ``limit`` rows of each query, ranked.

    The ``row_number`` filter is pushed below the shuffle by the optimizer, so a
    query matching a third of all objects ships ``limit`` rows per partition.
    """
    order = Window.partitionBy("query").orderBy(
        "tier", F.col("reachable").desc(), "obj_num", "gen", "doc_id"
    )
    return (
        find_object(queries, index)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


# --- cross-reference view ----------------------------------------------------


def xref_view(objects: DataFrame) -> DataFrame:
    """Cross-reference rows with their sentinels; object 0 is not a real one."""
    status = F.col("status")
    return objects.where("obj_num <> 0").select(
        "doc_id",
        "obj_num",
        "gen",
        "status",
        F.when(status == "in-use", F.coalesce("offset", F.lit(-1))).otherwise(F.lit(-1)).alias("offset"),
        F.when(status == "in-objstm", F.coalesce("host_objstm", F.lit(0))).otherwise(F.lit(0)).alias("host_objstm"),
        F.when(status == "free", F.lit("")).otherwise(
            F.format_string("obj:%d:%d", F.col("gen").cast("bigint"), F.col("obj_num").cast("bigint"))
        ).alias("node_id"),
    )


def order_index(df: DataFrame, image_rows: bool = False) -> DataFrame:
    """Global order of an index: by number, images by first use with errors last."""
    if image_rows:
        return df.orderBy(F.col("error").isNotNull(), "doc_id", "first_page", "obj_num", "gen")
    return df.orderBy("doc_id", "obj_num", "gen")


# --- rule lookups ------------------------------------------------------------


def forbidden_actions(entries: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Script and launch actions: ``doc_id, obj_id, kind, where``.

    Indirect objects, plus an action written directly as a catalog's
    ``/OpenAction``. ``catalogs`` has ``doc_id, obj_id``.
    """

    def kind(s: Column, js: Column) -> Column:
        return F.coalesce(
            F.when(s.isin("JavaScript", "Launch"), s), F.when(js.isNotNull(), F.lit("JavaScript"))
        )

    whole = pivot_keys(entries, ["S", "JS"]).select(
        *OBJ, kind(name_of("S"), F.col("JS")).alias("kind"), F.lit("object").alias("where")
    )
    direct = (
        pivot_keys(entries, ["S", "JS"], at=["OpenAction"])
        .join(catalogs.select(*OBJ), OBJ, "left_semi")
        .select(*OBJ, kind(name_of("S"), F.col("JS")).alias("kind"), F.lit("OpenAction").alias("where"))
    )
    return whole.unionByName(direct).where("kind IS NOT NULL")


FONT_FILES = ["FontFile", "FontFile2", "FontFile3"]


def non_embedded_fonts(entries: DataFrame) -> DataFrame:
    """Fonts without a font program: ``doc_id, obj_id, label``.

    Type3 fonts are exempt; CIDFonts are judged through the Type0 font that
    names them.
    """
    fonts = pivot_keys(entries, ["Type", "Subtype", "BaseFont", "FontDescriptor"]).where(
        name_of("Type") == "Font"
    )
    fonts = fonts.withColumn("_sub", F.coalesce(name_of("Subtype"), F.lit("")))
    judged = fonts.where(~F.col("_sub").isin("Type3", "CIDFontType0", "CIDFontType2"))
    carriers = (
        entries.where((F.size("path") == 1) & F.col("key").isin(FONT_FILES))
        .select("doc_id", F.col("obj_id").alias("_fd"))
        .distinct()
    )
    own = fonts.select(*OBJ, F.col("FontDescriptor")["ref_id"].alias("_fd")).join(
        carriers, ["doc_id", "_fd"], "left_semi"
    ).select(*OBJ)
    inline = (
        entries.where(
            (F.size("path") == 2) & (F.col("parent_path")[0] == "FontDescriptor")
            & F.col("key").isin(FONT_FILES)
        ).select(*OBJ)
    )
    with_program = own.unionByName(inline).distinct()
    descendants = entries.where(
        (F.size("path") == 2) & (F.col("parent_path")[0] == "DescendantFonts") & F.col("ref_id").isNotNull()
    ).select(*OBJ, F.col("ref_id").alias("_kid"))
    via_kid = (
        descendants.join(
            with_program.withColumnRenamed("obj_id", "_kid"), ["doc_id", "_kid"], "left_semi"
        ).select(*OBJ).distinct()
    )
    simple = judged.where("_sub <> 'Type0'").join(with_program, OBJ, "left_anti")
    composite = judged.where("_sub = 'Type0'").join(via_kid, OBJ, "left_anti")
    label = F.coalesce(name_of("BaseFont"), F.nullif(F.col("_sub"), F.lit("")), F.lit("(unnamed)"))
    return simple.unionByName(composite).select(*OBJ, label.alias("label"))
