"""Fonts: encodings, code maps, rosters and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.values import encoding_summary, flag_names
from quire.operators.objects import FONT_FILES, OBJ, int_of, name_of, pivot_keys, root_rows
from quire.operators.scan import DEFAULT_SKEW, Skew, scan_groups

FONT = ["doc_id", "font_id"]


def parse_differences(elements: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``doc_id, font_id, code, glyph, pos`` from a differences array.

    ``elements`` has ``doc_id, font_id, pos, int_val, name``. An integer sets the
    code, each name takes it and moves it on; codes outside 0..255 are dropped,
    and so is everything before the first integer.
    """

    def build(rows: DataFrame, scan) -> DataFrame:
        chunk = skew.chunk(F.col("pos"))
        islands = scan.running(
            rows, FONT, ["pos"], chunk,
            _start=("last", F.col("int_val")),
            _at=("last", F.when(F.col("int_val").isNotNull(), F.col("pos"))),
            # Elements that are neither integer nor name take no code.
            _names=("sum", F.col("name").isNotNull().cast("bigint"), True),
        )
        return scan.running(
            islands, FONT, ["pos"], chunk,
            _base=("last", F.when(F.col("int_val").isNotNull(), F.col("_names"))),
        )

    coded = scan_groups(elements, FONT, build, skew)
    code = F.col("_start") + F.col("_names") - F.col("_base")
    return coded.where("name IS NOT NULL AND _start IS NOT NULL").select(
        *FONT, code.alias("code"), F.concat(F.lit("/"), "name").alias("glyph"), "pos"
    ).where(F.col("code").between(0, 255))


def last_per_code(rows: DataFrame, order: str, *values: str) -> DataFrame:
    """One row per ``(font, code)``: the last declaration wins."""
    picked = F.max_by(F.struct(*values), order).alias("_v")
    return rows.groupBy(*FONT, "code").agg(picked).select(*FONT, "code", "_v.*")


def mapping_join(differences: DataFrame, tounicode: DataFrame) -> DataFrame:
    """Per code of either side: ``code, code_hex, glyph, unicode, text``.

    ``differences`` has ``code, glyph, pos``; ``tounicode`` has ``code, unicode,
    glyph, ord`` (the shape of ``cmap_mappings``).
    """
    left = last_per_code(differences, "pos", "glyph")
    right = last_per_code(tounicode.withColumnRenamed("glyph", "text"), "ord", "unicode", "text")
    joined = left.withColumn("has_glyph", F.lit(True)).join(
        right.withColumn("has_unicode", F.lit(True)), [*FONT, "code"], "full_outer"
    )
    return joined.select(
        *FONT,
        "code",
        F.concat(F.lit("0x"), F.hex(F.col("code"))).alias("code_hex"),
        F.coalesce("glyph", F.lit("")).alias("glyph"),
        F.coalesce("unicode", F.lit("")).alias("unicode"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("has_glyph", F.lit(False)).alias("has_glyph"),
        F.coalesce("has_unicode", F.lit(False)).alias("has_unicode"),
    )


def font_health(fonts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Coverage of each font.

    ``fonts`` has ``doc_id, font_id, encoding_name``; ``mapping`` comes from
    :func:`mapping_join`. The codes with a glyph but no unicode are at most 256 a
    font, because differences are.
    """
    gap = F.col("has_glyph") & ~F.col("has_unicode")
    sums = mapping.groupBy(*FONT).agg(
        F.count(F.lit(1)).alias("declared_codes"),
        F.max("has_unicode").alias("_any"),
        F.array_sort(F.collect_list(F.when(gap, F.col("code")))).alias("_gaps"),
    )
    missing = ~F.coalesce("_any", F.lit(False))
    identity = F.regexp_replace(F.coalesce("encoding_name", F.lit("")), "^/", "").isin("Identity-H", "Identity-V")
    return fonts.join(sums, FONT, "left").select(
        *FONT,
        F.coalesce("declared_codes", F.lit(0)).alias("declared_codes"),
        missing.alias("tounicode_missing"),
        (identity & missing).alias("identity_without_tounicode"),
        F.coalesce("_gaps", F.array().cast("array<bigint>")).alias("codes_without_unicode"),
    )


# --- font objects ------------------------------------------------------------


def _programs(entries: DataFrame) -> DataFrame:
    """``doc_id, fd_id, format, program_id`` of descriptors with a font program."""
    streams = root_rows(entries).where("value_type = 'stream'").select("doc_id", F.col("obj_id").alias("ref_id"))
    files = (
        entries.where((F.size("path") == 1) & F.col("key").isin(FONT_FILES) & F.col("ref_id").isNotNull())
        .select("doc_id", "obj_id", "key", "ref_id")
        .join(streams, ["doc_id", "ref_id"], "left_semi")
    )
    subtype = pivot_keys(entries, ["Subtype"]).select(
        "doc_id", F.col("obj_id").alias("ref_id"), name_of("Subtype").alias("_sub"))
    fmt = (
        F.when(F.col("key") == "FontFile", "Type1")
        .when(F.col("key") == "FontFile2", "TrueType")
        .otherwise(F.coalesce("_sub", F.lit("FontFile3")))
    )
    return (
        files.join(subtype, ["doc_id", "ref_id"], "left")
        .groupBy("doc_id", F.col("obj_id").alias("fd_id"))
        .agg(F.min_by(F.struct(fmt.alias("format"), F.col("ref_id").alias("program_id")), "key").alias("p"))
        .select("doc_id", "fd_id", "p.*")
    )


def embedded_fonts(entries: DataFrame) -> DataFrame:
    """``doc_id, obj_id`` of fonts with a program, a Type0 through its first descendant."""
    fonts = pivot_keys(entries, ["Type", "Subtype", "FontDescriptor"]).where(name_of("Type") == "Font")
    own = fonts.select(
        *OBJ, F.col("FontDescriptor")["ref_id"].alias("fd_id"), F.coalesce(name_of("Subtype"), F.lit("")).alias("_sub")
    ).join(_programs(entries).select("doc_id", "fd_id"), ["doc_id", "fd_id"], "left_semi")
    first = (
        entries.where((F.size("path") == 2) & (F.col("parent_path")[0] == "DescendantFonts"))
        .groupBy(*OBJ)
        .agg(F.min_by("ref_id", "idx").alias("_kid"))
    )
    kids = own.select("doc_id", F.col("obj_id").alias("_kid"))
    composite = (
        fonts.where(name_of("Subtype") == "Type0").select(*OBJ).join(first, OBJ).join(kids, ["doc_id", "_kid"], "left_semi")
    )
    return own.where("_sub <> 'Type0'").select(*OBJ).unionByName(composite.select(*OBJ)).distinct()


def _encodings(entries: DataFrame) -> DataFrame:
    """``doc_id, obj_id, enc_name, enc_is_dict, enc_base, enc_has_diff`` per font.

    The encoding may be a name, a dictionary, or a reference to either.
    """
    own = pivot_keys(entries, ["Encoding"])
    inline = pivot_keys(entries, ["BaseEncoding", "Differences"], at=["Encoding"])
    roots = root_rows(entries).select("doc_id", F.col("obj_id").alias("_enc"), F.col("value_type").alias("_vt"), F.col("value").alias("_v"))
    far = pivot_keys(entries, ["BaseEncoding", "Differences"]).select(
        "doc_id", F.col("obj_id").alias("_enc"), F.col("BaseEncoding").alias("_fb"), F.col("Differences").alias("_fd"))
    joined = (
        own.withColumn("_enc", F.col("Encoding")["ref_id"])
        .join(inline, OBJ, "left")
        .join(roots, ["doc_id", "_enc"], "left")
        .join(far, ["doc_id", "_enc"], "left")
    )
    base = F.coalesce("BaseEncoding", "_fb")
    kind = F.coalesce(F.col("_vt"), F.col("Encoding")["value_type"])
    return joined.select(
        *OBJ,
        F.when(kind == "name", F.coalesce(F.col("_v"), F.col("Encoding")["value"])).alias("enc_name"),
        (kind == "dict").alias("enc_is_dict"),
        F.when(base["value_type"] == "name", base["value"]).alias("enc_base"),
        F.coalesce("Differences", "_fd").isNotNull().alias("enc_has_diff"),
    )


def font_roster(resources: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per font resource name; unresolved rows are kept.

    ``resources`` has ``doc_id, owner_id, name, ref_id``. ``kind`` says what the
    whole dictionary is: ``roster`` when any row resolves, else ``neither``.
    """
    fonts = pivot_keys(entries, ["Type", "Subtype", "BaseFont"]).where(name_of("Type") == "Font").select(
        "doc_id", F.col("obj_id").alias("ref_id"), name_of("BaseFont").alias("_base"), name_of("Subtype").alias("_sub"),
        F.lit(True).alias("_font"))
    enc = _encodings(entries).withColumnRenamed("obj_id", "ref_id")
    emb = embedded_fonts(entries).select("doc_id", F.col("obj_id").alias("ref_id"), F.lit(True).alias("_emb"))
    key = ["doc_id", "ref_id"]
    rows = resources.join(fonts, key, "left").join(enc, key, "left").join(emb, key, "left")
    resolved = F.coalesce("_font", F.lit(False))
    summary = encoding_summary(
        F.col("enc_name"), F.coalesce("enc_is_dict", F.lit(False)), F.coalesce("enc_has_diff", F.lit(False)), F.col("enc_base"))
    shaped = rows.select(
        "doc_id", "owner_id", "name", "ref_id",
        F.when(F.col("_base").isNotNull(), F.concat(F.lit("/"), "_base")).otherwise("").alias("base_font"),
        F.coalesce("_sub", F.lit("")).alias("subtype"),
        F.when(resolved, summary).otherwise("").alias("encoding"),
        F.coalesce("_emb", F.lit(False)).alias("embedded"),
        (~resolved).alias("unresolved"),
    )
    kinds = shaped.groupBy("doc_id", "owner_id").agg(
        F.when(F.max(~F.col("unresolved")), "roster").otherwise("neither").alias("kind"))
    return shaped.join(kinds, ["doc_id", "owner_id"])


def font_view(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """How each dictionary (``doc_id, obj_id``) is shown: ``kind``.

    ``detail`` is a font, whose facts are a row of :func:`font_detail`; ``roster`` is no
    font but has a font among its entries (see :func:`font_roster`); else ``neither``.
    """
    fonts = pivot_keys(entries, ["Type"]).where(name_of("Type") == "Font").select(*OBJ)
    held = entries.where((F.size("path") == 1) & F.col("ref_id").isNotNull()).select("doc_id", F.col("obj_id").alias("_owner"), F.col("ref_id").alias("obj_id"))
    owners = held.join(fonts, OBJ, "left_semi").select("doc_id", F.col("_owner").alias("obj_id")).distinct()
    marked = nodes.select(*OBJ).distinct().join(fonts.withColumn("_font", F.lit(True)), OBJ, "left").join(
        owners.withColumn("_has", F.lit(True)), OBJ, "left")
    return marked.select(*OBJ, F.when(F.col("_font"), "detail").when(F.col("_has"), "roster").otherwise("neither").alias("kind"))


def font_detail(entries: DataFrame) -> DataFrame:
    """Metadata of each font object with its descriptor and first descendant."""
    fonts = pivot_keys(
        entries, ["Type", "Subtype", "BaseFont", "FirstChar", "LastChar", "FontDescriptor", "DW", "CIDToGIDMap"]
    ).where(name_of("Type") == "Font")
    number = lambda k: F.col(k)["num"]
    desc = pivot_keys(
        entries, ["FontName", "Flags", "ItalicAngle", "Ascent", "Descent", "CapHeight", "StemV"]
    ).select(
        "doc_id", F.col("obj_id").alias("fd_id"), name_of("FontName").alias("font_name"), int_of("Flags").alias("flags"),
        *[number(k).alias(a) for k, a in (
            ("ItalicAngle", "italic_angle"), ("Ascent", "ascent"), ("Descent", "descent"),
            ("CapHeight", "cap_height"), ("StemV", "stem_v"))])
    info = pivot_keys(entries, ["Registry", "Ordering", "Supplement"], at=["CIDSystemInfo"]).select(
        *OBJ, F.concat_ws("-", F.col("Registry")["value"], F.col("Ordering")["value"], F.col("Supplement")["value_raw"]).alias("collection"))
    first = (
        entries.where((F.size("path") == 2) & (F.col("parent_path")[0] == "DescendantFonts"))
        .groupBy(*OBJ).agg(F.min_by("ref_id", "idx").alias("descendant_id")))
    emb = embedded_fonts(entries).withColumn("_emb", F.lit(True))
    cid = name_of("Subtype").isin("CIDFontType0", "CIDFontType2")
    glyph_map = F.when(
        cid, F.when(F.col("CIDToGIDMap")["ref_id"].isNotNull(), "Stream").otherwise(F.coalesce(name_of("CIDToGIDMap"), F.lit(""))))
    shaped = fonts.select(
        *OBJ,
        F.coalesce(name_of("Subtype"), F.lit("")).alias("subtype"),
        F.coalesce(F.concat(F.lit("/"), name_of("BaseFont")), F.lit("")).alias("base_font"),
        int_of("FirstChar").alias("first_char"),
        int_of("LastChar").alias("last_char"),
        F.when(cid, int_of("DW")).alias("default_width"),
        glyph_map.alias("glyph_map"),
        F.col("FontDescriptor")["ref_id"].alias("fd_id"),
    )
    return (
        shaped.join(desc, ["doc_id", "fd_id"], "left")
        .join(_programs(entries), ["doc_id", "fd_id"], "left")
        .join(_encodings(entries), OBJ, "left")
        .join(info, OBJ, "left")
        .join(first, OBJ, "left")
        .join(emb, OBJ, "left")
        .select(
            *OBJ, "subtype", "base_font", "first_char", "last_char", "default_width", "glyph_map",
            F.coalesce(F.concat(F.lit("/"), "enc_name"), F.lit("")).alias("encoding_name"),
            F.coalesce(F.concat(F.lit("/"), "enc_base"), F.lit("")).alias("base_encoding"),
            "font_name", "flags", flag_names(F.col("flags")).alias("flag_names"), "italic_angle", "ascent", "descent",
            "cap_height", "stem_v", "format", "program_id", "collection", "descendant_id",
            F.coalesce("_emb", F.lit(False)).alias("embedded"),
        )
    )
