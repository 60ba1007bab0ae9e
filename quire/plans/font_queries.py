"""Font queries: part brands read as fonts, part names as glyphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.cmap import cmap_errors, cmap_mappings
from quire.operators import fonts as ft
from quire.operators import objects as ob
from quire.plans import bindings as b
from quire.plans.registry import query, table


def _elements(spark, d):
    """Differences arrays: every part gives its size as a code, then its name and type."""
    return table(spark, d, "part").selectExpr(
        "'parts' as doc_id", "p_brand as font_id", "p_partkey",
        "explode(array(named_struct('k', 0, 'int_val', cast(p_size * 6 as bigint), 'name', cast(null as string)), "
        "named_struct('k', 1, 'int_val', cast(null as bigint), 'name', p_name), "
        "named_struct('k', 2, 'int_val', cast(null as bigint), 'name', p_type))) as e",
    ).selectExpr("doc_id", "font_id", "p_partkey * 3 + e.k as pos", "e.int_val", "e.name")


_DIFF_SQL = """
diff AS (
  SELECT p_brand AS font_id, p_size * 6 AS code, '/' || p_name AS glyph, p_partkey * 3 + 1 AS pos FROM part WHERE p_size * 6 < 256
  UNION ALL SELECT p_brand, p_size * 6 + 1, '/' || p_type, p_partkey * 3 + 2 FROM part WHERE p_size * 6 + 1 < 256)
"""


@query("parse_differences", f"WITH {_DIFF_SQL} SELECT font_id, code, glyph, pos FROM diff")
def _(spark, d):
    return ft.parse_differences(_elements(spark, d)).drop("doc_id")


def _cmaps(spark, d):
    """Map text of each part: one pair and one range, written out in map syntax."""
    return table(spark, d, "part").selectExpr(
        "'parts' as doc_id", "p_brand as font_id", "p_partkey",
        "concat('% part\\n1 beginbfchar <', lpad(hex(p_size), 2, '0'), '> <', lpad(hex(p_size + 64), 4, '0'), '> endbfchar ',"
        " '1 beginbfrange <', lpad(hex(p_size + 100), 2, '0'), '> <', lpad(hex(p_size + 102), 2, '0'), '> <', "
        " lpad(hex(p_partkey % 130 + 65405), 4, '0'), '> endbfrange', if(p_size = 50, ' beginbfchar', '')) as cmap",
    )


_CMAP_SQL = """
cm AS (
  SELECT p_partkey, p_brand, p_size AS code, p_size + 64 AS cp FROM part WHERE p_size <> 50
  UNION ALL SELECT p_partkey, p_brand, p_size + 100 + k, p_partkey % 130 + 65405 + k FROM part, range(3) r(k)
  WHERE p_size <> 50 AND p_partkey % 130 + 65405 + k < 65536)
"""


@query("cmap_mappings", f"""WITH {_CMAP_SQL}
SELECT p_partkey, code, 'U+' || lpad(upper(to_hex(cp)), 4, '0') AS unicode,
  CASE WHEN cp >= 57344 AND cp <= 63743 THEN '' WHEN cp BETWEEN 127 AND 160 THEN '' ELSE chr(CAST(cp AS INTEGER)) END AS glyph FROM cm""")
def _(spark, d):
    return cmap_mappings(_cmaps(spark, d), ["p_partkey"]).drop("ord")


@query("cmap_errors", "SELECT p_partkey, 'bfchar: missing endbfchar' AS error, false AS large FROM part WHERE p_size = 50")
def _(spark, d):
    return cmap_errors(_cmaps(spark, d), ["p_partkey"])


def _mapping(spark, d):
    diff = ft.parse_differences(_elements(spark, d))
    keys = ["doc_id", "font_id", "p_partkey"]
    uni = cmap_mappings(_cmaps(spark, d), keys).where("font_id <> 'Brand#7'")
    uni = uni.withColumn("ord", F.struct("p_partkey", "ord")).drop("p_partkey")
    return ft.mapping_join(diff, uni)


_MAPPING_SQL = f"""{_DIFF_SQL}, {_CMAP_SQL},
l AS (SELECT font_id, code, max_by(glyph, pos) AS glyph FROM diff GROUP BY ALL),
r AS (SELECT p_brand AS font_id, code, max_by(cp, p_partkey * 1000 + code + CASE WHEN code >= 100 THEN 500 ELSE 0 END) AS cp FROM cm
  WHERE p_brand <> 'Brand#7' GROUP BY ALL),
m AS (SELECT coalesce(l.font_id, r.font_id) AS font_id, coalesce(l.code, r.code) AS code, glyph, cp
  FROM l FULL JOIN r ON l.font_id = r.font_id AND l.code = r.code)
"""


@query("mapping_join", f"""WITH {_MAPPING_SQL}
SELECT font_id, code, '0x' || upper(to_hex(code)) AS code_hex, coalesce(glyph, '') AS glyph,
  coalesce('U+' || lpad(upper(to_hex(cp)), 4, '0'), '') AS unicode FROM m""")
def _(spark, d):
    return _mapping(spark, d).select("font_id", "code", "code_hex", "glyph", "unicode")


@query("font_health", f"""WITH {_MAPPING_SQL}
SELECT font_id, count(*) AS declared_codes, count(cp) = 0 AS tounicode_missing, count(cp) = 0 AS identity_without_tounicode,
  coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE glyph IS NOT NULL AND cp IS NULL), '') AS codes_without_unicode
FROM m GROUP BY font_id""")
def _(spark, d):
    fonts = table(spark, d, "part").selectExpr("'parts' as doc_id", "p_brand as font_id", "'/Identity-H' as encoding_name").distinct()
    health = ft.font_health(fonts, _mapping(spark, d)).drop("doc_id")
    return health.withColumn("codes_without_unicode", F.array_join(F.col("codes_without_unicode").cast("array<string>"), ","))


# Fonts as objects: a supplier is a font descriptor, a customer a font. Customers
# of a nation whose first supplier has a positive balance have a font program.
_FONT_SQL = """
fd AS (SELECT s_suppkey, s_acctbal > 3000 AS has_file FROM supplier),
font AS (
  SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Type3' WHEN c_mktsegment = 'MACHINERY' THEN 'Type0'
     WHEN c_mktsegment = 'FURNITURE' THEN 'CIDFontType2' ELSE 'TrueType' END AS subtype,
   c_custkey % (SELECT count(*) FROM supplier) AS fd_key FROM customer)
"""


def _font_entries(spark, d):
    n = table(spark, d, "supplier").count()
    customer = table(spark, d, "customer").selectExpr(
        "*", "case c_mktsegment when 'BUILDING' then 'Type3' when 'MACHINERY' then 'Type0' "
        "when 'FURNITURE' then 'CIDFontType2' else 'TrueType' end as sub", f"c_custkey % {n} as fd_key")
    doc = "'fonts'"
    plain = "sub not in ('Type0', 'Type3')"
    return b.union_all(
        b.entries_of(
            customer, doc, "concat('F', c_custkey)", b.container([], "dict"), b.name(["Type"], "'Font'"), b.name(["Subtype"], "sub"),
            b.name(["BaseFont"], "c_name"), b.number(["FirstChar"], "c_nationkey"), b.number(["LastChar"], "c_nationkey + 200"),
            b.only_if(plain, b.ref(["FontDescriptor"], "concat('D', fd_key)")),
            b.only_if("sub = 'CIDFontType2'", b.number(["DW"], "1000")),
            b.only_if("sub = 'Type0'", b.container(["DescendantFonts"], "array")),
            # A composite font's descendant is the CIDFont with the next key, if it is one.
            b.only_if("sub = 'Type0'", b.ref(["DescendantFonts", "[0]"], "concat('F', c_custkey + 1)", "0")),
            b.only_if("sub = 'TrueType' and c_nationkey < 10", b.name(["Encoding"], "'WinAnsiEncoding'")),
            b.only_if("sub = 'TrueType' and c_nationkey >= 15", b.container(["Encoding"], "dict")),
            b.only_if("sub = 'TrueType' and c_nationkey >= 20", b.name(["Encoding", "BaseEncoding"], "'MacRomanEncoding'")),
            b.only_if("sub = 'TrueType' and c_nationkey between 15 and 17", b.container(["Encoding", "Differences"], "array")),
        ),
        b.entries_of(
            table(spark, d, "supplier"), doc, "concat('D', s_suppkey)", b.container([], "dict"), b.name(["FontName"], "s_name"),
            b.number(["Flags"], "s_nationkey"), b.number(["Ascent"], "s_acctbal"),
            b.only_if("s_acctbal > 3000", b.ref(["FontFile2"], "concat('P', s_suppkey)")),
            placed=[("concat('P', s_suppkey)", b.container([], "stream"))],
        ),
    )


_EMB_SQL = f"""{_FONT_SQL},
emb AS (
  SELECT f.*, fd.has_file AS own, k.subtype AS kid_sub, kd.has_file AS kid_file FROM font f JOIN fd ON fd.s_suppkey = fd_key
  LEFT JOIN font k ON k.c_custkey = f.c_custkey + 1 LEFT JOIN fd kd ON kd.s_suppkey = k.fd_key)
"""


@query("non_embedded_fonts", f"""WITH {_EMB_SQL}
SELECT 'F' || c_custkey AS obj_id, c_name AS label FROM emb
WHERE (subtype = 'TrueType' AND NOT own) OR (subtype = 'Type0' AND NOT coalesce(kid_file AND kid_sub IN ('TrueType', 'CIDFontType2'), false))""")
def _(spark, d):
    return ob.non_embedded_fonts(_font_entries(spark, d)).drop("doc_id")


_EMBEDDED = """CASE subtype WHEN 'Type3' THEN false
  WHEN 'Type0' THEN coalesce(kid_file AND kid_sub IN ('TrueType', 'CIDFontType2'), false) ELSE own END"""


@query("font_roster", f"""WITH {_EMB_SQL}
SELECT 'N' || c_nationkey AS owner_id, 'Fn' || c.c_custkey AS name, '/' || e.c_name AS base_font, subtype,
  CASE WHEN subtype <> 'TrueType' THEN 'Built-in' WHEN c_nationkey < 10 THEN '/WinAnsiEncoding' WHEN c_nationkey < 15 THEN 'Built-in'
    WHEN c_nationkey <= 17 THEN 'Differences' WHEN c_nationkey >= 20 THEN '/MacRomanEncoding' ELSE 'Dict' END AS encoding,
  {_EMBEDDED} AS embedded, false AS unresolved, 'roster' AS kind
FROM customer c JOIN emb e USING (c_custkey)
UNION ALL SELECT 'S' || s_nationkey, 'Fn' || s_suppkey, '', '', '', false, true, 'neither' FROM supplier""")
def _(spark, d):
    names = table(spark, d, "customer").selectExpr(
        "'fonts' as doc_id", "concat('N', c_nationkey) as owner_id", "concat('Fn', c_custkey) as name", "concat('F', c_custkey) as ref_id")
    # Descriptors are no fonts, so a dictionary of them is no roster.
    wrong = table(spark, d, "supplier").selectExpr(
        "'fonts' as doc_id", "concat('S', s_nationkey) as owner_id", "concat('Fn', s_suppkey) as name", "concat('D', s_suppkey) as ref_id")
    return ft.font_roster(names.unionByName(wrong), _font_entries(spark, d)).drop("doc_id", "ref_id")


@query("font_view", """
SELECT 'F' || c_custkey AS obj_id, 'detail' AS kind FROM customer
UNION ALL SELECT DISTINCT 'N' || c_nationkey, 'roster' FROM customer
UNION ALL SELECT 'D' || s_suppkey, 'neither' FROM supplier""")
def _(spark, d):
    # A nation's dictionary names the fonts of its customers.
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    named = b.entries_of(customer, "'fonts'", "concat('N', c_nationkey)", b.ref(["concat('Fn', c_custkey)"], "concat('F', c_custkey)"))
    entries = _font_entries(spark, d).unionByName(named)
    nodes = b.union_all(
        customer.selectExpr("'fonts' as doc_id", "concat('F', c_custkey) as obj_id"),
        customer.selectExpr("'fonts' as doc_id", "concat('N', c_nationkey) as obj_id"),
        supplier.selectExpr("'fonts' as doc_id", "concat('D', s_suppkey) as obj_id"))
    return ft.font_view(entries, nodes).drop("doc_id")


@query("font_detail", f"""WITH {_EMB_SQL}
SELECT 'F' || c_custkey AS obj_id, e.subtype, '/' || e.c_name AS base_font, CAST(c_nationkey AS BIGINT) AS first_char,
  CASE WHEN subtype = 'CIDFontType2' THEN 1000 END AS default_width,
  CASE WHEN subtype IN ('TrueType', 'CIDFontType2') THEN s_name END AS font_name,
  CASE WHEN subtype IN ('TrueType', 'CIDFontType2') THEN concat_ws(',', CASE WHEN s_nationkey & 1 > 0 THEN 'FixedPitch' END,
    CASE WHEN s_nationkey & 2 > 0 THEN 'Serif' END, CASE WHEN s_nationkey & 4 > 0 THEN 'Symbolic' END,
    CASE WHEN s_nationkey & 8 > 0 THEN 'Script' END) END AS flag_names,
  CASE WHEN subtype IN ('TrueType', 'CIDFontType2') THEN s_acctbal END AS ascent,
  CASE WHEN subtype IN ('TrueType', 'CIDFontType2') AND own THEN 'TrueType' END AS format,
  CASE WHEN subtype = 'Type0' THEN 'F' || (c_custkey + 1) END AS descendant_id, {_EMBEDDED} AS embedded
FROM emb e JOIN customer c USING (c_custkey) JOIN supplier ON s_suppkey = fd_key""")
def _(spark, d):
    return ft.font_detail(_font_entries(spark, d)).select(
        "obj_id", "subtype", "base_font", "first_char", "default_width", "font_name",
        F.array_join("flag_names", ",").alias("flag_names"), "ascent", "format", "descendant_id", "embedded")
