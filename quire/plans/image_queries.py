"""Image queries: the links of web pages read as images on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.values import decode_ceiling, estimated_bytes, image_flags
from quire.operators import images as im
from quire.plans import bindings as b
from quire.plans.registry import query, table

LINKS_SQL = """
uses AS (
  SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc_id, page_id AS page_num,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS obj_id,
         unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord FROM pages),
once AS (SELECT DISTINCT doc_id, obj_id, page_num FROM uses)
"""


@query("image_index", f"""WITH {LINKS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, obj_id ORDER BY page_num) AS rn FROM once)
SELECT doc_id, obj_id, min(page_num) AS first_page, count(*) AS page_count,
  string_agg(page_num, ',' ORDER BY page_num) FILTER (WHERE rn <= 16) AS first_pages
FROM ranked GROUP BY doc_id, obj_id""")
def _(spark, d):
    index = im.image_index(b.link_uses(spark, d))
    return index.withColumn("first_pages", F.array_join(F.col("first_pages").cast("array<string>"), ","))


@query("image_pages", f"""WITH {LINKS_SQL}
SELECT doc_id, obj_id, page_num FROM once
WHERE (doc_id, obj_id) IN (SELECT doc_id, obj_id FROM once GROUP BY ALL HAVING count(*) > 3)""")
def _(spark, d):
    uses = b.link_uses(spark, d)
    popular = im.image_index(uses).where("page_count > 3")
    return im.image_pages(uses, popular)


@query("images_by_page", f"""WITH {LINKS_SQL},
firsts AS (SELECT doc_id, page_num, obj_id, min(ord) AS ord FROM uses GROUP BY ALL),
bad AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc_id, page_id AS page_num FROM pages WHERE length(html) > 4000)
SELECT coalesce(f.doc_id, bad.doc_id) AS doc_id, coalesce(f.page_num, bad.page_num) AS page_num,
  coalesce(CASE WHEN f.obj_id IS NOT NULL THEN row_number() OVER (PARTITION BY f.doc_id, f.page_num ORDER BY ord) END, 0) AS position,
  obj_id, 'L' || ord AS path, bad.page_num IS NOT NULL AS incomplete
FROM firsts f FULL JOIN bad ON f.doc_id = bad.doc_id AND f.page_num = bad.page_num""")
def _(spark, d):
    uses = b.link_uses(spark, d).withColumn("path", F.concat(F.lit("L"), F.col("ord").cast("string")))
    bad = b.page_frame(spark, d).where(F.char_length("html") > 4000)
    return im.images_by_page(uses, bad)


_RANGES = """SELECT doc_id, obj_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges
FROM (SELECT doc_id, obj_id, min(page_num) AS lo, max(page_num) AS hi FROM
  (SELECT *, page_num - row_number() OVER (PARTITION BY doc_id, obj_id ORDER BY page_num) AS run FROM once) GROUP BY doc_id, obj_id, run)
GROUP BY doc_id, obj_id"""


@query("page_ranges", f"WITH {LINKS_SQL} {_RANGES}")
def _(spark, d):
    return im.page_ranges(b.link_uses(spark, d), ["doc_id", "obj_id"]).drop("single")


@query("order_row_ranges", """
SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges
FROM (SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM
  (SELECT *, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders) GROUP BY o_custkey, run)
GROUP BY o_custkey""")
def _(spark, d):
    return im.page_ranges(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").drop("single")


@query("issue_rollup", f"""WITH {LINKS_SQL}, r AS ({_RANGES})
SELECT r.doc_id, r.obj_id AS issue_key, min(page_num) AS first_page,
  '/XObject entry ' || r.obj_id || ' on ' || CASE WHEN count(*) = 1 THEN 'page ' ELSE 'pages ' END || ranges
    || ' could not be read' AS error
FROM r JOIN once o ON o.doc_id = r.doc_id AND o.obj_id = r.obj_id GROUP BY r.doc_id, r.obj_id, ranges""")
def _(spark, d):
    issues = b.link_uses(spark, d).select(
        "doc_id", F.col("obj_id").alias("issue_key"), "page_num",
        F.concat(F.lit("/XObject entry "), "obj_id", F.lit(" on ")).alias("prefix"),
        F.lit(" could not be read").alias("suffix"))
    return im.issue_rollup(issues)


def _order_forms(spark, d):
    """Orders as pages, customers as shared resources, nations as forms, parts as images.

    A customer's resources list its nation's form and the parts of its orders'
    lines; a nation's form lists its region's form; a region's form lists the
    suppliers of the region as images and, forming a cycle, its nations.
    """
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    pages = orders.selectExpr("'shop' as doc_id", "o_orderkey as page_num", "concat('C', o_custkey) as res_id")
    xobjects = b.union_all(
        customer.selectExpr("'shop' as doc_id", "concat('C', c_custkey) as owner_id", "concat('Fm', c_nationkey) as name",
                            "concat('N', c_nationkey) as obj_id", "'Form' as subtype"),
        nation.selectExpr("'shop'", "concat('N', n_nationkey)", "'FmR'", "concat('R', n_regionkey)", "'Form'").toDF(
            "doc_id", "owner_id", "name", "obj_id", "subtype"),
        nation.selectExpr("'shop'", "concat('R', n_regionkey)", "concat('Fm', n_nationkey)", "concat('N', n_nationkey)", "'Form'").toDF(
            "doc_id", "owner_id", "name", "obj_id", "subtype"),
        supplier.selectExpr("'shop'", "concat('N', s_nationkey)", "concat('Im', s_suppkey)", "concat('S', s_suppkey)", "'Image'").toDF(
            "doc_id", "owner_id", "name", "obj_id", "subtype"),
    )
    return pages, xobjects


@query("image_uses", """
SELECT c_nationkey AS nation, CASE WHEN s_nationkey = c_nationkey THEN 'own' ELSE 'region' END AS via,
  'S' || s_suppkey AS obj_id, CASE WHEN s_nationkey = c_nationkey THEN 'Fm' || c_nationkey || ' > Im' || s_suppkey
    ELSE 'Fm' || c_nationkey || ' > FmR > Fm' || s_nationkey || ' > Im' || s_suppkey END AS path, count(*) AS n_pages
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN nation sn ON sn.n_regionkey = cn.n_regionkey JOIN supplier ON s_nationkey = sn.n_nationkey GROUP BY ALL""")
def _(spark, d):
    pages, xobjects = _order_forms(spark, d)
    uses, _ = im.image_uses(pages, xobjects, by_page=False)
    depth = F.size("path")
    nation = F.regexp_extract(F.element_at("path", 1), r"(\d+)", 1).cast("int")
    return uses.groupBy(
        nation.alias("nation"), F.when(depth == 2, "own").otherwise("region").alias("via"), "obj_id",
        F.array_join("path", " > ").alias("path"),
    ).agg(F.sum("n_pages").alias("n_pages"))


@query("image_uses_too_deep", """
SELECT 'shop' AS doc_id, o_orderkey AS page_num, 'R' || n_regionkey AS obj_id,
  'Form XObject nesting deeper than 1 at R' || n_regionkey || ' on page ' || o_orderkey || '; deeper forms were not walked' AS error
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    pages, xobjects = _order_forms(spark, d)
    return im.image_uses(pages, xobjects, max_depth=1)[1]


@query("walk_budget", f"""WITH {LINKS_SQL}, run AS (
  SELECT doc_id, page_num, sum(n) OVER (PARTITION BY doc_id ORDER BY page_num) AS used
  FROM (SELECT doc_id, page_num, count(*) AS n FROM uses GROUP BY ALL))
SELECT doc_id, min(page_num) AS page_num,
  'image walk stopped at the limit of 200 image uses at page ' || min(page_num) AS error FROM run WHERE used > 200 GROUP BY doc_id""")
def _(spark, d):
    return im.walk_budget(b.link_uses(spark, d), limit=200)


_IMAGES_SQL = """
img AS (
  SELECT p_partkey, p_partkey % 300 AS width, p_size * 10 AS height,
    CASE WHEN p_size < 10 THEN NULL WHEN p_size < 25 THEN 1 ELSE 8 END AS bits,
    CASE p_type WHEN 'ECONOMY' THEN 'DeviceCMYK' WHEN 'SMALL' THEN 'Indexed' WHEN 'STANDARD' THEN 'DeviceRGB' ELSE 'DeviceGray' END AS cs,
    CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'SMALL' THEN 3 WHEN 'STANDARD' THEN 3 ELSE 1 END AS n,
    p_name LIKE 'red%' AS mask, p_name LIKE '%bolt' AS inverted,
    CASE WHEN p_name LIKE 'blue%' THEN 'present' ELSE 'absent' END AS marker
  FROM part)
"""


def _images(spark, d):
    n = "case p_type when 'ECONOMY' then 4 when 'SMALL' then 3 when 'STANDARD' then 3 else 1 end"
    return table(spark, d, "part").selectExpr(
        "'parts' as doc_id", "cast(p_partkey as string) as obj_id", "p_partkey % 300 as width", "p_size * 10 as height",
        "case when p_size < 10 then null when p_size < 25 then 1 else 8 end as bits",
        "case p_type when 'ECONOMY' then 'DeviceCMYK' when 'SMALL' then 'Indexed' when 'STANDARD' then 'DeviceRGB' else 'DeviceGray' end as color_space",
        f"{n} as components", "p_name like 'red%' as image_mask", "cast(null as string) as smask_id",
        f"if(p_name like '%bolt', array_repeat(1d, 0) || flatten(array_repeat(array(1d, 0d), if(p_name like 'red%', 1, {n}))), null) as decode",
        "false as decode_rejected", "cast(null as array<double>) as lab_range",
        "if(p_name like 'blue%', 'present', 'absent') as marker",
    )


@query("image_facts", f"""WITH {_IMAGES_SQL}
SELECT CAST(p_partkey AS VARCHAR) AS obj_id, width, height, coalesce(bits, 8) AS bits, cs AS color_space, mask AS image_mask,
  inverted AS decode_non_default,
  CASE WHEN width = 0 THEN 0 ELSE (width * (CASE WHEN mask THEN 1 ELSE coalesce(bits, 8) * CASE WHEN cs = 'Indexed' THEN 1 ELSE n END END) + 7) // 8 * height END AS estimated_bytes,
  CASE WHEN NOT mask AND inverted AND cs = 'Indexed' THEN 'Not classified: /Decode on an Indexed or Lab image is not a simple inversion'
    WHEN NOT mask AND n = 4 AND marker = 'present' AND inverted THEN 'Normal: /Decode compensates for Adobe-inverted CMYK'
    WHEN NOT mask AND n = 4 AND marker = 'present' THEN 'Inverted: Adobe CMYK is stored inverted and no /Decode compensates'
    WHEN NOT inverted THEN 'Normal (default)'
    WHEN NOT mask AND n = 4 THEN 'Inverted: /Decode inverts, no Adobe APP14 marker' ELSE 'Inverted by /Decode' END AS verdict
FROM img""")
def _(spark, d):
    facts = im.image_facts(_images(spark, d))
    return facts.select("obj_id", "width", "height", "bits", "color_space", "image_mask", "decode_non_default", "estimated_bytes", "verdict")


@query("image_rows", f"""WITH {_IMAGES_SQL},
u AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS rn, o_orderstatus <> 'P' AS own FROM u JOIN orders ON o_orderkey = l_orderkey),
i AS (SELECT l_partkey, min(l_orderkey) AS first_page, count(*) AS page_count, string_agg(l_orderkey, ',' ORDER BY l_orderkey) FILTER (rn <= 16) AS first_pages,
  string_agg(CASE WHEN own THEN 'obj:0:' || l_orderkey ELSE '' END, ',' ORDER BY l_orderkey) FILTER (rn <= 16) AS nodes FROM r GROUP BY l_partkey)
SELECT CAST(p_partkey AS VARCHAR) AS obj_id, CAST(p_partkey AS VARCHAR) AS node_id, first_page, page_count, first_pages, nodes,
  width, CASE WHEN mask THEN 'JBIG2Decode' ELSE 'FlateDecode,DCTDecode' END AS filters,
  CASE WHEN width > 200 THEN CASE WHEN inverted THEN '' ELSE 'S' || p_partkey END END AS smask, inverted AS has_decode,
  CASE WHEN marker = 'present' THEN height // 10 END AS transform,
  CASE WHEN width = 0 THEN 'Width metadata: not read' ELSE '' END AS warning, '' AS error, 0 AS kind
FROM img JOIN i ON l_partkey = p_partkey
UNION ALL SELECT 'S' || s_suppkey, '', 0, 0, '', '', NULL, NULL, NULL, NULL, NULL, NULL, 'form of nation ' || s_nationkey, 1 FROM supplier""")
def _(spark, d):
    # Parts are images on the orders of their lines; a supplier is an object at which a walk stopped.
    images = _images(spark, d).withColumns({
        "doc_id": F.lit("shop"),
        "filters": F.when(F.col("image_mask"), F.array(F.lit("JBIG2Decode"))).otherwise(F.array(F.lit("FlateDecode"), F.lit("DCTDecode"))),
        "has_smask": F.col("width") > 200, "transform": F.expr("cast(height div 10 as int)"),
        "smask_id": F.when((F.col("width") > 200) & F.col("decode").isNull(), F.concat(F.lit("S"), "obj_id")),
        "failed": F.when(F.col("width") == 0, F.array(F.lit("Width metadata: not read")))})
    uses = table(spark, d, "lineitem").selectExpr("'shop' as doc_id", "cast(l_partkey as string) as obj_id", "l_orderkey as page_num")
    pages = table(spark, d, "orders").selectExpr("'shop' as doc_id", "o_orderkey as page_num", "if(o_orderstatus = 'P', null, concat('obj:0:', o_orderkey)) as page_id")
    issues = table(spark, d, "supplier").selectExpr("'shop' as doc_id", "concat('S', s_suppkey) as obj_id", "concat('form of nation ', s_nationkey) as error")
    rows = im.image_rows(uses, im.image_facts(images), pages, issues)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "obj_id", "node_id", "first_page", "page_count", joined("first_pages").alias("first_pages"), joined("first_page_nodes").alias("nodes"),
        "width", joined("filters").alias("filters"), "smask", F.when(F.col("filters").isNotNull(), F.col("decode").isNotNull()).alias("has_decode"),
        "transform", "warning", "error", F.col("place.k").alias("kind"))


@query("image_sizes", f"""WITH {_IMAGES_SQL}, s AS (
  SELECT p_partkey, CASE WHEN width = 0 THEN 0 ELSE (width * 1000 * coalesce(bits, 8) * n + 7) // 8 * (height * 10) END AS est FROM img)
SELECT p_partkey, est, greatest(52428800, least(536870912, CASE WHEN est = 0 THEN 0 ELSE est * 2 + 1048576 END)) AS ceiling FROM s""")
def _(spark, d):
    w, h, bits, n = F.col("width") * 1000, F.col("height") * 10, F.coalesce("bits", F.lit(8)), F.col("components")
    return _images(spark, d).select(
        F.col("obj_id").cast("bigint").alias("p_partkey"),
        estimated_bytes(w, h, bits, n).alias("est"), decode_ceiling(w, h, bits, n).alias("ceiling"))


@query("image_flags", f"""WITH {_IMAGES_SQL}
SELECT p_partkey, concat_ws(', ', CASE WHEN mask THEN 'mask' END, CASE WHEN width > 200 THEN 'SMask' END,
  CASE WHEN inverted THEN 'Decode' END, CASE WHEN marker = 'present' THEN CASE WHEN bits IS NULL THEN 'APP14' ELSE 'APP14 t=' || bits END END) AS flags
FROM img""")
def _(spark, d):
    flags = image_flags(F.col("image_mask"), F.col("width") > 200, F.col("decode").isNotNull(), F.col("marker"), F.col("bits"))
    return _images(spark, d).select(F.col("obj_id").cast("bigint").alias("p_partkey"), F.array_join(flags, ", ").alias("flags"))
