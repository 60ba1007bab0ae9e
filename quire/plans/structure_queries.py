"""Structure queries: order lines as marked content, customers as elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import structure as st
from quire.operators.graph import NodeReader
from quire.plans import bindings as b
from quire.plans.registry import query, table

# Lines are content, lines of finished orders have a parent-tree slot, and
# returned lines are claimed by the customer's element.


def content(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "'shop' as doc_id", "l_orderkey as page_num", "cast(l_linenumber as bigint) as mcid")


def _owned(spark, d, flag):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = table(spark, d, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(flag).selectExpr(
        "'shop' as doc_id", "l_orderkey as page_num", "cast(l_linenumber as bigint) as mcid", "concat('E', o_custkey) as owner_id")


@query("align_mcids", """
WITH c AS (SELECT l_orderkey AS page_num, l_linenumber AS mcid, count(*) AS n FROM lineitem GROUP BY ALL),
j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT DISTINCT l_orderkey AS page_num, l_linenumber AS mcid, 'E' || o_custkey AS slot FROM j WHERE o_orderstatus = 'F'),
t AS (SELECT l_orderkey AS page_num, l_linenumber AS mcid, count(*) AS n, 'E' || min(o_custkey) AS owner FROM j WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT page_num, CAST(mcid AS BIGINT) AS mcid, c.n AS content_count, slot, coalesce(t.n, 0) AS n_claims, owner AS first_claim,
  c.n = 1 AND coalesce(t.n, 0) = 1 AND coalesce(slot = owner, false) AS consistent
FROM c LEFT JOIN s USING (page_num, mcid) LEFT JOIN t USING (page_num, mcid)""")
def _(spark, d):
    slots = _owned(spark, d, "o_orderstatus = 'F'").distinct().selectExpr(
        "doc_id", "page_num", "mcid", "owner_id as element", "cast(null as string) as error")
    return st.align_mcids(content(spark, d), slots, _owned(spark, d, "l_returnflag = 'R'")).drop("doc_id")


@query("duplicate_keys", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey || '/' || l_suppkey || '/' || l_quantity AS loc FROM lineitem)
SELECT l_orderkey AS page_num, CAST(l_linenumber AS BIGINT) AS mcid, count(*) AS n, 0 AS part, string_agg(loc, ', ' ORDER BY loc) AS labels
FROM r GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as page_num", "cast(l_linenumber as bigint) as mcid",
        "concat_ws('/', l_partkey, l_suppkey, l_quantity) as loc")
    return st.duplicate_keys(rows, ["page_num", "mcid"], ["loc"], F.col("loc"))


@query("first_seen", """
SELECT o_orderkey, o_custkey, f.o AS first_value FROM orders JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) f USING (o_custkey)
WHERE o_orderkey <> f.o""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return st.first_seen(rows.withColumn("v", F.col("o_orderkey")), ["o_custkey"], "o_orderkey", "v").drop("v")


@query("key_order_check", """
SELECT o_custkey AS node, o_orderkey AS pair, CAST(floor(o_totalprice) AS BIGINT) AS key,
  lag(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_key FROM orders""")
def _(spark, d):
    pairs = table(spark, d, "orders").selectExpr(
        "'shop' as doc_id", "o_custkey as node", "0 as ord", "o_orderkey as pair", "cast(floor(o_totalprice) as bigint) as key")
    return st.key_order_check(pairs).drop("doc_id", "ord")


_NT_SQL = """
cust AS (
  SELECT 'R' || n_regionkey AS doc_id, 'N' || n_nationkey AS node, n_nationkey, c_custkey AS pair, 'C' || c_custkey AS ref_id,
    CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey - 25 ELSE c_custkey END END AS key
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY n_nationkey, pair) AS rn,
    first_value(node) OVER (PARTITION BY doc_id, key ORDER BY n_nationkey, pair) AS first_node,
    lag(key) OVER (PARTITION BY doc_id, node ORDER BY pair) AS prev FROM cust WHERE key IS NOT NULL)
"""


def _number_tree(spark, d):
    t = b.tree_frames(spark, d)
    n, r = "concat('N', n_nationkey)", "concat('R', r_regionkey)"
    key = "if(c_mktsegment = 'BUILDING', c_custkey - 25, c_custkey)"
    nums = "concat('N', c_nationkey)"

    def place(e):
        return f"concat('[', {e}, ']')"

    entries = b.union_all(
        b.entries_of(t["region"], r, r, b.container([], "dict"), b.container(["Kids"], "array")),
        b.entries_of(
            t["nation"], b.TREE_DOC, n, b.container([], "dict"), b.container(["Nums"], "array"),
            b.only_if("n_nationkey >= 5", b.container(["Limits"], "array")),
            b.only_if("n_nationkey >= 5", b.number(["Limits", "[0]"], "0", "0")),
            b.only_if("n_nationkey >= 5", b.number(["Limits", "[1]"], "1000", "1")),
            placed=[(b.TREE_DOC, b.ref(["Kids", place("n_nationkey")], n, "n_nationkey"))],
        ),
        b.entries_of(
            t["customer"], b.TREE_DOC, "concat('C', c_custkey)", b.container([], "dict"),
            placed=[
                (nums, b.only_if("c_acctbal >= 0", b.number(["Nums", place("2 * c_custkey")], key, "2 * c_custkey"))),
                (nums, b.only_if("c_acctbal < 0", b.name(["Nums", place("2 * c_custkey")], "c_name", ))),
                (nums, b.ref(["Nums", place("2 * c_custkey + 1")], "concat('C', c_custkey)", "2 * c_custkey + 1")),
            ],
        ),
    )
    # A name has a position too.
    entries = entries.withColumn(
        "idx", F.when(F.col("idx").isNull() & F.col("key").startswith("["), F.regexp_extract("key", r"(\d+)", 1).cast("bigint")).otherwise(F.col("idx")))
    return st.number_tree(b.stored(entries), b.tree_roots(spark, d))


@query("number_tree", f"WITH {_NT_SQL} SELECT doc_id, key, node, ref_id FROM ranked WHERE rn = 1")
def _(spark, d):
    return _number_tree(spark, d)[0].select("doc_id", "key", "node", "ref_id")


@query("number_tree_problems", f"""WITH {_NT_SQL}
SELECT DISTINCT doc_id, node, 'non-root node has no /Limits' AS message FROM (SELECT 'R' || n_regionkey AS doc_id, 'N' || n_nationkey AS node FROM nation WHERE n_nationkey < 5)
UNION ALL SELECT doc_id, node, '/Nums entry ' || 2 * pair || ': key is a name, not an integer' FROM cust WHERE key IS NULL
UNION ALL SELECT doc_id, node, 'key ' || key || ' outside /Limits [0 1000]' FROM ranked WHERE n_nationkey >= 5 AND (key < 0 OR key > 1000)
UNION ALL SELECT doc_id, node, 'key ' || key || ' after key ' || prev || ': keys not in ascending order' FROM ranked WHERE key < prev
UNION ALL SELECT doc_id, node, 'key ' || key || ' already in node ' || first_node || '; first value kept' FROM ranked WHERE rn > 1""")
def _(spark, d):
    return _number_tree(spark, d)[1].select("doc_id", "node", "message")


@query("number_tree_incomplete", f"""WITH {_NT_SQL}
SELECT doc_id, min_by('/Nums entry ' || 2 * pair || ': key is a name, not an integer', CAST(n_nationkey AS BIGINT) * 1000000000 + pair) AS message
FROM cust WHERE key IS NULL GROUP BY doc_id""")
def _(spark, d):
    return _number_tree(spark, d)[2]


def _roles(spark, d):
    return table(spark, d, "customer").selectExpr(
        "concat('N', c_nationkey) as doc_id", "concat('C', c_custkey) as role",
        "case when c_acctbal < 0 then concat('C', c_custkey) when c_mktsegment = 'BUILDING' and c_acctbal > 9000 then '' "
        "else concat('C', c_custkey div 2) end as target")


@query("map_role", """
WITH RECURSIVE r AS (
  SELECT 'N' || c_nationkey AS doc_id, 'C' || c_custkey AS role, CASE WHEN c_acctbal < 0 THEN 'C' || c_custkey
    WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN '' ELSE 'C' || c_custkey // 2 END AS target FROM customer),
w AS (
  SELECT doc_id, role, role AS cur, [role] AS path, CAST(NULL AS VARCHAR) AS error, false AS done FROM r
  UNION ALL
  SELECT w.doc_id, w.role, CASE WHEN target IS NULL OR target = '' OR list_contains(path, target) THEN cur ELSE target END,
    CASE WHEN target IS NULL THEN path ELSE list_append(path, target) END,
    CASE WHEN target = '' THEN '/RoleMap maps /' || cur || ' to an empty name'
      WHEN list_contains(path, target) THEN '/RoleMap cycle: ' || array_to_string(list_append(path, target), ' -> ') END,
    target IS NULL OR target = '' OR list_contains(path, target)
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.role = w.cur WHERE NOT done)
SELECT doc_id, role, CASE WHEN error IS NULL AND cur <> role THEN cur ELSE '' END AS mapped, error FROM w WHERE done""")
def _(spark, d):
    return st.map_role(_roles(spark, d))


_ST_SQL = """
cu AS (
  SELECT 'R' || n_regionkey AS doc_id, n_nationkey, c_custkey, c_acctbal, 'C' || c_custkey AS el,
    CASE WHEN c_acctbal > 5000 THEN c_custkey ELSE 0 END AS page FROM customer JOIN nation ON c_nationkey = n_nationkey),
kids AS (
  SELECT 'R' || n_regionkey AS doc_id, '' AS owner_id, n_nationkey AS idx, 'element' AS kind, 'N' || n_nationkey AS ref_id, 'Sect' AS s,
    0 AS page, CAST(NULL AS BIGINT) AS mcid, CAST(NULL AS VARCHAR) AS error FROM nation
  UNION ALL SELECT doc_id, 'N' || n_nationkey, c_custkey, 'element', el, CASE WHEN c_acctbal >= 0 THEN 'P' END, page, NULL,
    nullif(concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'no /S' END,
      CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN '/Pg G' || c_custkey || ' is not a page in the page tree' END), '') FROM cu
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 1000000000 + s_suppkey, 'error', 'X' || s_suppkey, NULL, 0, NULL,
    'X' || s_suppkey || ' does not resolve to an object' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT doc_id, el, o_orderkey, 'mcid', NULL, NULL, page, o_orderkey, CASE WHEN page = 0 THEN
    'no page: the nearest /Pg (on the kid, its element or an ancestor) is absent or not a page; MCID not attributed to a page' END
    FROM cu JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT doc_id, el, o_orderkey, 'mcr', NULL, NULL, page, CASE WHEN o_totalprice > 100000 THEN o_orderkey END,
    CASE WHEN o_totalprice <= 100000 THEN 'MCR has no /MCID' WHEN page = 0 THEN
    'no page: the nearest /Pg (on the kid, its element or an ancestor) is absent or not a page; MCID not attributed to a page' END
    FROM cu JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
  UNION ALL SELECT doc_id, el, o_orderkey, 'objr', NULL, NULL, page, NULL, CASE WHEN o_totalprice <= 100000 THEN 'OBJR has no /Obj' END
    FROM cu JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
"""


def struct_tree(spark, d):
    t = b.tree_frames(spark, d)
    r, n, c = "concat('R', r_regionkey)", "concat('N', n_nationkey)", "concat('C', c_custkey)"

    def slot(key):
        return f"concat('[', {key}, ']')"

    k = slot("o_orderkey")
    owner = "concat('C', o_custkey)"
    orders = t["orders"]
    entries = b.union_all(
        b.entries_of(t["region"], r, r, b.container([], "dict"), b.container(["K"], "array")),
        b.entries_of(t["nation"], b.TREE_DOC, n, b.container([], "dict"), b.name(["S"], "'Sect'"), b.container(["K"], "array"),
                     placed=[(b.TREE_DOC, b.ref(["K", slot("n_nationkey")], n, "n_nationkey"))]),
        b.entries_of(t["customer"], b.TREE_DOC, c, b.container([], "dict"), b.only_if("c_acctbal >= 0", b.name(["S"], "'P'")),
                     b.only_if("c_acctbal >= 0", b.ref(["Pg"], "concat('G', c_custkey)")), b.container(["K"], "array"),
                     placed=[("concat('N', c_nationkey)", b.ref(["K", slot("c_custkey")], c, "c_custkey"))]),
        b.entries_of(t["supplier"], b.TREE_DOC, "concat('N', s_nationkey)",
                     b.ref(["K", slot("1000000000 + s_suppkey")], "concat('X', s_suppkey)", "1000000000 + s_suppkey")),
        b.entries_of(orders.where("o_orderstatus = 'F'"), b.TREE_DOC, owner, b.number(["K", k], "o_orderkey", "o_orderkey")),
        b.entries_of(orders.where("o_orderstatus <> 'F'"), b.TREE_DOC, owner, b.container(["K", k], "dict", "o_orderkey"),
                     b.only_if("o_orderstatus = 'O'", b.name(["K", k, "Type"], "'MCR'")),
                     b.only_if("o_orderstatus = 'O' and o_totalprice > 100000", b.number(["K", k, "MCID"], "o_orderkey")),
                     b.only_if("o_orderstatus = 'P'", b.name(["K", k, "Type"], "'OBJR'")),
                     b.only_if("o_orderstatus = 'P' and o_totalprice > 100000", b.ref(["K", k, "Obj"], owner))),
    )
    pages = t["customer"].where("c_acctbal > 5000").selectExpr(
        f"{b.TREE_DOC} as doc_id", "concat('G', c_custkey) as obj_id", "c_custkey as page_num")
    return st.struct_tree(b.stored(entries), b.tree_roots(spark, d), pages)


@query("struct_tree", f"WITH {_ST_SQL} SELECT * FROM kids")
def _(spark, d):
    return struct_tree(spark, d).select("doc_id", "owner_id", "idx", "kind", "ref_id", "s", "page", "mcid", "error")


@query("struct_claims", f"""WITH {_ST_SQL}
SELECT doc_id, page AS page_num, mcid, owner_id FROM kids WHERE kind IN ('mcid', 'mcr') AND mcid IS NOT NULL AND page > 0""")
def _(spark, d):
    return st.claims(struct_tree(spark, d))


@query("structure_counts", f"""WITH {_ST_SQL}
SELECT k.doc_id, count(*) FILTER (WHERE kind = 'element') AS elements, count(*) FILTER (WHERE kind = 'mcid') AS mcid_kids,
  count(*) FILTER (WHERE kind = 'mcr') AS mcr_kids, count(*) FILTER (WHERE kind = 'objr') AS objr_kids,
  count(*) FILTER (WHERE kind = 'error') AS error_kids, (SELECT count(*) FROM orders o JOIN cu ON cu.c_custkey = o.o_custkey WHERE cu.doc_id = k.doc_id) AS content_mcids
FROM kids k GROUP BY k.doc_id""")
def _(spark, d):
    marks = b.tree_frames(spark, d)["orders"].selectExpr(f"{b.TREE_DOC} as doc_id", "o_orderkey as mcid")
    return st.structure_counts(struct_tree(spark, d), marks)


def _parent_tree(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    pages = orders.selectExpr(
        "'shop' as doc_id", "o_orderkey as page_num",
        "case o_orderstatus when 'F' then 'number' when 'P' then 'name' end as key_type",
        "case o_orderstatus when 'F' then cast(o_custkey as string) when 'P' then '/P' end as key_raw",
        "case when o_orderstatus = 'F' then o_custkey end as key")
    numtree = customer.where("c_acctbal > -500").selectExpr(
        "'shop' as doc_id", "c_custkey as key", "if(c_acctbal > 0, 'array', 'dict') as value_type", "cast(null as string) as value_raw",
        "if(c_acctbal > 0, concat('A', c_custkey), null) as array_id", "cast(null as string) as ref_id")
    arrays = orders.selectExpr(
        "'shop' as doc_id", "concat('A', o_custkey) as array_id", "o_orderkey as mcid",
        "if(o_orderpriority = '1-URGENT', 'number', 'reference') as value_type",
        "if(o_orderpriority = '1-URGENT', if(o_orderkey % 2 = 0, cast(o_orderkey as string), concat(o_orderkey, '.5')), null) as value_raw",
        "if(o_orderpriority = '1-URGENT', null, concat('O', o_orderkey)) as ref_id")
    elements = orders.where("o_totalprice > 100000").selectExpr(
        "'shop' as doc_id", "concat('O', o_orderkey) as ref_id", "'dict' as target_type", "cast(null as string) as target_raw", "o_orderstatus as s")
    return pages, numtree, arrays, elements


@query("page_parent_tree_errors", """
SELECT o_orderkey AS page_num, CASE WHEN o_orderstatus = 'P' THEN '/StructParents is a name, not an integer'
  WHEN c_acctbal <= -500 THEN 'ParentTree has no key ' || o_custkey ELSE 'ParentTree key ' || o_custkey || ' is a dictionary, not an array' END AS error
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND c_acctbal <= 0)""")
def _(spark, d):
    pages, numtree, arrays, elements = _parent_tree(spark, d)
    trees = pages.select("doc_id").distinct()
    return st.page_parent_tree(pages, numtree, arrays, elements, trees)[0].select("page_num", "error")


@query("page_parent_tree_slots", """
SELECT p.o_orderkey AS page_num, p.o_custkey AS key, e.o_orderkey AS mcid,
  CASE WHEN e.o_orderpriority <> '1-URGENT' THEN 'O' || e.o_orderkey END AS element,
  CASE WHEN e.o_orderpriority <> '1-URGENT' AND e.o_totalprice > 100000 THEN e.o_orderstatus END AS s,
  CASE WHEN e.o_orderpriority = '1-URGENT' THEN CASE WHEN e.o_orderkey % 2 = 0 THEN 'value is an integer' ELSE 'value is a real' END || ', not a reference to an element'
    WHEN e.o_totalprice <= 100000 THEN 'O' || e.o_orderkey || ' does not resolve to an object' END AS error
FROM orders p JOIN customer ON p.o_custkey = c_custkey JOIN orders e ON e.o_custkey = p.o_custkey
WHERE p.o_orderstatus = 'F' AND c_acctbal > 0""")
def _(spark, d):
    pages, numtree, arrays, elements = _parent_tree(spark, d)
    trees = pages.select("doc_id").distinct()
    return st.page_parent_tree(pages, numtree, arrays, elements, trees)[1].drop("doc_id")


@query("other_parent_tree", """
SELECT c_custkey AS key, CASE WHEN c_acctbal <= 0 THEN 'value is a dictionary, not a reference to an element' END AS error,
  CASE WHEN c_acctbal > 0 THEN 'array value no page''s /StructParents names; may belong to a Form XObject''s /StructParents' END AS note
FROM customer WHERE c_acctbal > -500 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, d):
    pages, numtree, arrays, elements = _parent_tree(spark, d)
    return st.other_parent_tree(numtree, pages, elements).select("key", "error", "note")


_HEADER_DOC = "concat('D', c_custkey)"


def _headers(spark, d):
    customer = table(spark, d, "customer")
    entries = b.entries_of(
        b.dealt(customer), _HEADER_DOC, "'cat'", b.container([], "dict"),
        b.only_if("c_nationkey < 10", b.string(["Lang"], "c_name")),
        b.only_if("c_nationkey >= 20", b.number(["Lang"], "c_nationkey")),
        b.only_if("c_mktsegment = 'BUILDING'", b.container(["MarkInfo"], "dict")),
        b.only_if("c_mktsegment = 'BUILDING'", b.boolean(["MarkInfo", "Marked"], "if(c_acctbal > 0, 'true', 'false')")),
        b.only_if("c_mktsegment = 'MACHINERY'", b.name(["MarkInfo"], "'yes'")),
        b.only_if("c_mktsegment <> 'FURNITURE'", b.ref(["StructTreeRoot"], "if(c_acctbal > 0, 'root', 'gone')")),
        placed=[("'root'", b.container([], "dict")), ("'root'", b.number(["ParentTreeNextKey"], "c_custkey")),
                ("'root'", b.ref(["ParentTree"], "'pt'")),
                ("'root'", b.only_if("c_nationkey = 7", b.number(["RoleMap"], "1.5"))),
                ("'root'", b.only_if("c_nationkey <> 7", b.container(["RoleMap"], "dict"))),
                ("'root'", b.only_if("c_nationkey <> 7", b.name(["RoleMap", "(concat('R', c_custkey))"], "c_mktsegment"))),
                ("'root'", b.only_if("c_nationkey < 3", b.string(["RoleMap", "Note"], "c_name")))],
    )
    return b.stored(entries), customer.selectExpr(f"{_HEADER_DOC} as doc_id", "'cat' as obj_id")


def _header(spark, d):
    entries, catalogs = _headers(spark, d)
    return st.structure_header(entries, catalogs)


@query("role_map", """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 AND c_nationkey <> 7)
SELECT 'D' || c_custkey AS doc_id, 'R' || c_custkey AS role, c_mktsegment AS target, true AS is_name FROM c
UNION ALL SELECT 'D' || c_custkey, 'Note', '', false FROM c WHERE c_nationkey < 3""")
def _(spark, d):
    entries, _ = _headers(spark, d)
    reader = NodeReader(entries)
    roots = table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE' AND c_acctbal > 0").selectExpr(
        f"{_HEADER_DOC} as doc_id", "'root' as obj_id", "cast(array() as array<string>) as at")
    return st.role_map(reader, roots)[0]


@query("structure_header", """
SELECT 'D' || c_custkey AS doc_id, CASE WHEN c_nationkey < 10 THEN c_name ELSE '' END AS lang,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal > 0 END AS marked, CASE WHEN c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 THEN 'root' END AS root_id,
  c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 AS has_tree, CASE WHEN c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 THEN 'pt' END AS parent_tree_id,
  CASE WHEN c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 THEN c_custkey END AS next_key FROM customer""")
def _(spark, d):
    return _header(spark, d)[0]


@query("structure_header_problems", """
SELECT 'D' || c_custkey AS doc_id, 'catalog' AS place, '/Lang is an integer that does not decode as a text string' AS message FROM customer WHERE c_nationkey >= 20
UNION ALL SELECT 'D' || c_custkey, 'catalog', '/MarkInfo is a name, not a dictionary' FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'D' || c_custkey, 'catalog', '/StructTreeRoot gone does not resolve to an object; treated as absent'
  FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal <= 0
UNION ALL SELECT 'D' || c_custkey, 'StructTreeRoot root', '/RoleMap is a real, not a dictionary'
  FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 AND c_nationkey = 7
UNION ALL SELECT 'D' || c_custkey, 'StructTreeRoot root', '/RoleMap /Note maps to a string, not a name'
  FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 AND c_nationkey < 3""")
def _(spark, d):
    return _header(spark, d)[1]
