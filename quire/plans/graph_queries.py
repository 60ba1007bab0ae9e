"""Queries over the reference graph of the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.values import breadcrumb, node_id, parse_ref, ref_string
from quire.operators import graph, objects as ob
from quire.operators.content import first_k
from quire.plans import bindings as b
from quire.plans.registry import query, table

_NODES = """
nodes AS (
  SELECT 'R' || r_regionkey AS doc_id, 'R' || r_regionkey AS obj_id, CAST(NULL AS VARCHAR) AS parent_id,
         0 AS level, 'Region' AS type_name, CAST(r_regionkey AS BIGINT) * 5 + 1 AS obj_num, false AS free
  FROM region
  UNION ALL
  SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey, 1, 'Nation',
         CAST(n_nationkey AS BIGINT) * 5 + 2, false
  FROM nation
  UNION ALL
  SELECT 'R' || n_regionkey, 'C' || c_custkey, 'N' || c_nationkey, 2, 'Customer', c_custkey * 5 + 3, false
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'R' || n_regionkey, 'O' || o_orderkey, 'C' || o_custkey, 3, '', o_orderkey * 5 + 4, false
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
suppliers AS (
  SELECT 'R' || n_regionkey AS doc_id, 'S' || s_suppkey AS obj_id, 'N' || s_nationkey AS nation_id,
         s_suppkey * 5 + 5 AS obj_num, s_acctbal < 0 AS free
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def reached(spark, d):
    return graph.reachable(ob.edges(b.tree_entries(spark, d)), b.tree_roots(spark, d))


@query("reachable", f"""WITH {_NODES}
SELECT doc_id, obj_id, level, parent_id FROM nodes""")
def _(spark, d):
    return reached(spark, d)


@query("object_index", f"""WITH {_NODES}
SELECT doc_id, obj_id, obj_num, 0 AS gen, type_name, free, true AS reachable,
       'obj:0:' || obj_num AS node_id FROM nodes
UNION ALL
SELECT doc_id, obj_id, obj_num, 0, CASE WHEN free THEN '' ELSE 'Supplier' END, free, false, '' FROM suppliers""")
def _(spark, d):
    return graph.object_index(b.tree_objects(spark, d), reached(spark, d))


@query("orphan_objects", f"""WITH {_NODES}
SELECT doc_id, obj_id, obj_num FROM suppliers WHERE NOT free""")
def _(spark, d):
    return graph.orphans(b.tree_objects(spark, d), reached(spark, d)).select("doc_id", "obj_id", "obj_num")


@query("ancestor_path", f"""WITH {_NODES}
SELECT o.doc_id, o.obj_id, o.doc_id || ' > ' || c.parent_id || ' > ' || o.parent_id || ' > ' || o.obj_id AS crumbs,
       CAST(NULL AS VARCHAR) AS error
FROM nodes o JOIN nodes c ON o.parent_id = c.obj_id AND o.doc_id = c.doc_id WHERE o.level = 3
UNION ALL
SELECT doc_id, obj_id, NULL, 'object is not reachable from the catalog' FROM suppliers""")
def _(spark, d):
    targets = b.tree_objects(spark, d).where("obj_id LIKE 'O%' OR obj_id LIKE 'S%'")
    return graph.ancestor_path(reached(spark, d), targets).select(
        "doc_id", "obj_id", breadcrumb(F.col("ids")).alias("crumbs"), "error"
    )


@query("reverse_refs", f"""WITH {_NODES},
refs AS (
  SELECT doc_id, obj_id, parent_id, '/Kids[' || substr(obj_id, 2) || ']' AS path FROM nodes WHERE level > 0
  UNION ALL
  SELECT doc_id, parent_id, obj_id, '/Parent' FROM nodes WHERE level IN (1, 2))
SELECT r.doc_id, r.obj_id, r.parent_id, p.type_name AS parent_type, r.path,
       CASE p.level WHEN 0 THEN '' WHEN 1 THEN '/Kids[' || substr(p.obj_id, 2) || ']'
         ELSE '/Kids[' || substr(p.parent_id, 2) || '] /Kids[' || substr(p.obj_id, 2) || ']' END AS parent_path,
       p.obj_num AS parent_num
FROM refs r JOIN nodes p ON r.parent_id = p.obj_id AND r.doc_id = p.doc_id""")
def _(spark, d):
    edges = ob.edges(b.tree_entries(spark, d))
    seen = graph.reachable(edges, b.tree_roots(spark, d))
    paths = graph.root_paths(edges, seen)
    return graph.reverse_refs(edges, seen, b.tree_objects(spark, d), paths).drop("parent_gen")


@query("reverse_ref_counts", f"""WITH {_NODES}
SELECT 'N' || n_nationkey AS obj_id, 'R' || n_regionkey AS doc_id,
       1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_refs FROM nation""")
def _(spark, d):
    # Back-edges make the nations the hot targets; counts combine before the shuffle.
    edges = ob.edges(b.tree_entries(spark, d))
    seen = graph.reachable(edges, b.tree_roots(spark, d)).select("doc_id", F.col("obj_id").alias("src_id"))
    return (
        edges.join(seen, ["doc_id", "src_id"], "left_semi")
        .where("dst_id LIKE 'N%'")
        .groupBy("doc_id", F.col("dst_id").alias("obj_id"))
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )


@query("parent_labels", """
SELECT 'R' || n_regionkey AS doc_id, 'O' || o_orderkey AS parent_id, 'Kids' AS parent_type
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    # Orders have no type; a reference out of each one shows the fallback label.
    tree = b.tree_entries(spark, d)
    note = tree.where("obj_id LIKE 'O%' AND size(path) = 0").select(
        "doc_id", F.col("obj_id").alias("src_id"), F.col("doc_id").alias("dst_id"),
        F.lit("/Region").alias("path"), F.array(F.lit("Region")).alias("ord"))
    edges = ob.edges(tree).unionByName(note)
    seen = graph.reachable(edges, b.tree_roots(spark, d))
    paths = seen.select("doc_id", "obj_id", F.lit("").alias("root_path"))
    refs = graph.reverse_refs(edges, seen, b.tree_objects(spark, d), paths)
    return refs.where("parent_id LIKE 'O%'").select("doc_id", "parent_id", "parent_type")


@query("resolve_depth_2", f"""WITH {_NODES}
SELECT doc_id, doc_id AS root_id, 'Kids/[' || substr(obj_id, 2) || ']' AS path, 0 AS depth, CAST(NULL AS VARCHAR) AS flag
  FROM nodes WHERE level = 1
UNION ALL SELECT doc_id, doc_id, 'Kids/[' || substr(obj_id, 2) || ']/Parent', 1, 'cyclic' FROM nodes WHERE level = 1
UNION ALL SELECT doc_id, doc_id, 'Kids/[' || substr(parent_id, 2) || ']/Kids/[' || substr(obj_id, 2) || ']', 1, NULL
  FROM nodes WHERE level = 2
UNION ALL SELECT doc_id, doc_id, 'Kids/[' || substr(parent_id, 2) || ']/Kids/[' || substr(obj_id, 2) || ']/Parent', 2, 'cyclic'
  FROM nodes WHERE level = 2
UNION ALL SELECT o.doc_id, o.doc_id, 'Kids/[' || substr(c.parent_id, 2) || ']/Kids/[' || substr(c.obj_id, 2) || ']/Kids/['
    || substr(o.obj_id, 2) || ']', 2, 'truncated'
  FROM nodes o JOIN nodes c ON o.parent_id = c.obj_id AND o.doc_id = c.doc_id WHERE o.level = 3""")
def _(spark, d):
    rows = graph.resolve(b.tree_entries(spark, d), b.tree_roots(spark, d), 2)
    return rows.where("ref_id IS NOT NULL").select(
        "doc_id", "root_id", F.array_join("path", "/").alias("path"), "depth", "flag"
    )


@query("resolve_closure", """
WITH o AS (SELECT 'N' || c_nationkey AS doc_id, c_custkey AS c, o_orderkey AS o, o_orderkey % 500 = 0 AS loop FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT o.*, 'S' || l_suppkey AS s, l_linenumber * 100000 + l_partkey AS i FROM o JOIN lineitem ON l_orderkey = o)
SELECT doc_id, doc_id AS obj_id, '' AS path, 1 AS n_paths, false AS cyclic FROM (SELECT DISTINCT 'N' || n_nationkey AS doc_id FROM nation)
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'Kids/[' || c_custkey || ']', 1, false FROM customer
UNION ALL SELECT doc_id, 'O' || o, 'Kids/[' || c || ']/Kids/[' || o || ']', CASE WHEN loop THEN NULL ELSE 1 END, loop FROM o
UNION ALL SELECT doc_id, s, arg_min('Kids/[' || c || ']/Kids/[' || o || ']/Lines/[' || i || ']', (c, o, i)),
  CASE WHEN bool_or(loop) THEN NULL ELSE count(*) END, bool_or(loop) FROM l GROUP BY doc_id, s""")
def _(spark, d):
    # Nations to customers to orders to the suppliers of their lines; some orders refer to themselves.
    customer = table(spark, d, "customer")
    orders = table(spark, d, "orders").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").join(orders.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    slot = lambda key, n: [key, f"concat('[', {n}, ']')"]
    nation = "concat('N', c_nationkey)"
    rows = b.union_all(
        b.entries_of(customer, nation, "concat('C', c_custkey)", b.container([], "dict"),
                     placed=[(nation, b.ref(slot("Kids", "c_custkey"), "concat('C', c_custkey)", "c_custkey"))]),
        b.entries_of(orders, nation, "concat('O', o_orderkey)", b.only_if("o_orderkey % 500 = 0", b.ref(["Self"], "concat('O', o_orderkey)")),
                     placed=[("concat('C', o_custkey)", b.ref(slot("Kids", "o_orderkey"), "concat('O', o_orderkey)", "o_orderkey"))]),
        b.entries_of(lines, nation, "concat('O', l_orderkey)", b.ref(
            slot("Lines", "l_linenumber * 100000 + l_partkey"), "concat('S', l_suppkey)", "l_linenumber * 100000 + l_partkey")),
    )
    roots = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as doc_id", "concat('N', n_nationkey) as obj_id")
    out = graph.resolve_once(rows, roots)
    return out.select("doc_id", "obj_id", F.array_join("path", "/").alias("path"), F.col("n_paths").cast("bigint").alias("n_paths"), "cyclic")


@query("tree_dump", f"""WITH {_NODES}, per AS (SELECT doc_id, level, count(*) AS n FROM nodes GROUP BY ALL)
SELECT doc_id, level AS depth,
       CASE level WHEN 0 THEN 3 + (SELECT n FROM per p WHERE p.doc_id = q.doc_id AND p.level = 1)
                  WHEN 1 THEN 4 * n + (SELECT n FROM per p WHERE p.doc_id = q.doc_id AND p.level = 2)
                  WHEN 2 THEN 5 * n + (SELECT n FROM per p WHERE p.doc_id = q.doc_id AND p.level = 3)
                  ELSE 2 * n END AS n_rows
FROM per q""")
def _(spark, d):
    return (
        graph.tree_dump(b.tree_entries(spark, d), b.tree_roots(spark, d))
        .groupBy("doc_id", "depth")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query("tree_dump_depth_1", f"""WITH {_NODES}
SELECT doc_id, 'Kids/[' || substr(parent_id, 2) || ']/Kids/[' || substr(obj_id, 2) || ']' AS path, obj_id AS ref_id
FROM nodes WHERE level = 2
UNION ALL SELECT doc_id, 'Kids/[' || substr(obj_id, 2) || ']', obj_id FROM nodes WHERE level = 1
UNION ALL SELECT doc_id, 'Kids/[' || substr(obj_id, 2) || ']/Parent', doc_id FROM nodes WHERE level = 1""")
def _(spark, d):
    rows = graph.tree_dump(b.tree_entries(spark, d), b.tree_roots(spark, d), max_depth=1)
    return rows.where("ref_id IS NOT NULL").select("doc_id", F.array_join("path", "/").alias("path"), "ref_id")


# --- projections and lookups -------------------------------------------------


@query("classify_value", """
WITH kids AS (
  SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'C' || c_custkey AS obj_id, p.path, p.node_type, p.value_type, p.has_children,
       CASE p.path WHEN '' THEN 5 WHEN 'Kids' THEN n WHEN 'Parent' THEN -1 ELSE 0 END AS child_count
FROM kids, (VALUES ('', 'dict', '', true), ('Kids', 'array', '', true), ('Parent', 'ref', 'reference', true),
  ('Type', 'scalar', 'name', false), ('Name', 'scalar', 'string', false), ('Balance', 'scalar', 'number', false))
  AS p(path, node_type, value_type, has_children)""")
def _(spark, d):
    rows = ob.classify_value(b.tree_entries(spark, d))
    return rows.where("obj_id LIKE 'C%' AND size(path) < 2").select(
        "obj_id", F.array_join("path", "/").alias("path"), "node_type", "value_type", "has_children", "child_count"
    )


@query("semantic_label", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Font: ' || p_name WHEN 'SMALL' THEN 'Image'
    WHEN 'STANDARD' THEN 'Form XObject' WHEN 'LARGE' THEN 'MediaBox' WHEN 'MEDIUM' THEN 'Catalog'
    ELSE p_name END AS label FROM part""")
def _(spark, d):
    t = F.col("p_type")
    lit = lambda kind, v: F.when(t == kind, F.lit(v))
    return table(spark, d, "part").select(
        "p_partkey",
        ob.semantic_label(
            F.coalesce(lit("LARGE", "MediaBox"), F.lit("")),
            F.coalesce(lit("ECONOMY", "Font"), lit("MEDIUM", "Catalog")),
            F.coalesce(lit("SMALL", "Image"), lit("STANDARD", "Form")),
            F.when(t == "ECONOMY", F.col("p_name")),
            F.lit("string"),
            F.col("p_name"),
        ).alias("label"),
    )


@query("children", """
SELECT 'N' || n_nationkey AS obj_id, v.key, CASE v.key WHEN 'Name' THEN n_name WHEN 'Type' THEN 'Nation'
    WHEN 'Parent' THEN 'R' || n_regionkey END AS value
FROM nation, (VALUES ('Name'), ('Type'), ('Parent'), ('Kids')) AS v(key)""")
def _(spark, d):
    nations = b.tree_objects(spark, d).where("type_name = 'Nation'")
    return ob.children(b.tree_entries(spark, d), nations).select("obj_id", "key", "value")


@query("array_children", """
SELECT 'N' || c_nationkey AS obj_id, '[' || c_custkey || ']' AS key, c_custkey AS idx, 'C' || c_custkey AS ref_id
FROM customer""")
def _(spark, d):
    nations = b.tree_objects(spark, d).where("type_name = 'Nation'")
    return ob.children(b.tree_entries(spark, d), nations, ["Kids"]).select("obj_id", "key", "idx", "ref_id")


@query("object_detail", """
SELECT 'O' || o_orderkey AS obj_id, 'Status' AS key, o_orderstatus AS display, CAST(NULL AS VARCHAR) AS raw FROM orders
UNION ALL SELECT 'S' || s_suppkey, 'Nation', 'N' || s_nationkey, NULL FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'Type', 'Supplier', '/Supplier' FROM supplier""")
def _(spark, d):
    rows = ob.object_detail(b.tree_entries(spark, d), b.tree_objects(spark, d))
    return rows.where("key = 'Status' OR obj_id LIKE 'S%'").select("obj_id", "key", "display", "raw")


@query("stream_facts", """
SELECT 'P' || p_partkey AS obj_id, CASE WHEN p_type = 'LARGE' THEN NULL ELSE CAST(p_size AS BIGINT) END AS length,
  CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN p_type ELSE 'A,' || p_type END AS filters FROM part""")
def _(spark, d):
    # The length of a stream is its own, behind a reference, or no number at all.
    part = table(spark, d, "part")
    rows = b.entries_of(
        part, "'parts'", "concat('P', p_partkey)", b.container([], "stream"),
        b.only_if("p_type = 'SMALL'", b.ref(["Length"], "concat('L', p_partkey)")),
        b.only_if("p_type not in ('SMALL', 'LARGE')", b.number(["Length"], "p_size")),
        b.only_if("p_type = 'LARGE'", b.name(["Length"], "'many'")),
        b.only_if("p_size between 21 and 40", b.name(["Filter"], "p_type")),
        b.only_if("p_size <= 20", b.container(["Filter"], "array")),
        b.only_if("p_size <= 20", b.entry(["Filter", "[0]"], "name", "'/A'", "'A'", idx="0")),
        b.only_if("p_size <= 20", b.entry(["Filter", "[1]"], "name", "concat('/', p_type)", "p_type", idx="1")),
        placed=[("concat('L', p_partkey)", b.number([], "p_size"))],
    )
    return ob.stream_facts(rows).select("obj_id", "length", F.array_join("filters", ",").alias("filters"))


def _palette(spark, d):
    """Search texts taken from the data: names, references, prefixes and junk."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return b.union_all(
        r.select(F.concat(F.lit("("), (F.col("r_regionkey") * 5 + 1).cast("string"), F.lit(" 0 R)")).alias("query")),
        n.select((F.col("n_nationkey") * 5 + 2).cast("string").alias("query")),
        r.select(F.when(F.col("r_regionkey") == 0, "/nation").when(F.col("r_regionkey") == 1, "c")
                 .when(F.col("r_regionkey") == 2, "su").when(F.col("r_regionkey") == 3, "7 x").otherwise("/").alias("query")),
    )


_PALETTE_SQL = """
index AS (
  SELECT doc_id, obj_num, type_name, true AS reachable FROM nodes
  UNION ALL SELECT doc_id, obj_num, CASE WHEN free THEN '' ELSE 'Supplier' END, false FROM suppliers),
hits AS (
  SELECT '(' || (r_regionkey * 5 + 1) || ' 0 R)' AS query, i.*, 0 AS tier FROM region JOIN index i
    ON i.obj_num = r_regionkey * 5 + 1
  UNION ALL SELECT CAST(n_nationkey * 5 + 2 AS VARCHAR), i.*, 0 FROM nation JOIN index i ON i.obj_num = n_nationkey * 5 + 2
  UNION ALL SELECT '/nation', i.*, 0 FROM index i WHERE type_name = 'Nation'
  UNION ALL SELECT 'c', i.*, 1 FROM index i WHERE type_name = 'Customer'
  UNION ALL SELECT 'su', i.*, 1 FROM index i WHERE type_name = 'Supplier')
"""


def _index(spark, d):
    idx = graph.object_index(b.tree_objects(spark, d), reached(spark, d))
    return idx.select("doc_id", "obj_num", "gen", "type_name", "reachable")


@query("find_object", f"""WITH {_NODES}, {_PALETTE_SQL}
SELECT query, doc_id, obj_num, tier FROM hits""")
def _(spark, d):
    return ob.find_object(_palette(spark, d), _index(spark, d)).select("query", "doc_id", "obj_num", "tier")


@query("rank_objects", f"""WITH {_NODES}, {_PALETTE_SQL}
SELECT query, doc_id, obj_num, rank FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY query ORDER BY tier, reachable DESC, obj_num, doc_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 8""")
def _(spark, d):
    return ob.rank_objects(_palette(spark, d), _index(spark, d)).select("query", "doc_id", "obj_num", "rank")


@query("xref_view", f"""WITH {_NODES}
SELECT doc_id, obj_num, 'in-use' AS status, CASE level WHEN 0 THEN -1 WHEN 1 THEN (obj_num - 2) // 5 * 100
   ELSE (obj_num - 3) // 5 * 1000 END AS "offset", 0 AS host_objstm, 'obj:0:' || obj_num AS node_id FROM nodes WHERE level < 3
UNION ALL
SELECT 'R' || n_regionkey, o_orderkey * 5 + 4, CASE o_orderstatus WHEN 'P' THEN 'in-objstm' ELSE 'in-use' END,
   CASE o_orderstatus WHEN 'P' THEN -1 ELSE o_orderkey * 10 END, CASE o_orderstatus WHEN 'P' THEN o_custkey ELSE 0 END,
   'obj:0:' || (o_orderkey * 5 + 4)
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT doc_id, obj_num, CASE WHEN free THEN 'free' ELSE 'in-use' END, -1, 0, CASE WHEN free THEN '' ELSE 'obj:0:' || obj_num END
FROM suppliers""")
def _(spark, d):
    return ob.xref_view(b.tree_objects(spark, d)).drop("gen")


@query("order_index", f"""WITH {_NODES}
SELECT doc_id, obj_num FROM nodes UNION ALL SELECT doc_id, obj_num FROM suppliers""")
def _(spark, d):
    return ob.order_index(b.tree_objects(spark, d)).select("doc_id", "obj_num")


@query("reference_forms", """
SELECT o_orderkey, o_orderkey || ' 0 R' AS ref, 'obj:0:' || o_orderkey AS node, o_orderkey AS num_a, o_orderkey AS num_b,
       CAST(NULL AS BIGINT) AS num_c FROM orders""")
def _(spark, d):
    num = F.col("o_orderkey")
    forms = table(spark, d, "orders").select(
        "o_orderkey", ref_string(num, F.lit(0)).alias("ref"), node_id(num, F.lit(0)).alias("node"),
        F.col("o_orderpriority").alias("junk"))
    return forms.select(
        "o_orderkey", "ref", "node",
        parse_ref(F.col("ref"))["num"].alias("num_a"),
        parse_ref(F.col("node"))["num"].alias("num_b"),
        parse_ref(F.col("junk"))["num"].alias("num_c"),
    )


@query("forbidden_actions", """
SELECT 'e' || event_id AS obj_id, CASE event_type WHEN 'click' THEN 'JavaScript' WHEN 'purchase' THEN 'Launch'
   ELSE 'JavaScript' END AS kind, 'object' AS "where" FROM events WHERE event_type IN ('click', 'purchase', 'error')
UNION ALL SELECT 'e' || event_id, 'Launch', 'OpenAction' FROM events WHERE event_type = 'signup'""")
def _(spark, d):
    case = lambda kind, row: b.only_if(f"event_type = '{kind}'", row)
    rows = b.entries_of(
        table(spark, d, "events"), "user_id", "concat('e', event_id)",
        b.container([], "dict"),
        case("click", b.name(["S"], "'JavaScript'")),
        case("purchase", b.name(["S"], "'Launch'")),
        case("view", b.name(["S"], "'GoTo'")),
        case("error", b.string(["JS"], "props")),
        case("signup", b.container(["OpenAction"], "dict")),
        case("signup", b.name(["OpenAction", "S"], "'Launch'")),
    )
    catalogs = rows.where("size(path) = 0")
    return ob.forbidden_actions(rows, catalogs).select("obj_id", "kind", "where")


@query("dereference", """
SELECT 'O' || o_orderkey AS obj_id, 'C' || o_custkey AS ref_id, CASE WHEN o_orderstatus = 'F' THEN 'dict' END AS target_type, o_orderstatus = 'O' AS dangling
FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'O' || o_orderkey, NULL, NULL, false FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    # Finished orders point at their customer, open ones at nothing, pending ones hold a value.
    orders = table(spark, d, "orders")
    rows = orders.selectExpr(
        "'shop' as doc_id", "concat('O', o_orderkey) as obj_id",
        "case o_orderstatus when 'F' then concat('C', o_custkey) when 'O' then concat('X', o_custkey) end as ref_id")
    targets = b.entries_of(table(spark, d, "customer"), "'shop'", "concat('C', c_custkey)", b.container([], "dict"))
    out = ob.dereference(rows, targets)
    return out.select("obj_id", F.regexp_replace("ref_id", "^X", "C").alias("ref_id"), "target_type", "dangling")


@query("first_k", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey, count(*) AS n, string_agg(o_orderkey, ', ' ORDER BY o_orderkey) FILTER (WHERE rn <= 3) AS first FROM r GROUP BY o_custkey""")
def _(spark, d):
    return first_k(table(spark, d, "orders").withColumn("v", F.col("o_orderkey")), ["o_custkey"], "o_orderkey", "v", 3)
