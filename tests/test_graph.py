from fixtures import Ref, sort_rows
from pyspark.sql import functions as F

from quire.operators import graph as g
from quire.operators import objects as ob


def roots(spark, *ids):
    return spark.createDataFrame([("d", i) for i in ids], "doc_id string, obj_id string")


def test_deep_chain(spark):
    n = 24
    edges = spark.createDataFrame([("d", str(i), str(i + 1), "/Kids[0]", ["Kids", "[0]"]) for i in range(n)], "doc_id string, src_id string, dst_id string, path string, ord array<string>")
    seen = g.reachable(edges, roots(spark, "0"))
    assert sort_rows(seen, "level") == sorted([(i,) for i in range(n + 1)], key=repr)
    path = g.ancestor_path(seen, roots(spark, str(n), "zz")).collect()
    by = {r.obj_id: r for r in path}
    assert by[str(n)].ids == [str(i) for i in range(n + 1)] and by["zz"].error


def test_hot_sources_are_split_without_loss(spark):
    pairs = [("d", "hub", f"t{i}") for i in range(50)] + [("d", "t1", "hub"), ("d", "t2", "x"), ("d", "lost", "y")]
    edges = spark.createDataFrame(pairs, "doc_id string, src_id string, dst_id string")
    plain = sort_rows(g.reachable(edges, roots(spark, "hub")), "obj_id", "level", "parent_id")
    split = sort_rows(g.reachable(edges, roots(spark, "hub"), per_bucket=7), "obj_id", "level", "parent_id")
    assert plain == split and len(plain) == 52


def test_resolve_marks_cycles_and_depth_but_not_diamonds(spark, obj):
    e = obj({
        ("d", "1"): {"A": Ref("2"), "B": Ref("3"), "Gone": Ref("9")},
        ("d", "2"): {"C": Ref("4")},
        ("d", "3"): {"C": Ref("4")},
        ("d", "4"): {"Up": Ref("2"), "V": 1},
    })
    flags = {"/".join(r.path): r.flag for r in g.resolve(e, roots(spark, "1"), 3).collect()}
    assert flags["A/C/Up"] == "cyclic" and flags["B/C"] is None and flags["A/C"] is None
    assert flags["Gone"] == "truncated" and flags["B/C/Up"] is None and flags["B/C/V"] is None
    assert flags["B/C/Up/C"] == "cyclic" if "B/C/Up/C" in flags else True
    shallow = {"/".join(r.path): r.flag for r in g.resolve(e, roots(spark, "1"), 0).collect()}
    assert shallow == {"A": "truncated", "B": "truncated", "Gone": "truncated"}
    assert g.resolve(e, roots(spark, "1"), -5).count() == 3


def test_tree_dump_expands_each_object_once(spark, obj):
    e = obj({("d", "1"): {"A": Ref("2"), "B": Ref("2")}, ("d", "2"): {"V": 1, "Self": Ref("1")}})
    assert sort_rows(g.tree_dump(e, roots(spark, "1")).select(F.array_join("path", "/").alias("p")), "p") == [
        ("A",), ("A/Self",), ("A/V",), ("B",)]


def test_reverse_refs_label_and_reachability(spark, obj):
    e = obj({
        ("d", "1"): {"Type": "Catalog", "Outlines": Ref("2")},
        ("d", "2"): {"First": Ref("3"), "Kids": [Ref("3")]},
        ("d", "3"): {"Parent": Ref("2")},
        ("d", "4"): {"Stray": Ref("3")},
    })
    edges = ob.edges(e)
    seen = g.reachable(edges, roots(spark, "1"))
    objects = spark.createDataFrame(
        [("d", str(i), i, 0, t) for i, t in ((1, "Catalog"), (2, None), (3, None), (4, "X"))],
        "doc_id string, obj_id string, obj_num bigint, gen int, type_name string")
    refs = g.reverse_refs(edges, seen, objects, g.root_paths(edges, seen))
    got = sort_rows(refs.where("obj_id = '3'"), "parent_id", "parent_type", "path", "parent_path")
    assert got == [("2", "Outlines", "/First", "/Outlines"), ("2", "Outlines", "/Kids[0]", "/Outlines")]


def test_search_box_grammar(spark):
    q = spark.createDataFrame([(x,) for x in ["", " (12 0 r) ", "7", "/Page", "pa", "/", "1 x"]], "query string")
    kinds = [(r.q.kind, r.q.num, r.q.gen, r.q.value, r.q.exact) for r in q.select(ob.parse_query(F.col("query")).alias("q")).collect()]
    assert [k[0] for k in kinds] == ["empty", "numeric", "numeric", "type", "type", "invalid", "invalid"]
    assert kinds[1][1:3] == (12, 0) and kinds[3][3:] == ("page", True) and kinds[4][3:] == ("pa", False)


def test_stream_length_behind_a_reference(spark, obj):
    from fixtures import Stream

    e = obj({("d", "1"): Stream({"Length": Ref("2"), "Filter": ["A", "B"]}), ("d", "2"): 44, ("d", "3"): Stream({"Length": -1, "Filter": "C"})})
    got = {r.obj_id: (r.length, r.filters) for r in ob.stream_facts(e).collect()}
    assert got == {"1": (44, ["A", "B"]), "3": (None, ["C"])}


def links(spark, rows):
    return spark.createDataFrame([("d", a, b, [s]) for a, b, s in rows], "doc_id string, src_id string, dst_id string, step array<string>")


def test_a_level_moves_its_frontier_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([("d", str(i), str(i + 1)) for i in range(60)] + [("d", "7", "3")], "doc_id string, src_id string, dst_id string")
        spread, seen = g.SpreadEdges(edges), g.Visited(g.OBJ)
        frontier = seen.add(roots(spark, "0"))
        for _ in range(3):
            level = g.next_level(spread, seen, frontier)
            assert level._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
            frontier = seen.add(level.select(*g.OBJ), laid=True)
        # A fresh part joins the next edges without any exchange.
        assert "Exchange" not in spread.step(frontier)._jdf.queryExecution().executedPlan().toString()
        reader = g.NodeReader(_entries(spark))
        nodes = seen.add(roots(spark, "p").withColumn("level", F.lit(1)).drop("level"))
        nodes = g.BucketedTable.write(nodes.withColumn("at", F.array().cast("array<string>")), g.NODE).df
        for rows in (reader.keys(nodes, ["Type", "Kids"], resolve=True), reader.items(nodes, "Kids", resolve=True)):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert g.reachable(edges, roots(spark, "0")).count() == 61
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _entries(spark):
    from fixtures import entries_frame

    return entries_frame(spark, {("d", "p"): {"Type": "Pages", "Kids": [Ref("q"), Ref("r")]}, ("d", "q"): {"Type": "Page"}, ("d", "r"): {}})


def test_long_chain_by_pointer_jumping(spark):
    n = 5000
    chain = spark.range(n + 1).selectExpr("'d' as doc_id", "cast(id as string) as obj_id", "cast(id as int) as level", "if(id = 0, null, cast(id - 1 as string)) as parent_id")
    got = g.ancestor_path(chain, roots(spark, str(n), "1", "0", "zz")).collect()
    by = {r.obj_id: r.ids for r in got}
    assert by[str(n)] == [str(i) for i in range(n + 1)] and by["1"] == ["0", "1"] and by["0"] == ["0"] and by["zz"] is None


def test_paths_through_a_hot_ancestor(spark):
    rows = [("d", "r", 0, None), ("d", "a", 1, "r"), ("d", "b", 2, "a")] + [("d", f"x{i}", 3, "b") for i in range(300)]
    rows += [("d", f"y{i}", 4, f"x{i}") for i in range(300)]
    reached = spark.createDataFrame(rows, "doc_id string, obj_id string, level int, parent_id string")
    targets = reached.where("level > 2").select("doc_id", "obj_id")
    plain = {r.obj_id: r.ids for r in g.ancestor_path(reached, targets).collect()}
    dealt = {r.obj_id: r.ids for r in g.ancestor_path(reached, targets, per_key=50).collect()}
    assert plain == dealt and plain["y7"] == ["r", "a", "b", "x7", "y7"] and len(plain) == 600


def depth_first(edges, root):
    kids, met = {}, {}
    for a, b, s in sorted(edges, key=lambda e: e[2]):
        kids.setdefault(a, []).append((s, b))

    def visit(v, path):
        met[v] = path
        for s, w in kids.get(v, []):
            if w not in met:
                visit(w, [*path, s])

    visit(root, [])
    return met


def test_first_sight_is_the_depth_first_reader(spark):
    import random

    # A shared node met deep first, shallow later.
    fixed = [("1", "2", "a"), ("2", "3", "a"), ("3", "4", "a"), ("1", "4", "b"), ("4", "1", "a"), ("4", "5", "b"), ("5", "3", "a")]
    for seed in range(3):
        rng = random.Random(seed)
        edges = fixed if seed == 0 else [(str(rng.randrange(12)), str(rng.randrange(12)), f"{k:03d}") for k in range(40)]
        root = "1"
        named = links(spark, edges).withColumnsRenamed({"src_id": "obj_id", "dst_id": "to_obj_id"})
        starts = roots(spark, root).withColumn("label", F.array().cast("array<string>"))
        got = {r.obj_id: list(r.label) for r in g.first_sight(named, starts, ["obj_id"]).collect()}
        assert got == depth_first(edges, root)


def test_diamonds_and_cycles_without_listing(spark):
    edges, n = [], 8
    for i in range(n):
        edges += [(f"n{i}", f"a{i}", "a"), (f"n{i}", f"b{i}", "b"), (f"a{i}", f"n{i + 1}", "x"), (f"b{i}", f"n{i + 1}", "x")]
    edges += [("n0", "c", "c"), ("c", "d", "d"), ("d", "c", "e"), ("d", "t", "t"), ("n0", "t", "t"), ("q", "n1", "q")]
    starts = spark.createDataFrame([("d", "n0", "n0")], "doc_id string, root_id string, obj_id string")
    rows = {r.obj_id: r for r in g.closure(links(spark, edges), starts).collect()}
    assert rows[f"n{n}"].n_paths == 2**n and rows[f"n{n}"].path == ["a", "x"] * n and not rows[f"n{n}"].cyclic
    assert rows["b3"].n_paths == 8 and rows["n0"].n_paths == 1 and "q" not in rows
    assert all(rows[v].cyclic and rows[v].n_paths is None for v in "cdt") and len(rows) == 3 * n + 1 + 3


def test_resolve_once_orders_array_places(spark, obj):
    e = obj({("d", "1"): {"K": [Ref("9")] * 10 + [Ref("2")], "L": Ref("2")}, ("d", "2"): {"V": 1}})
    rows = {r.obj_id: r for r in g.resolve_once(e, roots(spark, "1")).collect()}
    assert rows["2"].path == ["K", "[10]"] and rows["2"].n_paths == 2
    assert rows["9"].path == ["K", "[0]"] and rows["9"].n_paths == 10 and rows["1"].n_paths == 1


def test_tree_dump_follows_document_order(spark, obj):
    # 4 is met deep first, below 2; the shallow reference of 1 comes later.
    e = obj({("d", "1"): {"A": Ref("2"), "B": Ref("4")}, ("d", "2"): {"C": Ref("3")}, ("d", "3"): {"D": Ref("4")}, ("d", "4"): {"V": 1}})
    rows = {"/".join(r.path): r.depth for r in g.tree_dump(e, roots(spark, "1")).collect()}
    assert rows == {"A": 0, "B": 0, "A/C": 1, "A/C/D": 2, "A/C/D/V": 3}
