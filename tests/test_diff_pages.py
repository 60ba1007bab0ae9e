from fixtures import Ref, entries_frame, sort_rows

from quire.operators import diff, images, pages
from quire.plans import validation as v


def pair(spark):
    return spark.createDataFrame([("d", "1", "1")], "doc_id string, left_id string, right_id string")


def chain(n, last):
    out = {("d", str(i)): {"Next": Ref(str(i + 1))} for i in range(1, n)}
    out["d", str(n)] = {"V": last}
    return out


def test_leaf_rules(spark, obj):
    left = obj({("d", "1"): {"Same": 1, "Gone": "x", "Kind": 1, "Raw": b"A", "Sig": {"ByteRange": [0], "Contents": b"ab"}, "Arr": [1, 2], "Up": Ref("1")}})
    right = entries_frame(spark, {("d", "1"): {
        "Same": 1, "New": {"k": Ref("1")}, "Kind": [1], "Raw": b"A", "Sig": {"ByteRange": [0], "Contents": b"zz"}, "Arr": [1, 2, 3], "Up": Ref("1")}})
    from pyspark.sql import functions as F

    # Other bytes that decode alike: a change, shown as stored.
    right = right.withColumn("value_raw", F.when(F.col("key") == "Raw", "<FEFF0041>").otherwise(F.col("value_raw")))
    nodes = diff.diff_pair(left, right, pair(spark))
    got = {"/".join(r.path): (r.status, r.left, r.right) for r in diff.changes(nodes).collect()}
    # A back-edge compares its target by one level of text, so it differs too.
    assert got.pop("Up")[0] == "changed"
    assert got == {
        "Arr/[2]": ("added", "", "3"),
        "Gone": ("removed", "/x", ""),
        "Kind": ("changed", "1", "[ 1 ]"),
        "New": ("added", "", "<< /k <ref> >>"),
        "Raw": ("changed", "(A)", "<FEFF0041>"),
        "Sig/Contents": ("changed", "<binary, 2 bytes>", "<binary, 2 bytes>"),
    }
    assert nodes.where("array_contains(path, 'Same') AND status <> 'unchanged'").count() == 0
    same = diff.diff_pair(left, left, pair(spark))
    assert same.where("status <> 'unchanged' OR truncated").count() == 0


def test_depth_limit_truncates_and_reconciles(spark, obj):
    a, b = obj(chain(6, 1)), obj(chain(6, 2))
    nodes = diff.diff_pair(a, b, pair(spark), max_depth=3)
    assert nodes.where("truncated").count() == 1 and nodes.where("status <> 'unchanged'").count() == 0
    assert diff.diff_pair(a, b, pair(spark), max_depth=8).where("status = 'changed' AND is_leaf").count() == 1
    # The capped pair is also entered through a shorter way, so it hides nothing.
    short = chain(6, 1)
    short["d", "1"] = {"Next": Ref("2"), "Far": Ref("5")}
    s = obj(short)
    assert diff.diff_pair(s, s, pair(spark), max_depth=3).where("truncated").count() == 0


def test_page_tree_faults(spark, obj):
    e = obj({
        ("d", "1"): {"Type": "Pages", "MediaBox": [0, 0, 9, 9], "Rotate": 90, "Kids": [
            Ref("2"), None, 7, Ref("1"), Ref("99"), Ref("2"), Ref("3"), {"Type": "Page"}, Ref("4")]},
        ("d", "2"): {"Type": "Page", "MediaBox": Ref("98"), "Rotate": 1.6},
        ("d", "3"): {"Type": "Pages"},
        ("d", "4"): {"Kids": [Ref("5"), Ref("4")]},
        ("d", "5"): {"Type": "Page", "Kids": [], "Rotate": "x"},
    })
    roots = spark.createDataFrame([("d", "1")], "doc_id string, obj_id string")
    rows = pages.page_index(e, roots).orderBy("ord").collect()
    got = [(r.page_num, r.obj_id, r.error) for r in rows]
    lost = "/MediaBox resolves to nothing; inherited value used; /Rotate is not an integer; read as 2"
    assert got == [
        (1, "2", lost),
        (None, None, "/Kids entry 1 is null"),
        (None, None, "/Kids entry 2 is not a dictionary: integer"),
        (None, "1", "/Kids entry 3 (1) points at an ancestor: page tree cycle"),
        (None, "99", "/Kids entry 4 (99) is a dangling reference"),
        (2, "2", "page object also listed as page 1; " + lost),
        (None, "3", "/Pages node has no /Kids"),
        (3, None, "page is a direct dictionary, not an indirect reference"),
        (4, "5", "page has a /Kids entry; its kids are not walked; /Rotate is not a number"),
        (None, "4", "/Kids entry 1 (4) points at an ancestor: page tree cycle"),
    ]


def test_images_through_forms(spark):
    pg = spark.createDataFrame([("d", 1, "r"), ("d", 2, "r")], "doc_id string, page_num bigint, res_id string")
    x = spark.createDataFrame(
        [("d", "r", "B", "f1", "Form"), ("d", "r", "Z", "im", "Image"), ("d", "f1", "A", "im", "Image"), ("d", "f1", "F", "f2", "Form"),
         ("d", "f2", "Back", "f1", "Form"), ("d", "f2", "I", "im2", "Image")],
        "doc_id string, owner_id string, name string, obj_id string, subtype string")
    uses, issues = images.image_uses(pg, x)
    got = [(r.page_num, r.obj_id, list(r.path)) for r in uses.orderBy("page_num", "obj_id").collect()]
    assert got == [(p, i, path) for p in (1, 2) for i, path in (("im", ["B", "A"]), ("im2", ["B", "F", "I"]))]
    assert issues.count() == 0
    capped, issues = images.image_uses(pg, x, max_depth=1)
    assert sort_rows(capped, "page_num", "obj_id") == [(1, "im"), (2, "im")] and issues.count() == 2


def test_equal_resources_are_walked_once(spark):
    pg = spark.createDataFrame([("d", n, r) for n, r in ((1, "r1"), (2, "r2"), (3, "r2"), (4, "f"), (5, "g"), (6, "r3"), (7, None))], "doc_id string, page_num int, res_id string")
    # r1 and r2 hold the same; so do f and g, but f is met again on the way from g.
    x = spark.createDataFrame(
        [("d", o, n, i, k) for o in ("r1", "r2") for n, i, k in (("F", "f", "Form"), ("I", "im", "Image"))]
        + [("d", o, n, i, k) for o in ("f", "g") for n, i, k in (("F", "f", "Form"), ("I", "im2", "Image"))] + [("d", "r3", "I", "im", "Image")],
        "doc_id string, owner_id string, name string, obj_id string, subtype string")
    uses, _ = images.image_uses(pg, x)
    got = sorted((r.page_num, r.obj_id, list(r.path)) for r in uses.collect())
    both = lambda p: [(p, "im", ["I"]), (p, "im2", ["F", "I"])]
    assert got == [*both(1), *both(2), *both(3), (4, "im2", ["I"]), (5, "im2", ["F", "I"]), (6, "im", ["I"])]
    counted, _ = images.image_uses(pg, x, by_page=False)
    got = sorted((r.res_id, r.n_pages, r.obj_id, list(r.path)) for r in counted.collect())
    assert got == [("f", 1, "im2", ["I"]), ("g", 1, "im2", ["F", "I"]), ("r1", 3, "im", ["I"]), ("r1", 3, "im2", ["F", "I"]), ("r3", 1, "im", ["I"])]


def test_unknown_profile_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        v.rule_table(spark, "pdfx")


def test_large_containers_are_compared_by_sums(spark):
    big = {f"k{i:05d}": i for i in range(2500)}
    make = lambda last: entries_frame(spark, {("d", "1"): {"A": Ref("2"), "B": Ref("2"), "Gone": [1, 2]}, ("d", "2"): {**big, "k00007": last}})
    left, right = make(7), make(8)
    # The second reference meets the same pair again, so its container is a leaf that is compared as a whole.
    same = {"/".join(r.path): r.status for r in diff.diff_pair(left, left, pair(spark)).where("is_leaf AND size(path) = 1").collect()}
    rows = {"/".join(r.path): r for r in diff.diff_pair(left, right, pair(spark)).where("is_leaf AND size(path) = 1").collect()}
    assert same == {"B": "unchanged"} and rows["B"].status == "changed"
    assert rows["B"].left.startswith("<< /k00000 0 /k00001 1") and rows["B"].left.endswith("/k00999 999 and 1500 more >>")
    nodes = spark.createDataFrame([("d", "2", [], "dict", False)], "doc_id string, obj_id string, at array<string>, type string, bin boolean")
    side = diff._Side(left, 1000)
    parts = side.texts(nodes, skew=diff.Skew(max_group_rows=100, chunk_rows=300)).orderBy("part").collect()
    assert [len(r.shown.split(" /")) - 1 for r in parts] == [1000, 1000, 500]
    assert "".join(r.exact for r in parts) == "".join(f" /{k} {v}" for k, v in sorted(big.items()))


def test_a_comparison_keeps_one_table_a_level(spark):
    import re
    from quire import session

    left = entries_frame(spark, {("d", "1"): {"A": Ref("2"), "B": Ref("2"), "C": 1}, ("d", "2"): {"x": 1}})
    database = session._database(spark)
    names = lambda: {r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect() if re.match("w[0-9a-f]{32}$", r.tableName)}
    before, setting = names(), spark.conf.get(session._CLEANUP, None)
    rows = {"/".join(r.path): (r.status, r.is_leaf) for r in diff.diff_pair(left, left, pair(spark)).collect()}
    assert rows == {"": ("unchanged", False), "A": ("unchanged", False), "A/x": ("unchanged", True), "B": ("unchanged", True), "C": ("unchanged", True)}
    # The roots, one table a level (two) and the result; what a level was made from is gone.
    assert len(names() - before) == 4
    # The setting is as it was.
    assert setting == spark.conf.get(session._CLEANUP, None)


def test_a_comparison_releases_what_it_is_done_with(spark, monkeypatch):
    import re

    from quire import session

    objects = {("d", "1"): {"A": Ref("2"), "B": Ref("2"), "C": 1, "Gone": [1]}, ("d", "2"): {"x": 1, "Up": Ref("1")}, ("e", "1"): {"A": Ref("2")}, ("e", "2"): {"x": 1}}
    other = {**objects, ("d", "1"): {**objects["d", "1"], "C": 2, "New": {"k": 1}}, ("e", "2"): {"x": 2}}
    del other["d", "1"]["Gone"]
    pairs = spark.createDataFrame([("d", "1", "1"), ("e", "1", "1")], "doc_id string, left_id string, right_id string")
    database = session._database(spark)
    names = lambda kind: {r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect() if re.match(f"{kind}[0-9a-f]{{32}}$", r.tableName)}
    got = []
    for most in (1, 8):
        monkeypatch.setattr(diff, "MOST_PARTS", most)
        monkeypatch.setattr(diff, "NODES_PER_PART", 1)
        left, right = (session.WrittenRows.write(entries_frame(spark, o)) for o in (objects, other))
        before = names("t")
        nodes = diff.diff_pair(left.df, right.df, pairs, release=[left, right])
        # Neither the snapshots nor how they were laid out, nor the pairs met, are kept for the result.
        assert names("t") == before and not {t.name.split(".")[1] for t in (left, right)} & names("w")
        got.append({(r.doc_id, "/".join(r.path)): (r.status, r.kind, r.left, r.right, r.is_leaf, r.n_changed_keys) for r in nodes.collect()})
    assert got[0] == got[1] == {
        ("d", ""): ("changed", "dict", "", "", False, 4),
        ("d", "A"): ("changed", "dict", "", "", False, 1),
        ("d", "A/x"): ("unchanged", "scalar", "1", "1", True, 0),
        ("d", "A/Up"): ("changed", "ref", "<< /A <ref> /B <ref> /C 1 /Gone [...] >>", "<< /A <ref> /B <ref> /C 2 /New <<...>> >>", True, 0),
        ("d", "B"): ("unchanged", "ref", "<< /Up <ref> /x 1 >>", "<< /Up <ref> /x 1 >>", True, 0),
        ("d", "C"): ("changed", "scalar", "1", "2", True, 0),
        ("d", "Gone"): ("removed", "array", "[ 1 ]", "", True, 0),
        ("d", "New"): ("added", "dict", "", "<< /k 1 >>", True, 0),
        ("e", ""): ("changed", "dict", "", "", False, 1),
        ("e", "A"): ("changed", "dict", "", "", False, 1),
        ("e", "A/x"): ("changed", "scalar", "1", "2", True, 0),
    }


def test_a_null_value_differs_from_a_text(spark, obj):
    from pyspark.sql import functions as F

    left = obj({("d", "1"): {"A": b"x", "B": b"x", "C": b"x"}})
    emptied = lambda df, key: df.withColumns({c: F.when(F.col("key").isin(key), None).otherwise(F.col(c)).alias(c) for c in ("value", "value_raw")})
    nodes = diff.diff_pair(emptied(left, ["A", "C"]), emptied(left, ["B", "C"]), pair(spark)).where("is_leaf")
    assert {r.path[0]: (r.status, r.left, r.right) for r in nodes.collect()} == {"A": ("changed", None, "x"), "B": ("changed", "x", None), "C": ("unchanged", None, None)}
