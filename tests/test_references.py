"""Values behind references, kinds of numbers, shared arrays and walks past the old limits."""

from fixtures import Ref, Stream, sort_rows

from quire.functions import cmap
from quire.operators import documents, graph, pages, signatures
from quire.operators import structure as st


def roots(spark, ids="1"):
    return spark.createDataFrame([("d", i) for i in ids.split()], "doc_id string, obj_id string")


def test_elements_behind_references(spark, obj):
    e = obj({
        ("d", "1"): {"K": [Ref("2"), Ref("3"), Ref("4"), 1.5]},
        ("d", "2"): {"S": Ref("s"), "Type": Ref("t"), "K": Ref("k"), "Alt": b"alt", "T": Ref("title")},
        ("d", "3"): {"S": 7, "Type": "X", "K": Ref("k"), "Pg": 5, "E": "name"},
        ("d", "4"): {"S": 7.5, "K": [{"Type": "MCR", "MCID": Ref("n"), "Pg": Ref("p")}]},
        ("d", "s"): "P", ("d", "t"): "StructElem", ("d", "k"): [0, 1], ("d", "title"): b"T", ("d", "n"): 3, ("d", "p"): {"Type": "Page"},
    })
    page = spark.createDataFrame([("d", "p", 1)], "doc_id string, obj_id string, page_num bigint")
    roles = st.map_role(spark.createDataFrame([("d", "P", "")], "doc_id string, role string, target string"))
    rows = {(r.owner_id, r.idx): r for r in st.struct_tree(e, roots(spark), page, roles).collect()}
    assert rows["", 0].s == "P" and rows["", 0].alt == "alt" and rows["", 0].title == "T"
    assert rows["", 0].error == "/RoleMap maps /P to an empty name"
    assert rows["", 1].error == (
        "/S is an integer, not a name; /Type /X is not StructElem; /Pg is an integer, not a reference to a page; "
        "/E is a name that does not decode as a text string"
    )
    assert rows["", 2].error == "/S is a real, not a name"
    assert rows["", 3].error == "kid is a real, not an element, MCID, MCR or OBJR"
    # The array that both elements name is listed once.
    assert [(rows["2", i].kind, rows["2", i].mcid) for i in (0, 1)] == [("mcid", 0), ("mcid", 1)]
    assert rows["3", 0].kind == "error" and rows["3", 0].error == "/K array k already listed; not walked again" and ("3", 1) not in rows
    assert (rows["4", 0].kind, rows["4", 0].mcid, rows["4", 0].page) == ("mcr", 3, 1)


def test_header_behind_references(spark, obj):
    e = obj({
        ("d", "1"): {"Lang": Ref("l"), "MarkInfo": Ref("m"), "StructTreeRoot": Ref("r")},
        ("d", "l"): b"en", ("d", "m"): {"Marked": Ref("yes")}, ("d", "yes"): True, ("d", "r"): {"ParentTreeNextKey": Ref("n")}, ("d", "n"): 4,
        ("e", "1"): {"Lang": "en", "StructTreeRoot": Ref("r")}, ("e", "r"): {"ParentTreeNextKey": 1.5},
    })
    cats = spark.createDataFrame([("d", "1"), ("e", "1")], "doc_id string, obj_id string")
    facts, problems = st.structure_header(e, cats)
    assert sort_rows(facts, "doc_id", "lang", "marked", "next_key") == [("d", "en", True, 4), ("e", "", None, None)]
    assert sort_rows(problems, "doc_id", "message") == [
        ("e", "/Lang is a name that does not decode as a text string"),
        ("e", "/ParentTreeNextKey is a real, not an integer"),
    ]


def test_pages_behind_references(spark, obj):
    e = obj({
        ("d", "1"): {"Type": Ref("ps"), "Kids": [Ref("2"), 1.5, 3]},
        ("d", "2"): {"Type": Ref("p"), "MediaBox": [0, 0, Ref("w"), 5]},
        ("d", "ps"): "Pages", ("d", "p"): "Page", ("d", "w"): 7,
    })
    index = pages.page_index(e, roots(spark))
    rows = index.orderBy("ord").collect()
    assert [(r.page_num, r.error) for r in rows] == [
        (1, ""), (None, "/Kids entry 1 is not a dictionary: real"), (None, "/Kids entry 2 is not a dictionary: integer")]
    assert [list(r.media_box) for r in pages.page_geometry(index, e).collect()] == [[0, 0, 7, 5]]


def test_icc_alternates(spark, obj):
    reader = graph.NodeReader(obj({
        ("d", "1"): {"A": ["ICCBased", Ref("2")], "B": ["ICCBased", Ref("3")]},
        ("d", "2"): Stream({"N": 3, "Alternate": ["CalRGB", {}]}), ("d", "3"): Stream({"N": 1, "Alternate": Ref("4")}), ("d", "4"): ["CalGray", {}],
    }))
    places = spark.createDataFrame(
        [("d", n, "array", None, "1", [n]) for n in "AB"],
        "doc_id string, cs_id string, value_type string, value string, obj_id string, at array<string>")
    rows = pages.color_spaces(reader, places).collect()
    assert sorted(r.alternate for r in rows) == ["CalGray", "CalRGB"]


def test_walks_have_no_limit_of_their_own(spark, obj):
    n = 6
    e = {("d", str(i)): {"Kids": [Ref(str(i + 1))], "Names": [b"k", {"v": i}]} for i in range(1, n)}
    e["d", str(n)] = {"Names": [b"last", {"v": n}]}
    assert documents.name_tree(obj(e), roots(spark)).count() == n
    assert documents.name_tree(obj(e), roots(spark), max_depth=3).count() == 4
    f = {("d", str(i)): {"T": b"f", "Kids": [Ref(str(i + 1))]} for i in range(1, n)}
    f["d", str(n)] = {"T": b"f", "FT": "Sig"}
    tops = spark.createDataFrame([("d", "1", 0)], "doc_id string, obj_id string, idx bigint")
    assert [r.field_name for r in signatures.field_tree(obj(f), tops).collect()] == [".".join(["f"] * n)]


def test_large_code_maps_give_their_rows(spark):
    text = "beginbfrange <0000> <1FFFF> <0041> endbfrange"
    df = spark.createDataFrame([("m", text)], "id string, cmap string")
    # Targets beyond the last 16-bit unit don't exist, as before.
    assert cmap.cmap_mappings(df, ["id"]).count() == 0x10000 - 0x41
    assert [(r.error, r.large) for r in cmap.cmap_errors(df, ["id"]).collect()] == [("bfrange: range span 131072 exceeds cap 65536", True)]
