import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import content as ct
from quire.operators.scan import Skew

TINY = Skew(max_group_rows=1, chunk_rows=2)


def tokens(spark, *streams, types=None):
    """Streams of blank separated tokens; kinds follow from their look."""
    rows = []
    for s, text in enumerate(streams):
        for i, t in enumerate(text.split()):
            kind = (
                "comment" if t.startswith("%") else "name" if t.startswith("/") else "string" if t.startswith("(")
                else "number" if t.lstrip("-").replace(".", "").isdigit() else "operator")
            rows.append(("d", 1, s, i, kind, t, i + 1, 1))
    return spark.createDataFrame(rows, schemas.TOKENS)


@pytest.mark.parametrize("skew", [Skew(), TINY])
def test_operations(spark, skew):
    t = tokens(spark, "1 0 %c q [ (a) 2 Tz ] TJ BI /W ] 5 %x ID (z) EI ET Q Q ] 9 rg 7")
    got = [tuple(r)[3:] for r in ct.format_ops(t, skew).orderBy("first_tok").collect()]
    assert got == [
        (0, "", 2, 1, 2, 0),  # operands cut off by the comment
        (2, "", 1, 3, 3, 0),
        (3, "q", 1, 4, 4, 0),
        (4, "TJ", 6, 5, 10, 1),  # the operator inside the array is an operand
        (10, "BI", 8, 11, 18, 1),
        (18, "ET", 1, 19, 19, 0),
        (19, "Q", 1, 20, 20, 0),
        (20, "Q", 1, 21, 21, 0),  # never below zero
        (21, "rg", 3, 22, 24, 0),
        (24, "", 1, 25, 25, 0),
    ]


@pytest.mark.parametrize("skew", [Skew(), TINY])
def test_balance_carries_across_streams(spark, skew):
    t = tokens(spark, "/P BMC /P BMC", "EMC EMC EMC /P BMC", "f")
    got = [tuple(r)[2:] for r in ct.marked_balance(t, None, skew).orderBy("stream_idx").collect()]
    assert got == [(0, 2, 0, 2, 0), (1, 1, 3, 1, -1), (2, 0, 0, 1, 1)]


@pytest.mark.parametrize("skew", [Skew(), TINY])
def test_mcid_rows(spark, skew):
    t = tokens(
        spark,
        "/A << /MCID 1 >> BDC /X BMC /B << /K << /MCID 9 >> /MCID 2 >> BDC EMC EMC EMC",
        "/C << /Z 1 >> BDC /D /P1 BDC /E /P2 BDC /F << /MCID -3 >> BDC BDC /G BDC 5 /Q BDC << /MCID 7 BDC /T << /MCID 4 BDC",
    )
    props = spark.createDataFrame([("d", 1, "P1", "6", None)], "doc_id string, page_num bigint, name string, mcid string, error string")
    got = [
        (r.tag, r.mcid, r.depth, r.parent_mcid, r.error)
        for r in ct.mcid_rows(t, props, None, skew).orderBy("stream_idx", "tok_idx").collect()
    ]
    assert got == [
        ("A", 1, 1, None, None),
        ("B", 2, 3, 1, None),  # the nested key does not count; BMC between is skipped over
        ("D", 6, 2, None, None),
        ("E", -1, 3, 6, "property list /P2 not found in /Resources /Properties"),
        ("F", -1, 4, 6, "/MCID -3 is negative"),
        ("", -1, 5, 6, "BDC has 0 of its 2 operands (a tag and a property list)"),
        ("G", -1, 6, 6, "BDC has 1 of its 2 operands (a tag and a property list)"),
        ("", -1, 7, 6, 'BDC operand "5" before the property list is not a tag name; property list not read'),
        ("", -1, 8, 6, "BDC has 1 of its 2 operands (a tag and a property list)"),
        ("T", 4, 9, 6, "property-list dictionary has no closing >>"),
    ]


def test_undecodable_stream_drops_pending_operands(spark):
    t = tokens(spark, "/A << /MCID 1 >>", "f", "BDC")
    bad = spark.createDataFrame([("d", 1, 1)], "doc_id string, page_num bigint, stream_idx int")
    with_break = ct.mcid_rows(t.where("stream_idx <> 1"), None, bad).collect()
    assert with_break[0].error.startswith("BDC has 0")


def test_device_color_is_three_valued(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    t = spark.createDataFrame([("a", "operator", "rg"), ("c", "string", "rg")], "doc_id string, type string, value string")
    unread = spark.createDataFrame([(x, i, f"page {i}") for x in "ab" for i in range(5)], "doc_id string, ord int, part string")
    got = {r.doc_id: (r.used, r.reason) for r in ct.uses_device_color(docs, t, unread).collect()}
    assert got["a"] == (True, None) and got["c"] == (False, None)
    assert got["b"] == (None, "no device colour found in what was read, but could not read page 0, page 1, page 2 and 2 more")


def test_first_do_name_decides(spark):
    t = tokens(spark, "/none /ps /im Do /im Do")
    res = spark.createDataFrame(
        [("d", 1, "ps", "PS", "1 0 R"), ("d", 1, "im", "Image", "2 0 R")], "doc_id string, page_num bigint, name string, subtype string, ref_id string")
    got = [(r.name, r.resource_type) for r in ct.classify_do(ct.op_params(t), res).orderBy("op_group").collect()]
    assert got == [("ps", None), ("im", "Image")]
