"""Work that grows with the input: adapters read once, rows without a key dealt, paths counted by length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph
from quire.operators import pages as pg
from quire.plans import bindings as b
from quire.plans import rule_queries as rq
from quire.plans import structure_queries as sq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_made_without_a_lambda(spark):
    df = b.entries_of(
        spark.range(3), "id", "concat('x', id)", b.container([], "dict"), b.only_if("id = 1", b.number(["N"], "id")), placed=[("'p'", b.only_if("id = 2", b.ref(["R"], "'y'")))])
    assert "lambda" not in plan(df)
    assert sorted((r.doc_id, r.obj_id, r.key, r.ref_id) for r in df.collect() if r.key) == [("1", "x1", "N", None), ("2", "p", "R", "y")]
    assert df.count() == 5


def test_adapted_rows_are_written_once(spark):
    assert "Generate" not in plan(sq._headers(spark, SF)[0])
    tokens, _, streams = rq._page_streams(spark, SF)
    assert "Generate" not in plan(tokens) and "Generate" not in plan(streams)


@pytest.fixture()
def plain_joins(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_without_a_reference_are_dealt(spark, obj, plain_joins):
    reader = graph.NodeReader(obj({("d", "1"): {"A": 1}, ("d", "2"): {"A": 2}}))
    rows = spark.range(4000).selectExpr("'d' as doc_id", "if(id % 1000 = 0, '1', if(id % 1000 = 1, 'gone', null)) as ref_id", "id as n")
    got = reader.resolved(rows)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 4000 and max(per_task) < 2000
    assert {(r.ref_id, r.target_type) for r in got.collect()} == {(None, None), ("1", "dict"), ("gone", None)}


def test_few_rows_of_pages_go_to_a_task():
    assert pg.PAGE_SKEW.max_group_rows <= 1_000_000 and pg.number_pages.__defaults__ == (pg.PAGE_SKEW,)


def closure_rows(df):
    return sorted((r.root_id, r.obj_id or "", tuple(r.path), None if r.n_paths is None else int(r.n_paths), r.cyclic) for r in df.collect())


def paths(links, root, starts, loops):
    """Brute force: least path, number of paths and cyclic of all that the starts reach."""
    out = {}

    def walk(at, path, looped):
        looped = looped or at in loops
        least, n, cyclic = out.get(at, (path, 0, False))
        out[at] = (min(least, path), n + 1, cyclic or looped)
        for to in sorted(z for a, z in links if a == at and z != at):
            walk(to, (*path, f"{to:02d}"), looped)

    for s in starts:
        walk(s, (), False)
    return [(root, f"o{k}", path, None if c else n, c) for k, (path, n, c) in out.items()]


def test_paths_are_counted_by_their_length(spark):
    rng = np.random.default_rng(5)
    for loops in (set(), {3, 8}):
        links = {(int(min(x)), int(max(x))) for x in rng.integers(0, 9, (14, 2)) if x[0] != x[1]} | {(k, k) for k in loops}
        rows = [("d", f"o{a}", f"o{z}", [f"{z:02d}"]) for a, z in sorted(links)] + [("d", "o0", None, ["99"]), ("e", "o0", "o1", ["01"])]
        edges = spark.createDataFrame(rows, "doc_id string, src_id string, dst_id string, step array<string>")
        starts = spark.createDataFrame([("d", "o0", "o0"), ("d", "o1", "o1"), ("d", "o1", "o2")], "doc_id string, root_id string, obj_id string")
        want = [*paths(links, "o0", [0], loops), *paths(links, "o1", [1, 2], loops), ("o0", "", ("99",), None, True)]
        named = edges.toDF("doc_id", "obj_id", "to_obj_id", "step")
        assert closure_rows(graph.closure(edges, starts)) == sorted(want)
        assert graph._closure_by_length(named, starts, graph.EDGES_PER_BUCKET, 1) is None


def test_a_longer_cycle_is_left_to_the_order(spark):
    rows = [("d", "a", "b", ["1"]), ("d", "b", "c", ["1"]), ("d", "c", "b", ["1"]), ("d", "a", "x", ["2"])]
    edges = spark.createDataFrame(rows, "doc_id string, src_id string, dst_id string, step array<string>")
    starts = spark.createDataFrame([("d", "a", "a")], "doc_id string, root_id string, obj_id string")
    assert closure_rows(graph.closure(edges, starts)) == [
        ("a", "a", (), 1, False), ("a", "b", ("1",), None, True), ("a", "c", ("1", "1"), None, True), ("a", "x", ("2",), 1, False)]
