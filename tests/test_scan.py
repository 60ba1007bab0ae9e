import random

from pyspark.sql import functions as F

from quire.operators.scan import ChunkScan, Skew, WindowScan, range_ranks, row_numbers, scan_groups

ROWS = [(k, i, random.Random(k * 100 + i).choice([-1, 0, 1, None])) for k in range(4) for i in range(k * 9)]


def brute():
    out = {}
    for k in {r[0] for r in ROWS}:
        total, low, high, last, prev, depth = 0, None, None, None, None, 0
        for _, i, v in (r for r in ROWS if r[0] == k):
            before_last = last
            total += v or 0
            if v is not None:
                low = v if low is None else min(low, v)
                high = v if high is None else max(high, v)
                last = v
            under = (v or 0) < 0 and depth == 0
            depth = max(0, depth + (v or 0))
            out[k, i] = (total, low, high, last, before_last, prev, depth, under)
            prev = v
    return out


def test_windows_and_chunks_agree_with_a_loop(spark):
    df = spark.createDataFrame(ROWS, "k int, i bigint, v int")
    for scan, rows in ((WindowScan(), 10**6), (ChunkScan(), 4)):
        chunk = Skew(chunk_rows=rows).chunk(F.col("i"))
        out = scan.running(
            df, ["k"], ["i"], chunk, s=("sum", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v")),
            la=("last", F.col("v")), lx=("last", F.col("v"), True), lg=("lag", F.col("v")))
        out = scan.clamped_depth(out, ["k"], ["i"], chunk, F.coalesce("v", F.lit(0)), "d", "u")
        got = {(r.k, r.i): (r.s, r.lo, r.hi, r.la, r.lx, r.lg, r.d, r.u) for r in out.collect()}
        assert got == brute()


def test_only_big_groups_are_cut(spark):
    df = spark.createDataFrame(ROWS, "k int, i bigint, v int")
    ways = []

    def build(rows, scan):
        ways.append(type(scan).__name__)
        return scan.running(rows, ["k"], ["i"], F.col("i"), n=("sum", F.lit(1)))

    skew = Skew(max_group_rows=10, chunk_rows=5)
    assert scan_groups(df, ["k"], build, skew).count() == len(ROWS)
    assert ways == ["WindowScan", "ChunkScan"]
    numbered = row_numbers(df, ["k"], ["i"], "n", skew)
    assert all(r.n == r.i + 1 for r in numbered.collect())


def test_ranges_spread_whatever_the_order_looks_like(spark):
    # One root kid: all orders begin alike, and one group holds nearly all rows.
    df = spark.range(2000).selectExpr("if(id < 1990, 'd', 'e') as k", "array(0L, pmod(id * 37, 2000), id) as ord").repartition(5)
    skew = Skew(max_group_rows=100, chunk_rows=200)
    got = row_numbers(df, ["k"], ["ord"], "n", skew).orderBy("k", "ord").collect()
    assert [r.n for r in got] == [*range(1, 1991), *range(1, 11)]
    placed = range_ranks(df.where("k = 'd'"), ["k"], ["ord"], "n", skew)
    assert sorted(r.n for r in placed.collect()) == list(range(1, 1991))
    dealt = df.where("k = 'd'").repartitionByRange(10, "k", "ord")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400
    none = row_numbers(spark.createDataFrame([(None, 1), (None, 2), (None, 2)], "k string, ord int"), ["k"], ["ord"], "n", Skew(max_group_rows=1, chunk_rows=1))
    assert sorted(r.n for r in none.collect()) == [1, 2, 3]
