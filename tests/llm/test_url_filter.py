"""URL filter: parts, rules, the filter's false positives, and edge rows."""

from pyspark.sql import functions as F

from quire.llm import url_filter as uf
from quire.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, verdict int, extra string"


def run(spark, urls, listed, **kw):
    df = spark.createDataFrame([(i, u, "h", 7, "e") for i, u in enumerate(urls)], SCHEMA)
    seeds = spark.createDataFrame([(u,) for u in listed], "url string")
    out = uf.judge_urls(df, seeds, URL_RULES, **kw)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict", "listed"]
    return [(r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]


def test_rules_and_parts(spark):
    got = run(spark, [
        "HTTP://WWW.Example.ORG/es/x?q#f", "http://a.example.org/en/12", "http://example.org/en/2", "x://notexample.org/es/", "http://b.org?x",
        "http://shop.com/de/1", "http://shop.com/fr", "http://shop.com/fr/", "http://ÄB.com/de/", "no scheme.com/de/", None, "", "http://", "a://b://c.com/de/",
    ], [])
    assert got == [
        ("www.example.org", "/es/x", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"), ("b.org", "", None, "allow"),
        ("shop.com", "/de/1", "com/de/", "block"), ("shop.com", "/fr", None, "allow"), ("shop.com", "/fr/", "com/fr/", "allow"),
        ("Äb.com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b:", "//c.com/de/", None, "allow"),
    ]


def test_list_is_exact_at_any_filter_size(spark):
    listed = [f"http://www.h{i}.net/p{i}/" for i in range(0, 400, 2)] + ["http://h0.net/p0", None, "bad"]
    urls = [f"https://m.h{i}.net/p{i}?x" for i in range(400)] + [f"https://h{i}.net/P{i}" for i in range(0, 400, 2)]
    # A block per 2,000 keys: nearly all bits are set and nearly all rows are possible hits.
    for kw in ({}, {"keys_per_block": 2000}, {"broadcast_limit_mb": 0.0}):
        got = [v for *_, v in run(spark, urls, listed, **kw)]
        assert got == ["block" if i % 2 == 0 else "allow" for i in range(400)] + ["allow"] * 200


def test_edges(spark):
    long = "http://long.net/" + "x" * 200_000
    assert [v for *_, v in run(spark, [long, long, "http://other.net/"], [long])] == ["block", "block", "allow"]
    assert run(spark, [], ["http://a.net/"]) == []


def test_rows_that_ask_nothing_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        urls = spark.range(4000).selectExpr("id as page_id", "concat('http://shop.com/fr/', id) as url")
        listed = spark.createDataFrame([("http://a.net/",)], "url string")
        out = uf.judge_urls(urls, listed, URL_RULES, broadcast_limit_mb=0.0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
