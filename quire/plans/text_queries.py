"""Text and scalar queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import values as vl
from quire.operators import search
from quire.plans.registry import query, table

_HITS = r"""
WITH p AS (SELECT doc_id, unnest(string_split({text}, '{needle}')) AS part, unnest(range(len(string_split({text}, '{needle}')))) AS i FROM documents),
s AS (SELECT doc_id, i, sum(length(part) + {n}) OVER w AS e, sum(len(string_split(part, chr(10))) - 1) OVER w AS nl,
  count(*) OVER (PARTITION BY doc_id) AS parts FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(e - {n} AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(nl + 1 AS BIGINT) AS line FROM s WHERE i < parts - 1"""


@query("find_literal", _HITS.format(text="text", needle="the", n=3))
def _(spark, d):
    return search.find_literal(table(spark, d, "documents"), ["doc_id"], "text", "the")


@query("find_literal_any_case", _HITS.format(text="CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE text END", needle="an", n=2))
def _(spark, d):
    return search.find_literal(table(spark, d, "documents"), ["doc_id"], "text", "An", case_sensitive=False)


@query("find_in_spans", """
WITH s AS (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS col, unnest([p_name, p_brand, p_type]) AS cell FROM part),
p AS (SELECT p_partkey, col, unnest(string_split(lower(cell), 'e')) AS part, unnest(range(len(string_split(lower(cell), 'e')))) AS i FROM s),
r AS (SELECT p_partkey, col, i, sum(length(part) + 1) OVER (PARTITION BY p_partkey, col ORDER BY i) AS e, count(*) OVER (PARTITION BY p_partkey, col) AS n FROM p)
SELECT p_partkey, col, CAST(e - 1 AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM r WHERE i < n - 1""")
def _(spark, d):
    return search.find_in_spans(table(spark, d, "part"), ["p_partkey"], ["p_name", "p_brand", "p_type"], "E")


@query("text_string", "SELECT conv_id, turn, length(text) AS n, md5(text) AS digest FROM conversations")
def _(spark, d):
    # Stored three ways: UTF-16 and UTF-8 with their marks, and ASCII as is.
    t = table(spark, d, "conversations")
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x17\x20-\x7F]")
    stored = (
        F.when(ascii_only, F.encode("text", "UTF-8"))
        .when(F.col("role") == "user", F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    )
    out = tx.text_string(stored)
    return t.select("conv_id", "turn", F.char_length(out).cast("bigint").alias("n"), F.md5(out).alias("digest"))


@query("text_or_raw", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def _(spark, d):
    t = table(spark, d, "documents")
    out = tx.text_or_raw(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    return t.select("doc_id", F.char_length(out).cast("bigint").alias("n"), F.md5(out).alias("digest"))


@query("latin1_view", r"""
SELECT doc_id, octet_length(encode(text)) AS n, md5(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) AS digest FROM documents""")
def _(spark, d):
    # Every byte is one character; dropping those above 0x7F leaves the ASCII text.
    t = table(spark, d, "documents")
    shown = tx.latin1_view(F.encode("text", "UTF-8"))
    return t.select(
        "doc_id", F.char_length(shown).cast("bigint").alias("n"),
        F.md5(F.regexp_replace(shown, r"[\u0080-ÿ]", "")).alias("digest"))


_ESCAPED = r"""replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@query("escape_display", f"SELECT doc_id, md5({_ESCAPED}) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.escape_display(F.col("text"))).alias("digest"))


@query("clamp_display", rf"""
WITH e AS (SELECT doc_id, {_ESCAPED} AS e FROM documents),
k AS (SELECT doc_id, e, regexp_extract(left(e, 80), '^(?:[^\\]|\\[nrt\\])*') AS head FROM e)
SELECT doc_id, CASE WHEN length(e) > 80 THEN head || ' [truncated: ' || length(head) || ' of ' || length(e) || ']' ELSE e END AS shown FROM k""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clamp_display(F.col("text"), 80).alias("shown"))


@query("normalize_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("xmp_value", """
SELECT page_id, CASE WHEN regexp_matches(html, '<title[^>]*>[^<]*</title>') THEN
  md5(replace(replace(replace(replace(replace(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'))
  ELSE md5('') END AS digest FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.xmp_value(F.col("html"), "title")).alias("digest"))


@query("format_bytes", """
WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1000 ELSE 0.01 END) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 AND n / 1024 < 1023.95 THEN format('{:.1f} KB', round(n / 1024, 1))
  WHEN n < 1073741824 AND n / 1048576 < 1023.95 THEN format('{:.1f} MB', round(n / 1048576, 1)) ELSE format('{:.1f} GB', round(n / 1073741824, 1)) END AS shown FROM n""")
def _(spark, d):
    n = F.expr("cast(floor(o_totalprice * case when o_orderkey % 3 = 0 then 1 when o_orderkey % 3 = 1 then 1000 else 0.01d end) as bigint)")
    return table(spark, d, "orders").select("o_orderkey", tx.format_bytes(n).alias("shown"))


@query("pdf_date", "SELECT o_orderkey, o_orderdate - to_hours(2) - to_minutes(30) AS ts FROM orders")
def _(spark, d):
    raw = F.expr("date_format(o_orderdate, \"'D:'yyyyMMddHHmmss\")")
    return table(spark, d, "orders").select("o_orderkey", tx.pdf_date(F.concat(raw, F.lit("+02'30'"))).alias("ts"))


@query("byte_range_coverage", """
WITH o AS (SELECT o_orderkey, CAST(l_linenumber AS BIGINT) * 100 AS a, CAST(l_quantity AS BIGINT) * 20 AS b, l_partkey AS c, l_suppkey * 10 AS len FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
c AS (SELECT *, CASE WHEN a > 1000 OR b > 1000 OR len > 1000 THEN '/ByteRange value exceeds the file size' WHEN a > 1000 OR b + len > 1000 THEN '/ByteRange extends past the end of the file'
  WHEN b < a THEN '/ByteRange ranges overlap' END AS error FROM o)
SELECT error, count(*) AS n, count(*) FILTER (WHERE error IS NULL AND b + len = 1000) AS whole, CAST(coalesce(sum(CASE WHEN error IS NULL THEN 1000 - b - len END), 0) AS BIGINT) AS gaps FROM c GROUP BY error""")
def _(spark, d):
    v = F.expr("array(0L, cast(l_linenumber as bigint) * 100, cast(l_quantity as bigint) * 20, l_suppkey * 10)")
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.expr("l_orderkey = o_orderkey"))
    c = li.select(vl.byte_range_coverage(v, F.lit(1000).cast("bigint")).alias("c")).select("c.*")
    return c.groupBy("error").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("covers_whole_file").alias("whole"),
        F.coalesce(F.sum("trailing_gap"), F.lit(0)).alias("gaps"))


@query("flag_names", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey & 1 > 0 THEN 'FixedPitch' END, CASE WHEN c_custkey & 2 > 0 THEN 'Serif' END, CASE WHEN c_custkey & 4 > 0 THEN 'Symbolic' END,
  CASE WHEN c_custkey & 8 > 0 THEN 'Script' END, CASE WHEN c_custkey & 32 > 0 THEN 'Nonsymbolic' END, CASE WHEN c_custkey & 64 > 0 THEN 'Italic' END,
  CASE WHEN c_custkey & 65536 > 0 THEN 'AllCap' END, CASE WHEN c_custkey & 131072 > 0 THEN 'SmallCap' END, CASE WHEN c_custkey & 262144 > 0 THEN 'ForceBold' END) AS flags FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(vl.flag_names(F.col("c_custkey")), ",").alias("flags"))


@query("unicode_display", """
WITH u AS (SELECT p_partkey, p_partkey % 50000 + 160 AS cp, 127488 + p_size AS wide FROM part)
SELECT p_partkey, 'U+' || lpad(upper(to_hex(cp)), 4, '0') || ' U+' || upper(to_hex(wide)) AS shown,
  CASE WHEN cp = 160 THEN '' ELSE chr(CAST(cp AS INTEGER)) END || chr(CAST(wide AS INTEGER)) AS glyph FROM u""")
def _(spark, d):
    # One plain unit below the surrogates, then a surrogate pair for U+1F200 onwards.
    h = F.expr("concat(lpad(hex(p_partkey % 50000 + 160), 4, '0'), 'D83C', lpad(hex(p_size + 56832), 4, '0'))")
    return table(spark, d, "part").select("p_partkey", vl.unicode_display(h).alias("shown"), vl.unicode_glyph(h).alias("glyph"))


@query("path_join", """SELECT o_orderkey, '/Root /Pages /Kids[' || o_custkey || '] /Kids[' || o_orderkey || ']' AS path, 'Root > ' || o_custkey || ' > ' || o_orderkey AS crumbs FROM orders""")
def _(spark, d):
    steps = F.expr("array('Root', 'Pages', 'Kids', concat('[', o_custkey, ']'), 'Kids', concat('[', o_orderkey, ']'))")
    return table(spark, d, "orders").select(
        "o_orderkey", vl.path_join(vl.display_steps(steps)).alias("path"),
        vl.breadcrumb(F.expr("array('Root', string(o_custkey), string(o_orderkey))")).alias("crumbs"))


@query("display_rules", """
SELECT event_id, event_type = 'error' OR event_type = 'purchase' AS raw_needed, event_type = 'click' OR (event_type = 'view' AND user_id > 50) AS is_binary,
  '<binary, ' || length(props) || ' bytes>' AS summary FROM events""")
def _(spark, d):
    ev = table(spark, d, "events")
    t, shown = F.col("event_type"), F.col("props")
    raw = F.when(t == "error", F.hex(F.encode(shown, "UTF-8"))).when(t == "purchase", F.concat(F.lit("<"), shown)).when(
        t == "view", F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    key = F.when(t == "click", "CheckSum").when(t == "view", "Contents").otherwise("Title")
    return ev.select(
        "event_id", vl.raw_needed(raw, shown).alias("raw_needed"), vl.binary_key(key, F.col("user_id") > 50).alias("is_binary"),
        vl.binary_summary(F.encode(shown, "UTF-8")).alias("summary"))
