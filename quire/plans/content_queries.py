"""Queries over content tokens: web pages read as content streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import content as ct
from quire.plans import bindings as b
from quire.plans.registry import query

_OPS_SQL = f"""{b.TOKENS_SQL},
inl AS (
  SELECT *, coalesce(last_value(CASE WHEN type = 'operator' AND value IN ('BI', 'EI') THEN value END IGNORE NULLS)
     OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'BI',
     false) AS inline FROM tokens),
sums AS (
  SELECT *, sum(CASE WHEN inline OR type <> 'operator' THEN 0 WHEN value = '[' THEN 1 WHEN value = ']' THEN -1 ELSE 0 END)
     OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY tok_idx) AS s FROM inl),
nest AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY tok_idx)) AS nest FROM sums),
ends AS (
  SELECT *, type = 'comment' AND NOT inline AS is_comment,
    type = 'operator' AND NOT inline AND nest = 0 AND value NOT IN ('[', ']', 'BI')
      OR (inline AND type = 'operator' AND value = 'EI') OR (type = 'comment' AND NOT inline) AS ends,
    type = 'operator' AND NOT inline AND nest = 0 AND value = 'BI' AS starts FROM nest),
grp AS (
  SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY tok_idx
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS op_group FROM ends),
ops AS (
  SELECT doc_id, page_num, stream_idx, min(tok_idx) AS first_tok, count(*) AS n_tokens,
    CASE WHEN bool_or(starts) THEN 'BI' ELSE coalesce(max(CASE WHEN ends AND NOT is_comment THEN value END), '') END AS operator,
    min(line) AS line_start, max(line) AS line_end
  FROM grp GROUP BY doc_id, page_num, stream_idx, op_group, is_comment)
"""


@query("format_ops", f"""WITH {_OPS_SQL},
run AS (SELECT *, sum(CASE WHEN operator IN ('q', 'BT', 'BMC', 'BDC') THEN 1 WHEN operator IN ('Q', 'ET', 'EMC') THEN -1
   ELSE 0 END) OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY first_tok) AS s FROM ops)
SELECT doc_id, page_num, stream_idx, first_tok, operator, n_tokens, line_start, line_end,
  s - least(0, min(s) OVER (PARTITION BY doc_id, page_num, stream_idx ORDER BY first_tok))
    - CASE WHEN operator IN ('q', 'BT', 'BMC', 'BDC') THEN 1 ELSE 0 END AS indent FROM run""")
def _(spark, d):
    return ct.format_ops(b.page_tokens(spark, d))


@query("op_tokens", f"""WITH {_OPS_SQL}
SELECT doc_id, page_num, stream_idx, min(tok_idx) OVER (PARTITION BY doc_id, page_num, stream_idx, op_group, is_comment) AS first_tok,
  tok_idx, type, value, line FROM grp""")
def _(spark, d):
    return ct.op_tokens(b.page_tokens(spark, d))


_BALANCE_SQL = f"""{b.TOKENS_SQL},
ev AS (SELECT *, CASE WHEN value = 'EMC' THEN -1 ELSE 1 END AS delta FROM tokens
  WHERE type = 'operator' AND value IN ('BMC', 'BDC', 'EMC')),
s AS (SELECT *, sum(delta) OVER (PARTITION BY doc_id, page_num ORDER BY tok_idx) AS s FROM ev),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, page_num ORDER BY tok_idx)) AS depth,
   delta < 0 AND s - delta - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, page_num ORDER BY tok_idx
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) = 0 AS under FROM s),
per AS (SELECT doc_id, page_num, stream_idx, count(*) FILTER (WHERE delta > 0) AS opens,
   count(*) FILTER (WHERE delta < 0) AS closes, max_by(depth, tok_idx) AS e,
   min(CASE WHEN under THEN -1 WHEN delta < 0 THEN depth END) AS low FROM d GROUP BY ALL),
filled AS (SELECT doc_id, page_num, stream_idx, coalesce(opens, 0) AS opens, coalesce(closes, 0) AS closes, low,
   coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id, page_num ORDER BY stream_idx), 0) AS depth_at_end,
   coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id, page_num ORDER BY stream_idx
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM (SELECT DISTINCT doc_id, page_num, stream_idx FROM tokens) LEFT JOIN per USING (doc_id, page_num, stream_idx)),
balance AS (SELECT doc_id, page_num, stream_idx, opens, closes, depth_at_end, least(st, coalesce(low, st)) AS min_depth FROM filled)
"""


@query("marked_balance", f"WITH {_BALANCE_SQL} SELECT * FROM balance")
def _(spark, d):
    return ct.marked_balance(b.page_tokens(spark, d))


def _mcid_tokens(spark, d):
    """Content in which every paragraph is a marked sequence with an inline MCID.

    A ``BDC`` token becomes ``/P << /MCID n >> BDC`` with n the paragraph's place
    on its line, so numbers repeat; ``BMC`` gets a tag.
    """
    t = b.page_tokens(spark, d)

    def tok(i, kind, value):
        return F.struct(
            (F.col("tok_idx") * 8 + i).cast("bigint").alias("tok_idx"), F.lit(kind).alias("type"),
            (F.lit(value) if isinstance(value, str) else value).alias("value"),
            (F.col("col") + i).cast("bigint").alias("col"))

    bdc = F.array(
        tok(0, "name", "/P"), tok(1, "operator", "<<"), tok(2, "name", "/MCID"),
        tok(3, "number", F.col("line").cast("string")), tok(4, "operator", ">>"), tok(5, "operator", "BDC"))
    bmc = F.array(tok(0, "name", "/Span"), tok(1, "operator", "BMC"))
    same = F.array(F.struct((F.col("tok_idx") * 8).alias("tok_idx"), "type", "value", "col"))
    op = F.col("type") == "operator"
    return t.select(
        "doc_id", "page_num", "stream_idx", "line",
        F.explode(F.when(op & (F.col("value") == "BDC"), bdc).when(op & (F.col("value") == "BMC"), bmc).otherwise(same)).alias("t"),
    ).select("doc_id", "page_num", "stream_idx", "t.*", "line")


_MCID_SQL = f"""{b.TOKENS_SQL},
ev AS (SELECT *, CASE WHEN value = 'EMC' THEN -1 ELSE 1 END AS delta, value = 'BDC' AS mc FROM tokens
  WHERE type = 'operator' AND value IN ('BMC', 'BDC', 'EMC')),
s AS (SELECT *, sum(delta) OVER (PARTITION BY doc_id, page_num ORDER BY tok_idx) AS s FROM ev),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, page_num ORDER BY tok_idx)) AS depth FROM s),
lv AS (SELECT *, CASE WHEN delta > 0 THEN depth ELSE depth + 1 END AS lvl FROM d),
closed AS (SELECT *, coalesce(min(CASE WHEN delta < 0 THEN tok_idx END) OVER (PARTITION BY doc_id, page_num, lvl
   ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9223372036854775807) AS close_at FROM lv),
mcids AS (
  SELECT doc_id, page_num, stream_idx, tok_idx, 'P' AS tag, line AS mcid, depth, line, col, close_at FROM closed WHERE mc)
"""


@query("mcid_rows", f"""WITH {_MCID_SQL}
SELECT c.doc_id, c.page_num, c.stream_idx, c.tok_idx * 8 + 5 AS tok_idx, c.tag, c.mcid, c.depth,
  max_by(o.mcid, o.tok_idx) AS parent_mcid, CAST(NULL AS VARCHAR) AS error,
  c.stream_idx AS at_stream, c.line AS at_line, c.col AS at_col
FROM mcids c LEFT JOIN mcids o ON o.doc_id = c.doc_id AND o.page_num = c.page_num
  AND o.tok_idx < c.tok_idx AND o.close_at > c.tok_idx
GROUP BY ALL""")
def _(spark, d):
    return ct.mcid_rows(_mcid_tokens(spark, d))


@query("classify_do", """
WITH l AS (
  SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc_id, page_id AS page_num,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name,
         unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord FROM pages)
SELECT doc_id, page_num, ord AS op_group, CASE WHEN length(name) > 2 THEN name END AS name,
  CASE WHEN length(name) > 4 THEN 'Image' WHEN length(name) > 3 THEN 'Form' END AS resource_type,
  CASE WHEN length(name) > 3 THEN 'ref ' || name END AS object_ref FROM l""")
def _(spark, d):
    uses = b.link_uses(spark, d)
    # Each link is drawn as `/zzz /name Do`; short names are missing or of another kind.
    tokens = uses.select(
        "doc_id", "page_num", F.lit(0).alias("stream_idx"),
        F.explode(F.array(
            F.struct((F.col("ord") * 3).cast("bigint").alias("tok_idx"), F.lit("name").alias("type"), F.lit("/?zzz").alias("value")),
            F.struct((F.col("ord") * 3 + 1).cast("bigint").alias("tok_idx"), F.lit("name").alias("type"), F.concat(F.lit("/"), F.col("obj_id")).alias("value")),
            F.struct((F.col("ord") * 3 + 2).cast("bigint").alias("tok_idx"), F.lit("operator").alias("type"), F.lit("Do").alias("value")))).alias("t"),
    ).select("doc_id", "page_num", "stream_idx", "t.*", F.lit(1).cast("bigint").alias("line"), F.lit(1).cast("bigint").alias("col"))
    n = F.char_length("obj_id")
    resources = uses.where(n > 2).select(
        "doc_id", "page_num", F.col("obj_id").alias("name"),
        F.when(n > 4, "Image").when(n > 3, "Form").otherwise("PS").alias("subtype"),
        F.concat(F.lit("ref "), F.col("obj_id")).alias("ref_id")).distinct()
    return ct.classify_do(ct.op_params(tokens), resources).drop("stream_idx")


@query("uses_device_color", """
WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc_id, length(html) AS n FROM pages),
u AS (SELECT doc_id, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS n
  FROM p WHERE n > 3000)
SELECT d.doc_id, CASE WHEN d.doc_id = 'en' THEN true WHEN max(u.n) > 0 THEN NULL ELSE false END AS used,
  CASE WHEN d.doc_id <> 'en' AND max(u.n) > 0 THEN 'no device colour found in what was read, but could not read '
   || string_agg('page ' || page_id, ', ' ORDER BY page_id) FILTER (WHERE rn <= 3)
   || CASE WHEN max(u.n) > 3 THEN ' and ' || (max(u.n) - 3) || ' more' ELSE '' END END AS reason
FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, d):
    pages = b.page_frame(spark, d)
    tokens = b.page_tokens(spark, d).withColumn(
        "value", F.when((F.col("doc_id") == "en") & (F.col("value") == "BDC"), "rg").otherwise(F.col("value")))
    unread = pages.where(F.char_length("html") > 3000).select(
        "doc_id", F.col("page_num").alias("ord"), F.concat(F.lit("page "), F.col("page_num").cast("string")).alias("part"))
    return ct.uses_device_color(pages.select("doc_id").distinct(), tokens, unread)
