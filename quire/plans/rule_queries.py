"""Rule queries: every rule on its own, then whole profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import content as ct
from quire.operators import documents as dc
from quire.plans import bindings as b
from quire.plans import content_queries as cq
from quire.plans import document_queries as dq
from quire.plans import font_queries as fq
from quire.plans import structure_queries as sq
from quire.plans import validation as v
from quire.plans.registry import query, table


@query("rule_font_embedding", f"""WITH {fq._EMB_SQL}
SELECT 'F' || c_custkey AS obj_id, 'font /' || c_name || ' is not embedded' AS message FROM emb
WHERE (subtype = 'TrueType' AND NOT own) OR (subtype = 'Type0' AND NOT coalesce(kid_file AND kid_sub IN ('TrueType', 'CIDFontType2'), false))""")
def _(spark, d):
    return v.font_embedding(fq._font_entries(spark, d)).select("obj_id", "message")


def _docs(spark, d):
    """Customers as documents; lines of thought: debt locks a file, low balance loses its id."""
    return table(spark, d, "customer").selectExpr(
        "concat('D', c_custkey) as doc_id", "c_acctbal < -500 as encrypted", "c_acctbal > 1000 as has_file_id", "c_acctbal < -900 as sealed")


@query("rule_no_encryption", """SELECT 'D' || c_custkey AS doc_id,
  'document is encrypted (/Encrypt present; PDF/A forbids encryption)' AS message FROM customer WHERE c_acctbal < -500""")
def _(spark, d):
    return v.no_encryption(_docs(spark, d)).select("doc_id", "message")


@query("rule_document_id", """SELECT 'D' || c_custkey AS doc_id, 'document /ID is missing from the trailer' AS message FROM customer WHERE c_acctbal <= 1000""")
def _(spark, d):
    return v.document_id(_docs(spark, d)).select("doc_id", "message")


def _color(spark, d):
    """Orders as pages: urgent ones of big value set a device colour, refused ones are unreadable."""
    o = table(spark, d, "orders")
    doc = "concat('D', o_custkey) as doc_id"
    tokens = o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").selectExpr(
        doc, "'operator' as type", "'rg' as value")
    unread = o.where("o_orderpriority = '5-LOW' AND o_totalprice > 450000").selectExpr(
        doc, "o_orderkey as ord", "concat('page ', o_orderkey) as part")
    return ct.uses_device_color(_docs(spark, d), tokens, unread)


_COLOR_SQL = """
color AS (SELECT c_custkey, c_nationkey, bool_or(o_orderpriority = '1-URGENT' AND o_totalprice > 400000) AS used,
  string_agg('page ' || o_orderkey, ', ' ORDER BY o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW' AND o_totalprice > 450000) AS unread
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
"""


@query("rule_output_intent", f"""WITH {_COLOR_SQL}
SELECT 'D' || c_custkey AS doc_id, 'finding' AS kind FROM color WHERE used AND c_nationkey >= 10
UNION ALL SELECT 'D' || c_custkey, 'no device colour found in what was read, but could not read ' || unread FROM color
WHERE NOT coalesce(used, false) AND unread IS NOT NULL AND c_nationkey >= 10""")
def _(spark, d):
    intents = table(spark, d, "customer").where("c_nationkey < 10").selectExpr("concat('D', c_custkey) as doc_id")
    found, skipped = v.output_intent(intents, _color(spark, d))
    return found.select("doc_id", F.lit("finding").alias("kind")).union(skipped.select("doc_id", "reason"))


@query("rule_no_js_launch", """
SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_type <> 'signup' THEN 'e' || event_id END AS obj_id,
  CASE event_type WHEN 'purchase' THEN 'Launch action present (forbidden in PDF/A)' WHEN 'signup' THEN 'Launch action present in catalog /OpenAction (forbidden in PDF/A)'
    ELSE 'JavaScript action present (forbidden in PDF/A)' END AS message FROM events WHERE event_type <> 'view'""")
def _(spark, d):
    case = lambda kind, row: b.only_if(f"event_type = '{kind}'", row)
    rows = b.entries_of(
        table(spark, d, "events"), "user_id", "concat('e', event_id)", b.container([], "dict"),
        case("click", b.name(["S"], "'JavaScript'")), case("purchase", b.name(["S"], "'Launch'")), case("view", b.name(["S"], "'GoTo'")),
        case("error", b.string(["JS"], "props")), case("signup", b.container(["OpenAction"], "dict")), case("signup", b.name(["OpenAction", "S"], "'Launch'")))
    return v.no_js_launch(rows, rows.where("size(path) = 0")).select("doc_id", "obj_id", "message")


def _xmp(spark, d):
    return table(spark, d, "customer").where("c_nationkey <> 7").selectExpr(
        "concat('D', c_custkey) as doc_id", "concat('<dc:title>', if(c_acctbal < 0, 'x', c_name), '</dc:title>') as xmp")


_XMP_SQL = """
SELECT 'D' || c_custkey AS doc_id, CASE WHEN c_nationkey = 7 THEN 'XMP metadata packet is missing (/Metadata)'
  ELSE '/Info /Title ("' || c_name || '") differs from XMP dc:title ("x")' END AS message
FROM customer WHERE c_nationkey = 7 OR (c_acctbal < 0 AND c_nationkey <> 3)"""


@query("rule_xmp_metadata", _XMP_SQL)
def _(spark, d):
    return v.xmp_metadata(_docs(spark, d), _xmp(spark, d), dc.metadata(*dq._info(spark, d))).select("doc_id", "message")


@query("rule_marked", """SELECT 'D' || c_custkey AS doc_id FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 0)""")
def _(spark, d):
    return v.marked(sq._header(spark, d)[0]).select("doc_id")


@query("rule_struct_tree_root", """SELECT 'D' || c_custkey AS doc_id FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_acctbal <= 0""")
def _(spark, d):
    return v.struct_tree_root(sq._header(spark, d)[0]).select("doc_id")


@query("rule_lang", """SELECT 'D' || c_custkey AS doc_id FROM customer WHERE c_nationkey >= 10""")
def _(spark, d):
    return v.lang(sq._header(spark, d)[0]).select("doc_id")


def _page_streams(spark, d):
    """Pages and their streams; long pages lose their third stream, one language is unreadable."""
    tokens = b.stored(b.page_tokens(spark, d))
    pages = b.page_frame(spark, d).selectExpr(
        "doc_id", "page_num", "concat('P', page_num) as ref", "if(doc_id = 'es', 'no /Contents', null) as error")
    streams = tokens.groupBy("doc_id", "page_num", "stream_idx").agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        "doc_id", "page_num", "stream_idx", "concat('S', page_num, '.', stream_idx) as ref", "if(stream_idx = 2, 'bad data', null) as error")
    return tokens, pages, streams


@query("rule_marked_content_balance", f"""WITH {cq._BALANCE_SQL},
pg AS (SELECT doc_id, page_num, bool_or(stream_idx = 2) AS bad, max_by(depth_at_end, stream_idx) AS open FROM balance GROUP BY ALL)
SELECT 'P' || page_num AS obj_id, 'page ' || page_num || ' content could not be read (no /Contents); marked content not checked' AS message FROM pg WHERE doc_id = 'es'
UNION ALL SELECT 'S' || page_num || '.2', 'content stream S' || page_num || '.2 of page ' || page_num || ' could not be decoded (bad data); its marked content was not checked' FROM pg WHERE bad
UNION ALL SELECT 'P' || page_num, 'page ' || page_num || ': EMC with no open marked-content sequence (in content stream S' || page_num || '.' || stream_idx || ')'
  FROM balance WHERE min_depth < 0 AND stream_idx < 2
UNION ALL SELECT 'P' || page_num, 'page ' || page_num || ': ' || open || ' marked-content sequence(s) still open at the end of the page''s content' FROM pg
  WHERE NOT bad AND doc_id <> 'es' AND open > 0""")
def _(spark, d):
    tokens, pages, streams = _page_streams(spark, d)
    return v.marked_content_balance(pages, streams, ct.marked_balance(tokens)).select("obj_id", "message")


_LOC = "'stream S' || page_num || '.' || stream_idx || ' line ' || line || ' col ' || col"


@query("rule_mcid_unique", f"""WITH {cq._MCID_SQL}
SELECT doc_id, 'page ' || page_num || ': MCID ' || mcid || ' marks ' || count(*) || ' BDC sequences: ' || string_agg({_LOC}, ', ' ORDER BY tok_idx) AS message
FROM mcids GROUP BY doc_id, page_num, mcid HAVING count(*) > 1""")
def _(spark, d):
    _, _, streams = _page_streams(spark, d)
    return v.mcid_unique(streams, ct.mcid_rows(cq._mcid_tokens(spark, d))).select("doc_id", "message")


@query("rule_mcid_not_nested", f"""WITH {cq._MCID_SQL},
par AS (SELECT c.*, max_by(o.mcid, o.tok_idx) AS parent FROM mcids c JOIN mcids o ON o.doc_id = c.doc_id AND o.page_num = c.page_num
  AND o.tok_idx < c.tok_idx AND o.close_at > c.tok_idx GROUP BY ALL)
SELECT doc_id, 'page ' || page_num || ': MCID ' || mcid || ' (' || {_LOC} || ') is nested inside MCID ' || parent AS message FROM par WHERE stream_idx < 2""")
def _(spark, d):
    _, _, streams = _page_streams(spark, d)
    return v.mcid_not_nested(streams, ct.mcid_rows(cq._mcid_tokens(spark, d))).select("doc_id", "message")


@query("rule_mcid_in_parent_tree", f"""WITH {cq._MCID_SQL}
SELECT doc_id, 'page ' || page_num || ' content could not be read (no /Contents); its MCIDs were not checked against the ParentTree' AS message
  FROM (SELECT DISTINCT doc_id, page_num FROM tokens) WHERE doc_id = 'es'
UNION ALL SELECT DISTINCT doc_id, 'content stream S' || page_num || '.2 of page ' || page_num || ' could not be decoded (bad data); its MCIDs were not checked against the ParentTree'
  FROM tokens WHERE stream_idx = 2
UNION ALL SELECT doc_id, 'page ' || page_num || ': MCIDs ' || string_agg(mcid, ', ' ORDER BY mcid) || ' not reachable: page has no /StructParents'
  FROM (SELECT DISTINCT doc_id, page_num, mcid FROM mcids WHERE doc_id = 'fr') GROUP BY doc_id, page_num
UNION ALL SELECT doc_id, 'page ' || page_num || ': MCID ' || mcid || ' (' || string_agg({_LOC}, ', ' ORDER BY tok_idx) || ') has no structure element in ParentTree key ' || page_num
  FROM mcids WHERE doc_id <> 'fr' AND mcid > 4 GROUP BY doc_id, page_num, mcid""")
def _(spark, d):
    tokens, pages, streams = _page_streams(spark, d)
    # Asked for their places and for their slots.
    mcids = b.stored(ct.mcid_rows(cq._mcid_tokens(spark, d)))
    pages = pages.withColumn("struct_parents", F.when(F.col("doc_id") != "fr", F.col("page_num")))
    slots = mcids.where("mcid <= 4 AND doc_id <> 'fr'").selectExpr(
        "doc_id", "page_num", "mcid", "'E' as element", "cast(null as string) as error").distinct()
    errors = pages.where("false").select("doc_id", "page_num", "error")
    return v.mcid_in_parent_tree(pages, streams, mcids, errors, slots)[0].select("doc_id", "message")


@query("rule_struct_elem_type", """
SELECT 'R' || n_regionkey AS doc_id, 'structure element C' || c_custkey || ' has no usable /S (no /S)' AS message
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0""")
def _(spark, d):
    return v.struct_elem_type(sq.struct_tree(spark, d)).select("doc_id", "message")


# --- profiles ----------------------------------------------------------------


def archive_profile(spark, d):
    docs = _docs(spark, d)
    intents = table(spark, d, "customer").where("c_nationkey < 10").selectExpr("concat('D', c_custkey) as doc_id")
    color, undecided = v.output_intent(intents, _color(spark, d))
    findings = [
        v.no_encryption(docs), v.document_id(docs), color,
        v.xmp_metadata(docs, _xmp(spark, d), dc.metadata(*dq._info(spark, d))),
        # A rule of another profile is left out.
        v.lang(docs.selectExpr("doc_id", "'' as lang")),
    ]
    return v.validate(docs, v.PDFA, findings, [undecided], docs.where("sealed"))


_PROFILE_SQL = f"""{_COLOR_SQL},
f AS (
  SELECT 'D' || c_custkey AS doc_id, c_acctbal < -900 AS sealed, CASE WHEN c_acctbal < -500 THEN 1 ELSE 0 END AS enc, CASE WHEN c_acctbal <= 1000 THEN 1 ELSE 0 END AS id,
    CASE WHEN used AND c.c_nationkey >= 10 THEN 1 ELSE 0 END AS color, NOT coalesce(used, false) AND unread IS NOT NULL AND c.c_nationkey >= 10 AS undecided,
    CASE WHEN c.c_nationkey = 7 OR (c_acctbal < 0 AND c.c_nationkey <> 3) THEN 1 ELSE 0 END AS xmp
  FROM customer c JOIN color USING (c_custkey))
"""


@query("validate_summary", f"""WITH {_PROFILE_SQL}
SELECT doc_id, CASE WHEN sealed THEN 1 ELSE enc + id + color + xmp END AS errors, 0 AS warnings, CASE WHEN NOT sealed AND undecided THEN 1 ELSE 0 END AS info FROM f""")
def _(spark, d):
    return archive_profile(spark, d)[2]


@query("validate_outcomes", f"""WITH {_PROFILE_SQL}
SELECT doc_id, r.rule_id, NOT (r.rule_id = 'output-intent' AND undecided) AS evaluated,
  CASE r.rule_id WHEN 'no-encryption' THEN CASE WHEN sealed THEN 1 ELSE enc END WHEN 'document-id' THEN id WHEN 'output-intent' THEN color WHEN 'xmp-metadata' THEN xmp ELSE 0 END AS findings
FROM f, (VALUES ('font-embedding'), ('no-encryption'), ('output-intent'), ('no-js-launch'), ('xmp-metadata'), ('document-id')) AS r(rule_id)
WHERE NOT sealed OR r.rule_id = 'no-encryption'""")
def _(spark, d):
    return archive_profile(spark, d)[1].select("doc_id", "rule_id", "evaluated", "findings")


@query("validate_problems", f"""WITH {_PROFILE_SQL}
SELECT rule_id, severity, count(*) AS n FROM (
  SELECT 'no-encryption' AS rule_id, 'error' AS severity FROM f WHERE sealed OR enc = 1
  UNION ALL SELECT 'document-id', 'error' FROM f WHERE NOT sealed AND id = 1
  UNION ALL SELECT 'output-intent', 'error' FROM f WHERE NOT sealed AND color = 1
  UNION ALL SELECT 'output-intent', 'info' FROM f WHERE NOT sealed AND undecided
  UNION ALL SELECT 'xmp-metadata', 'error' FROM f WHERE NOT sealed AND xmp = 1) GROUP BY ALL""")
def _(spark, d):
    return archive_profile(spark, d)[0].groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("gate", f"""WITH {_PROFILE_SQL}
SELECT doc_id, CASE WHEN sealed OR enc + id + color + xmp > 0 OR undecided THEN 1 ELSE 0 END AS exit_code FROM f""")
def _(spark, d):
    _, outcomes, summary = archive_profile(spark, d)
    return v.gate(summary, outcomes)
