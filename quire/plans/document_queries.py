"""Document-level queries: metadata, attachments, signatures, file state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import documents as dc
from quire.operators import signatures as sg
from quire.plans import bindings as b
from quire.plans.registry import query, table


def _info(spark, d):
    c = table(spark, d, "customer")
    doc = "concat('D', c_custkey)"
    entries = b.entries_of(
        c, doc, "'info'", b.container([], "dict"), b.string(["Title"], "c_name"),
        b.only_if("c_acctbal > 0", b.string(["Author"], "c_mktsegment")), b.string(["Subject"], "''"),
        b.string(["CreationDate"], "concat('D:20240101', lpad(c_nationkey % 24, 2, '0'), '0000Z')"),
        b.number(["Pages"], "c_nationkey"))
    docs = c.selectExpr(f"{doc} as doc_id", "if(c_nationkey = 3, null, 'info') as info_id")
    return docs, entries


_INFO_SQL = """
SELECT 'D' || c_custkey AS doc_id, 'Title' AS key, c_name AS value FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'D' || c_custkey, 'Author', c_mktsegment FROM customer WHERE c_nationkey <> 3 AND c_acctbal > 0
UNION ALL SELECT 'D' || c_custkey, 'CreationDate', 'D:20240101' || lpad(CAST(c_nationkey % 24 AS VARCHAR), 2, '0') || '0000Z'
  FROM customer WHERE c_nationkey <> 3"""


@query("metadata", _INFO_SQL)
def _(spark, d):
    return dc.metadata(*_info(spark, d))


@query("info_vs_xmp", """
SELECT 'D' || c_custkey AS doc_id, 'Title' AS key, c_name AS info, c_name || ' & Co' AS xmp,
  '/Info /Title ("' || c_name || '") differs from XMP dc:title ("' || c_name || ' & Co")' AS message
FROM customer WHERE c_nationkey NOT IN (3, 4) AND c_acctbal < 0
UNION ALL SELECT 'D' || c_custkey, 'Author', c_mktsegment, 'é' || c_mktsegment,
  '/Info /Author ("' || c_mktsegment || '") differs from XMP dc:creator ("\\u00e9' || c_mktsegment || '")'
FROM customer WHERE c_nationkey NOT IN (3, 5) AND c_acctbal > 5000""")
def _(spark, d):
    info = dc.metadata(*_info(spark, d))
    xmp = table(spark, d, "customer").selectExpr(
        "concat('D', c_custkey) as doc_id",
        # Nation 4 lists two titles and nation 5 two authors: ambiguous, so skipped.
        "concat('<x><dc:title><rdf:Alt><rdf:li xml:lang=\"x\">', c_name, if(c_acctbal < 0, ' &amp;\\n  Co', ''), '</rdf:li>', "
        "if(c_nationkey = 4, '<rdf:li>t</rdf:li>', ''), '</rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>', "
        "if(c_acctbal > 5000, '&#233;', ''), c_mktsegment, '</rdf:li>', if(c_nationkey = 5, '<rdf:li>a</rdf:li>', ''), "
        "'</rdf:Seq></dc:creator></x>') as xmp")
    return dc.info_vs_xmp(info, xmp)


@query("name_tree", """
SELECT 'R' || n_regionkey AS doc_id, 'C' || c_custkey AS ref_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""")
def _(spark, d):
    t = b.tree_frames(spark, d)
    n, r = "concat('N', n_nationkey)", "concat('R', r_regionkey)"
    owner = "concat('N', c_nationkey)"
    slot = lambda k: f"concat('[', {k}, ']')"
    entries = b.union_all(
        b.entries_of(t["region"], r, r, b.container([], "dict"), b.container(["Kids"], "array")),
        # Each nation is listed twice; it is read once.
        b.entries_of(t["nation"], b.TREE_DOC, n, b.container([], "dict"), b.container(["Names"], "array"),
                     placed=[(b.TREE_DOC, b.ref(["Kids", slot("n_nationkey")], n, "n_nationkey")),
                             (b.TREE_DOC, b.ref(["Kids", slot("n_nationkey + 100")], n, "n_nationkey + 100"))]),
        b.entries_of(t["customer"], b.TREE_DOC, "concat('C', c_custkey)", b.only_if("c_acctbal >= 0", b.container([], "dict")),
                     placed=[(owner, b.entry(["Names", slot("2 * c_custkey")], "string", "c_name", idx="2 * c_custkey")),
                             (owner, b.ref(["Names", slot("2 * c_custkey + 1")], "concat('C', c_custkey)", "2 * c_custkey + 1"))]))
    return dc.name_tree(entries, b.tree_roots(spark, d)).select("doc_id", "ref_id")


@query("merge_sources", """
WITH src AS (
  SELECT 0 AS source, CASE WHEN o_orderstatus = 'F' THEN 'O' || o_custkey END AS ref_id, o_orderkey AS ord FROM orders
  UNION ALL SELECT 1, 'O' || c_custkey, c_custkey FROM customer)
SELECT ref_id, source, ord FROM src WHERE ref_id IS NULL
UNION ALL SELECT ref_id, min(source), min_by(ord, source * 1000000000000 + ord) FROM src WHERE ref_id IS NOT NULL GROUP BY ref_id""")
def _(spark, d):
    af = table(spark, d, "orders").selectExpr("'shop' as doc_id", "if(o_orderstatus = 'F', concat('O', o_custkey), null) as ref_id", "o_orderkey as ord")
    names = table(spark, d, "customer").selectExpr("'shop' as doc_id", "concat('O', c_custkey) as ref_id", "c_custkey as ord")
    return dc.merge_sources(af, names).select("ref_id", "source", "ord")


@query("embedded_files", """
SELECT 'P' || p_partkey AS filespec_ref, CASE WHEN p_size < 10 THEN p_brand ELSE p_name END AS name, 'Data' AS relationship,
  CASE WHEN p_type <> 'SMALL' THEN 'E' || p_partkey END AS file_ref,
  CASE WHEN p_type IN ('SMALL', 'LARGE', 'MEDIUM') THEN '' ELSE 'text/' || p_brand END AS mime,
  CASE WHEN p_type IN ('SMALL', 'LARGE', 'MEDIUM') THEN 0 WHEN p_size > 25 THEN p_size ELSE p_partkey END AS size,
  CASE p_type WHEN 'SMALL' THEN 'filespec has no /EF embedded-file stream' WHEN 'LARGE' THEN 'embedded-file stream could not be resolved'
    WHEN 'MEDIUM' THEN 'embedded-file target is not a stream' END AS warning FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    obj, file = "concat('P', p_partkey)", "concat('E', p_partkey)"
    entries = b.entries_of(
        b.dealt(p), "'shop'", obj, b.container([], "dict"), b.string(["F"], "p_brand"), b.only_if("p_size >= 10", b.string(["UF"], "p_name")),
        b.name(["AFRelationship"], "'Data'"), b.container(["EF"], "dict"), b.only_if("p_type <> 'SMALL'", b.ref(["EF", "F"], file)),
        placed=[(file, b.only_if("p_type = 'MEDIUM'", b.container([], "dict"))),
                (file, b.only_if("p_type not in ('MEDIUM', 'LARGE')", b.container([], "stream"))),
                (file, b.name(["Subtype"], "concat('text#2F', replace(p_brand, '#', '#23'))")),
                (file, b.number(["Length"], "p_partkey")), (file, b.container(["Params"], "dict")),
                (file, b.number(["Params", "Size"], "if(p_size > 25, p_size, -p_size)"))])
    specs = p.selectExpr("'shop' as doc_id", f"{obj} as ref_id", f"{obj} as obj_id", "cast(array() as array<string>) as at")
    return dc.embedded_files(b.stored(entries), specs).drop("doc_id", "checksum", "mod_date")


@query("select_unique", """
WITH req AS (SELECT DISTINCT p_brand AS doc_id, p_name AS name FROM part UNION SELECT DISTINCT p_brand, p_type FROM part),
f AS (SELECT p_brand AS doc_id, p_name AS name, count(*) AS n, bool_or(p_size > 10) AS ok, min(CAST(p_partkey AS VARCHAR)) AS ref_id FROM part GROUP BY ALL)
SELECT doc_id, name, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' WHEN NOT ok THEN 'unusable' ELSE 'ok' END AS status,
  coalesce(n, 0) AS n, CASE WHEN n = 1 AND ok THEN ref_id END AS ref_id FROM req LEFT JOIN f USING (doc_id, name)""")
def _(spark, d):
    p = table(spark, d, "part")
    rows = p.selectExpr("p_brand as doc_id", "p_name as name", "cast(p_partkey as string) as ref_id", "p_size")
    requests = rows.select("doc_id", "name").union(p.select("p_brand", "p_type")).distinct()
    return dc.select_unique(requests, rows, F.col("p_size") > 10)


@query("disk_status", """
SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_totalprice < 50000 OR o_orderpriority = '5-LOW' THEN 'changed' ELSE 'current' END AS state,
  epoch_ms(o_orderdate) AS loaded_mtime, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice < 50000 THEN epoch_ms(o_orderdate) - 3600000 ELSE epoch_ms(o_orderdate) END AS disk_mtime,
  CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END AS disk_size FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    then = o.selectExpr("concat('f', o_orderkey) as path", "o_custkey as size", "cast(o_orderdate as timestamp) as mtime")
    now = o.where("o_orderstatus <> 'P'").selectExpr(
        "concat('f', o_orderkey) as path", "if(o_orderpriority = '5-LOW', o_custkey + 1, o_custkey) as size",
        "if(o_totalprice < 50000, cast(o_orderdate as timestamp) - interval 1 hour, cast(o_orderdate as timestamp)) as mtime")
    return dc.disk_status(then, now)


_RECENT = """SELECT user_id, item, rank FROM (SELECT user_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS INTEGER) AS rank
FROM (SELECT user_id, props AS item, max(ts) AS ts FROM events GROUP BY ALL)) WHERE rank <= {k}"""


@query("recent_files", _RECENT.format(k=10))
def _(spark, d):
    events = table(spark, d, "events").select("user_id", F.col("props").alias("item"), "ts")
    return dc.recents(events, 10).drop("last_ts")


@query("recent_jumps", _RECENT.format(k=5))
def _(spark, d):
    events = table(spark, d, "events").select("user_id", F.col("props").alias("item"), "ts")
    return dc.recents(events, 5).drop("last_ts")


@query("stage_budget", """
WITH s AS (SELECT l_orderkey AS obj, l_linenumber AS stage, CASE WHEN l_discount > 0 THEN CAST(l_quantity AS BIGINT) END AS size FROM lineitem),
g AS (SELECT obj, min(CASE WHEN size IS NULL THEN stage END) AS gap FROM s GROUP BY obj)
SELECT CAST(obj AS VARCHAR) AS obj_id, coalesce(bool_or((gap IS NULL OR stage < gap) AND size > 40), false) AS over_budget,
  max(gap) IS NULL AS measured, 'F' || max(gap) AS first_unmeasured FROM s JOIN g USING (obj) GROUP BY obj""")
def _(spark, d):
    stages = table(spark, d, "lineitem").selectExpr(
        "'shop' as doc_id", "cast(l_orderkey as string) as obj_id", "l_linenumber as stage", "concat('F', l_linenumber) as filter",
        "if(l_discount > 0, cast(l_quantity as bigint), null) as size")
    return dc.stage_budget(stages, 40).drop("doc_id")


# --- signatures --------------------------------------------------------------


def _fields(spark, d):
    t = b.tree_frames(spark, d)
    n, c = "concat('N', n_nationkey)", "concat('C', c_custkey)"
    entries = b.union_all(
        b.entries_of(t["nation"], b.TREE_DOC, n, b.container([], "dict"), b.string(["T"], "n_name"),
                     b.name(["FT"], "if(n_nationkey < 10, 'Tx', 'Sig')"), b.container(["Kids"], "array")),
        b.entries_of(t["customer"], b.TREE_DOC, c, b.container([], "dict"), b.only_if("c_acctbal > 0", b.string(["T"], "c_name")),
                     b.only_if("c_mktsegment = 'BUILDING'", b.name(["FT"], "if(c_nationkey < 10, 'Sig', 'Tx')")),
                     placed=[("concat('N', c_nationkey)", b.ref(["Kids", "concat('[', c_custkey, ']')"], c, "c_custkey"))]))
    tops = t["nation"].selectExpr(f"{b.TREE_DOC} as doc_id", f"{n} as obj_id", "cast(n_nationkey as bigint) as idx")
    return entries, tops


@query("field_tree", """
SELECT 'R' || n_regionkey AS doc_id, n_name || '.' || c_name AS field_name, 'C' || c_custkey AS obj_id
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND (n_nationkey >= 10) = (c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'R' || n_regionkey, n_name, 'N' || n_nationkey FROM nation WHERE n_nationkey >= 10
  AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, d):
    return sg.field_tree(*_fields(spark, d)).select("doc_id", "field_name", "obj_id")


@query("signature_facts", """
WITH o AS (SELECT *, o_orderkey + 1000 AS size, CASE o_orderpriority WHEN '1-URGENT' THEN 'adbe.pkcs7.detached' WHEN '2-HIGH' THEN 'ETSI.RFC3161'
  WHEN '3-MEDIUM' THEN 'adbe.x509.rsa_sha1' ELSE 'other' END AS sub FROM orders)
SELECT 'F' || o_orderkey AS field_name, o_orderstatus <> 'P' AS signed,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN sub = 'ETSI.RFC3161' THEN 'document-timestamp' ELSE 'signature' END END AS type,
  CASE WHEN o_orderstatus <> 'P' THEN CASE sub WHEN 'adbe.pkcs7.detached' THEN 'cms' WHEN 'ETSI.RFC3161' THEN 'timestamp' WHEN 'adbe.x509.rsa_sha1' THEN 'cert-entry' ELSE 'other' END END AS kind,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS signing_time,
  CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_totalprice < 50000 THEN '/ByteRange missing' WHEN o_totalprice < 100000 THEN '/ByteRange is not an array'
    WHEN o_totalprice > 400000 THEN '/ByteRange ranges overlap' END END AS coverage_error,
  CASE WHEN o_orderstatus <> 'P' AND o_totalprice BETWEEN 100000 AND 400000 THEN CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 100 END END AS trailing_gap,
  o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 400000 AS covers_whole_file,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'trust not verified - structural decomposition only' || CASE WHEN sub = 'other' THEN ', subFilter not decomposed' ELSE '' END END AS notes
FROM o""")
def _(spark, d):
    o = table(spark, d, "orders")
    obj, sig = "concat('F', o_orderkey)", "concat('V', o_orderkey)"
    sub = ("case o_orderpriority when '1-URGENT' then 'adbe.pkcs7.detached' when '2-HIGH' then 'ETSI.RFC3161' "
           "when '3-MEDIUM' then 'adbe.x509.rsa_sha1' else 'other' end")
    has = "o_totalprice >= 100000"
    gap = "if(o_orderstatus = 'F', 0, 100)"
    second = "if(o_totalprice > 400000, 5, 500)"
    entries = b.entries_of(
        o, "'shop'", obj, b.container([], "dict"), b.only_if("o_orderstatus <> 'P'", b.ref(["V"], sig)),
        placed=[(sig, b.container([], "dict")), (sig, b.name(["SubFilter"], sub)),
                (sig, b.string(["M"], "date_format(o_orderdate, \"'D:'yyyyMMddHHmmss'Z'\")")),
                (sig, b.only_if("o_totalprice between 50000 and 99999.9999", b.name(["ByteRange"], "'none'"))),
                (sig, b.only_if(has, b.container(["ByteRange"], "array"))),
                (sig, b.only_if(has, b.number(["ByteRange", "[0]"], "0", "0"))), (sig, b.only_if(has, b.number(["ByteRange", "[1]"], "100", "1"))),
                (sig, b.only_if(has, b.number(["ByteRange", "[2]"], second, "2"))),
                (sig, b.only_if(has, b.number(["ByteRange", "[3]"], f"o_orderkey + 1000 - {second} - {gap}", "3")))])
    fields = o.selectExpr("'shop' as doc_id", f"{obj} as field_name", f"{obj} as obj_id", "cast(array() as array<string>) as at", "array(o_orderkey) as ord",
                          "o_orderkey + 1000 as size")
    # One file per field, so that sizes differ: the document is the field.
    entries = entries.withColumn("doc_id", F.regexp_extract("obj_id", r"(\d+)", 1))
    fields = fields.withColumn("doc_id", F.regexp_extract("obj_id", r"(\d+)", 1))
    facts = sg.signature_facts(entries, fields.drop("size"), fields.select("doc_id", "size"))
    return facts.select("field_name", "signed", "type", "kind", "signing_time", "coverage_error", "trailing_gap", "covers_whole_file",
                        F.array_join("notes", ", ").alias("notes"))


def _signers(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.expr("max_by(l_suppkey, l_partkey * 1000000 + l_suppkey) as sk"), F.max("l_partkey").alias("pk"), F.min("l_partkey").alias("low"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    infos = o.selectExpr(
        "'shop' as doc_id", "cast(o_orderkey as string) as field_name",
        "case o_orderstatus when 'F' then 'issuer' when 'O' then 'ski' else 'cert-entry' end as sid_kind",
        "cast(sk as string) as issuer", "cast(pk as string) as serial", "concat('k', if(o_totalprice > 200000, low, -1)) as ski",
        "'2.16.840.1.101.3.4.2.1' as digest_oid", "if(o_orderstatus = 'F', '1.2.840.113549.1.1.11', '1.2.3') as sig_oid")
    certs = table(spark, d, "lineitem").selectExpr(
        "'shop' as doc_id", "cast(l_orderkey as string) as field_name", "l_linenumber * 1000000 + l_partkey as cert_idx",
        "concat('S', l_partkey) as subject", "cast(l_suppkey as string) as issuer", "cast(l_partkey as string) as serial", "concat('k', l_partkey) as ski")
    return infos, certs


@query("match_signer", """
WITH li AS (SELECT l_orderkey, max_by(l_suppkey, l_partkey * 1000000 + l_suppkey) AS sk, max(l_partkey) AS pk, min(l_partkey) AS low FROM lineitem GROUP BY 1),
i AS (SELECT * FROM orders JOIN li ON o_orderkey = l_orderkey),
m AS (SELECT i.o_orderkey, o_orderstatus, min(c.l_linenumber * 1000000 + c.l_partkey) FILTER (WHERE
    (o_orderstatus = 'F' AND c.l_partkey = pk AND c.l_suppkey = sk) OR (o_orderstatus = 'O' AND o_totalprice > 200000 AND c.l_partkey = low)) AS idx
  FROM i JOIN lineitem c ON c.l_orderkey = o_orderkey GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS field_name, idx AS cert_idx, 'S' || idx % 1000000 AS subject, 'SHA-256' AS digest_algorithm,
  CASE o_orderstatus WHEN 'F' THEN 'RSA with SHA-256' ELSE '1.2.3' END AS signature_algorithm,
  CASE WHEN idx IS NULL THEN 'signer certificate not present in the embedded set' END AS note FROM m""")
def _(spark, d):
    return sg.match_signer(*_signers(spark, d)).drop("doc_id", "cert_serial")


@query("cert_facts", """
SELECT p_partkey AS cert_idx, CASE WHEN p_size >= 10 THEN concat_ws(',', CASE WHEN p_size & 1 > 0 THEN 'digitalSignature' END, CASE WHEN p_size & 2 > 0 THEN 'nonRepudiation' END,
    CASE WHEN p_size & 4 > 0 THEN 'keyEncipherment' END, CASE WHEN p_size & 8 > 0 THEN 'dataEncipherment' END, CASE WHEN p_size & 16 > 0 THEN 'keyAgreement' END,
    CASE WHEN p_size & 32 > 0 THEN 'keyCertSign' END) END AS key_usage,
  CASE p_type WHEN 'ECONOMY' THEN 'serverAuth' WHEN 'SMALL' THEN 'timeStamping,' WHEN 'STANDARD' THEN '' END AS purposes FROM part""")
def _(spark, d):
    certs = table(spark, d, "part").selectExpr(
        "'shop' as doc_id", "p_brand as field_name", "cast(p_partkey as int) as cert_idx", "p_name as subject", "p_type as issuer", "'1' as serial",
        "cast(null as timestamp) as not_before", "cast(null as timestamp) as not_after", "if(p_size >= 10, p_size, null) as ku_bits",
        "case p_type when 'ECONOMY' then array('1.3.6.1.5.5.7.3.1') when 'SMALL' then array('1.3.6.1.5.5.7.3.8', '1.2.3') "
        "when 'STANDARD' then cast(array() as array<string>) end as eku",
        "cast(null as array<string>) as crl", "cast(null as array<string>) as ocsp", "cast(null as array<string>) as ca_issuers")
    return sg.cert_facts(certs).select(
        "cert_idx", F.when(F.col("key_usage").isNotNull(), F.array_join("key_usage", ",")).alias("key_usage"),
        F.when(F.col("ext_key_usage").isNotNull(), F.array_join(F.transform("ext_key_usage", lambda x: x["name"]), ",")).alias("purposes"))


@query("certs_to_export", """
WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS field_name,
  'sig' || n || '-cert' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber * 1000000 + l_partkey) AS file_name
FROM f JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def _(spark, d):
    sigs = table(spark, d, "orders").selectExpr(
        "cast(o_custkey as string) as doc_id", "cast(o_orderkey as string) as field_name", "array(o_orderkey) as ord", "o_orderstatus <> 'P' as signed")
    owner = table(spark, d, "orders").selectExpr("cast(o_orderkey as string) as field_name", "cast(o_custkey as string) as doc_id")
    certs = _signers(spark, d)[1].drop("doc_id").join(owner, "field_name").select("doc_id", "field_name", "cert_idx", "subject")
    return sg.certs_to_export(sigs, certs).select("doc_id", "field_name", "file_name")
