"""Registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import decontaminate, html_text, language, line_dedup, ngram_join, packing, passages, pii, quality, toxicity, turn_trie, url_filter, whitening
from quire.plans.registry import query, table

#: Fixed values of the query: host rules, and the host names that feed the list.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
LISTED_NAMES = "ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm"

_URL_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+\z', '') END AS key,
  CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM s),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)({LISTED_NAMES})\.'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN key IN (SELECT key FROM l WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM k"""


@query("op3_url_filter", _URL_SQL)
def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The list: every page address that the table has on hosts of these names.
    host, _ = url_filter.url_parts(F.col("url"))
    listed = pages.where(host.rlike(rf"(^|\.)({LISTED_NAMES})\."))
    out = url_filter.judge_urls(pages, listed, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


_LINE = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_N = "len(regexp_split_to_array(regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z', '', 'g'), '[\\x20\\x09-\\x0D]+'))"
_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_LINE} AS lines,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
q AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS total,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT (
      100 * length(regexp_replace(x, '[^#*$%&|<>!]', '', 'g')) >= 8 * length(x)
      OR ({_N} >= 30 AND NOT regexp_matches(x, '[.,;:?!]'))
      OR (regexp_matches(x, '[|»›•]') AND 6 * length(regexp_replace(x, '[^|»›•]', '', 'g')) >= {_N})
      OR {' OR '.join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)})), lambda x: length(x))), 0) AS survived
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * survived >= 50 * total AS kept FROM b"""


@query("op8_quality_rules", _QUALITY_SQL)
def op8_quality_rules(spark, sf_dir):
    out = quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Production would take the key from a secret store; equal keys link values across runs.
PII_KEY = "quire-demo-key"


@query("op7_pii")
def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymize(docs, PII_KEY)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_NGRAM_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


@query("op1_ngram_jaccard_join", _NGRAM_SQL)
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))

_STRIPPED = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES_SQL = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS x, len(lines) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT *, translate({_STRIPPED}, '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> doc_id AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM d GROUP BY doc_id"""


@query("op12_line_dedup", _LINES_SQL)
def op12_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_TRIE_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
p AS (SELECT c.conv_id, 0 AS own, pos, k, chars FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, k, chars FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM c UNION ALL SELECT conv_id, depth, path, chars FROM s),
e AS (SELECT conv_id, max(depth) AS turns FROM m GROUP BY conv_id),
n AS (SELECT path, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256 FROM m JOIN e USING (conv_id) GROUP BY ALL),
k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT substr(path, 1, 32 * d) AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM
  (SELECT n.path, CAST(k.path IS NULL AS INT) AS leaf, (n_convs - 1) * chars AS saved, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k USING (path)) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))"""


@query("op11_conversation_trie", _TRIE_SQL)
def op11_conversation_trie(spark, sf_dir):
    return turn_trie.prefix_trie(turn_trie.rebuilt(turn_trie.turn_sequences(table(spark, sf_dir, "conversations"))))


@query("pipeline")
def pipeline(spark, sf_dir):
    # The pipeline builds on this module, so it is imported when it runs.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
