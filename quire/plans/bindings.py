"""Adapters: the shared test tables seen as object tables.

Every adapter is a plain projection or join of whole tables, so the work of a
query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import table
from quire.session import written



def lit(text: str) -> str:
    return "'" + text + "'"


def entry(path: list[str], value_type: str, raw: str = "null", value: str | None = None,
          ref: str = "null", idx: str = "null") -> str:
    """SQL of one entries row. Path steps are SQL; so are the values."""
    steps = [p if p[0] in "'(" or "(" in p else lit(p) for p in path]
    whole = f"array({', '.join(steps)})" if steps else "cast(array() as array<string>)"
    parent = f"array({', '.join(steps[:-1])})" if len(steps) > 1 else "cast(array() as array<string>)"
    num = f"try_cast({raw} as double)" if value_type == "number" else "cast(null as double)"
    return (
        f"named_struct('path', {whole}, 'parent_path', {parent}, "
        f"'key', cast({steps[-1] if steps else 'null'} as string), 'idx', cast({idx} as bigint), "
        f"'value_type', '{value_type}', 'value_raw', cast({raw} as string), "
        f"'value', cast({value or raw} as string), 'num', {num}, 'ref_id', cast({ref} as string))"
    )


def name(path: list[str], v: str) -> str:
    return entry(path, "name", f"concat('/', {v})", v)


def string(path: list[str], v: str) -> str:
    return entry(path, "string", f"concat('(', {v}, ')')", v)


def number(path: list[str], v: str, idx: str = "null") -> str:
    return entry(path, "number", v, idx=idx)


def boolean(path: list[str], v: str) -> str:
    return entry(path, "boolean", v)


def ref(path: list[str], target: str, idx: str = "null") -> str:
    return entry(path, "reference", target, ref=target, idx=idx)


def container(path: list[str], kind: str, idx: str = "null") -> str:
    return entry(path, kind, idx=idx)


def only_if(condition: str, row: str) -> str:
    return f"if({condition}, {row}, null)"


def entries_of(df: DataFrame, doc: str, obj: str, *rows: str, placed: list[tuple[str, str]] | None = None) -> DataFrame:
    """Entries rows of one object per input row; NULL rows are left out.

    ``placed`` rows belong to other objects, such as the slot of a parent's
    array; making them here saves a second pass over the input.
    """
    items = [(obj, r) for r in rows] + (placed or [])
    structs = [
        f"if({r} is null, null, named_struct('o', cast({o} as string), 'e', {r}))" if r.startswith("if(")
        else f"named_struct('o', cast({o} as string), 'e', {r})"
        for o, r in items
    ]
    made = f"array({', '.join(structs)})"
    # A lambda over the array would leave generated code; NULL rows are dropped behind it.
    return df.selectExpr(f"cast({doc} as string) as doc_id", f"explode({made}) as r").where("r is not null").selectExpr(
        "doc_id", "r.o as obj_id", "r.e.*"
    )


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file over all tasks, before each is made into many."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def stored(entries: DataFrame) -> DataFrame:
    """The adapted rows written out, as object tables are: operators pass over them more than once."""
    return written(entries)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- G-tree: region > nation > customer > order, suppliers unreferenced ------


def tree_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").join(
        customer.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return {
        "region": table(spark, d, "region"),
        "nation": nation,
        "customer": customer,
        "orders": orders,
        "supplier": supplier,
    }


TREE_DOC = "concat('R', n_regionkey)"


def tree_entries(spark: SparkSession, d: str) -> DataFrame:
    """Objects R, N, C, O, S with /Kids arrays, /Parent back-edges and scalars.

    Array positions are the child's key: ordered, not dense.
    """
    t = tree_frames(spark, d)
    r, n, c, o, s = (f"concat('{p}', {k})" for p, k in (
        ("R", "r_regionkey"), ("N", "n_nationkey"), ("C", "c_custkey"),
        ("O", "o_orderkey"), ("S", "s_suppkey")))
    nation_of = "concat('N', c_nationkey)"

    def slot(target: str, key: str) -> str:
        return ref(["Kids", f"concat('[', {key}, ']')"], target, key)

    return union_all(
        entries_of(t["region"], r, r, container([], "dict"), name(["Type"], "'Region'"),
                   string(["Name"], "r_name"), container(["Kids"], "array")),
        entries_of(t["nation"], TREE_DOC, n, container([], "dict"), name(["Type"], "'Nation'"),
                   string(["Name"], "n_name"), ref(["Parent"], TREE_DOC), container(["Kids"], "array"),
                   placed=[(TREE_DOC, slot(n, "n_nationkey"))]),
        entries_of(t["customer"], TREE_DOC, c, container([], "dict"), name(["Type"], "'Customer'"),
                   string(["Name"], "c_name"), number(["Balance"], "c_acctbal"),
                   ref(["Parent"], nation_of), container(["Kids"], "array"),
                   placed=[(nation_of, slot(c, "c_custkey"))]),
        # Orders carry no /Type, so their label comes from the path.
        entries_of(t["orders"], TREE_DOC, o, container([], "dict"),
                   string(["Status"], "o_orderstatus"), number(["Total"], "o_totalprice"),
                   placed=[("concat('C', o_custkey)", slot(o, "o_orderkey"))]),
        entries_of(t["supplier"], TREE_DOC, s, container([], "dict"), name(["Type"], "'Supplier'"),
                   ref(["Nation"], "concat('N', s_nationkey)")),
    )


def tree_objects(spark: SparkSession, d: str) -> DataFrame:
    """The cross-reference rows of the tree; orders sit in object streams."""
    t = tree_frames(spark, d)

    def rows(df, doc, prefix, key, slot, type_name, status="'in-use'", offset="null", host="null"):
        return df.selectExpr(
            f"{doc} as doc_id", f"concat('{prefix}', {key}) as obj_id",
            f"cast({key} as bigint) * 5 + {slot + 1} as obj_num", "0 as gen", f"{status} as status",
            f"cast({offset} as bigint) as offset", f"cast({host} as bigint) as host_objstm",
            f"cast({type_name} as string) as type_name",
        )

    return union_all(
        rows(t["region"], "concat('R', r_regionkey)", "R", "r_regionkey", 0, "'Region'"),
        rows(t["nation"], TREE_DOC, "N", "n_nationkey", 1, "'Nation'", offset="n_nationkey * 100"),
        rows(t["customer"], TREE_DOC, "C", "c_custkey", 2, "'Customer'", offset="c_custkey * 1000"),
        rows(t["orders"], TREE_DOC, "O", "o_orderkey", 3, "null",
             status="if(o_orderstatus = 'P', 'in-objstm', 'in-use')", offset="o_orderkey * 10", host="o_custkey"),
        rows(t["supplier"], TREE_DOC, "S", "s_suppkey", 4, "'Supplier'",
             status="if(s_acctbal < 0, 'free', 'in-use')"),
    )


def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    r = "concat('R', r_regionkey)"
    return table(spark, d, "region").selectExpr(f"{r} as doc_id", f"{r} as obj_id")


# --- G-use: links of web pages as image uses ---------------------------------

LANG = r'<html lang="([a-z]+)"'


def page_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        F.regexp_extract("html", LANG, 1).alias("doc_id"),
        F.col("page_id").alias("page_num"),
        "html",
    )


def link_uses(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, page_num, obj_id, ord``: one row per link, in page order."""
    return page_frame(spark, d).select(
        "doc_id",
        "page_num",
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "obj_id"),
    )


# --- G-token: markup as content tokens ---------------------------------------

# How markup reads as content operators.
TAG_OPERATORS = {
    "p": ("BDC", "EMC"),
    "b": ("BMC", "EMC"),
    "li": ("q", "Q"),
    "a": ("[", "]"),
    "script": ("BI", "EI"),
}
TOKENS_PER_STREAM = 50
TOKENS_PER_LINE = 8


def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each page; every 50 tokens are one content stream."""
    raw = page_frame(spark, d).selectExpr(
        "doc_id", "page_num", "posexplode(regexp_extract_all(html, '<[^>]+>|[^<]+', 0)) as (tok_idx, text)"
    ).selectExpr(
        "*", "regexp_extract(text, '^</?([a-z0-9]+)', 1) as tag", "startswith(text, '</') as closing",
        "startswith(text, '<!--') as comment", "startswith(text, '<') as markup",
    )
    mapped = " ".join(
        f"when tag = '{t}' then if(closing, '{closer}', '{opener}')" for t, (opener, closer) in TAG_OPERATORS.items()
    )
    return raw.selectExpr(
        "doc_id",
        "page_num",
        f"cast(tok_idx div {TOKENS_PER_STREAM} as int) as stream_idx",
        "cast(tok_idx as bigint) as tok_idx",
        "case when comment then 'comment' when markup then 'operator' else 'string' end as type",
        f"case when comment or not markup then text {mapped} else concat('T', tag) end as value",
        f"tok_idx div {TOKENS_PER_LINE} + 1 as line",
        f"cast(tok_idx % {TOKENS_PER_LINE} + 1 as bigint) as col",
    )


TOKENS_SQL = """
raw_tokens AS (
  SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS doc_id, page_id AS page_num,
         unnest(regexp_extract_all(html, '<[^>]+>|[^<]+')) AS text,
         unnest(range(len(regexp_extract_all(html, '<[^>]+>|[^<]+')))) AS tok_idx
  FROM pages),
tagged AS (
  SELECT *, regexp_extract(text, '^</?([a-z0-9]+)', 1) AS tag, starts_with(text, '</') AS closing
  FROM raw_tokens),
tokens AS (
  SELECT doc_id, page_num, CAST(tok_idx // 50 AS INTEGER) AS stream_idx, CAST(tok_idx AS BIGINT) AS tok_idx,
         CASE WHEN starts_with(text, '<!--') THEN 'comment' WHEN starts_with(text, '<') THEN 'operator'
              ELSE 'string' END AS type,
         CASE WHEN starts_with(text, '<!--') OR NOT starts_with(text, '<') THEN text
              WHEN tag = 'p' AND closing THEN 'EMC' WHEN tag = 'p' THEN 'BDC'
              WHEN tag = 'b' AND closing THEN 'EMC' WHEN tag = 'b' THEN 'BMC'
              WHEN tag = 'li' AND closing THEN 'Q' WHEN tag = 'li' THEN 'q'
              WHEN tag = 'a' AND closing THEN ']' WHEN tag = 'a' THEN '['
              WHEN tag = 'script' AND closing THEN 'EI' WHEN tag = 'script' THEN 'BI'
              ELSE 'T' || tag END AS value,
         CAST(tok_idx // 8 + 1 AS BIGINT) AS line, CAST(tok_idx % 8 + 1 AS BIGINT) AS col
  FROM tagged)
"""
