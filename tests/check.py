"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import logging
import math
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(master: str = "local[8]"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f:.9g}")
    return (3, str(v))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    want_cols = [c[0] for c in res.description]
    want = res.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(want_cols):
        return f"columns {cols} != {sorted(want_cols)}"
    order = [want_cols.index(c) for c in cols]
    a = sorted(tuple(norm(r[c]) for c in cols) for r in got)
    b = sorted(tuple(norm(r[i]) for i in order) for r in want)
    if a == b:
        return f"ok {len(a)} rows"
    sa, sb = set(a), set(b)
    return (
        f"DIFFERENT spark {len(a)} sql {len(b)}\n   only spark {sorted(sa - sb)[:3]}\n   only sql   {sorted(sb - sa)[:3]}"
    )


def main():
    from quire.plans.registry import ORACLES, QUERIES
    import __spark_entry__

    __spark_entry__.queries()
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            if name in ORACLES:
                msg = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                msg = f"no sql, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            msg = "FAILED " + "".join(traceback.format_exception_only(e))[:500]
        bad += not msg.startswith(("ok", "no sql"))
        print(f"{name:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
