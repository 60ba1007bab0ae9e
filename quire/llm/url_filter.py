"""URL filtering: host rules, then a blocked Bloom filter before an exact join.

Everything is DataFrame and SQL functions. A listed URL is compared in canonical
form (``canonical_url``). The Bloom filter is a table of blocks of 256 bits, built
by OR-ing the masks of the listed URLs; a URL sets or tests eight bits of one
block. Only possible hits go on to the exact join on the canonical URL, which
removes the filter's false positives, so the verdict never depends on its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_PER_BLOCK = 4
BITS_PER_KEY = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and the path without its last slashes; null for no host."""
    return F.when(
        host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))
    )


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule is ``host/path``: it fits its host and all subdomains of it when the
    URL's path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rule_path = name.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """The eight bits of a key as one long per word of its block: two bits a word."""
    h = F.xxhash64(key, F.lit(2))
    out = []
    for w in range(WORDS_PER_BLOCK):
        bits = [F.shiftrightunsigned(h, 12 * w + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1)]
        one = [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]
        out.append(one[0].bitwiseOR(one[1]))
    return out


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """A row per non-empty block: block, w0..w3."""
    masks = _masks(F.col(key))
    rows = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def judge_urls(
    urls: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    listed_col: str = "url",
    keys_per_block: int = 16,
    broadcast_limit_mb: float = 64.0,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` to every row of ``urls``.

    The verdict is the longest rule's; where none fits, ``block`` for a URL whose
    canonical form is among those of ``listed[listed_col]``, else ``allow``. Columns
    of those names in ``urls`` are replaced. Null, empty and malformed URLs have an
    empty host and path, no rule and are allowed; they list nothing. Repeated listed
    URLs count once. With an empty list every URL without a rule is allowed.

    Listed URLs are counted to size the filter (16 to a block of 32 bytes: about
    0.1 % false positives). The filter is broadcast while it stays below
    ``broadcast_limit_mb``; beyond that it is joined by block like any table.
    """
    host, path = url_parts(F.col(listed_col))
    keys = listed.select(canonical_url(host, path).alias("key")).where(F.col("key").isNotNull()).distinct()
    n_blocks = max(1, -(-keys.count() // keys_per_block))
    bloom = blocked_bloom(keys, "key", n_blocks)
    # A block is five longs and its row header in memory.
    if n_blocks * 64 <= broadcast_limit_mb * 1e6:
        bloom = F.broadcast(bloom)

    made = ["host", "path", "rule", "verdict", "listed"]
    kept = [c for c in urls.columns if c not in made]
    host, path = url_parts(F.col(url_col))
    judged = urls.select(*kept, host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), said.alias("_said"), canonical_url(F.col("host"), F.col("path")).alias("_key"))

    # Only rows without a rule ask the list. The others get numbers of their own that are no
    # block, as a null key would bring them all to one task.
    asks = F.col("rule").isNull() & F.col("_key").isNotNull()
    judged = judged.withColumn("_row", F.monotonically_increasing_id())
    judged = judged.withColumn("_block", F.when(asks, _block(F.col("_key"), n_blocks).cast("long")).otherwise(-1 - F.col("_row")))
    bloom = bloom.select(F.col("block").alias("_b"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS_PER_BLOCK)])
    probed = judged.join(bloom, F.col("_block") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    for i, m in enumerate(_masks(F.col("_key"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
    # No key begins with a slash.
    probed = probed.withColumn("_maybe", F.when(hit, F.col("_key")).otherwise(F.concat(F.lit("/"), F.col("_row").cast("string"))))
    exact = keys.select(F.col("key").alias("_listed"))
    out = probed.join(exact, F.col("_maybe") == F.col("_listed"), "left")
    is_listed = F.col("_listed").isNotNull()
    verdict = F.coalesce(F.col("_said"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*kept, "host", "path", "rule", verdict.alias("verdict"), is_listed.alias("listed"))
