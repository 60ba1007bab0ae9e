"""Main text of web pages: page structure first, then a suffix array over each host's pages.

Text inside ``<article>`` or ``<main>`` is content and text inside menus, footers,
adverts and the like is not. Pages without such an element keep the blocks that no
structure decides, unless the host repeats them: the token streams of a host's pages
are concatenated and their suffixes sorted by their first ``MIN_RUN`` tokens; suffixes
that agree so far and lie on distinct pages are repeats, and the union of their first
tokens is the union of all long repeated substrings. Blocks that repeats cover by half
or more are removed, the unique rest stays.

Articles go through the same arrays. Articles quote and copy one another, so two that
agree say nothing yet: a run is furniture if it stands in half or more of the host's
different articles and in ``MIN_ARTICLES`` at least. Blocks of an article that such runs
cover by half or more are removed, unless they cover half of the article: copies of an
article on a host stay whole.

A host's pages are dealt into shards of about ``SHARD_PAGES`` or ``SHARD_CHARS``, each
with its suffix array. A shard emits one row per distinct run of ``MIN_RUN`` tokens
outside articles, with up to two of its pages counted; summed by run, these rows find
repeats across shards as well. A run of half of the articles has its share of them in
one shard at least: such runs are emitted, and counted over all articles of the host.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.hashing import SPACE_BYTES, hash_words, in_runs, shingles, sliced
from quire.llm.url_filter import url_parts
from quire.session import materialize

MIN_RUN = 8
SHARD_PAGES = 4000
SHARD_CHARS = 8_000_000
MIN_ARTICLES = 3

_SILENT = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""(?i)\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HINT = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input link meta".split()
)
SPACED = frozenset(["br", "td", "th"])
CONTENT = frozenset(["article", "main"])
#: Elements that are no article text; a header counts only outside articles.
FURNITURE = frozenset(["nav", "footer", "aside", "form", "dialog", "menu"])
#: Words in class, id or role that say the same.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget "
    "footer masthead toolbar share sharing social related recommended comment comments commentlist discussion disqus reply replies "
    "newsletter subscribe subscription signup login search pagination pager skip copyright legal complementary contentinfo".split()
)
#: Of these, the ones around readers' words or other pages' articles, which hold articles of their own.
FOREIGN = frozenset("related recommended comment comments commentlist discussion disqus reply replies".split())
#: An article is none of the page's if its class or id begins with one of these.
NOT_OURS = FOREIGN | frozenset("ad ads advert adverts advertisement sponsor sponsored promo widget".split())
#: A name that begins so says something about the page, not about the element.
QUALIFIERS = frozenset("no not has with without is hide".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements whose start ends an open paragraph.
_ENDS_P = frozenset(["p", "div", "ul", "ol", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "nav", "aside", "footer", "header"])


def _unwanted(attributes: str, tag: str) -> int:
    """2 for an element that is no article text in any case, 1 for one whose name looks like furniture, else 0."""
    found = 0
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name not in ("class", "id", "role") or tag in ("html", "body", "main") or tag in HEADINGS:
            continue
        for words in map(_HINT.findall, value.split()):
            if not words or words[0] in QUALIFIERS:
                continue
            if tag == "article":
                found = max(found, 2 if words[0] in NOT_OURS else 0)
            elif not HINTS.isdisjoint(words):
                found = max(found, 1 if FOREIGN.isdisjoint(words) else 2)
    return found


def split_blocks(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order with their zone: 2 content, 1 undecided, 0 furniture.

    An article inside an element that only its name makes furniture counts as content
    if the page has no other one.
    """
    blocks: list[tuple[str, int]] = []
    if not page:
        return blocks
    page = _SILENT.sub(" ", page)
    stack: list[tuple[str, int]] = []  # open elements with the zone they had around them
    # While parsing: 3 is an article within something that looks like furniture, -1 furniture in any case.
    zone, parts, at = 1, [], 0

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
            if text:
                blocks.append((text, zone))
            parts.clear()

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in SPACED:
            parts.append(" ")
        hinted = 0 if closing or tag in VOID or not attributes else _unwanted(attributes, tag)
        if tag in INLINE and not hinted and not (closing and any(t == tag for t, _ in stack[-4:])):
            continue
        if tag not in SPACED:
            end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            zone = stack.pop()[1]
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append((tag, zone))
        if zone == -1 or hinted == 2 or tag in FURNITURE or (tag == "header" and zone < 2):
            zone = -1
        elif tag in CONTENT:
            zone = 3 if zone in (0, 3) else 2
        elif hinted:
            zone = 0
    if at < len(page):
        parts.append(page[at:])
    end_block()
    held = 0 if any(z == 2 for _, z in blocks) else 2
    return [(t, held if z == 3 else max(z, 0)) for t, z in blocks]


def _parse(names: list[str], html_at: int):
    """Arrow function: the kept columns, the host, the text if decided, undecided blocks, and the stream outside articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text, undecided, streams, starts = [], [], [], []
            for value in batch.column(html_at):
                blocks = split_blocks(value.as_py())
                content = [t for t, z in blocks if z == 2]
                open_blocks = [] if content else [t for t, z in blocks if z == 1]
                outside = [(t, z) for t, z in blocks if z < 2]
                text.append("\n\n".join(content) if not open_blocks else None)
                undecided.append(open_blocks)
                streams.append(" ".join(t for t, _ in outside))
                # Where each undecided block begins in the stream, in tokens.
                at, own = 0, []
                for t, z in outside:
                    n = len(t.split(" "))
                    if open_blocks and z == 1:
                        own.append(at)
                    at += n
                starts.append(own)
            made = [pa.array(text, pa.string()), pa.array(undecided, pa.list_(pa.string())), pa.array(streams, pa.string()), pa.array(starts, pa.list_(pa.int32()))]
            kept = [c for i, c in enumerate(batch.columns) if i != html_at]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return run


def _stream_hashes(stream: str | None) -> np.ndarray:
    _, run = next(in_runs([stream or ""]))
    return hash_words(run, SPACE_BYTES ^ True).hashes


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` tokens (a power of two), by prefix doubling."""
    _, rank = np.unique(tokens, return_inverse=True)
    done = 1
    while done < length:
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - done)] = rank[done:]
        _, rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)
        done *= 2
    return rank


def _shard_runs(key: tuple, table: pa.Table) -> pa.Table:
    """One row per distinct run of a shard: host, run, pages outside articles (1, or 2 for more), articles.

    Articles are counted from ``least`` on, else 0; a run that has neither gives no row.
    """
    length = MIN_RUN
    names = np.array([str(p) for p in table.column("page").to_pylist()])
    article = table.column("article").to_numpy()
    # Rows of the same page count as one page, equal articles as one article.
    _, page = np.unique(names, return_inverse=True)
    once = np.ones(len(names), bool)
    once[article] = False
    once[np.flatnonzero(article)[np.unique(page[article], return_index=True)[1]]] = True
    page, article = page[once], article[once]
    each = [_stream_hashes(s) for s in table.column("stream").filter(pa.array(once)).to_pylist()]
    source = np.repeat(np.arange(len(each)), [len(e) + 1 for e in each])
    # A separator of its own after each stream keeps runs within pages.
    ends = np.cumsum([len(e) + 1 for e in each]) - 1
    tokens = np.zeros(len(source), np.uint64)
    runs = np.zeros(len(source), np.uint64)
    inside = np.zeros(len(source), bool)
    for e, end in zip(each, ends):
        begin = end - len(e)
        tokens[begin:end], tokens[end] = e, end
        n = len(e) - length + 1
        if n > 0:
            runs[begin : begin + n] = shingles(e, length)
            inside[begin : begin + n] = True
    rank = suffix_ranks(tokens, length)[inside] if inside.any() else np.zeros(0, np.int64)
    runs, source = runs[inside], source[inside]
    # Once for each page and article that holds the run.
    owner = page[source] * 2 + article[source]
    order = np.lexsort((owner, rank))
    rank, runs, owner = rank[order], runs[order], owner[order]
    new = np.diff(rank, prepend=-1) != 0
    own = new | (np.diff(owner, prepend=-1) != 0)
    first = np.flatnonzero(new)
    count = lambda flags: np.add.reduceat(flags.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    pages, articles = np.minimum(count(own & (owner % 2 == 0)), 2), count(own & (owner % 2 == 1))
    articles[articles < table.column("least")[0].as_py()] = 0
    some = (pages > 0) | (articles > 0)
    host = pa.array([key[0].as_py()] * int(some.sum()), pa.string())
    return pa.table({"host": host, "run": runs[first[some]].view(np.int64), "pages": pages[some], "articles": articles[some]})


def _hits(stream: str, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a stream, and the positions of those among ``runs``."""
    own = shingles(_stream_hashes(stream), MIN_RUN).view(np.int64)
    return own, np.flatnonzero(np.isin(own, runs))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per article (host, article, text, runs): host, article, and each of the runs that it holds."""
    for batch in sliced(batches):
        found = []
        for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own, at = _hits(text, np.array(runs, np.int64))
            found.append(np.unique(own[at]))
        row = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]), pa.int64())
        run = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), run], ["host", "article", "run"])


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of undecided pages' streams: key, position, run."""
    for batch in sliced(batches):
        keys, positions, runs = [], [], []
        for key, stream in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            got = shingles(_stream_hashes(stream), MIN_RUN)
            keys.append(np.full(len(got), key, np.int64))
            positions.append(np.arange(len(got), dtype=np.int32))
            runs.append(got.view(np.int64))
        host = np.repeat(np.arange(batch.num_rows), [len(r) for r in runs])
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cat(keys, np.int64), pa.int64()), batch.column(1).take(pa.array(host, pa.int64())), pa.array(cat(positions, np.int32), pa.int32()), pa.array(cat(runs, np.int64), pa.int64())],
            ["_key", "host", "position", "run"],
        )


def unique_blocks(blocks: list[str], starts: list[int], hits: list[int] | None, min_covered: float) -> list[str]:
    """Blocks of which repeated runs, beginning at ``hits``, cover less than the share."""
    if not hits:
        return blocks
    sizes = [len(b.split(" ")) for b in blocks]
    edges = np.zeros(max(max(hits) + MIN_RUN, max(s + n for s, n in zip(starts, sizes))) + 1, np.int64)
    np.add.at(edges, np.array(hits), 1)
    np.add.at(edges, np.array(hits) + MIN_RUN, -1)
    covered = np.cumsum(edges) > 0
    return [b for b, s, n in zip(blocks, starts, sizes) if covered[s : s + n].sum() < min_covered * n]


def _decide(n_kept: int, names: list[str], min_covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns[n_kept:]))
            text = ["\n\n".join(unique_blocks(blocks, starts, hits, min_covered)) for blocks, starts, hits in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(text, pa.string())], names)

    return run


def unique_article(text: str, runs: list[int], min_covered: float) -> str:
    """An article without the blocks that ``runs`` cover; one that they cover as a whole is a copy and stays."""
    blocks = text.split("\n\n")
    sizes = [len(b.split(" ")) for b in blocks]
    _, hits = _hits(text, np.array(runs, np.int64))
    covered = np.unique((hits[:, None] + np.arange(MIN_RUN)).ravel())
    if len(covered) >= min_covered * sum(sizes):
        return text
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return "\n\n".join(unique_blocks(blocks, starts, hits.tolist(), min_covered))


def _strip(names: list[str], min_covered: float):
    """Arrow function: the columns before the text, and the text without the runs that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns[-2:]))
            text = [unique_article(t, runs, min_covered) if t and runs else t for t, runs in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(text, pa.string())], names)

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_covered: float = 0.5) -> DataFrame:
    """Every row of ``pages`` without its html, with ``text`` (string) and ``n_chars`` (long).

    Blocks are joined by two line feeds; character references are decoded and white
    space inside a block is one space. A page without main text, a null and an empty
    html give an empty text. Columns of the added names are replaced. Rows of the
    same id count as one page when repeats are sought; pages without a host are
    compared with each other.
    """
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != html_col]
    # Equal rows get equal keys and equal decisions.
    host, _ = url_parts(F.col(url_col))
    keyed = pages.select(*kept, host.alias("_host"), F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("_key"), html_col)
    fields = [T.StructField("text", T.StringType()), T.StructField("_open", T.ArrayType(T.StringType())), T.StructField("stream", T.StringType()), T.StructField("_starts", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*keyed.drop(html_col).schema.fields, *fields])
    parsed = keyed.mapInArrow(_parse(schema.names, keyed.columns.index(html_col)), schema)

    # All but the articles is small: written once, it serves the search for repeats.
    sized = parsed.withColumns({"_article": F.when(F.col("text") != "", F.xxhash64("text")), "_size": F.length("stream") + F.coalesce(F.length("text"), F.lit(0))})
    outside = materialize(sized.drop("text"))
    open_pages = outside.where(F.size("_open") > 0)
    most = F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum("_size") / SHARD_CHARS))
    half = F.greatest(F.lit(MIN_ARTICLES), F.ceil(F.count_distinct("_article") / 2))
    hosts = outside.groupBy(F.col("_host").alias("host")).agg(most.alias("_shards"), half.alias("half"))
    hosts = materialize(hosts.withColumn("least", F.ceil(F.col("half") / F.col("_shards"))))
    streams = outside.where(F.col("stream") != "").select(F.col("_host").alias("host"), F.col(id_col).cast("string").alias("page"), "stream", F.lit(False).alias("article"))
    # Where no page is undecided, repeats outside articles have nothing to decide.
    needed = open_pages.select(F.col("_host").alias("host")).distinct()
    streams = streams.join(needed, "host", "left_semi")
    articles = parsed.where(F.col("text") != "").select(F.col("_host").alias("host"), F.xxhash64("text").alias("article"), "text")
    whole = articles.select("host", F.col("article").cast("string").alias("page"), F.col("text").alias("stream"), F.lit(True).alias("article"))
    streams = streams.union(whole).join(hosts, "host")
    shard = F.pmod(F.xxhash64("page"), F.col("_shards")).alias("shard")
    dealt = streams.select("host", shard, "page", "stream", "article", "least").groupBy("host", "shard")
    runs = materialize(dealt.applyInArrow(_shard_runs, "host string, run long, pages long, articles long"))

    # The few runs that may stand in half of a host's articles are counted over all of them.
    often = materialize(runs.where("articles > 0").groupBy("host").agg(F.collect_set("run").alias("_runs")))
    held = articles.join(often, "host").select("host", "article", "text", "_runs").mapInArrow(_held, "host string, article long, run long")
    held = held.distinct().groupBy("host", "run").agg(F.count("*").alias("n")).join(hosts, "host").where(F.col("n") >= F.col("half"))
    furniture = often if often.isEmpty() else materialize(held.groupBy("host").agg(F.collect_list("run").alias("_runs")))

    repeated = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= 2).select("host", "run")
    own = open_pages.select("_key", F.col("_host").alias("host"), "stream").distinct()
    own = own.mapInArrow(_cover, "_key long, host string, position int, run long")
    hits = own.join(repeated, ["host", "run"], "left_semi").groupBy("_key").agg(F.collect_set("position").alias("_hits"))

    decided = open_pages.join(hits, "_key", "left").select(*kept, "_open", "_starts", "_hits")
    out_schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType())])
    decided = decided.mapInArrow(_decide(len(kept), out_schema.names, min_covered), out_schema)
    closed = parsed.where(F.size("_open") == 0)
    if not furniture.isEmpty():
        closed = closed.join(furniture.withColumnRenamed("host", "_host"), "_host", "left").select(*kept, "text", "_runs").mapInArrow(_strip(out_schema.names, min_covered), out_schema)
    out = closed.select(*kept, "text").unionByName(decided)
    return out.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
