"""Images of a corpus: where they are used and what is known about them."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.values import (
    decode_default,
    decode_identity,
    estimated_bytes,
    sample_verdict,
)
from quire.operators.graph import Levels, SpreadEdges
from quire.operators.objects import OBJ
from quire.operators.scan import DEFAULT_SKEW, Skew, row_numbers, scan_groups
from quire.session import materialize

FIRST_PAGES = 16
MAX_WALK_USES = 4_000_000


# --- index -------------------------------------------------------------------


def image_index(uses: DataFrame, first_pages: int = FIRST_PAGES) -> DataFrame:
    """``doc_id, obj_id, first_page, page_count, first_pages`` per image.

    ``uses`` has ``doc_id, obj_id, page_num`` and may repeat. Counting runs on
    deduplicated uses with map-side partial counts; the first pages come from a
    row-number filter that is applied per partition before the shuffle. An image
    on a third of all pages so never gathers its pages in one place.
    """
    once = uses.select("doc_id", "obj_id", "page_num").distinct()
    counts = once.groupBy(*OBJ).agg(
        F.min("page_num").alias("first_page"), F.count(F.lit(1)).alias("page_count")
    )
    rank = F.row_number().over(Window.partitionBy(*OBJ).orderBy("page_num"))
    first = (
        once.withColumn("_rn", rank)
        .where(F.col("_rn") <= first_pages)
        .groupBy(*OBJ)
        .agg(F.array_sort(F.collect_list("page_num")).alias("first_pages"))
    )
    return counts.join(first, OBJ)


def image_pages(uses: DataFrame, images: DataFrame) -> DataFrame:
    """Every page of the listed images, flat; order by ``page_num``."""
    return uses.join(images.select(*OBJ).distinct(), OBJ, "left_semi").select(*OBJ, "page_num").distinct()


def images_by_page(
    uses: DataFrame, incomplete: DataFrame | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """``doc_id, page_num, position, obj_id, path, incomplete`` in walk order.

    An image counts once per page, with its first path. A page without images is
    listed only when its walk is incomplete; its ``position`` is 0.
    """
    page = ["doc_id", "page_num"]
    once = uses.groupBy(*page, "obj_id").agg(
        F.min_by("path", "ord").alias("path"), F.min("ord").alias("_ord")
    )
    placed = row_numbers(once, page, ["_ord", "obj_id"], "position", skew).drop("_ord")
    if incomplete is None:
        return placed.withColumn("incomplete", F.lit(False))
    marks = incomplete.select(*page, F.lit(True).alias("_bad")).distinct()
    joined = placed.join(marks, page, "full_outer")
    return joined.select(
        *page, F.coalesce("position", F.lit(0)).alias("position"), "obj_id", "path",
        F.coalesce("_bad", F.lit(False)).alias("incomplete"),
    )


# --- page ranges -------------------------------------------------------------


def page_islands(df: DataFrame, keys: list[str], num: str = "page_num", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``keys, low, high``: runs of consecutive numbers."""
    once = df.select(*keys, F.col(num).cast("bigint").alias("_n")).distinct()
    numbered = row_numbers(once, keys, ["_n"], "_rn", skew)
    return (
        numbered.groupBy(*keys, (F.col("_n") - F.col("_rn")).alias("_run"))
        .agg(F.min("_n").alias("low"), F.max("_n").alias("high"))
        .drop("_run")
    )


def page_ranges(df: DataFrame, keys: list[str], num: str = "page_num", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """``keys, ranges``: "1-3, 5". Only runs, not pages, meet in one row."""
    one = F.col("low").cast("string")
    text = F.when(F.col("low") == F.col("high"), one).otherwise(F.concat_ws("-", one, F.col("high").cast("string")))
    runs = page_islands(df, keys, num, skew).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("low", text.alias("text")))).alias("_runs"),
        F.min("low").alias("_low"),
        F.max("high").alias("_high"),
    )
    return runs.select(
        *keys,
        F.array_join(F.transform("_runs", lambda r: r["text"]), ", ").alias("ranges"),
        (F.col("_low") == F.col("_high")).alias("single"),
    )


def issue_rollup(issues: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """One row per failing object naming every page it cut short.

    ``issues`` has ``doc_id, issue_key, page_num, prefix, suffix``.
    """
    keys = ["doc_id", "issue_key"]
    texts = issues.groupBy(*keys).agg(
        F.min_by(F.struct("prefix", "suffix"), "page_num").alias("_t"), F.min("page_num").alias("first_page")
    )
    ranges = page_ranges(issues, keys, "page_num", skew)
    pages = F.when(F.col("single"), F.concat(F.lit("page "), "ranges")).otherwise(F.concat(F.lit("pages "), "ranges"))
    return texts.join(ranges, keys).select(
        *keys, "first_page", F.concat(F.col("_t.prefix"), pages, F.col("_t.suffix")).alias("error")
    )


# --- the walk from pages to images -------------------------------------------


def _alike(pages: DataFrame, forms: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, res_id, start_id``: the least of the pages' resources that hold the same entries.

    Entries are compared by their number and two sums of 64-bit hashes. Resources that a
    form entry leads to stand for themselves: a walk from others may come back to them.
    """
    starts = pages.select("doc_id", "res_id").where("doc_id IS NOT NULL AND res_id IS NOT NULL").distinct()
    led_to = forms.select("doc_id", F.col("obj_id").alias("res_id")).distinct().withColumn("_own", F.col("res_id"))
    fields = ["name", "obj_id", "subtype"]
    told = [x for c in fields for x in (F.col(c), F.col(c).isNull())]
    entries = forms.select("doc_id", F.col("owner_id").alias("res_id"), *fields).unionByName(
        images.select("doc_id", F.col("owner_id").alias("res_id"), *fields))
    mark = [F.sum(F.xxhash64(F.lit(n), *told).cast("decimal(38,0)")).alias(f"_s{n}") for n in (1, 2)]
    marks = entries.groupBy("doc_id", "res_id").agg(F.count(F.lit(1)).alias("_n"), *mark)
    held = starts.join(marks, ["doc_id", "res_id"], "left").join(led_to, ["doc_id", "res_id"], "left")
    group = ["doc_id", "_n", "_s1", "_s2", "_own"]
    held = materialize(held.select("res_id", *group))
    least = held.groupBy(*group).agg(F.min("res_id").alias("start_id")).toDF(*[f"{c}_" for c in group], "start_id")
    return materialize(held.join(least, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group])).select("doc_id", "res_id", "start_id"))


def image_uses(
    pages: DataFrame, xobjects: DataFrame, max_depth: int | None = None, by_page: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Images each page reaches, and the forms nested below ``max_depth``, if it is given.

    ``pages`` has ``doc_id, page_num, res_id``: the page's effective resources.
    ``xobjects`` has ``doc_id, owner_id, name, obj_id, subtype``: the entries of
    each resources dictionary or of each form's own resources, owned by that
    ``res_id`` or form.

    Resources shared by many pages are walked once, and so are dictionaries of the same
    entries (see :func:`_alike`): the closure runs over distinct ones and is joined to
    the pages at the end. In a closure a cycle adds nothing, so it needs no guard. A
    form counts by its least depth.

    Returns ``uses(doc_id, page_num, obj_id, path)`` and
    ``issues(doc_id, page_num, obj_id, error)``. Every page has a use for every image it
    reaches; without ``by_page`` the pages of the same entries are one row each instead:
    ``uses(doc_id, res_id, n_pages, obj_id, path)`` with the least ``res_id`` of them.
    """
    forms = xobjects.where("subtype = 'Form'")
    images = xobjects.where("subtype = 'Image'")
    spread = SpreadEdges(
        forms.select("doc_id", F.col("owner_id").alias("src_id"), F.col("obj_id").alias("dst_id"), "name"),
        extra=["name"],
    )
    alike = _alike(pages, forms, images)
    # One row per (starting resources, form): its first path at its least depth.
    frontier = materialize(
        alike.select("doc_id", "start_id").distinct().select(
            "doc_id", "start_id", F.col("start_id").alias("obj_id"),
            F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"),
        )
    )
    owners = Levels(frontier)
    key = ["doc_id", "start_id", "obj_id"]
    deep = None
    for depth in itertools.count(1):
        found = (
            spread.step(frontier.select(*key, "path"))
            .groupBy("doc_id", "start_id", F.col("dst_id").alias("obj_id"))
            .agg(F.min(F.array_append("path", F.col("name"))).alias("path"))
            .join(owners.all().select(*key), key, "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = materialize(found)
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            deep = frontier
            break
        owners.add(frontier)
    reached = owners.all()
    direct = (
        images.select("doc_id", F.col("owner_id").alias("_owner"), F.col("obj_id").alias("image_id"), "name")
        .join(reached.withColumnRenamed("obj_id", "_owner"), ["doc_id", "_owner"])
        .groupBy("doc_id", "start_id", "image_id")
        .agg(F.min(F.array_append("path", F.col("name"))).alias("path"))
    )
    # A shared dictionary is expanded to its pages only here.
    on_pages = pages.select("doc_id", "page_num", "res_id").join(alike, ["doc_id", "res_id"]).drop("res_id")
    if by_page:
        uses = direct.join(on_pages, ["doc_id", "start_id"]).select(
            "doc_id", "page_num", F.col("image_id").alias("obj_id"), "path"
        )
    else:
        counted = on_pages.groupBy("doc_id", "start_id").agg(F.count(F.lit(1)).alias("n_pages"))
        uses = direct.join(counted, ["doc_id", "start_id"]).select(
            "doc_id", F.col("start_id").alias("res_id"), "n_pages", F.col("image_id").alias("obj_id"), "path"
        )
    if deep is None:
        deep = frontier.limit(0)
    issues = deep.join(on_pages, ["doc_id", "start_id"]).select(
        "doc_id",
        "page_num",
        "obj_id",
        F.concat(
            F.lit(f"Form XObject nesting deeper than {max_depth} at "), F.col("obj_id"), F.lit(" on page "),
            F.col("page_num").cast("string"), F.lit("; deeper forms were not walked"),
        ).alias("error"),
    )
    return uses, issues


def walk_budget(uses: DataFrame, limit: int = MAX_WALK_USES, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Documents over the budget of image uses: ``doc_id, page_num, error``.

    The page is the one at which the running number of uses passes the limit.
    """
    per_page = uses.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("_n"))
    totals = scan_groups(
        per_page, ["doc_id"],
        lambda rows, scan: scan.running(
            rows, ["doc_id"], ["page_num"], skew.chunk(F.col("page_num")), _used=("sum", F.col("_n"))
        ),
        skew,
    )
    return (
        totals.where(F.col("_used") > limit)
        .groupBy("doc_id")
        .agg(F.min("page_num").alias("page_num"))
        .select(
            "doc_id", "page_num",
            F.format_string(f"image walk stopped at the limit of {limit} image uses at page %d", "page_num").alias("error"),
        )
    )


# --- facts -------------------------------------------------------------------


def image_facts(images: DataFrame) -> DataFrame:
    """Facts of each image from its dictionary values.

    ``images`` has ``doc_id, obj_id, width, height, bits, color_space,
    components, image_mask, smask_id, decode (array<double>), decode_rejected,
    lab_range (array<double>), marker``. Absent bits read as 8.

    It may have ``filters (array<string>), has_smask, transform, failed
    (array<string>)`` too: the filters in order, whether a soft mask is there at all,
    the marker's transform, and what could not be read. ``smask`` is null without a
    soft mask and empty if it is no reference; ``decode`` null where it was rejected.
    """
    absent = {"filters": "array<string>", "has_smask": "boolean", "transform": "int", "failed": "array<string>"}
    images = images.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in images.columns})
    mask = F.coalesce("image_mask", F.lit(False))
    bits = F.coalesce("bits", F.lit(8))
    size_bits = F.when(mask, F.lit(1)).otherwise(bits)
    size_components = (
        F.when(mask | (F.col("color_space") == "Indexed"), F.lit(1))
        .when(F.coalesce("components", F.lit(0)) <= 0, F.lit(0))
        .otherwise(F.col("components"))
    )
    has_decode = F.coalesce(F.size("decode") > 0, F.lit(False)) & F.col("decode").isNotNull()
    pairs_of = F.when(mask, F.lit(1)).otherwise(F.coalesce("components", F.lit(0)))
    pairs = F.when(pairs_of > 0, pairs_of).otherwise(F.floor(F.size("decode") / 2).cast("int"))
    indexed_or_lab = ~mask & F.coalesce(F.col("color_space").isin("Indexed", "Lab"), F.lit(False))
    non_default = F.when(
        has_decode,
        F.when(indexed_or_lab, ~decode_default(F.col("color_space"), bits, F.col("decode"), F.col("lab_range")))
        .otherwise(~decode_identity(F.col("decode"), pairs)),
    ).otherwise(F.lit(False)) | F.coalesce("decode_rejected", F.lit(False))
    return images.select(
        *OBJ,
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        bits.alias("bits"),
        F.coalesce("color_space", F.lit("")).alias("color_space"),
        mask.alias("image_mask"),
        "smask_id",
        non_default.alias("decode_non_default"),
        estimated_bytes(F.col("width"), F.col("height"), size_bits, size_components).alias("estimated_bytes"),
        sample_verdict(
            F.col("color_space"), mask, F.col("components"), F.col("decode"), F.col("decode_rejected"), F.col("marker")
        ).alias("verdict"),
        F.coalesce("filters", F.array().cast("array<string>")).alias("filters"),
        F.when(F.coalesce("has_smask", F.lit(False)) | F.col("smask_id").isNotNull(), F.coalesce("smask_id", F.lit(""))).alias("smask"),
        F.when(~F.coalesce("decode_rejected", F.lit(False)), F.col("decode")).alias("decode"),
        "marker",
        F.when(F.col("marker") == "present", F.col("transform")).alias("transform"),
        F.concat_ws(
            "; ", F.coalesce("failed", F.array().cast("array<string>")),
            F.when(F.coalesce("decode_rejected", F.lit(False)), F.lit("decode array metadata: rejected"))).alias("warning"),
    )


def image_rows(uses: DataFrame, facts: DataFrame, pages: DataFrame, issues: DataFrame, first_pages: int = FIRST_PAGES) -> DataFrame:
    """The image list: one row an image with its uses and facts, then one a failing object.

    ``uses`` as for :func:`image_index`, ``facts`` from :func:`image_facts`, ``pages`` has
    ``doc_id, page_num, page_id`` (null for a page that is no object of its own),
    ``issues`` has ``doc_id, obj_id, error``, one row an object. ``first_page_nodes``
    names the first pages in their order, '' for a page without a reference. An error
    row has no node and zero counts. ``place`` sorts a document's rows: images by first
    page, errors last.
    """
    index = image_index(uses, first_pages)
    # At most ``first_pages`` rows an image.
    opened = index.select(*OBJ, F.explode("first_pages").alias("page_num")).join(pages, ["doc_id", "page_num"], "left")
    nodes = opened.groupBy(*OBJ).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("page_id", F.lit("")).alias("n")))), lambda x: x["n"]).alias("first_page_nodes"))
    rows = index.join(nodes, OBJ).join(facts, OBJ, "left").select(
        "*", F.col("obj_id").alias("node_id"), F.lit("").alias("error"), F.struct(F.lit(0).alias("k"), F.col("first_page").alias("p"), "obj_id").alias("place"))
    zero = F.lit(0).cast("bigint")
    bad = issues.select(
        *OBJ, F.lit("").alias("node_id"), "error", zero.alias("first_page"), zero.alias("page_count"),
        F.array().cast("array<bigint>").alias("first_pages"), F.array().cast("array<string>").alias("first_page_nodes"),
        F.struct(F.lit(1).alias("k"), zero.alias("p"), "obj_id").alias("place"))
    return rows.unionByName(bad, allowMissingColumns=True)

