"""Structure trees: number trees, elements, and their alignment with content."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import NODE, Levels, NodeReader, first_sight, lookup_left
from quire.operators.scan import DEFAULT_SKEW, Skew, row_numbers, scan_groups
from quire.session import BucketedTable, materialize

PAGE = ["doc_id", "page_num"]
LOCATIONS_PER_PART = 1000
# Text entries of an element and their columns, in the order of their messages.
TEXT_FIELDS = {"Alt": "alt", "ActualText": "actual_text", "E": "expansion", "T": "title", "Lang": "lang"}

# Messages of the structure reader.
ROOT_MCID = "MCID directly under the structure tree root, with no element to own it; not aligned"
NO_PAGE = (
    "no page: the nearest /Pg (on the kid, its element or an ancestor) is absent or not a page; "
    "MCID not attributed to a page"
)
ARRAY_NOTE = "array value no page's /StructParents names; may belong to a Form XObject's /StructParents"

def _no_path() -> Column:
    return F.array().cast("array<string>")


def behind(c: Column, part: str = "type") -> Column:
    """A part (type, raw, value) of an entry read with ``resolve``, followed through a reference."""
    missing = F.lit("null") if part == "type" else F.lit(None).cast("string")
    there = F.coalesce(c[f"target_{part}"], missing)
    return F.when(c["ref_id"].isNotNull(), there).otherwise(c["value_type" if part == "type" else "value_raw" if part == "raw" else "value"])


def kind_of(value_type: Column, raw: Column) -> Column:
    """Wording of a value's kind in messages; ``raw`` tells integers from reals."""
    whole = F.coalesce(raw.rlike(r"^[+-]?\d+$"), F.lit(False))
    return (
        F.when(value_type.isNull() | (value_type == "null"), "null")
        .when(value_type == "dict", "a dictionary")
        .when(value_type == "array", "an array")
        .when(value_type == "stream", "a stream")
        .when(value_type == "number", F.when(whole, "an integer").otherwise("a real"))
        .otherwise(F.concat(F.lit("a "), value_type))
    )


def _integer(value_type: Column, raw: Column) -> Column:
    return F.when((value_type == "number") & raw.rlike(r"^[+-]?\d+$"), raw.try_cast("bigint"))


# --- number trees ------------------------------------------------------------

_AFTER_KIDS = 1 << 60


def number_tree(
    entries: DataFrame, roots: DataFrame, skew: Skew = DEFAULT_SKEW, max_depth: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read the number tree below each root (``doc_id, obj_id``), to ``max_depth`` levels if it is given.

    Returns ``values(doc_id, key, node, value_type, ref_id)`` with the first value
    of each key, ``problems(doc_id, node, message, ord)``, and
    ``incomplete(doc_id, message)``: the first problem that lost entries.

    ``ord`` sorts problems in reading order. A node reached twice is walked where a
    depth-first reader meets it first.
    """
    reader = NodeReader(entries)
    problems: list[DataFrame] = []

    def note(rows: DataFrame, message: Column, lost: bool, *suffix: Column) -> None:
        tail = [F.lit(-1).cast("bigint")] if not suffix else list(suffix)
        problems.append(
            rows.select(
                "doc_id", "node", message.alias("message"), F.lit(lost).alias("lost"),
                F.concat("ord", F.array(*tail)).alias("ord"),
            ).where("message IS NOT NULL")
        )

    is_ref = F.col("ref_id").isNotNull()
    shown = F.coalesce("target_type", "value_type")
    bad = F.when(
        is_ref & (F.col("target_type").isNull() | (F.col("target_type") == "null")), F.lit("node does not resolve to an object")
    ).when(~shown.isin("dict", "stream"), F.format_string("node is %s, not a dictionary", kind_of(shown, F.coalesce("target_raw", "value_raw"))))
    links = reader.array("Kids").all().where(bad.isNull()).select(
        *NODE, F.col("item_obj").alias("to_obj_id"), F.col("item_at").alias("to_at"), F.array("idx").alias("step"))
    starts = roots.select("doc_id", "obj_id", _no_path().alias("at"), F.array().cast("array<bigint>").alias("label"))
    met = first_sight(links, starts, ["obj_id", "at"], max_steps=None if max_depth is None else max_depth - 1)
    every = BucketedTable.write(
        met.select(
            *NODE, F.when(F.size("at") == 0, F.col("obj_id")).otherwise("(direct)").alias("node"), F.col("label").alias("ord"),
            (F.size("label") == 0).alias("is_root")),
        NODE, laid=True).df
    first = every.select("doc_id", F.col("obj_id").alias("item_obj"), F.col("at").alias("item_at"), F.col("ord").alias("_first"))
    kids = reader.items(every.select(*NODE, "ord"), "Kids", resolve=True).withColumns(
        {"node": F.coalesce("ref_id", F.lit("(direct)")), "ord": F.array_append("ord", F.col("idx"))})
    kids = materialize(kids.join(first, ["doc_id", "item_obj", "item_at"], "left"))
    deep = F.lit(False) if max_depth is None else F.size("ord") >= max_depth
    note(kids.where(deep), F.lit(f"number tree deeper than {max_depth} levels; node not walked"), True)
    note(kids.where(~deep), bad, True)
    again = is_ref & bad.isNull() & (F.col("ord") != F.col("_first"))
    note(kids.where(~deep), F.when(again, F.lit("node reached twice; not walked again")), False)

    held = materialize(reader.keys(every, ["Kids", "Nums", "Limits"]))
    note(held, F.when(F.col("Kids").isNull() & F.col("Nums").isNull(), F.lit("node has neither /Kids nor /Nums")), True)
    for key, place in (("Kids", -1), ("Nums", _AFTER_KIDS)):
        ref = held.select(
            "doc_id", "node", "ord", F.col(key)["ref_id"].alias("ref_id"), F.col(key)["value_type"].alias("_vt"), F.col(key)["value_raw"].alias("_vr"))
        seen_type = reader.resolved(ref.where("_vt IS NOT NULL"))
        shown = F.when(F.col("ref_id").isNotNull(), F.col("target_type")).otherwise(F.col("_vt"))
        wrong = F.when(
            ~F.coalesce(shown == "array", F.lit(False)),
            F.concat(F.lit(f"/{key} is "), kind_of(shown, F.when(F.col("ref_id").isNotNull(), F.col("target_raw")).otherwise(F.col("_vr"))), F.lit(", not an array")),
        )
        note(seen_type, wrong, True, F.lit(place).cast("bigint"))

    limits = reader.items(held.where("NOT is_root").select(*NODE, "node", "ord"), "Limits", resolve=True)
    limits = limits.groupBy("doc_id", "node", "ord").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("idx") == 0, _integer(F.coalesce("target_type", "value_type"), F.coalesce("target_raw", "value_raw")))).alias("lo"),
        F.max(F.when(F.col("idx") == 1, _integer(F.coalesce("target_type", "value_type"), F.coalesce("target_raw", "value_raw")))).alias("hi"),
    )
    bounded = materialize(held.where("NOT is_root").join(limits, ["doc_id", "node", "ord"], "left"))
    two = F.coalesce((F.col("_n") == 2) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.lit(False))
    note(
        bounded,
        F.when(F.col("Limits").isNull(), F.lit("non-root node has no /Limits"))
        .when(~two, F.lit("/Limits is not an array of two integers"))
        .when(F.col("lo") > F.col("hi"), F.format_string("/Limits [%d %d] is not ascending", "lo", "hi")),
        False,
    )
    good = bounded.where(two & (F.col("lo") <= F.col("hi"))).select("doc_id", "node", "ord", "lo", "hi")

    elements = reader.items(held.select(*NODE, "node", "ord"), "Nums", resolve=True).select(
        "doc_id", "node", "ord", "idx",
        F.coalesce("target_type", "value_type").alias("vt"), F.coalesce("target_raw", "value_raw").alias("raw"),
        "ref_id", F.col("value_type").alias("own_type"),
    )
    elements = materialize(elements)
    sizes = elements.groupBy("doc_id", "node", "ord").agg(F.count(F.lit(1)).alias("_n"))
    after = F.lit(_AFTER_KIDS).cast("bigint")
    note(
        sizes,
        F.when(F.col("_n") % 2 == 1, F.format_string("/Nums has odd length %d; the last entry has no value", "_n")),
        True, after, F.lit(-1).cast("bigint"),
    )
    pair = F.floor(F.col("idx") / 2)
    pairs = elements.groupBy("doc_id", "node", "ord", pair.alias("pair")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.struct("vt", "raw"))).alias("k"),
        F.max(F.when(F.col("idx") % 2 == 1, F.struct("own_type", "ref_id"))).alias("v"),
    ).where("v IS NOT NULL").withColumn("key", _integer(F.col("k")["vt"], F.col("k")["raw"]))
    at = F.col("pair").cast("bigint")
    note(
        pairs,
        F.when(
            F.col("key").isNull(),
            F.format_string("/Nums entry %d: key is %s, not an integer", F.col("pair") * 2, kind_of(F.col("k")["vt"], F.col("k")["raw"])),
        ),
        True, after, at,
    )
    keyed = pairs.where("key IS NOT NULL")
    note(
        keyed.join(good, ["doc_id", "node", "ord"]),
        F.when(
            ~F.col("key").between(F.col("lo"), F.col("hi")),
            F.format_string("key %d outside /Limits [%d %d]", "key", "lo", "hi"),
        ),
        False, after, at, F.lit(0).cast("bigint"),
    )
    checked = materialize(key_order_check(keyed, skew))
    note(
        checked,
        F.when(
            F.col("key") < F.col("prev_key"),
            F.format_string("key %d after key %d: keys not in ascending order", "key", "prev_key"),
        ),
        False, after, at, F.lit(1).cast("bigint"),
    )
    placed = checked.withColumn("_at", F.concat("ord", F.array(after, at)))
    firsts = placed.groupBy("doc_id", "key").agg(
        F.min_by(F.struct("node", F.col("v")["own_type"].alias("value_type"), F.col("v")["ref_id"].alias("ref_id")), "_at").alias("f"),
        F.min("_at").alias("_first"),
    )
    firsts = materialize(firsts)
    note(
        placed.join(firsts, ["doc_id", "key"]),
        F.when(
            F.col("_at") != F.col("_first"),
            F.format_string("key %d already in node %s; first value kept", "key", F.col("f.node")),
        ),
        False, after, at, F.lit(2).cast("bigint"),
    )
    found = materialize(reduce(DataFrame.unionByName, problems))
    incomplete = found.where("lost").groupBy("doc_id").agg(F.min_by("message", "ord").alias("message"))
    return firsts.select("doc_id", "key", "f.*"), found, incomplete


def key_order_check(pairs: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Adds ``prev_key``, the integer key before this one in its leaf.

    ``pairs`` has ``doc_id, node, ord, pair, key``. A lower key is out of order;
    an equal one is a duplicate instead.
    """
    keys = ["doc_id", "node", "ord"]
    return scan_groups(
        pairs, keys,
        lambda rows, scan: scan.running(rows, keys, ["pair"], skew.chunk(F.col("pair")), prev_key=("last", F.col("key"), True)),
        skew,
    )


# --- role maps ---------------------------------------------------------------


def map_role(roles: DataFrame) -> DataFrame:
    """Follow each role to a name without a mapping: ``doc_id, role, mapped, error``.

    ``roles`` has ``doc_id, role, target``. A cycle or an empty target gives no
    mapping and a message. Chains are followed one link per step.
    """
    links = materialize(roles.select("doc_id", F.col("role").alias("cur"), F.col("target").alias("_next")).repartition("doc_id", "cur"))
    current = materialize(
        roles.select("doc_id", "role", F.col("role").alias("cur"), F.array("role").alias("path"))
    )
    done: Levels | None = None
    while not current.isEmpty():
        step = current.join(links, ["doc_id", "cur"], "left")
        nxt = F.col("_next")
        cyclic = F.array_contains("path", nxt)
        error = F.when(nxt == "", F.format_string("/RoleMap maps /%s to an empty name", "cur")).when(
            cyclic, F.concat(F.lit("/RoleMap cycle: "), F.array_join(F.array_append("path", nxt), " -> "))
        )
        step = materialize(step.withColumn("error", error))
        ends = step.where("error IS NOT NULL OR _next IS NULL").select(
            "doc_id", "role",
            F.when(F.col("error").isNull() & (F.col("cur") != F.col("role")), F.col("cur")).otherwise("").alias("mapped"),
            "error",
        )
        if done is None:
            done = Levels(ends)
        else:
            done.add(ends)
        current = step.where("error IS NULL AND _next IS NOT NULL").select(
            "doc_id", "role", nxt.alias("cur"), F.array_append("path", nxt).alias("path")
        )
    return done.all() if done else roles.select("doc_id", "role", F.lit("").alias("mapped"), F.lit(None).cast("string").alias("error"))


# --- structure elements ------------------------------------------------------


def struct_tree(
    entries: DataFrame, roots: DataFrame, pages: DataFrame, roles: DataFrame | None = None, max_depth: int | None = None
) -> DataFrame:
    """Every kid of every structure element, flat.

    ``roots`` has ``doc_id, obj_id`` (structure tree roots), ``pages`` has
    ``doc_id, obj_id, page_num``, ``roles`` the output of :func:`map_role`.

    Rows: ``doc_id, owner_id, idx, kind, ref_id, element_id, s, mapped, page,
    page_inherited, mcid, alt, actual_text, expansion, title, lang, error, depth,
    ord``. Values behind references are followed. An indirect /K array that several
    elements name is listed once. ``owner_id`` is '' for the root.
    The page of a kid is its own /Pg, else that of the nearest ancestor. An
    element met twice is listed where a depth-first reader meets it first.
    """
    reader = NodeReader(entries)
    named = ["Type", "S", "Pg", "MCID", "Stm", "Obj", *TEXT_FIELDS]
    page_of = pages.select("doc_id", F.col("obj_id").alias("_pg"), F.col("page_num").alias("_pn"))
    own = lookup_left(reader.table(named, resolve=True).withColumn("_pg", F.col("Pg")["ref_id"]), page_of, ["doc_id", "_pg"])
    own = BucketedTable.write(own, NODE).df
    held = reader.table(["K"], resolve=True)
    listing, shared = _element_links(reader, held)
    met = _met_elements(listing, shared, own, roots, max_depth)
    kids = _kids(reader, held, shared, met)
    value = F.coalesce("target_type", "value_type")
    number = _integer(value, F.coalesce("target_raw", "value_raw"))
    kids = kids.join(own.withColumnsRenamed({"obj_id": "item_obj", "at": "item_at"}), ["doc_id", "item_obj", "item_at"], "left")
    first = met.select("doc_id", F.col("obj_id").alias("item_obj"), F.col("at").alias("item_at"), F.col("ord").alias("_first"))
    kids = kids.join(first, ["doc_id", "item_obj", "item_at"], "left")
    depth = F.size("ord") + 1
    type_name = F.when(behind(F.col("Type")) == "name", behind(F.col("Type"), "value"))
    has_pg = F.col("Pg").isNotNull()
    kind = (
        F.when(F.col("array_seen"), "error")
        .when(F.col("ref_id").isNotNull() & (F.col("target_type").isNull() | (F.col("target_type") == "null")), "error")
        .when(number >= 0, "mcid")
        .when(number < 0, "error")
        .when(value == "dict", F.when(type_name == "MCR", "mcr").when(type_name == "OBJR", "objr").otherwise("element"))
        .otherwise("error")
    )
    kids = kids.withColumns({"_value": value, "_number": number, "kind": kind})
    element_id = F.when(F.col("kind") == "element", F.coalesce("ref_id", F.lit("(direct)")))
    kids = kids.withColumns({"element_id": element_id, "ord": F.array_append("ord", F.col("idx")), "depth": depth})
    is_ref = (F.col("kind") == "element") & F.col("ref_id").isNotNull()
    too_deep = (F.col("kind") == "element") & (F.lit(False) if max_depth is None else F.col("depth") > max_depth)
    # An element is listed where a depth-first reader meets it first.
    again = is_ref & ~F.coalesce(F.col("_first") == F.col("ord"), F.lit(False)) & ~too_deep
    own_page = F.when(has_pg, F.coalesce("_pn", F.lit(0))).otherwise(F.col("page"))
    mcr_value = _integer(behind(F.col("MCID")), behind(F.col("MCID"), "raw"))
    no_stm = F.col("Stm").isNull()
    pg_error = F.when(
        has_pg & F.col("_pn").isNull(),
        F.when(F.col("_pg").isNull(), F.format_string("/Pg is %s, not a reference to a page", kind_of(F.col("Pg")["value_type"], F.col("Pg")["value_raw"])))
        .otherwise(F.format_string("/Pg %s is not a page in the page tree", "_pg")),
    )
    sv = F.col("S")
    s_type, s_name = behind(sv), F.when(behind(sv) == "name", behind(sv, "value"))
    s_error = F.when(sv.isNull() | (s_type == "null"), "no /S").when(
        s_type != "name", F.format_string("/S is %s, not a name", kind_of(s_type, behind(sv, "raw")))
    ).when(s_name == "", "/S is an empty name")
    type_error = F.when((type_name != "") & (type_name != "StructElem"), F.format_string("/Type /%s is not StructElem", type_name))
    text_errors = [
        F.when(
            F.col(k).isNotNull() & (behind(F.col(k)) != "string"),
            F.format_string(f"/{k} is %s that does not decode as a text string", kind_of(behind(F.col(k)), behind(F.col(k), "raw"))),
        )
        for k in TEXT_FIELDS
    ]
    texts = [
        F.when((F.col("kind") == "element") & F.col(k).isNotNull(), F.when(behind(F.col(k)) == "string", behind(F.col(k), "value")).otherwise("")).alias(a)
        for k, a in TEXT_FIELDS.items()
    ]
    error = (
        F.when(F.col("array_seen"), F.format_string("/K array %s already listed; not walked again", "ref_id"))
        .when(too_deep, F.lit(f"structure tree deeper than {max_depth} levels; subtree not walked"))
        .when(again, F.format_string("element %s already listed; not walked again", "ref_id"))
        .when(
            (F.col("kind") == "error") & F.col("ref_id").isNotNull() & F.col("target_type").isNull(),
            F.format_string("%s does not resolve to an object", "ref_id"),
        )
        .when(F.col("_number") < 0, F.format_string("MCID %d is negative", "_number"))
        .when(F.col("kind") == "error", F.format_string("kid is %s, not an element, MCID, MCR or OBJR", kind_of(F.col("_value"), F.coalesce("target_raw", "value_raw"))))
        .when((F.col("kind") == "mcid") & (F.col("owner_id") == ""), F.lit(ROOT_MCID))
        .when((F.col("kind") == "mcid") & (F.col("page") == 0), F.lit(NO_PAGE))
        .when(
            F.col("kind") == "mcr",
            F.concat_ws(
                "; ", pg_error,
                F.when(F.col("MCID").isNull(), F.lit("MCR has no /MCID"))
                .when(mcr_value.isNull(), F.format_string("MCR /MCID is %s, not an integer", kind_of(behind(F.col("MCID")), behind(F.col("MCID"), "raw"))))
                .when(mcr_value < 0, F.format_string("MCR /MCID %d is negative", mcr_value))
                .when(no_stm & (F.col("owner_id") == ""), F.lit(ROOT_MCID))
                .when(no_stm & (own_page == 0) & pg_error.isNull(), F.lit(NO_PAGE)),
            ),
        )
        .when(
            F.col("kind") == "objr",
            F.concat_ws(
                "; ", pg_error,
                F.when(F.col("Obj").isNull(), F.lit("OBJR has no /Obj"))
                .when(F.col("Obj")["ref_id"].isNull(), F.format_string("OBJR /Obj is %s, not a reference", kind_of(F.col("Obj")["value_type"], F.col("Obj")["value_raw"]))),
            ),
        )
        .when(F.col("kind") == "element", F.concat_ws("; ", s_error, type_error))
    )
    # What stands behind the role's message, which is known after the walk.
    late = F.when((F.col("kind") == "element") & ~again & ~too_deep, F.concat_ws("; ", pg_error, *text_errors))
    tree = kids.select(
        "doc_id", "owner_id", "idx",
        F.when(again | too_deep, "error").otherwise(F.col("kind")).alias("kind"),
        "ref_id", "element_id",
        F.when(F.col("kind") == "element", s_name).alias("s"),
        F.when(F.col("kind") == "mcid", F.col("page")).when(F.col("kind") != "error", own_page).otherwise(F.lit(0)).cast("bigint").alias("page"),
        (F.when(F.col("kind") == "mcid", F.col("page") != 0).otherwise(~has_pg & (F.col("page") != 0))).alias("page_inherited"),
        F.when(F.col("kind") == "mcid", F.col("_number")).when((F.col("kind") == "mcr") & (mcr_value >= 0), mcr_value).alias("mcid"),
        ((F.col("kind") == "mcid") | ((F.col("kind") == "mcr") & no_stm)).alias("claims"),
        *texts,
        F.nullif(error, F.lit("")).alias("error"), F.nullif(late, F.lit("")).alias("_late"),
        F.when((F.col("kind") == "element") & ~again, s_error).alias("s_error"),
        "depth", "ord",
    )
    tree = materialize(tree)
    joined = lambda *parts: F.nullif(F.concat_ws("; ", *parts), F.lit(""))
    if roles is None:
        return tree.withColumn("error", joined("error", "_late")).drop("_late").withColumn("mapped", F.lit("").cast("string"))
    mapped = roles.select("doc_id", F.col("role").alias("s"), "mapped", F.col("error").alias("_re"))
    return tree.join(mapped, ["doc_id", "s"], "left").select(
        *[c for c in tree.columns if c not in ("error", "_late")],
        joined("error", "_re", "_late").alias("error"),
        F.coalesce("mapped", F.lit("")).alias("mapped"),
    )


def _element_links(reader: NodeReader, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the walk can follow, as rows of source place, target place and ``step``; and the indirect arrays.

    An element has one /K. A step to an array is 0, to its element the position; a
    single value counts as the only element. So an indirect array is a place of its
    own, which the first element that names it lists.
    """
    k = F.col("K")
    is_list = F.coalesce(behind(k) == "array", F.lit(False))
    target = [F.col("item_obj").alias("to_obj_id"), F.col("item_at").alias("to_at")]
    shared = held.where(is_list & k["ref_id"].isNotNull()).select(*NODE, k["ref_id"].alias("array_id"))
    shared = BucketedTable.write(shared, NODE, laid=True).df
    single = held.where(~is_list).select(
        *NODE, F.coalesce(k["ref_id"], "obj_id").alias("to_obj_id"),
        F.when(k["ref_id"].isNull(), F.array_append("at", F.lit("K"))).otherwise(_no_path()).alias("to_at"),
        F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("step"), behind(k).alias("_vt"))
    items = reader.array("K").all().withColumn("_vt", F.coalesce("target_type", "value_type"))
    direct = items.join(shared.select(*NODE), NODE, "left_anti").select(*NODE, *target, F.array(F.lit(0).cast("bigint"), "idx").alias("step"), "_vt")
    # The elements of an indirect array hang below the array, whoever names it.
    one_owner = shared.groupBy("doc_id", "array_id").agg(F.min(F.struct("obj_id", "at")).alias("o")).select("doc_id", "o.*", "array_id")
    below = items.join(one_owner, NODE).select(
        "doc_id", F.col("array_id").alias("obj_id"), _no_path().alias("at"), *target, F.array("idx").alias("step"), "_vt")
    to_array = shared.select(
        *NODE, F.col("array_id").alias("to_obj_id"), _no_path().alias("to_at"), F.array(F.lit(0).cast("bigint")).alias("step"), F.lit("array").alias("_vt"))
    return single.unionByName(direct).unionByName(below).unionByName(to_array), shared


def _met_elements(links: DataFrame, shared: DataFrame, own: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """Elements and indirect arrays where they are met first: place, label, ord, and the page that reaches them."""
    type_name = F.when(behind(F.col("Type")) == "name", behind(F.col("Type"), "value"))
    other = F.coalesce(type_name.isin("MCR", "OBJR"), F.lit(False))
    to = own.select(
        "doc_id", F.col("obj_id").alias("to_obj_id"), F.col("at").alias("to_at"), other.alias("_other"),
        F.when(F.col("Pg").isNotNull(), F.coalesce("_pn", F.lit(0)).cast("bigint")).alias("own"))
    links = links.where("_vt IN ('dict', 'array')").join(to, ["doc_id", "to_obj_id", "to_at"], "left").where("_other IS NULL OR NOT _other")
    starts = roots.select(
        "doc_id", "obj_id", _no_path().alias("at"), F.array().cast("array<bigint>").alias("label"), F.lit(0).cast("bigint").alias("carried"))
    # An element is one or two steps from the one above it.
    met = first_sight(
        links.drop("_vt", "_other"), starts, ["obj_id", "at"], max_steps=None if max_depth is None else 2 * max_depth,
        carry=lambda page, own: F.coalesce(own, page))
    ord_of = F.filter("label", lambda x, i: i % 2 == 1)
    return BucketedTable.write(met.select(*NODE, "label", ord_of.alias("ord"), F.col("carried").alias("page")), NODE, laid=True).df


def _kids(reader: NodeReader, held: DataFrame, shared: DataFrame, met: DataFrame) -> DataFrame:
    """The /K of each element met as rows: one value, an array, or a reference to either.

    An element that names an indirect array which another one lists gets a single row
    with ``array_seen``.
    """
    arrays = met.join(shared.select("doc_id", F.col("array_id").alias("obj_id")).distinct(), ["doc_id", "obj_id"], "left_semi").where(F.size("at") == 0)
    owner = F.when(F.size("label") == 0, F.lit("")).when(F.size("at") == 0, F.col("obj_id")).otherwise("(direct)")
    owners = met.where(F.size("label") % 2 == 0).select(*NODE, "label", "ord", "page", owner.alias("owner_id"))
    listers = arrays.select("doc_id", F.col("obj_id").alias("array_id"), F.slice("label", F.lit(1), F.size("label") - 1).alias("_lister"))
    kept = ["owner_id", "page", "ord"]
    named = owners.join(shared, NODE, "left").join(listers, ["doc_id", "array_id"], "left").withColumn(
        "array_seen", F.col("array_id").isNotNull() & ~F.coalesce(F.col("_lister") == F.col("label"), F.lit(False)))
    named = BucketedTable.write(named.select(*NODE, *kept, "array_seen"), NODE).df
    k = named.join(held, NODE).select(*NODE, *kept, "array_seen", "K.*")
    is_list = F.coalesce("target_type", "value_type") == "array"
    fields = ["value_type", "value_raw", "ref_id", "target_type", "target_raw"]
    one = k.where("array_seen").unionByName(k.where(~is_list & (F.coalesce("value_type", F.lit("null")) != "null") & ~F.col("array_seen"))).select(
        "doc_id", *kept, F.lit(0).cast("bigint").alias("idx"), *fields,
        F.coalesce("ref_id", "obj_id").alias("item_obj"),
        F.when(F.col("ref_id").isNull(), F.array_append("at", F.lit("K"))).otherwise(_no_path()).alias("item_at"), "array_seen")
    many = reader.items(named.where("NOT array_seen").drop("array_seen"), "K", resolve=True).where("value_type <> 'null'").select(
        "doc_id", *kept, "idx", *fields, "item_obj", "item_at", F.lit(False).alias("array_seen"))
    return materialize(one.unionByName(many))


def claims(tree: DataFrame) -> DataFrame:
    """``doc_id, page_num, mcid, owner_id``: content the elements say is theirs."""
    return tree.where("claims AND mcid IS NOT NULL AND owner_id <> '' AND page > 0").select(
        "doc_id", F.col("page").alias("page_num"), "mcid", "owner_id")


def structure_counts(tree: DataFrame, content: DataFrame) -> DataFrame:
    """Elements, kids by kind and content MCIDs of each document."""
    kinds = tree.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "element").alias("elements"),
        F.count_if(F.col("kind") == "mcid").alias("mcid_kids"),
        F.count_if(F.col("kind") == "mcr").alias("mcr_kids"),
        F.count_if(F.col("kind") == "objr").alias("objr_kids"),
        F.count_if(F.col("kind") == "error").alias("error_kids"),
    )
    marks = content.groupBy("doc_id").agg(F.count_if(F.col("mcid") >= 0).alias("content_mcids"))
    return kinds.join(marks, "doc_id", "full_outer").na.fill(0)


# --- alignment ---------------------------------------------------------------


def page_parent_tree(
    pages: DataFrame, numtree: DataFrame, arrays: DataFrame, elements: DataFrame, trees: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Each page's parent-tree array: ``(errors, slots)``.

    ``pages`` has ``doc_id, page_num, key_type, key`` (``key_type`` NULL: no
    /StructParents); ``numtree`` has ``doc_id, key, value_type, array_id``;
    ``arrays`` has ``doc_id, array_id, mcid, value_type, ref_id``; ``elements``
    has ``doc_id, ref_id, target_type, s``; ``trees`` lists the documents with a
    parent tree.
    """
    asked = pages.where("key_type IS NOT NULL").join(
        trees.select("doc_id").distinct().withColumn("_tree", F.lit(True)), "doc_id", "left")
    found = asked.join(numtree.withColumnsRenamed({"value_type": "_vt", "value_raw": "_vr"}), ["doc_id", "key"], "left")
    error = (
        F.when((F.col("key_type") != "number") | F.col("key").isNull(), F.format_string("/StructParents is %s, not an integer", kind_of(F.col("key_type"), F.col("key_raw"))))
        .when(F.col("_tree").isNull(), F.format_string("/StructParents %d but the document has no ParentTree", "key"))
        .when(F.col("_vt").isNull(), F.format_string("ParentTree has no key %d", "key"))
        .when(F.col("_vt") != "array", F.format_string("ParentTree key %d is %s, not an array", "key", kind_of(F.col("_vt"), F.col("_vr"))))
    )
    errors = found.select(*PAGE, "key", error.alias("error")).where("error IS NOT NULL")
    slots = (
        found.where(error.isNull()).select(*PAGE, "key", "array_id")
        .join(arrays, ["doc_id", "array_id"])
        .join(elements, ["doc_id", "ref_id"], "left")
        .where("value_type <> 'null'")
        .select(*PAGE, "key", "mcid", *_element_ref())
    )
    return errors, slots


def _element_ref() -> list[Column]:
    error = (
        F.when(F.col("ref_id").isNull(), F.format_string("value is %s, not a reference to an element", kind_of(F.col("value_type"), F.col("value_raw"))))
        .when(F.col("target_type").isNull(), F.format_string("%s does not resolve to an object", "ref_id"))
        .when(F.col("target_type") != "dict", F.format_string("%s is %s, not an element", "ref_id", kind_of(F.col("target_type"), F.col("target_raw"))))
    )
    return [F.col("ref_id").alias("element"), F.col("s"), error.alias("error")]


def other_parent_tree(numtree: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Parent-tree keys no page names: ``doc_id, key, element, s, error, note``."""
    named = pages.where("key IS NOT NULL").select("doc_id", "key").distinct()
    rest = numtree.join(named, ["doc_id", "key"], "left_anti").join(elements, ["doc_id", "ref_id"], "left")
    is_array = F.col("value_type") == "array"
    element, s, error = _element_ref()
    return rest.select(
        "doc_id", "key",
        F.when(~is_array, F.col("ref_id")).alias("element"),
        F.when(~is_array, s).alias("s"),
        F.when(~is_array, error).alias("error"),
        F.when(is_array, F.lit(ARRAY_NOTE)).alias("note"),
    )


def align_mcids(content: DataFrame, slots: DataFrame, claimed: DataFrame) -> DataFrame:
    """Per ``(doc, page, mcid)``: content count, slot element, claims, consistent.

    ``content`` has ``mcid``; ``slots`` has ``mcid, element, error``; ``claimed``
    has ``mcid, owner_id``. Each side is reduced to one row per key before the
    joins, so a key repeated a billion times joins as one row.
    """
    key = [*PAGE, "mcid"]
    c = content.where("mcid >= 0").groupBy(*key).agg(F.count(F.lit(1)).alias("content_count"))
    s = slots.groupBy(*key).agg(F.max(F.when(F.col("error").isNull(), F.col("element"))).alias("slot"))
    t = claimed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_claims"), F.min("owner_id").alias("first_claim"))
    joined = c.join(s, key, "full_outer").join(t, key, "full_outer")
    n, claims_n = F.coalesce("content_count", F.lit(0)), F.coalesce("n_claims", F.lit(0))
    consistent = (n == 1) & (claims_n == 1) & F.coalesce(F.col("slot") == F.col("first_claim"), F.lit(False))
    return joined.select(
        *key, n.alias("content_count"), "slot", claims_n.alias("n_claims"), "first_claim", consistent.alias("consistent"))


# --- repeated keys -----------------------------------------------------------


def labels_by_key(
    rows: DataFrame, keys: list[str], order: list[str], label: Column,
    at_least: int = 1, skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Keys on ``at_least`` rows with their labels in order: ``keys, n, part, labels``.

    :data:`LOCATIONS_PER_PART` labels go to a part, so a key of any size stays
    complete without building one huge row.
    """
    named = rows.withColumn("_label", label)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    numbered = row_numbers(named.join(counts, keys), keys, order, "_rn", skew)
    part = F.floor((F.col("_rn") - 1) / LOCATIONS_PER_PART).cast("int")
    return (
        numbered.groupBy(*keys, "n", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_label"))).alias("_l"))
        .select(*keys, "n", "part", F.array_join(F.transform("_l", lambda x: x["_label"]), ", ").alias("labels"))
    )


def duplicate_keys(
    rows: DataFrame, keys: list[str], order: list[str], label: Column, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Keys on more than one row, with all their labels."""
    return labels_by_key(rows, keys, order, label, 2, skew)


def first_seen(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Later rows of a repeated key with the value of the first: ``..., first_value``."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_first"), F.min_by(value, order).alias("first_value"))
    return rows.join(firsts, keys).where(F.col(order) != F.col("_first")).drop("_first")


# --- header ------------------------------------------------------------------


def role_map(reader: NodeReader, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """/RoleMap of each structure tree root (``doc_id, obj_id, at``): roles and problems.

    Roles: ``doc_id, role, target``, the target empty where it is no name; only the
    others are mappings (see :func:`map_role`). Problems: ``doc_id, message``.
    """
    held = reader.keys(roots.select(*NODE), ["RoleMap"], resolve=True).where("RoleMap IS NOT NULL")
    kind = behind(F.col("RoleMap"))
    wrong = held.where(kind != "dict").select(
        "doc_id", F.concat(F.lit("/RoleMap is "), kind_of(kind, behind(F.col("RoleMap"), "raw")), F.lit(", not a dictionary")).alias("message"))
    far = F.col("RoleMap")["ref_id"].isNotNull()
    maps = held.where(kind == "dict").select(
        "doc_id", F.when(far, F.col("RoleMap")["ref_id"]).otherwise(F.col("obj_id")).alias("obj_id"),
        F.when(far, _no_path()).otherwise(F.array_append("at", F.lit("RoleMap"))).alias("at"))
    rows = reader.resolved(reader.below.join(maps, NODE, "left_semi").where("key IS NOT NULL AND idx IS NULL"))
    value = F.struct("value_type", "value_raw", "value", "ref_id", "target_type", "target_raw", "target_value")
    rows = rows.select("doc_id", F.col("key").alias("role"), value.alias("v"))
    is_name = behind(F.col("v")) == "name"
    roles = rows.select("doc_id", "role", F.when(is_name, behind(F.col("v"), "value")).otherwise("").alias("target"), is_name.alias("is_name"))
    bad = rows.where(~is_name).select("doc_id", F.format_string(
        "/RoleMap /%s maps to %s, not a name", F.col("role"), kind_of(behind(F.col("v")), behind(F.col("v"), "raw"))).alias("message"))
    return roles, wrong.unionByName(bad)


def structure_header(entries: DataFrame, catalogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document-level structure facts and a problem row for each malformed one.

    ``catalogs`` has ``doc_id, obj_id``. Facts: ``doc_id, lang, marked, root_id,
    has_tree, parent_tree_id, next_key``. Problems: ``doc_id, place, message``.
    """
    reader = NodeReader(entries)
    cat = catalogs.select("doc_id", "obj_id", _no_path().alias("at"))
    top = reader.keys(cat, ["Lang", "MarkInfo", "StructTreeRoot"], resolve=True)
    inline = reader.keys(catalogs.select("doc_id", "obj_id", F.array(F.lit("MarkInfo")).alias("at")), ["Marked"], resolve=True).select(
        "doc_id", F.col("Marked").alias("_m1"))
    far = reader.keys(
        top.where(F.col("MarkInfo")["ref_id"].isNotNull()).select("doc_id", F.col("MarkInfo")["ref_id"].alias("obj_id"), _no_path().alias("at")),
        ["Marked"], resolve=True).select("doc_id", F.col("Marked").alias("_m2"))
    root_type = reader.roots.select("doc_id", F.col("ref_id").alias("root_id"), F.col("target_type").alias("root_type"))
    mark_type = reader.roots.select("doc_id", F.col("ref_id").alias("_mi"), F.col("target_type").alias("_mt"))
    t = (
        top.withColumns({"root_id": F.col("StructTreeRoot")["ref_id"], "_mi": F.col("MarkInfo")["ref_id"]})
        .join(inline, "doc_id", "left").join(far, "doc_id", "left")
        .join(root_type, ["doc_id", "root_id"], "left").join(mark_type, ["doc_id", "_mi"], "left")
    )
    roots = t.where("root_type = 'dict'").select("doc_id", F.col("root_id").alias("obj_id"), _no_path().alias("at"))
    _, role_problems = role_map(reader, roots)
    body = reader.keys(roots, ["ParentTree", "ParentTreeNextKey"], resolve=True).select(
        "doc_id", F.col("ParentTree")["ref_id"].alias("parent_tree_id"), F.col("ParentTreeNextKey").alias("_next"))
    t = materialize(t.join(body, "doc_id", "left"))
    marked = F.coalesce("_m1", "_m2")
    dangling = F.col("root_id").isNotNull() & F.col("root_type").isNull()
    has_root = F.col("StructTreeRoot").isNotNull() & (F.col("StructTreeRoot")["value_type"] != "null") & ~dangling
    mark_kind = F.coalesce(F.col("_mt"), F.col("MarkInfo")["value_type"])
    facts = t.select(
        "doc_id",
        F.when(behind(F.col("Lang")) == "string", behind(F.col("Lang"), "value")).otherwise("").alias("lang"),
        F.when(behind(marked) == "boolean", behind(marked, "value") == "true").alias("marked"),
        F.when(~dangling, F.col("root_id")).alias("root_id"),
        has_root.alias("has_tree"),
        "parent_tree_id",
        _integer(behind(F.col("_next")), behind(F.col("_next"), "raw")).alias("next_key"),
    )
    catalog = F.lit("catalog")
    where_root = F.concat(F.lit("StructTreeRoot "), F.coalesce("root_id", F.lit("")))
    messages = F.array_compact(F.array(
        F.when(F.col("Lang").isNotNull() & (behind(F.col("Lang")) != "string"), F.struct(catalog.alias("place"),
               F.format_string("/Lang is %s that does not decode as a text string", kind_of(behind(F.col("Lang")), behind(F.col("Lang"), "raw"))).alias("message"))),
        F.when(F.col("MarkInfo").isNotNull() & (mark_kind != "dict"), F.struct(catalog.alias("place"),
               F.format_string("/MarkInfo is %s, not a dictionary", kind_of(mark_kind, behind(F.col("MarkInfo"), "raw"))).alias("message"))),
        F.when(marked.isNotNull() & (behind(marked) != "boolean"), F.struct(catalog.alias("place"),
               F.format_string("/MarkInfo /Marked is %s, not a boolean", kind_of(behind(marked), behind(marked, "raw"))).alias("message"))),
        F.when(dangling, F.struct(catalog.alias("place"),
               F.format_string("/StructTreeRoot %s does not resolve to an object; treated as absent", "root_id").alias("message"))),
        F.when(has_root & (F.coalesce("root_type", F.col("StructTreeRoot")["value_type"]) != "dict"), F.struct(F.trim(where_root).alias("place"),
               F.format_string("/StructTreeRoot is %s, not a dictionary",
                               kind_of(F.coalesce("root_type", F.col("StructTreeRoot")["value_type"]), behind(F.col("StructTreeRoot"), "raw"))).alias("message"))),
        F.when(F.col("_next").isNotNull() & _integer(behind(F.col("_next")), behind(F.col("_next"), "raw")).isNull(), F.struct(F.trim(where_root).alias("place"),
               F.format_string("/ParentTreeNextKey is %s, not an integer", kind_of(behind(F.col("_next")), behind(F.col("_next"), "raw"))).alias("message"))),
    ))
    problems = t.select("doc_id", F.explode(messages).alias("p")).select("doc_id", "p.*")
    roles = role_problems.join(t.select("doc_id", F.trim(where_root).alias("place")), "doc_id").select("doc_id", "place", "message")
    return facts, problems.unionByName(roles)
