"""Page trees: numbering, inherited attributes, resources and form nesting."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import NODE, Levels, NodeReader, SpreadEdges, closure, first_sight
from quire.operators.objects import int_of, name_of, root_rows
from quire.operators.scan import Skew, row_numbers
from quire.operators.structure import behind, kind_of
from quire.session import BucketedTable, materialize

#: A row of a page has all that it inherits, so fewer of them go to a task than of other rows.
PAGE_SKEW = Skew(max_group_rows=1_000_000, chunk_rows=250_000)

# Inheritable attributes in bit order.
INHERITABLE = ["Resources", "MediaBox", "CropBox", "Rotate"]
_ATTR = "struct<place:string,value_type:string,value_raw:string,ref_id:string,obj_id:string,at:array<string>>"


def _no_path() -> Column:
    return F.array().cast("array<string>")


# --- the page tree -----------------------------------------------------------


def page_index(
    entries: DataFrame, roots: DataFrame, max_depth: int | None = None, skew: Skew = PAGE_SKEW
) -> DataFrame:
    """Pages in document order with inherited attributes.

    ``roots`` has ``doc_id, obj_id``: the page tree roots. Rows: ``doc_id,
    page_num`` (NULL for an error row), ``ord, obj_id, inherited`` (bit mask),
    one struct per attribute of :data:`INHERITABLE`, ``error``.

    A node typed Page is a page even with /Kids; /Kids makes a node intermediate;
    anything else but /Pages is a page. An entry that resolves to nothing falls
    back to the ancestor and is named. A subtree below ``max_depth`` becomes an
    error row if it is given; without it the cycle guard alone ends the walk.
    """
    reader = NodeReader(entries)
    table = reader.table(["Type", "Kids", *INHERITABLE], resolve=True)
    typ, has_kids = _name("Type"), F.col("Kids").isNotNull()
    is_page = F.coalesce(typ == "Page", F.lit(False))
    role = F.when(is_page, "leaf").when(has_kids, "inner").when(typ == "Pages", "empty").otherwise("leaf")
    facts = table.withColumn("_role", role)
    kids = reader.array("Kids").all()
    is_ref, shown = F.col("ref_id").isNotNull(), F.coalesce("target_type", "value_type")
    at = F.concat(F.lit("/Kids entry "), F.col("idx").cast("string"))
    named = F.concat(at, F.lit(" ("), "ref_id", F.lit(")"))
    not_dict = lambda where, kind, raw: F.concat(where, F.lit(" is not a dictionary: "), _label(kind, raw))
    fault = (
        F.when(~is_ref & (F.col("value_type") == "null"), F.concat(at, F.lit(" is null")))
        .when(~is_ref & (F.col("value_type") != "dict"), not_dict(at, F.col("value_type"), F.col("value_raw")))
        .when(is_ref & (F.col("target_type").isNull() | (F.col("target_type") == "null")), F.concat(named, F.lit(" is a dangling reference")))
        .when(is_ref & (shown != "dict"), not_dict(named, shown, F.coalesce("target_raw", "value_raw")))
    )

    # The walk goes along the intermediate nodes; each passes its attributes on.
    attrs = F.struct("obj_id", "at", F.lit(None).cast("string").alias("ref_id"), *INHERITABLE)
    own = facts.where("_role = 'inner'").select(
        "doc_id", F.col("obj_id").alias("to_obj_id"), F.col("at").alias("to_at"),
        attrs.withField("ref_id", F.when(F.size("at") == 0, F.col("obj_id"))).alias("own"))
    links = kids.where(fault.isNull()).select(
        *NODE, F.col("item_obj").alias("to_obj_id"), F.col("item_at").alias("to_at"), F.array("idx").alias("step"))
    null_attr = F.lit(None).cast(_ATTR)
    empty = F.struct(
        F.struct(*[null_attr.alias(a) for a in INHERITABLE]).alias("got"), F.struct(*[F.lit(None).cast("string").alias(a) for a in INHERITABLE]).alias("lost"))
    roots = roots.select("doc_id", "obj_id", _no_path().alias("at"), F.col("obj_id").alias("ref_id")).distinct()
    starts = roots.join(facts.where("_role = 'inner'"), NODE).select(
        *NODE, F.array().cast("array<bigint>").alias("label"), _passed_on(empty, F.struct("obj_id", "at", "ref_id", *INHERITABLE)).alias("carried"))
    met = first_sight(links.join(own, ["doc_id", "to_obj_id", "to_at"]), starts, ["obj_id", "at"], max_steps=max_depth, carry=_passed_on)
    inner = BucketedTable.write(met, NODE, laid=True).df
    deep = F.lit(False) if max_depth is None else F.size("label") >= max_depth

    errors: list[DataFrame] = []

    def fail(rows: DataFrame, message: Column) -> None:
        errors.append(rows.select("doc_id", "ord", F.col("ref_id").alias("obj_id"), message.alias("error")).where("error IS NOT NULL"))

    # The list of kids of every node on the walk.
    nodes = inner.select(*NODE, F.col("label").alias("ord"), F.when(F.size("at") == 0, F.col("obj_id")).alias("ref_id"), deep.alias("_deep"))
    fail(nodes.where("_deep"), F.lit(f"page tree deeper than {max_depth} levels; subtree not walked"))
    walked = nodes.where("NOT _deep").join(table.select(*NODE, "Kids"), NODE)
    held = F.col("Kids")
    kind, raw = behind(held), F.when(held["ref_id"].isNotNull(), held["target_raw"]).otherwise(held["value_raw"])
    fail(walked, F.when(kind != "array", F.concat(F.lit("/Kids is not an array: "), _label(kind, raw))))
    above = inner.where(~deep).select(*NODE, F.col("label").alias("_up"), "carried.got", "carried.lost")
    listed = reader.items(above, "Kids", resolve=True).withColumns({"ord": F.array_append("_up", F.col("idx")), "_fault": fault})
    targets = facts.select("doc_id", F.col("obj_id").alias("item_obj"), F.col("at").alias("item_at"), "Type", "Kids", *INHERITABLE, "_role")
    met_at = inner.select("doc_id", F.col("obj_id").alias("item_obj"), F.col("at").alias("item_at"), F.col("label").alias("_met"))
    listed = materialize(listed.join(targets, ["doc_id", "item_obj", "item_at"], "left").join(met_at, ["doc_id", "item_obj", "item_at"], "left"))
    # An object on the way down is met at a beginning of this place.
    cycle = is_ref & F.coalesce(F.slice("_up", F.lit(1), F.size("_met")) == F.col("_met"), F.lit(False))
    again = is_ref & (F.col("_role") == "inner") & (F.col("ord") != F.col("_met"))
    message = F.when(cycle, F.concat(named, F.lit(" points at an ancestor: page tree cycle"))).otherwise(F.col("_fault"))
    fail(listed, message)
    fail(listed.where(message.isNull()), F.when(again, F.lit("page tree node also reached from another parent")))
    others = listed.where(message.isNull() & ~F.coalesce(F.col("_role") == "inner", F.lit(False))).select(
        "doc_id", F.col("item_obj").alias("obj_id"), F.col("item_at").alias("at"), "ref_id", "ord", "got", "lost", "Type", "Kids", *INHERITABLE, "_role")
    lone = roots.join(facts, NODE, "left").where("_role IS NULL OR _role <> 'inner'").select(
        *NODE, "ref_id", F.array().cast("array<bigint>").alias("ord"), empty["got"].alias("got"), empty["lost"].alias("lost"),
        "Type", "Kids", *INHERITABLE, "_role")
    others = others.unionByName(lone)
    fail(others.where("_role = 'empty'"), F.lit("/Pages node has no /Kids"))
    pages = _inherit(others.where("_role IS NULL OR _role = 'leaf'").drop("_role"))
    rows = _leaf_rows(materialize(number_pages(pages, skew)))
    return rows.unionByName(reduce(DataFrame.unionByName, errors), allowMissingColumns=True)


def _label(value_type: Column, raw: Column) -> Column:
    """Kind of a value without its article."""
    return F.regexp_replace(kind_of(value_type, raw), "^an? ", "")


def _name(key: str) -> Column:
    """The name under a key that was read with ``resolve``, followed through a reference."""
    c = F.col(key)
    behind = F.when(c["target_type"] == "name", c["target_value"])
    return F.when(c["ref_id"].isNotNull(), behind).otherwise(F.when(c["value_type"] == "name", c["value"]))


def _attribute(a: str, own: Column, carried: Column) -> dict[str, Column]:
    """One attribute of a node: whether it has it, whether that resolves to nothing, and what it passes on.

    ``own`` has the entries of the node, its place ``obj_id, at`` and ``ref_id``;
    ``carried`` what its ancestors pass on: ``got`` and ``lost``.
    """
    v, place = own[a], F.coalesce(own["ref_id"], F.lit("a direct node"))
    dead = F.coalesce(v["ref_id"].isNotNull() & (v["target_type"].isNull() | (v["target_type"] == "null")), F.lit(False))
    alive = F.coalesce(v.isNotNull() & (v["value_type"] != "null") & ~dead, F.lit(False))
    mine = F.struct(
        place.alias("place"),
        F.coalesce(v["target_type"], v["value_type"]).alias("value_type"),
        F.coalesce(v["target_raw"], v["value_raw"]).alias("value_raw"),
        v["ref_id"].alias("ref_id"),
        F.coalesce(v["ref_id"], own["obj_id"]).alias("obj_id"),
        F.when(v["ref_id"].isNull(), F.array_append(own["at"], F.lit(a))).otherwise(_no_path()).alias("at"),
    )
    return {
        "alive": alive, "dead": dead, "got": F.when(alive, mine).otherwise(carried["got"][a]),
        "lost": F.when(alive, F.lit(None)).when(dead, place).otherwise(carried["lost"][a]),
    }


def _passed_on(carried: Column, own: Column) -> Column:
    """What a node passes on: its own value, else the ancestor's; what resolves to nothing is named."""
    parts = {a: _attribute(a, own, carried) for a in INHERITABLE}
    return F.struct(*[F.struct(*[parts[a][k].alias(a) for a in INHERITABLE]).alias(k) for k in ("got", "lost")])


def _inherit(nodes: DataFrame) -> DataFrame:
    """Leaves with ``got`` and ``lost`` of their own, ``inherited`` and ``own_lost`` as bits."""
    own = F.struct("obj_id", "at", "ref_id", *INHERITABLE)
    carried = F.struct("got", "lost")
    bits, own_lost = F.lit(0), F.lit(0)
    for i, a in enumerate(INHERITABLE):
        part = _attribute(a, own, carried)
        bits = bits + F.when(~part["alive"] & F.col("got")[a].isNotNull(), 1 << i).otherwise(0)
        own_lost = own_lost + F.when(part["dead"], 1 << i).otherwise(0)
    return nodes.withColumns({"inherited": bits, "own_lost": own_lost, "_new": _passed_on(carried, own)}).drop("got", "lost").select(
        "*", "_new.got", "_new.lost").drop("_new", *INHERITABLE)


def number_pages(leaves: DataFrame, skew: Skew = PAGE_SKEW) -> DataFrame:
    """1-based page numbers in document order (``ord``: child positions from the root).

    A document too long for one task is cut by ranges of ``ord``.
    """
    return row_numbers(leaves, ["doc_id"], ["ord"], "page_num", skew)


def _leaf_rows(leaves: DataFrame) -> DataFrame:
    firsts = leaves.where("ref_id IS NOT NULL").groupBy("doc_id", "ref_id").agg(F.min("page_num").alias("_first"))
    rows = leaves.join(firsts, ["doc_id", "ref_id"], "left")
    typ = F.col("Type")
    type_kind, type_name = behind(typ), behind(typ, "value")
    shown_type = F.when(type_kind == "name", F.concat(F.lit("/"), type_name)).otherwise(kind_of(type_kind, behind(typ, "raw")))
    errors = [
        F.when(F.col("ref_id").isNull(), F.lit("page is a direct dictionary, not an indirect reference")).when(
            F.col("_first") < F.col("page_num"), F.format_string("page object also listed as page %d", "_first")),
        F.when(typ.isNull() | (type_kind == "null"), F.lit("page has no /Type")).when(
            ~F.coalesce((type_kind == "name") & (type_name == "Page"), F.lit(False)),
            F.concat(F.lit("page has /Type "), shown_type, F.lit(", want /Page"))),
        F.when(F.col("Kids").isNotNull(), F.lit("page has a /Kids entry; its kids are not walked")),
    ]
    for i, a in enumerate(INHERITABLE):
        own = F.getbit(F.col("own_lost").cast("bigint"), F.lit(i)) == 1
        used = F.getbit(F.col("inherited").cast("bigint"), F.lit(i)) == 1
        text = F.when(own, F.lit(f"/{a} resolves to nothing")).otherwise(
            F.concat(F.lit(f"/{a} on "), F.col("lost")[a], F.lit(" resolves to nothing")))
        errors.append(
            F.when(F.col("lost")[a].isNotNull(), F.concat(text, F.when(used, F.lit("; inherited value used")).otherwise(""))))
    box = F.col("got")["MediaBox"]
    errors.append(
        F.when(box.isNull() & F.col("lost")["MediaBox"].isNull(), F.lit("no /MediaBox, own or inherited")).when(
            box["value_type"] != "array", F.lit("/MediaBox is not an array of four numbers")))
    turn = F.col("got")["Rotate"]
    value = F.when(turn["value_type"] == "number", turn["value_raw"].try_cast("double"))
    nearest = F.round(value).cast("bigint")
    errors.append(
        F.when(turn.isNotNull() & value.isNull(), F.lit("/Rotate is not a number")).when(
            value != nearest, F.format_string("/Rotate is not an integer; read as %d", nearest)))
    return rows.select(
        "doc_id", "page_num", "ord", F.col("ref_id").alias("obj_id"), "inherited",
        *[F.col("got")[a].alias(a) for a in INHERITABLE],
        F.coalesce(nearest, F.lit(0)).alias("rotation"),
        F.concat_ws("; ", *errors).alias("error"),
    )


def page_geometry(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Boxes as four numbers (NULL when absent or malformed) and the rotation.

    Elements that are references are followed.
    """
    numbered = pages.where("page_num IS NOT NULL")
    numbers = root_rows(entries).where("num IS NOT NULL").select("doc_id", F.col("obj_id").alias("ref_id"), F.col("num").alias("_num"))
    reader = entries.where("idx IS NOT NULL").select("doc_id", "obj_id", F.col("parent_path").alias("at"), "idx", "num", "ref_id")
    out = numbered.select("doc_id", "page_num", "rotation")
    for box, name in (("MediaBox", "media_box"), ("CropBox", "crop_box")):
        # Boxes are shared by many pages: each is read once, then joined.
        places = numbered.where(F.col(box).isNotNull()).select(
            "doc_id", F.col(box)["obj_id"].alias("obj_id"), F.col(box)["at"].alias("at")).distinct()
        read = places.join(reader, ["doc_id", "obj_id", "at"]).join(numbers, ["doc_id", "ref_id"], "left")
        read = read.withColumn("num", F.coalesce("num", "_num")).groupBy("doc_id", "obj_id", "at").agg(
            F.count(F.lit(1)).alias("_n"), F.count("num").alias("_ok"),
            *[F.max(F.when(F.col("idx") == i, F.col("num"))).alias(f"_{i}") for i in range(4)])
        read = read.where("_n = 4 AND _ok = 4").select(
            "doc_id", F.col("obj_id").alias("_o"), F.col("at").alias("_a"), F.array("_0", "_1", "_2", "_3").alias(name))
        keyed = numbered.select("doc_id", "page_num", F.col(box)["obj_id"].alias("_o"), F.col(box)["at"].alias("_a"))
        out = out.join(keyed.join(read, ["doc_id", "_o", "_a"], "left").select("doc_id", "page_num", name), ["doc_id", "page_num"])
    return out


def content_length(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """``doc_id, page_num, content_len``: sum of the stream lengths.

    ``contents`` has ``doc_id, page_num, length, bad``: ``length`` NULL when it is
    missing or no integer, ``bad`` when an element is no stream. -1 when anything
    is unreadable or the sum overflows, 0 without contents.
    """
    page = ["doc_id", "page_num"]
    unread = F.coalesce("bad", F.lit(False)) | F.col("length").isNull() | (F.col("length") < 0)
    sums = contents.groupBy(*page).agg(
        F.max(unread).alias("_bad"), F.try_sum(F.col("length").cast("bigint")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    total = F.when(F.col("_n").isNull(), F.lit(0)).when(F.col("_bad"), F.lit(-1)).otherwise(F.coalesce("_sum", F.lit(-1)))
    return pages.select(*page).join(sums, page, "left").select(*page, total.cast("bigint").alias("content_len"))


def count_disagreement(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents whose declared page count differs from the leaves found."""
    found = pages.where("page_num IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    declared = F.coalesce("page_count", F.lit(0))
    return docs.join(found, "doc_id", "left").where(n != declared).select(
        "doc_id", n.alias("leaves"), declared.alias("declared"),
        F.when(declared == 0, F.format_string("page tree has %d page leaves but /Count is 0 or unreadable", n))
        .otherwise(F.format_string("page tree has %d page leaves but /Count says %d", n, declared)).alias("message"))


# --- forms -------------------------------------------------------------------


def form_tree(pages: DataFrame, forms: DataFrame, depth: int | None = None) -> DataFrame:
    """Forms of each page nested through each form's own resources.

    ``pages`` has ``doc_id, page_num, res_id``; ``forms`` has ``doc_id, owner_id,
    name, obj_id``. Rows: ``doc_id, page_num, path, obj_id, flag``; ``cyclic``
    re-enters its own path, ``truncated`` is listed but not read because it lies at
    ``depth``. Without a depth everything is read.
    """
    spread = SpreadEdges(
        forms.select("doc_id", F.col("owner_id").alias("src_id"), F.col("obj_id").alias("dst_id"), "name"), extra=["name"])
    frontier = pages.select(
        "doc_id", "page_num", F.col("res_id").alias("obj_id"), _no_path().alias("path"), _no_path().alias("_ids"))
    out: Levels | None = None
    for level in itertools.count(1):
        if depth is not None and level > depth:
            break
        rows = spread.step(frontier).select(
            "doc_id", "page_num", F.array_append("path", F.col("name")).alias("path"), F.col("dst_id").alias("obj_id"), "_ids",
            F.when(F.array_contains("_ids", F.col("dst_id")), "cyclic").when(F.lit(level == depth), "truncated").alias("flag"),
        )
        rows = materialize(rows)
        out = Levels(rows) if out is None else (out.add(rows) or out)
        frontier = rows.where("flag IS NULL").select(
            "doc_id", "page_num", "obj_id", "path", F.array_append("_ids", F.col("obj_id")).alias("_ids"))
        if rows.isEmpty():
            break
    if out is None:
        return frontier.where("false").select("doc_id", "page_num", "path", "obj_id", F.lit(None).cast("string").alias("flag"))
    return out.all().drop("_ids")


def form_closure(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """Forms that each page reaches, one row each: ``doc_id, page_num, obj_id, path, n_paths, cyclic``.

    Input as for :func:`form_tree`, which lists every path instead. ``path`` is the
    least by name. Resources that many pages share are walked once. See
    :func:`~quire.operators.graph.closure`.
    """
    links = forms.select("doc_id", F.col("owner_id").alias("src_id"), F.col("obj_id").alias("dst_id"), F.array("name").alias("step"))
    starts = pages.select("doc_id", F.col("res_id").alias("root_id"), F.col("res_id").alias("obj_id"))
    reached = closure(links, starts).where(F.size("path") > 0)
    return pages.join(reached, (pages["doc_id"] == reached["doc_id"]) & (pages["res_id"] == reached["root_id"])).select(
        pages["doc_id"], "page_num", reached["obj_id"], "path", "n_paths", "cyclic")


# --- resource entries --------------------------------------------------------
#
# ``resources`` has ``doc_id, owner_id, name, obj_id, at``: where each named
# resource lives (the object it points at, or a place inside its owner).


def _at_home(resources: DataFrame) -> DataFrame:
    return resources.select(*NODE, "owner_id", "name")


def ext_gstates(reader: NodeReader, resources: DataFrame) -> DataFrame:
    """Blend mode, both alphas (absent is not 0) and the soft mask."""
    d = reader.keys(_at_home(resources), {"BM": "BM", "ca": "fill", "CA": "stroke", "SMask": "SMask"})
    modes = reader.items(d.where(F.col("BM")["value_type"] == "array").select(*NODE), "BM").where(
        "idx = 0 AND value_type = 'name'").select("doc_id", "item_obj", F.slice("item_at", 1, F.size("item_at") - 2).alias("at"), F.col("value").alias("_m"))
    d = d.join(modes.withColumnRenamed("item_obj", "obj_id"), NODE, "left")
    mask = reader.keys(
        d.where("SMask IS NOT NULL AND SMask.value_type <> 'name'").select(
            F.col("doc_id"), F.coalesce(F.col("SMask")["ref_id"], F.col("obj_id")).alias("obj_id"),
            F.when(F.col("SMask")["ref_id"].isNull(), F.array_append("at", F.lit("SMask"))).otherwise(_no_path()).alias("at"),
        ).distinct(), ["S", "G", "TR", "BC"])
    # The size of a backdrop colour that is written in place.
    sizes = reader.items(mask.where("BC.value_type = 'array'").select(*NODE), "BC").withColumn(
        "at", F.slice("item_at", 1, F.size("item_at") - 2)).where("ref_id IS NULL").groupBy(
        "doc_id", F.col("item_obj").alias("obj_id"), "at").agg(F.count(F.lit(1)).cast("int").alias("_bc"))
    mask = mask.join(sizes, NODE, "left").select(
        "doc_id", F.col("obj_id").alias("_mo"), F.col("at").alias("_ma"), name_of("S").alias("_s"),
        F.col("G")["ref_id"].alias("_g"), F.col("TR").isNotNull().alias("_tr"), "_bc")
    num = lambda k: F.when(F.col(k)["value_type"] == "number", F.col(k)["value_raw"].try_cast("double"))
    d = d.withColumns({
        "_mo": F.coalesce(F.col("SMask")["ref_id"], F.when(F.col("SMask").isNotNull(), F.col("obj_id"))),
        "_ma": F.when(F.col("SMask")["ref_id"].isNull(), F.array_append("at", F.lit("SMask"))).otherwise(_no_path()),
    }).join(mask, ["doc_id", "_mo", "_ma"], "left")
    return d.select(
        "doc_id", "owner_id", "name",
        F.coalesce(name_of("BM"), "_m", F.lit("")).alias("blend_mode"),
        num("fill").alias("fill_alpha"), num("stroke").alias("stroke_alpha"),
        F.coalesce(name_of("SMask"), "_s").alias("smask"), F.col("_g").alias("smask_group"),
        F.coalesce("_tr", F.lit(False)).alias("smask_transfer"), F.coalesce("_bc", F.lit(0)).alias("smask_backdrop"))


def _numbers(reader: NodeReader, nodes: DataFrame, key: str) -> DataFrame:
    """The numbers of a short array under ``key`` in their order; whatever else it holds is left out."""
    rows = reader.items(nodes.select(*NODE, F.struct(*NODE).alias("_node")), key).where("value_type = 'number'")
    listed = F.array_sort(F.collect_list(F.struct("idx", F.col("value_raw").try_cast("double").alias("n"))))
    return rows.groupBy("_node").agg(F.transform(listed, lambda x: x["n"]).alias(f"_{key}")).select("_node.*", f"_{key}")


def xobject_facts(reader: NodeReader, resources: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """Forms and images of a resources dictionary with their sizes and groups.

    A form has its box, matrix and, if it has a transparency group, the group's kind,
    colour space family and the flags isolated and knockout.
    """
    d = reader.keys(_at_home(resources), ["Subtype", "Width", "Height", "ColorSpace", "Group", "BBox", "Matrix"], resolve=True)
    sub = F.coalesce(name_of("Subtype"), F.lit(""))
    image = sub == "Image"
    forms = d.where(sub == "Form").select(*NODE, "Group").distinct()
    far = F.col("Group")["ref_id"].isNotNull()
    groups = forms.where(behind(F.col("Group")) == "dict").select(
        "doc_id", F.struct(*NODE).alias("_node"), F.when(far, F.col("Group")["ref_id"]).otherwise(F.col("obj_id")).alias("obj_id"),
        F.when(far, _no_path()).otherwise(F.array_append("at", F.lit("Group"))).alias("at"))
    flag = lambda k: F.coalesce((F.col(k)["value_type"] == "boolean") & (F.col(k)["value"] == "true"), F.lit(False))
    facts = reader.keys(groups, ["S", "CS", "I", "K"], resolve=True)
    heads = reader.items(facts.where(behind(F.col("CS")) == "array").select(*NODE), "CS").where("idx = 0 AND value_type = 'name'")
    # A family in front of an array that is written in the group, or that the group refers to.
    direct = heads.where(F.size("item_at") > 1).select(
        "doc_id", F.col("item_obj").alias("obj_id"), F.slice("item_at", 1, F.size("item_at") - 2).alias("at"), F.col("value").alias("_head"))
    shared = heads.where(F.size("item_at") == 1).select("doc_id", F.col("item_obj").alias("_cs"), F.col("value").alias("_far_head")).distinct()
    facts = facts.withColumn("_cs", F.col("CS")["ref_id"]).join(direct, NODE, "left").join(shared, ["doc_id", "_cs"], "left")
    facts = facts.select(
        "_node.*", F.struct(
            F.coalesce(name_of("S"), F.lit("")).alias("s"), F.coalesce(_name("CS"), "_head", "_far_head", F.lit("")).alias("cs"),
            flag("I").alias("isolated"), flag("K").alias("knockout")).alias("group_facts"))
    d = d.join(_numbers(reader, forms, "BBox"), NODE, "left").join(_numbers(reader, forms, "Matrix"), NODE, "left").join(facts, NODE, "left")
    out = d.select(
        "doc_id", "owner_id", "name", "obj_id", sub.alias("subtype"),
        F.when(image, int_of("Width")).alias("width"), F.when(image, int_of("Height")).alias("height"),
        F.when(image, F.when(F.col("ColorSpace")["ref_id"].isNull(), name_of("ColorSpace"))).alias("_cs_name"),
        F.when(sub == "Form", F.col("Group").isNotNull()).alias("has_group"),
        F.col("_BBox").alias("bbox"), F.col("_Matrix").alias("matrix"), "group_facts")
    if spaces is not None:
        out = out.join(spaces.select("doc_id", "obj_id", F.col("family").alias("_fam")), ["doc_id", "obj_id"], "left")
        return out.withColumn("color_space", F.coalesce("_cs_name", "_fam")).drop("_cs_name", "_fam")
    return out.withColumnRenamed("_cs_name", "color_space")


def page_links(reader: NodeReader, pages: DataFrame) -> DataFrame:
    """``doc_id, obj_id, annot_count, contents_id`` of each page object (``doc_id, obj_id``).

    The length of its /Annots, and the first stream of its /Contents; 0 and '' if there is none.
    """
    nodes = pages.select("doc_id", "obj_id", _no_path().alias("at")).distinct()
    d = reader.keys(nodes, ["Annots", "Contents"], resolve=True)
    owner = F.col("obj_id").alias("_page")
    annots = reader.items(nodes.select(*NODE, owner), "Annots").groupBy("doc_id", F.col("_page").alias("obj_id")).agg(
        F.count(F.lit(1)).alias("_n"))
    listed = reader.items(nodes.select(*NODE, owner), "Contents", resolve=True).where("ref_id IS NOT NULL AND target_type = 'stream'").groupBy(
        "doc_id", F.col("_page").alias("obj_id")).agg(F.min_by("ref_id", "idx").alias("_first"))
    one = F.when(behind(F.col("Contents")) == "stream", F.col("Contents")["ref_id"])
    return d.join(annots, ["doc_id", "obj_id"], "left").join(listed, ["doc_id", "obj_id"], "left").select(
        "doc_id", "obj_id", F.coalesce("_n", F.lit(0)).alias("annot_count"), F.coalesce(one, "_first", F.lit("")).alias("contents_id"))


def color_spaces(reader: NodeReader, places: DataFrame) -> DataFrame:
    """Family of each colour space and what it is built on.

    ``places`` has ``doc_id, cs_id, value_type, value, obj_id, at``: a name, or
    the place of an array. Rows: ``doc_id, cs_id, family, components, alternate,
    hival, tint_type, profile_size``. Of an alternate only the family is kept, so
    its own alternate needs no further step and a cycle of them cannot loop.
    """
    names = places.where("value_type = 'name'").select("doc_id", "cs_id", F.col("value").alias("family"))
    arrays = places.where("value_type = 'array'").select("doc_id", "cs_id", "obj_id", "at")
    slots = reader.resolved(
        reader.elements.join(arrays).select(
            "doc_id", "cs_id", "obj_id", "path", "idx", "value_type", "value_raw", "value", "ref_id"))
    slots = materialize(slots)
    at = lambda i, c: F.max(F.when(F.col("idx") == i, F.col(c)))
    wide = slots.groupBy("doc_id", "cs_id").agg(
        F.max(F.when((F.col("idx") == 0) & (F.col("value_type") == "name"), F.col("value"))).alias("family"),
        F.count(F.lit(1)).alias("_n"), at(1, "ref_id").alias("_profile"), at(2, "value_raw").alias("_hival"))
    # Element 2 of Separation and DeviceN, /Alternate of an ICC stream: a name or an array's head.
    third = slots.where("idx = 2").select(
        "doc_id", "cs_id", F.coalesce("target_type", "value_type").alias("_vt"), F.coalesce("target_value", "value").alias("_v"),
        F.coalesce("ref_id", "obj_id").alias("obj_id"), F.when(F.col("ref_id").isNull(), F.col("path")).otherwise(_no_path()).alias("at"))
    heads = reader.elements.join(third.where("_vt = 'array'").select("doc_id", "cs_id", "obj_id", "at")).where(
        "idx = 0 AND value_type = 'name'").select("doc_id", "cs_id", F.col("value").alias("_h"))
    third = third.join(heads, ["doc_id", "cs_id"], "left").select(
        "doc_id", "cs_id", F.when(F.col("_vt") == "name", F.col("_v")).otherwise(F.col("_h")).alias("_alt3"))
    tint = reader.keys(
        slots.where("idx = 3").select(
            "doc_id", "cs_id", F.coalesce("ref_id", "obj_id").alias("obj_id"),
            F.when(F.col("ref_id").isNull(), F.col("path")).otherwise(_no_path()).alias("at")), ["FunctionType"],
    ).select("doc_id", "cs_id", int_of("FunctionType").alias("_tint"))
    icc = reader.keys(
        wide.where("family = 'ICCBased' AND _profile IS NOT NULL").select("doc_id", "cs_id", F.col("_profile").alias("obj_id"), _no_path().alias("at")),
        ["N", "Alternate", "Length"], resolve=True,
    )
    alt = F.col("Alternate")
    # An alternate written as an array has its family in front.
    alt_heads = reader.elements.join(
        icc.where(behind(alt) == "array").select(
            "doc_id", "cs_id", F.coalesce(alt["ref_id"], "obj_id").alias("obj_id"),
            F.when(alt["ref_id"].isNull(), F.array(F.lit("Alternate"))).otherwise(_no_path()).alias("at"))
    ).where("idx = 0 AND value_type = 'name'").select("doc_id", "cs_id", F.col("value").alias("_head"))
    icc = icc.join(alt_heads, ["doc_id", "cs_id"], "left").select(
        "doc_id", "cs_id", int_of("N").alias("_icc_n"), F.coalesce(_name("Alternate"), "_head").alias("_icc_alt"), int_of("Length").alias("profile_size"))
    key = ["doc_id", "cs_id"]
    joined = wide.where("family IS NOT NULL").join(third, key, "left").join(tint, key, "left").join(icc, key, "left")
    tinted = F.col("family").isin("Separation", "DeviceN")
    shaped = joined.select(
        *key, "family",
        F.col("_icc_n").alias("components"),
        F.when(tinted, F.col("_alt3")).otherwise(F.col("_icc_alt")).alias("alternate"),
        F.when(F.col("family") == "Indexed", F.col("_hival").try_cast("bigint")).alias("hival"),
        F.when(tinted & (F.col("_n") >= 4), F.coalesce("_tint", F.lit(0))).alias("tint_type"),
        "profile_size",
    )
    return shaped.unionByName(names, allowMissingColumns=True)


def typed_resources(reader: NodeReader, resources: DataFrame, key: str) -> DataFrame:
    """Name, target and type number of patterns (``PatternType``) or shadings (``ShadingType``)."""
    d = reader.keys(_at_home(resources), [key])
    number = F.when(F.col(key)["value_type"] == "number", F.col(key)["value_raw"].try_cast("double").cast("int"))
    return d.select("doc_id", "owner_id", "name", "obj_id", F.coalesce(number, F.lit(0)).alias("type_number"))
