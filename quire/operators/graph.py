"""Walks over the reference graph, all documents at once.

Each level is one join of the frontier with the edges. The edges, what was met so
far and the frontier are tables bucketed by the same key, so a level moves what its
edges lead to, once, and nothing else. Levels are written to the checkpoint folder:
lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.objects import OBJ, root_rows
from quire.session import BucketedTable, WrittenRows, materialize, written

COMPACT_EVERY = 8
EDGES_PER_BUCKET = 1_000_000
SAMPLED_ROWS = 1_000
#: A key with more than this part of all rows is dealt over several tasks; so there are fewer such keys.
HOT_SHARE = 1_000


class SpreadTable:
    """A table bucketed once by its join key; hot keys lie apart, dealt further.

    Joins with it move the other side only, and not even that if it is bucketed
    alike. A key with more than ``per_bucket`` rows lies in a table of its own,
    bucketed by the key and a number that :func:`split_by` gives; other rows of such
    a key are copied to each of its numbers.

    Big keys are found on a sample that holds about :data:`SAMPLED_ROWS` rows of
    such a key. The sample decides the layout only; every row is kept.
    """

    def __init__(self, df: DataFrame, keys: list[str], split_by: str, per_bucket: int = EDGES_PER_BUCKET, parts: int = 1):
        self.keys = keys
        whole = BucketedTable.write(df, keys, parts=parts)
        share = min(1.0, SAMPLED_ROWS / per_bucket)
        sampled = whole.df.select(*keys) if share == 1.0 else whole.df.select(*keys).sample(share, seed=7)
        hot = materialize(
            sampled.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > per_bucket * share)
            .select(*keys, F.ceil(F.col("_n") / (per_bucket * share)).cast("int").alias("_buckets"))
        )
        self.hot = None if hot.isEmpty() else hot
        self.parts = [whole]
        if self.hot is not None:
            number = F.pmod(F.xxhash64(split_by), F.col("_buckets")).cast("int")
            self.parts = [
                BucketedTable.write(whole.df.join(hot, keys, "left_anti"), keys, laid=True),
                BucketedTable.write(whole.df.join(hot, keys).withColumn("_bucket", number).drop("_buckets"), [*keys, "_bucket"])]
            self.hot_rows = self.parts[1].df
            whole.drop()
        self.table = self.parts[0].df

    def join(self, frontier: DataFrame, how: str = "inner") -> DataFrame:
        """Rows of the table for each frontier row; the frontier has the keys.

        ``left`` keeps frontier rows without any; it is for tables without hot keys.
        """
        cold = frontier.join(self.table, self.keys, how)
        if self.hot is None:
            return cold
        copies = F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))
        dealt = frontier.join(self.hot, self.keys).withColumn("_bucket", copies).drop("_buckets")
        return cold.unionByName(dealt.join(self.hot_rows, [*self.keys, "_bucket"]).drop("_bucket"))

    def drop(self) -> None:
        """Remove the table and its files."""
        for part in self.parts:
            part.drop()

    def all(self) -> DataFrame:
        """The whole table."""
        return self.table if self.hot is None else self.table.unionByName(self.hot_rows.drop("_bucket"))


def spread_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], per_key: int = EDGES_PER_BUCKET) -> DataFrame:
    """Inner join of rows with a table of unique keys, whatever key they crowd on.

    Keys that hold more than ``per_key`` rows and more than a part of
    1/:data:`HOT_SHARE` of all are dealt over several tasks, their lookup rows copied.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    size = max(per_key, (total or 0) // HOT_SHARE)
    if not most or most <= size:
        return rows.join(lookup, keys)
    # Fewer than HOT_SHARE rows, since each stands for more than that part of all.
    hot = F.broadcast(materialize(counts.where(F.col("_n") > size).select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_copies"))))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("_copies")
    copied = lookup.join(hot, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [*keys, "_copy"]).drop("_copy")


def lookup_left(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by ``keys``, of which the last, a string, may be null: such rows are dealt by their hash.

    An equi-join would send all rows without it, of one document, to one task.
    """
    *same, key = keys
    dealt = rows.withColumn("_to", F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))))
    on = F.col(f"_r.{key}").isNotNull() & (F.col("_r._to") == F.col(f"_l.{key}"))
    for k in same:
        on = on & (F.col(f"_r.{k}") == F.col(f"_l.{k}"))
    kept = [*keys, *[c for c in rows.columns if c not in keys]]
    return dealt.alias("_r").join(lookup.alias("_l"), on, "left").select(
        *[F.col(f"_r.{c}") for c in kept], *[F.col(f"_l.{c}") for c in lookup.columns if c not in keys])


class SpreadEdges:
    """Edges laid out by source."""

    def __init__(self, edges: DataFrame, per_bucket: int = EDGES_PER_BUCKET, extra: Iterable[str] = ()):
        cols = ["doc_id", "src_id", "dst_id", *extra]
        self.spread = SpreadTable(edges.select(*cols), ["doc_id", "src_id"], "dst_id", per_bucket)

    def step(self, frontier: DataFrame) -> DataFrame:
        """Edges leaving the frontier (``doc_id, obj_id`` and any other columns)."""
        return self.spread.join(frontier.withColumnRenamed("obj_id", "src_id"))


class Levels:
    """Rows gathered level by level, compacted so that plans stay short."""

    def __init__(self, first: DataFrame):
        self._parts = [first]

    def add(self, rows: DataFrame) -> None:
        self._parts.append(rows)
        if len(self._parts) > COMPACT_EVERY:
            self._parts = [materialize(self.all())]

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self._parts)


class Visited:
    """Rows met so far, bucketed by their key; one part a level, compacted now and then.

    A key is in one part only.
    """

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)
        self.parts: list[BucketedTable] = []

    def add(self, rows: DataFrame, laid: bool = False) -> DataFrame:
        """Write ``rows`` as a part and return it; ``laid`` says that they are dealt by the key."""
        self.parts.append(BucketedTable.write(rows, self.keys, laid=laid))
        if len(self.parts) > COMPACT_EVERY:
            *old, last = self.parts
            self.parts = old
            whole = BucketedTable.write(self.all(), self.keys)
            for part in old:
                part.drop()
            # The last one is read as a frontier.
            self.parts = [whole, last]
        return self.parts[-1].df

    def without(self, rows: DataFrame) -> DataFrame:
        """``rows`` (which have the keys) that are not met yet; nothing but ``rows`` is moved."""
        for part in self.parts:
            rows = rows.join(part.df.select(*self.keys), self.keys, "left_anti")
        return rows

    def drop(self) -> None:
        """Remove all parts and their files."""
        for part in self.parts:
            part.drop()

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [part.df for part in self.parts])


def reachable(
    edges: DataFrame, roots: DataFrame, per_bucket: int = EDGES_PER_BUCKET
) -> DataFrame:
    """``doc_id, obj_id, level, parent_id`` of everything the roots reach.

    The roots count themselves at level 0. ``parent_id`` lies on a shortest path;
    ties go to the smallest id.
    """
    spread = SpreadEdges(edges.where("src_id <> dst_id"), per_bucket)
    seen = Visited(OBJ)
    frontier = seen.add(
        roots.select(*OBJ).distinct().select(*OBJ, F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id")))
    for level in itertools.count(1):
        if frontier.isEmpty():
            return seen.all()
        frontier = seen.add(next_level(spread, seen, frontier).select(*OBJ, F.lit(level).alias("level"), "parent_id"), laid=True)


def next_level(spread: SpreadEdges, seen: Visited, frontier: DataFrame) -> DataFrame:
    """What the frontier's edges lead to and was not met yet, with the smallest source."""
    found = spread.step(frontier.select(*OBJ)).groupBy("doc_id", F.col("dst_id").alias("obj_id")).agg(F.min("src_id").alias("parent_id"))
    return seen.without(found)


# --- first sight in document order -------------------------------------------


class Best(Visited):
    """The smallest ``label`` of every key, with what it carries; later parts hold smaller labels of a key."""

    def better(self, rows: DataFrame) -> DataFrame:
        """``rows`` (keys, ``label``) whose label is smaller than any known one of their key."""
        for part in self.parts:
            rows = rows.join(part.df.select(*self.keys, F.col("label").alias("_known")), self.keys, "left").where(
                "_known IS NULL OR label < _known").drop("_known")
        return rows

    def least(self, rows: DataFrame) -> DataFrame:
        """One row a key: its smallest label."""
        rest = [c for c in rows.columns if c not in (*self.keys, "label")]
        return rows.groupBy(*self.keys).agg(F.min("label").alias("label"), *[F.min_by(c, "label").alias(c) for c in rest])

    def all(self) -> DataFrame:
        return self.least(super().all())


def first_sight(
    edges: DataFrame, starts: DataFrame, node: Sequence[str], group: Sequence[str] = ("doc_id",),
    max_steps: int | None = None, carry: Callable[[Column, Column], Column] | None = None, per_bucket: int = EDGES_PER_BUCKET,
) -> DataFrame:
    """Where a depth-first reader meets every node first: its least path in document order.

    ``edges`` has ``doc_id``, the ``node`` columns of the source, the same columns with
    ``to_`` before their names for the target, and ``step``: an array of sortable
    values, none a beginning of another one of its source. ``starts`` has the ``group``
    columns (``doc_id`` first), ``node`` and ``label``, the array to begin with.
    Returns group, node and label.

    With ``carry`` starts have a value ``carried`` too, and edges what their target has
    itself as ``own``; ``carry(carried, own)`` is the target's value along its path.

    A reader that enters every node once goes along the least path that meets no node
    twice. Labels only fall: each round passes on those that fell, until none does. A
    path that comes back to a node is longer than that node's own label, so it never
    wins and cycles end by themselves. Rounds are as many as the longest such path.
    """
    node, group = list(node), list(group)
    key, source = [*group, *node], ["doc_id", *node]
    extra = [] if carry is None else ["own"]
    spread = SpreadTable(edges.select(*source, *[f"to_{c}" for c in node], "step", *extra), source, "step", per_bucket)
    best = Best(key)
    frontier = best.add(best.least(starts.select(*key, "label", *(["carried"] if carry else []))), laid=True)
    for rounds in itertools.count(1):
        if frontier.isEmpty() or (max_steps is not None and rounds > max_steps):
            return best.all()
        passed = [] if carry is None else [carry(F.col("carried"), F.col("own")).alias("carried")]
        moved = spread.join(frontier).select(
            *group, *[F.col(f"to_{c}").alias(c) for c in node], F.concat("label", "step").alias("label"), *passed)
        frontier = best.add(best.better(best.least(moved)), laid=True)


#: Rounds in which :func:`closure` counts paths by their length, before it gives that up for the order of the graph.
SHORT_WALK = 8


def closure(edges: DataFrame, starts: DataFrame, per_bucket: int = EDGES_PER_BUCKET, short: int = SHORT_WALK) -> DataFrame:
    """Everything that each start reaches, without listing paths.

    ``edges`` has ``doc_id, src_id, dst_id, step`` (see :func:`first_sight`), ``starts``
    ``doc_id, root_id, obj_id``. Rows: ``doc_id, root_id, obj_id, path`` (the least),
    ``n_paths`` and ``cyclic``. ``cyclic`` says that a cycle lies on the way, so that
    there is no end of paths; ``n_paths`` is null then, and where the number has more
    than 38 digits.

    Paths are counted by their length, one row an object and length, if none has more
    than ``short`` steps and no cycle but an object's own reference to itself is met.
    Else they are counted from the start in the order of the graph: an object passes
    its number on once all references to it have theirs. A chain of diamonds takes two
    rounds a diamond.
    """
    key = ["doc_id", "root_id", "obj_id"]
    named = written(edges.select("doc_id", F.col("src_id").alias("obj_id"), F.col("dst_id").alias("to_obj_id"), "step"))
    begin = starts.select(*key).distinct()
    found = _closure_by_length(named, begin, per_bucket, short)
    return _closure_by_order(named, begin, per_bucket) if found is None else found


_ONE = "decimal(38,0)"


def _closure_by_length(edges: DataFrame, starts: DataFrame, per_bucket: int, short: int) -> DataFrame | None:
    """:func:`closure` where every path has at most ``short`` steps, else None.

    No path that is least goes along an object's reference to itself, so these are left
    out; what they make endless is marked. Objects without references are not asked for any.
    """
    key = ["doc_id", "root_id", "obj_id"]
    itself = F.col("to_obj_id").eqNullSafe(F.col("obj_id"))
    nodes = written(edges.groupBy("doc_id", "obj_id").agg(F.bool_or(~itself).alias("_on"), F.bool_or(itself).alias("_loop")))
    ahead, loop = F.coalesce("_on", F.lit(False)).alias("_on"), F.coalesce("_loop", F.lit(False)).alias("_cyclic")
    links = lookup_left(edges.where(~itself), nodes.withColumnRenamed("obj_id", "to_obj_id"), ["doc_id", "to_obj_id"])
    spread = SpreadTable(links.select("doc_id", "obj_id", "to_obj_id", "step", ahead, loop.alias("_loop")), ["doc_id", "obj_id"], "step", per_bucket)
    one, label = F.lit(1).cast(_ONE), F.array().cast(edges.schema["step"].dataType)
    level = starts.join(nodes, ["doc_id", "obj_id"], "left").select(*key, label.alias("label"), one.alias("n_paths"), ahead, loop)
    levels = [WrittenRows.write(level)]
    for _ in range(short + 1):
        frontier = levels[-1].df.where("_on").drop("_on")
        if frontier.isEmpty():
            return _summed(levels, key)
        moved = spread.join(frontier).select(
            "doc_id", "root_id", F.col("to_obj_id").alias("obj_id"), F.concat("label", "step").alias("label"), "n_paths",
            "_on", (F.col("_cyclic") | F.col("_loop")).alias("_cyclic"))
        levels.append(WrittenRows.write(_merged(moved, key, F.bool_or("_on").alias("_on"))))
    for rows in levels:
        rows.drop()
    return None


def _merged(rows: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """One row a key: the least label, all paths (null if they are too many to count), and whether a cycle lies on one."""
    total = F.when(~F.bool_or(F.col("n_paths").isNull()), F.expr("try_sum(n_paths)").cast(_ONE)).alias("n_paths")
    return rows.groupBy(*key).agg(F.min("label").alias("label"), total, *more, F.bool_or("_cyclic").alias("_cyclic"))


def _summed(levels: list[WrittenRows], key: list[str]) -> DataFrame:
    rows = functools.reduce(DataFrame.unionByName, [x.df.drop("_on") for x in levels])
    # What has no id is no object, whose paths could be summed: a row for each length.
    nameless = functools.reduce(Column.__or__, [F.col(k).isNull() for k in key])
    cyclic = F.col("_cyclic")
    rows = _merged(rows.where(~nameless), key).unionByName(rows.where(nameless).withColumn("_cyclic", F.lit(True)))
    return rows.select(*key, F.col("label").alias("path"), F.when(~cyclic, F.col("n_paths")).alias("n_paths"), cyclic.alias("cyclic"))


def _closure_by_order(named: DataFrame, starts: DataFrame, per_bucket: int) -> DataFrame:
    """:func:`closure` of any graph."""
    group, key = ["doc_id", "root_id"], ["doc_id", "root_id", "obj_id"]
    begin = starts.withColumn("label", F.array().cast(named.schema["step"].dataType))
    met = BucketedTable.write(first_sight(named, begin, ["obj_id"], group, per_bucket=per_bucket), key).df
    spread = SpreadTable(named, ["doc_id", "obj_id"], "step", per_bucket)
    inside = spread.join(met.select(*key)).select(*group, F.col("to_obj_id").alias("obj_id"))
    wanted = met.join(inside.groupBy(*key).agg(F.count(F.lit(1)).alias("_in")), key, "left").join(
        begin.select(*key, F.lit(1).alias("_start")), key, "left")
    wanted = BucketedTable.write(wanted.select(*key, F.coalesce("_in", F.lit(0)).alias("_in"), F.coalesce("_start", F.lit(0)).alias("_start")), key).df
    one = F.lit(1).cast("decimal(38,0)")
    done, got = Visited(key), Visited(key)
    ready = done.add(wanted.where("_in = 0").select(*key, one.alias("n_paths")), laid=True)
    while not ready.isEmpty():
        sent = spread.join(ready).groupBy(*group, F.col("to_obj_id").alias("obj_id")).agg(
            F.count(F.lit(1)).alias("_refs"), F.expr("try_sum(n_paths)").cast("decimal(38,0)").alias("_paths"),
            F.bool_or(F.col("n_paths").isNull()).alias("_many"))
        sent = sent.select(*key, "_refs", "_paths", (F.col("_many") | F.col("_paths").isNull()).alias("_many"))
        touched = got.add(sent, laid=True).select(*key)
        sums = got.all().join(touched, key, "left_semi").groupBy(*key).agg(
            F.sum("_refs").alias("_refs"), F.expr("try_sum(_paths)").cast("decimal(38,0)").alias("_paths"), F.bool_or("_many").alias("_many"))
        full = sums.join(wanted, key).where("_refs = _in").select(
            *key, F.when(~F.col("_many"), F.expr("try_add(_paths, _start)")).cast("decimal(38,0)").alias("n_paths"))
        ready = done.add(full, laid=True)
    counted = done.all().withColumn("_done", F.lit(True))
    return met.join(counted, key, "left").select(*key, F.col("label").alias("path"), "n_paths", F.col("_done").isNull().alias("cyclic"))


def object_index(objects: DataFrame, reached: DataFrame) -> DataFrame:
    """Every cross-reference slot but 0 with its type and reachability."""
    marked = objects.where("obj_num <> 0").join(
        reached.select(*OBJ, F.lit(True).alias("_hit")), OBJ, "left"
    )
    free = F.col("status") == "free"
    hit = F.coalesce("_hit", F.lit(False)) & ~free
    return marked.select(
        *OBJ,
        "obj_num",
        "gen",
        F.when(free, F.lit("")).otherwise(F.coalesce("type_name", F.lit(""))).alias("type_name"),
        free.alias("free"),
        hit.alias("reachable"),
        F.when(
            hit,
            F.format_string("obj:%d:%d", F.col("gen").cast("bigint"), F.col("obj_num").cast("bigint")),
        ).otherwise(F.lit("")).alias("node_id"),
    )


def orphans(objects: DataFrame, reached: DataFrame) -> DataFrame:
    """Objects in use that nothing reaches."""
    return objects.where("status <> 'free' AND obj_num <> 0").join(
        reached.select(*OBJ), OBJ, "left_anti"
    )


def ancestor_path(reached: DataFrame, targets: DataFrame, per_key: int = EDGES_PER_BUCKET) -> DataFrame:
    """``doc_id, obj_id, ids, error``: one shortest path from a root to each target.

    Pointer jumping over the parents of :func:`reachable`: a round doubles how far the
    pointers reach and how many ancestors of a target are known, so a path of n steps
    takes log(n) rounds. An ancestor of a target is a row; the rows of a path meet at
    the end only.
    """
    wanted = targets.select(*OBJ).distinct()
    at = ["doc_id", "_at"]
    jumps = BucketedTable.write(
        reached.where("parent_id IS NOT NULL").select("doc_id", F.col("obj_id").alias("_at"), F.col("parent_id").alias("_to"), "level"), at).df
    first = wanted.join(reached.select(*OBJ, F.col("level").cast("long").alias("_level")), OBJ)
    known = materialize(first.select(*OBJ, F.col("obj_id").alias("_at"), "_level"))
    deepest = known.agg(F.max("_level")).first()[0] or 0
    step = 1
    while step <= deepest:
        # A row of an ancestor at least ``step`` levels down gives one more, ``step`` further up.
        higher = spread_lookup(known.where(F.col("_level") >= step), jumps.select(*at, "_to"), at, per_key)
        known = materialize(known.unionByName(higher.select(*OBJ, F.col("_to").alias("_at"), F.col("_level") - step)
                                              .toDF(*known.columns)))
        if 2 * step <= deepest:
            far = jumps.where(F.col("level") >= 2 * step).select("doc_id", F.col("_at").alias("_from"), F.col("_to").alias("_at"), "level")
            far = spread_lookup(materialize(far), jumps.select(*at, "_to"), at, per_key)
            jumps = BucketedTable.write(far.select("doc_id", F.col("_from").alias("_at"), "_to", "level"), at).df
        step *= 2
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_level", "_at"))), lambda x: x["_at"])
    paths = known.groupBy(*OBJ).agg(ids.alias("ids"))
    return wanted.join(paths, OBJ, "left").select(
        *OBJ,
        "ids",
        F.when(F.col("ids").isNull(), F.lit("object is not reachable from the catalog")).alias("error"),
    )


# --- references seen from their target ---------------------------------------


def reverse_refs(edges: DataFrame, reached: DataFrame, objects: DataFrame, paths: DataFrame) -> DataFrame:
    """Inbound references of every object, from reachable parents only.

    ``paths`` has ``doc_id, obj_id, root_path``: where each parent was first met.
    A parent without a type is labelled by the last key of its own first inbound
    path. Reachability is a semi join on the source, the type a join on the same
    key, so one layout of the edges serves both.
    """
    parents = (
        reached.select(*OBJ)
        .join(objects.select(*OBJ, "obj_num", "gen", "type_name"), OBJ)
        .join(paths, OBJ, "left")
        .withColumnRenamed("obj_id", "src_id")
    )
    inbound = edges.join(parents, ["doc_id", "src_id"]).select(
        "doc_id",
        F.col("dst_id").alias("obj_id"),
        F.col("src_id").alias("parent_id"),
        F.col("type_name").alias("parent_type"),
        "path",
        F.coalesce("root_path", F.lit("")).alias("parent_path"),
        F.col("obj_num").alias("parent_num"),
        F.col("gen").alias("parent_gen"),
    )
    return parent_label_fallback(inbound)


def parent_label_fallback(inbound: DataFrame) -> DataFrame:
    """Label untyped parents by the last key of their first inbound path."""
    order = F.struct("parent_num", "parent_gen", "path", "parent_id")
    labels = inbound.groupBy("doc_id", "obj_id").agg(
        F.regexp_extract(F.min_by("path", order), r"^.*/([^/\s\[\]]+)[^/]*$", 1).alias("_label")
    ).withColumnRenamed("obj_id", "parent_id")
    return inbound.join(labels, ["doc_id", "parent_id"], "left").select(
        *inbound.columns[:3],
        F.coalesce("parent_type", F.nullif(F.col("_label"), F.lit(""))).alias("parent_type"),
        *inbound.columns[4:],
    )


def root_paths(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """``doc_id, obj_id, root_path``: key path along the walk's parent pointers."""
    links = (
        edges.join(
            reached.where("parent_id IS NOT NULL").select(
                "doc_id", F.col("obj_id").alias("dst_id"), F.col("parent_id").alias("src_id"), "level"
            ),
            ["doc_id", "src_id", "dst_id"],
        )
        .groupBy("doc_id", "src_id", "dst_id", "level")
        .agg(F.min_by("path", "ord").alias("path"))
    )
    links = materialize(links.repartition("doc_id", "src_id"))
    current = materialize(
        reached.where("level = 0").select(*OBJ, F.lit("").alias("root_path"))
    )
    out = Levels(current)
    while not current.isEmpty():
        nxt = current.withColumnRenamed("obj_id", "src_id").join(links, ["doc_id", "src_id"]).select(
            "doc_id",
            F.col("dst_id").alias("obj_id"),
            F.trim(F.concat_ws(" ", "root_path", "path")).alias("root_path"),
        )
        current = materialize(nxt)
        out.add(current)
    return out.all()


# --- containers below a node -------------------------------------------------

NODE = ["doc_id", "obj_id", "at"]
_VALUE = ["idx", "value_type", "value_raw", "value", "ref_id"]


class NodeReader:
    """Reads dictionaries by place: an object, or a dictionary inside one.

    A node is ``doc_id, obj_id, at`` with ``at`` the path inside the object. What a
    walk asks of its nodes at every level is made once for all nodes, with references
    followed, and bucketed by node: a row of named entries, or the elements of an
    array. A level then joins that table and moves its own nodes only.
    """

    def __init__(self, entries: DataFrame, per_bucket: int = EDGES_PER_BUCKET):
        self.per_bucket = per_bucket
        self.below = entries.where(F.size("path") > 0).select(
            "doc_id", "obj_id", F.col("parent_path").alias("at"), "path", "key", *_VALUE)
        roots = root_rows(entries).select(
            "doc_id", F.col("obj_id").alias("ref_id"), F.col("value_type").alias("target_type"),
            F.col("value_raw").alias("target_raw"), F.col("value").alias("target_value"))
        # Dealt by target once, so following references moves the references only.
        self.roots = BucketedTable.write(roots, ["doc_id", "ref_id"]).df
        self._pivots: dict[tuple, DataFrame] = {}
        self._arrays: dict[str, SpreadTable] = {}

    @functools.cached_property
    def elements(self) -> SpreadTable:
        """Elements of every array."""
        rows = self.below.where("idx IS NOT NULL").select(*NODE, "path", *_VALUE)
        return SpreadTable(rows, NODE, "path", self.per_bucket)

    def table(self, names: list[str] | dict[str, str], resolve: bool = False) -> DataFrame:
        """Every node that has one of the entries, with the entries as structs; bucketed by node."""
        named = names if isinstance(names, dict) else {k: k for k in names}
        asked = (tuple(named.items()), resolve)
        if asked not in self._pivots:
            fields = ["value_type", "value_raw", "value", "ref_id"]
            rows = self.below.where(F.col("key").isin(list(named)))
            if resolve:
                rows = self.resolved(rows)
                fields += ["target_type", "target_raw", "target_value"]
            value = F.struct(*fields)
            found = rows.groupBy(*NODE).agg(*[F.max(F.when(F.col("key") == k, value)).alias(a) for k, a in named.items()])
            self._pivots[asked] = BucketedTable.write(found, NODE, laid=True).df
        return self._pivots[asked]

    def keys(self, nodes: DataFrame, names: list[str] | dict[str, str], resolve: bool = False) -> DataFrame:
        """``nodes`` (``doc_id, obj_id, at``, ...) with the named entries as structs.

        A mapping gives other column names, for keys that differ in case only.
        With ``resolve`` a struct also has the ``target_type``, ``target_raw`` and
        ``target_value`` of the object it points at.
        """
        return nodes.join(self.table(names, resolve), NODE, "left")

    def resolved(self, rows: DataFrame) -> DataFrame:
        """Rows with ``ref_id`` plus the type and value of what it points at."""
        return lookup_left(rows, self.roots, ["doc_id", "ref_id"])

    def array(self, key: str) -> SpreadTable:
        """Elements of the array under ``key`` of every node, which may be a reference to one.

        ``idx, value_type, value_raw, value, ref_id``, the type, raw and value of what a
        reference points at, and the element's own place ``item_obj, item_at``: the
        referenced object where the element is a reference.
        """
        if key not in self._arrays:
            nowhere = F.array().cast("array<string>")
            owners = self.below.where(F.col("key") == key).select(
                "doc_id", F.col("obj_id").alias("_obj"), F.col("at").alias("_at"),
                F.coalesce("ref_id", "obj_id").alias("obj_id"), F.when(F.col("ref_id").isNull(), F.col("path")).otherwise(nowhere).alias("at"))
            items = self.elements.join(owners).select(
                "doc_id", F.col("_obj").alias("own_obj"), F.col("_at").alias("own_at"), *_VALUE,
                F.coalesce("ref_id", "obj_id").alias("item_obj"),
                F.when(F.col("ref_id").isNull(), F.col("path")).otherwise(nowhere).alias("item_at"))
            rows = self.resolved(items).withColumnsRenamed({"own_obj": "obj_id", "own_at": "at"})
            self._arrays[key] = SpreadTable(rows, NODE, "idx", self.per_bucket)
        return self._arrays[key]

    def items(self, nodes: DataFrame, key: str, resolve: bool = False) -> DataFrame:
        """Elements of the array under ``key`` of each node, see :meth:`array`; other columns are kept.

        With ``resolve`` the target's type, raw and value are there too.
        """
        kept = [c for c in nodes.columns if c not in NODE]
        target = ["target_type", "target_raw", "target_value"] if resolve else []
        return self.array(key).join(nodes).select("doc_id", *kept, *_VALUE, *target, "item_obj", "item_at")


# --- expansion ---------------------------------------------------------------


def resolve(entries: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Expand references inline, up to ``depth`` levels if it is given.

    ``roots`` has ``doc_id, obj_id``. Rows: ``doc_id, root_id, path, depth,
    value_type, value, ref_id, flag``; ``flag`` is ``cyclic`` when the reference
    re-enters its own path, ``truncated`` when it is past the depth or dangling.
    A reference met twice on different paths is neither, and is expanded twice.
    """
    body = materialize(
        entries.where(F.size("path") > 0)
        .select(*OBJ, "path", "value_type", "value", "ref_id")
        .repartition(*OBJ)
    )
    present = root_rows(entries).select("doc_id", F.col("obj_id").alias("ref_id"), F.lit(True).alias("_ok"))
    frontier = roots.select(
        "doc_id",
        F.col("obj_id").alias("root_id"),
        "obj_id",
        F.array().cast("array<string>").alias("_prefix"),
        F.array("obj_id").alias("_ids"),
    ).distinct()
    out: Levels | None = None
    for level in itertools.count():
        rows = frontier.join(body, OBJ).select(
            "doc_id",
            "root_id",
            F.concat("_prefix", "path").alias("path"),
            F.lit(level).alias("depth"),
            "value_type",
            "value",
            "ref_id",
            "_ids",
        )
        cyclic = F.array_contains("_ids", F.col("ref_id"))
        past = F.lit(depth is not None and level >= depth)
        rows = rows.join(present, ["doc_id", "ref_id"], "left").select(
            "doc_id", "root_id", "path", "depth", "value_type", "value", "ref_id", "_ids",
            F.when(F.col("ref_id").isNull(), F.lit(None))
            .when(cyclic, "cyclic")
            .when(past | F.col("_ok").isNull(), "truncated")
            .alias("flag"),
        )
        rows = materialize(rows)
        if out is None:
            out = Levels(rows)
        else:
            out.add(rows)
        frontier = rows.where("ref_id IS NOT NULL AND flag IS NULL").select(
            "doc_id",
            "root_id",
            F.col("ref_id").alias("obj_id"),
            F.col("path").alias("_prefix"),
            F.array_append("_ids", F.col("ref_id")).alias("_ids"),
        )
        if level == depth or frontier.isEmpty():
            break
    return out.all().drop("_ids")


#: The step behind every reference followed; no key holds this character.
FOLLOWED = "\0"


def in_order(path: Column) -> Column:
    """A path whose steps sort in document order: array positions in ten digits."""
    return F.transform(path, lambda s: F.when(s.rlike(r"^\[\d+\]$"), F.concat(F.lit("["), F.lpad(F.substring_index(F.substring(s, 2, 20), "]", 1), 10, "0"), F.lit("]"))).otherwise(s))


def from_order(path: Column) -> Column:
    """The path that :func:`in_order` was made from."""
    return F.transform(path, lambda s: F.regexp_replace(s, r"^\[0*(\d+)\]$", r"[$1]"))


def resolve_once(entries: DataFrame, roots: DataFrame, per_bucket: int = EDGES_PER_BUCKET) -> DataFrame:
    """What each root refers to, one row an object: least path, number of paths, cyclic or not.

    ``roots`` has ``doc_id, obj_id``. See :func:`closure`; objects that are not there
    count as met. :func:`resolve` lists every path instead, of which there may be
    exponentially many.
    """
    links = entries.where("ref_id IS NOT NULL").select(
        "doc_id", F.col("obj_id").alias("src_id"), F.col("ref_id").alias("dst_id"), in_order(F.col("path")).alias("step"))
    starts = roots.select("doc_id", F.col("obj_id").alias("root_id"), "obj_id")
    return closure(links, starts, per_bucket).withColumn("path", from_order(F.col("path")))


def tree_dump(entries: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The tree below each root with every object expanded once.

    Rows: ``doc_id, root_id, path, depth, value_type, value, ref_id``. ``depth`` counts
    references followed. An object is expanded where a depth-first reader meets it
    first. With ``max_depth`` it is expanded where it is met first within that depth.
    """
    step = in_order(F.col("path"))
    present = root_rows(entries).select("doc_id", F.col("obj_id").alias("ref_id")).distinct()
    links = entries.where("ref_id IS NOT NULL").join(present, ["doc_id", "ref_id"], "left_semi").select(
        *OBJ, F.col("ref_id").alias("to_obj_id"), F.concat(step, F.array(F.lit(FOLLOWED))).alias("step"))
    starts = roots.select("doc_id", F.col("obj_id").alias("root_id"), "obj_id", F.array().cast("array<string>").alias("label"))
    met = first_sight(links, starts, ["obj_id"], ["doc_id", "root_id"], max_steps=max_depth)
    body = SpreadTable(entries.where(F.size("path") > 0).select(*OBJ, "path", "value_type", "value", "ref_id"), list(OBJ), "path")
    prefix = F.filter("label", lambda s: s != FOLLOWED)
    return body.join(met.withColumn("_depth", F.size("label") - F.size(prefix))).select(
        "doc_id", "root_id", F.concat(from_order(prefix), "path").alias("path"), F.col("_depth").alias("depth"), "value_type", "value", "ref_id")
