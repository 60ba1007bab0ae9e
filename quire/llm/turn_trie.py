"""A prefix trie of conversations, built as burst tries.

A conversation is a sequence of turn ids. Equal sequences are one row with their
members counted. All sequences start in one container under the root. A container of
more than ``burst`` sequences bursts: its head moves down by what all of them share,
and the next turn id deals them into containers below. The containers that remain
are sorted and swept, each in one pass with the current path in memory, and hand the
sums of their top node up the heads.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

BURST = 4096
#: Rows of a container are dealt over so many tasks when they meet the container's facts.
SALT = 64
#: Bytes of id lists that are joined to one text before hashing.
LIST_ROWS = 4096
ID = ["s1", "s2"]
NO_MEMBERS = hashlib.sha256(b"").digest()


# --- sequences ---------------------------------------------------------------


def turn_sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq``: turn ids with the code points of their text, by turn (null first), then role and text.

    A null role or text is empty. Rows without a conversation id belong to none.
    """
    held = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).isNotNull().alias("t0"), F.coalesce(F.col(turn), F.lit(0)).alias("t1"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    held = held.withColumn("tid", F.xxhash64("role", "text"))
    place = ["conv_id", "t0", "t1"]
    rows = materialize(held.select(*place, "tid", F.length("text").alias("chars")))
    # Only different turns of one number need their texts to be ordered.
    tied = materialize(rows.groupBy(*place).agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b").select(*place))
    rank = F.lit(0).cast("long")
    if not tied.isEmpty():
        texts = held.join(tied, place, "left_semi").groupBy(*place, "role", "text").agg(F.first("tid").alias("tid"))
        # Numbers that rise with the sorted order, over all partitions.
        sorted_rows = materialize(texts.repartitionByRange(*place, "role", "text").sortWithinPartitions(*place, "role", "text"))
        ranks = sorted_rows.select(*place, "tid", F.monotonically_increasing_id().alias("_rank"))
        rows = rows.join(ranks, [*place, "tid"], "left")
        rank = F.coalesce("_rank", F.lit(0).cast("long"))
    step = F.struct("t0", "t1", rank.alias("rank"), "tid", "chars")
    seq = F.transform(F.sort_array(F.collect_list(step)), lambda t: F.struct(t["tid"].alias("tid"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(seq.alias("seq"))


def rebuilt(sequences: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of conversation ``c - c % block``; h is crc32(c) modulo ``most``."""
    heads = sequences.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("seq", 1, most - 1).alias("_head"))
    own = sequences.withColumn("_base", F.col("conv_id") - F.col("conv_id") % block)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rest = F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("seq", 1, 0))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("seq"))


def _list_hashes(members: DataFrame) -> DataFrame:
    """``s1, s2, ends``: SHA-256 of each sequence's ids, ascending, joined by commas.

    The ids are sorted over all tasks and joined to texts of some thousand ids first;
    only these texts of a sequence meet in one task, where they pass one by one.
    """
    order = [*ID, "conv_id"]
    ids = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def close() -> None:
            if held:
                out.append((*key, held[0], ",".join(map(str, held)).encode()))
                held.clear()

        for b in batches:
            for s1, s2, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (s1, s2) != key or len(held) >= LIST_ROWS:
                    close()
                    key = (s1, s2)
                held.append(conv)
            if len(out) > 1000:
                yield _batch(out, LISTS)
                out = []
        close()
        yield _batch(out, LISTS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for s1, s2, text in zip(*(c.to_pylist() for c in b.columns)):
                if (s1, s2) != key:
                    if state:
                        out.append((*key, state.digest()))
                    key, state = (s1, s2), hashlib.sha256(text)
                else:
                    state.update(b"," + text)
            if len(out) > 1000:
                yield _batch(out, ENDS)
                out = []
        if state:
            out.append((*key, state.digest()))
        yield _batch(out, ENDS)

    lists = ids.mapInArrow(join, "s1 long, s2 long, first long, ids binary")
    dealt = lists.repartition(*ID).sortWithinPartitions(*ID, "first").select(*ID, "ids")
    return dealt.mapInArrow(digest, "s1 long, s2 long, ends binary")


LISTS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
ENDS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("ends", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """Each distinct sequence once: ``s1, s2`` (its hash), tids, chars, n, conv (smallest member), ends."""
    tids = F.transform("seq", lambda t: t["tid"])
    keyed = materialize(sequences.select("conv_id", F.xxhash64(tids).alias("s1"), F.xxhash64(F.lit(1), tids).alias("s2"), "seq"))
    groups = keyed.groupBy(*ID).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("seq").alias("seq"))
    return groups.join(_list_hashes(keyed), ID).select(
        *ID, tids.alias("tids"), F.transform("seq", lambda t: t["chars"]).alias("chars"), "n", "conv", "ends")


# --- bursting ----------------------------------------------------------------


def _shared(a: str, b: str) -> Column:
    """Length of the common beginning of two arrays without nulls."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _with_facts(rows: DataFrame, facts: DataFrame, how: str = "inner", key: str = "cid") -> DataFrame:
    """Join a few facts a container to its many rows; no task gets all rows of a container."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    deal = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("tids", "chars")]), F.lit(SALT)).cast("int")
    return rows.withColumn("_salt", deal).join(salted, [key, "_salt"], how).drop("_salt")


def burst_containers(sequences: DataFrame, burst: int = BURST) -> tuple[DataFrame, list[DataFrame]]:
    """Sequences with their container, and the heads of every round.

    Sequences get ``cid`` (container), ``parent`` (the container that burst into it)
    and ``d0`` (turns of its head). Heads have cid, parent, d0, ``deep`` (turns that all
    of its sequences share), chars of these turns, and ``n, conv, ends`` of the sequence
    that ends there (0 and nulls, if none does). A container of a few sequences is no
    larger than they are; every burst parts at least two sequences.
    """
    root = F.lit(0).cast("long")
    open_rows = materialize(sequences.withColumns({"cid": root, "parent": F.lit(None).cast("long"), "d0": F.lit(0)}))
    done: list[DataFrame] = []
    heads: list[DataFrame] = []
    while True:
        facts = open_rows.groupBy("cid").agg(F.count("*").alias("_n"), F.min("tids").alias("_low"), F.max("tids").alias("_high"))
        over = materialize(facts.where(F.col("_n") > burst).select("cid", _shared("_low", "_high").alias("deep")))
        if over.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, open_rows]), heads
        marked = materialize(_with_facts(open_rows, over, "left"))
        done.append(marked.where("deep IS NULL").drop("deep"))
        inside = marked.where("deep IS NOT NULL")
        ends = F.size("tids") == F.col("deep")
        heads.append(materialize(inside.groupBy("cid", "parent", "d0", "deep").agg(
            F.min_by(F.slice("chars", 1, F.col("deep")), F.struct(*ID)).alias("chars"),
            *[F.max(F.when(ends, F.col(c))).alias(c) for c in ("n", "conv", "ends")],
        )))
        below = inside.where(~ends).withColumns({"parent": F.col("cid"), "d0": F.col("deep") + 1})
        cid = F.xxhash64("cid", "d0", F.element_at("tids", F.col("d0")))
        open_rows = materialize(below.withColumn("cid", cid).drop("deep"))


# --- sweeping ----------------------------------------------------------------

NODES = pa.schema([
    ("cid", pa.int64()), ("parent", pa.int64()), ("top", pa.bool_()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.binary()),
])
NODES_DDL = (
    "cid long, parent long, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary"
)


class _Node:
    """A node of the current path, with its closed children waiting for its smallest member."""

    __slots__ = ("depth", "chars", "n", "conv", "ends", "leaves", "saved", "closed")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.n = self.leaves = self.saved = 0
        self.conv = self.ends = None
        self.closed: list[_Node] = []

    def count(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


class _Sweep:
    """The nodes of one container from its sorted sequences."""

    def __init__(self, cid: int, parent: int | None, d0: int):
        self.cid, self.parent, self.d0 = cid, parent, d0
        self.path: list[_Node] = []
        self.before: list[int] = []
        self.rows: list[tuple] = []

    def row(self, node: _Node, parent_conv: int | None, top: bool) -> None:
        self.rows.append((
            self.cid, self.parent, top, node.depth, node.conv, parent_conv, node.n, len(node.closed), node.leaves, node.saved, node.ends,
        ))

    def close(self) -> None:
        node = self.path.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.chars
        for child in node.closed:
            self.row(child, node.conv, False)
        if not self.path:
            self.row(node, None, True)
            return
        up = self.path[-1]
        up.count(node.n, node.conv)
        up.leaves += node.leaves
        up.saved += node.saved
        node.closed = [None] * len(node.closed)
        up.closed.append(node)

    def take(self, tids: list[int], chars: list[int], n: int, conv: int, ends: bytes) -> None:
        """The next sequence in order; nodes that it does not pass are closed."""
        if not self.path:
            self.path.append(_Node(self.d0, chars[self.d0 - 1] if self.d0 else 0))
        shared = self.d0
        while shared < min(len(tids), len(self.before)) and tids[shared] == self.before[shared]:
            shared += 1
        while len(self.path) - 1 > shared - self.d0:
            self.close()
        for d in range(shared, len(tids)):
            self.path.append(_Node(d + 1, chars[d]))
        self.path[-1].count(n, conv)
        self.path[-1].ends = ends
        self.before = tids


def sweep_containers(sequences: DataFrame) -> DataFrame:
    """Nodes of every container from its head down; ``top`` marks the head's own node."""
    columns = ["cid", "parent", "d0", "tids", "chars", "n", "conv", "ends"]
    dealt = sequences.select(*columns).repartition("cid").sortWithinPartitions("cid", "tids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                for cid, parent, d0, *sequence in zip(*(c.to_pylist() for c in b.slice(a, 1000).columns)):
                    if sweep is None or sweep.cid != cid:
                        rows = _end(sweep)
                        sweep = _Sweep(cid, parent, d0)
                        sweep.rows = rows
                    sweep.take(*sequence)
                yield _batch(sweep.rows, NODES)
                sweep.rows = []
        yield _batch(_end(sweep), NODES)

    return dealt.mapInArrow(run, NODES_DDL)


def _end(sweep: _Sweep | None) -> list[tuple]:
    while sweep and sweep.path:
        sweep.close()
    return sweep.rows if sweep else []


# --- heads -------------------------------------------------------------------


def _head_nodes(heads: list[DataFrame], swept: DataFrame) -> list[DataFrame]:
    """Nodes above the containers, from the last round of bursts up, in the columns of ``swept``.

    A head stands for a chain from d0 to deep turns: all its nodes have the same members.
    """
    tops = swept.where("top").select("cid", "parent", F.col("conv_id").alias("conv"), "n_convs", "n_leaves", "saved_tokens")
    out = []
    for round_heads in reversed(heads):
        below = tops.groupBy(F.col("parent").alias("cid")).agg(
            F.min("conv").alias("_conv"), F.sum("n_convs").alias("_n"), F.count("*").alias("_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved"))
        known = round_heads.join(below, "cid").withColumns({
            "conv": F.least("_conv", "conv"), "n": F.col("_n") + F.coalesce("n", F.lit(0).cast("long")),
        })
        chain = known.withColumn("depth", F.explode(F.sequence("d0", "deep")))
        # Turns e..deep, each counted by its last text; a node of no turns has no text.
        under = F.expr("aggregate(slice(chars, greatest(depth, 1), deep - greatest(depth, 1) + 1), 0L, (s, x) -> s + x)")
        last, top = F.col("depth") == F.col("deep"), F.col("depth") == F.col("d0")
        nodes = materialize(chain.select(
            "cid", "parent", top.alias("top"), F.col("depth").cast("long").alias("depth"), F.col("conv").alias("conv_id"),
            F.when(~top, F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
            (F.col("_saved") + (F.col("n") - 1) * under).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"),
        ))
        out.append(nodes)
        tops = tops.unionByName(
            nodes.where("top").select("cid", "parent", F.col("conv_id").alias("conv"), "n_convs", "n_leaves", "saved_tokens"))
    return out


def prefix_trie(sequences: DataFrame, burst: int = BURST) -> DataFrame:
    """Nodes of the trie of ``conv_id, seq`` (see :func:`turn_sequences`), one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Conversation ids are longs, each once. A table without
    conversations has no node. A conversation's turn ids and lengths lie in one row,
    12 bytes a turn; all else is spread over tasks, whatever repeats. The ids of equal
    conversations are hashed in one pass, as SHA-256 has an order.
    """
    placed, heads = burst_containers(materialize(distinct_sequences(sequences)), burst)
    swept = materialize(sweep_containers(placed))
    nodes = functools.reduce(DataFrame.unionByName, [swept, *_head_nodes(heads, swept)])
    if heads:
        # A top node's parent is the last node of the chain that it was burst from.
        above = functools.reduce(DataFrame.unionByName, _head_tops(nodes, heads))
        tops = _with_facts(nodes.where("top").drop("parent_conv_id"), above, "left", "parent")
        nodes = nodes.where("NOT top").unionByName(tops.withColumnRenamed("_above", "parent_conv_id"))
    none = F.lit(NO_MEMBERS)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.lower(F.hex(F.coalesce("ends", none))).alias("ends_sha256"))


def _head_tops(nodes: DataFrame, heads: list[DataFrame]) -> list[DataFrame]:
    """``parent, _above``: the smallest member of every container that burst."""
    tops = nodes.where("top").select(F.col("cid").alias("parent"), F.col("conv_id").alias("_above"))
    return [tops.join(h.select(F.col("cid").alias("parent")), "parent", "left_semi") for h in heads]
