"""Jaccard self-join of documents on word shingles, by token-combination prefixes.

Similar sets overlap in at least ``need(n)`` of a set's n tokens, so a prefix of
``n - need(n) + 1`` tokens in any global order meets every partner's prefix. Here
the order is by frequency, rare first. Rare tokens are indexed one by one. Frequent
ones (``FREQUENT`` sets or more) fall into classes by hash, and only pairs of a
class are indexed; the prefix is extended by one token for each class that it
touches. Then two similar sets share a single rare token or a pair of a frequent
class: were there no such pair, each class would hold at most one shared token, and
too many tokens of the shorter prefix would be unshared. Tokens that no other set
has are never indexed at all, and a set with enough of them has no partner.

Frequencies are counted over all documents, within size bands (a set belongs to the
band of its size, and to the next one if partners can lie there). Bands of larger
sets count and index the tokens with the smallest hashes, about a quarter; sets with
too few of these for a prefix add the tokens that follow, ordered after all others.

Equal sets are one vertex. A group of sets under one key is not expanded into
pairs: each round compares its members with one of them, verifies these links
exactly and merges components, as long as that joins many. Members that are still
in other components than most of their group meet all others of it, unless a sketch
rules the pair out: a bit says whether an even or odd number of the set's tokens fall
into its place, so the differing bits of two sketches are at most the unshared tokens.
Tokens and sets are identified by 64-bit hashes; texts are verified by their sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.components import compacted, connected_components
from quire.llm.hashing import SPACE_BYTES, U, Words, hash_words, in_runs, mix, shingles, sliced
from quire.session import materialize

FREQUENT = 64
HUB_ROUNDS = 6  # at most; rounds end sooner when they stop helping
SKETCH_BITS = 1024
#: Ids up to this number are broadcast to pick the texts to verify (about 40 MB at most).
BROADCAST_IDS = 500_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a similar set."""
    return -(-percent * n // 100)


def band_of(n: int) -> int:
    """0 for up to 32 tokens, then one more for every factor of four."""
    b, top = 0, 32
    while n > top:
        b, top = b + 1, top * 4
    return b


def bands(n: int, percent: int) -> list[int]:
    b = band_of(n)
    next_least = 32 * 4**b + 1
    return [b, b + 1] if 100 * n >= percent * next_least else [b]


def counted_below(band: int, percent: int) -> int:
    """Token hashes below this count in a band: all of them in the two lowest, else 1.6 times what prefixes need."""
    return 2**64 - 1 if band < 2 else min(2**64 - 1, 2**64 * (100 - percent) * 16 // 1000)


def n_classes(band: int) -> int:
    """Classes of frequent tokens; none in the lowest band, where all tokens are indexed singly."""
    return 4**band if band else 0


def sets_of(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; short texts have their whole sequence as one."""
    all_windows = shingles(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(all_windows[a : b - size + 1]))
        elif b > a:
            out.append(shingles(words.hashes[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    for _, run in in_runs(texts):
        yield from sets_of(hash_words([t.translate(_TO_LOWER) for t in run], SPACE_BYTES ^ True), size)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        m = mix(s + U(0x51ED270B))
        both = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m)]) * U(0xC2B2AE3D27D4EB4F) + U(len(s))
        return int(mix(mix(both[:1]) + both[1:]).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of ``SKETCH_BITS`` places, as signed longs."""
    with np.errstate(over="ignore"):
        place = (mix(s ^ U(0x5BD1E995)) % U(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def band_tokens(s: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """The tokens that a set shows in a band, as signed longs, and how many of them are counted.

    The lowest bit marks a token beyond the counted ones, the next four the band.
    """
    n = len(s)
    with np.errstate(over="ignore"):
        h = np.sort(mix(s ^ U(0x9E37 + band)))
    counted = n if band < 2 else int(np.searchsorted(h, U(counted_below(band, percent))))
    # Enough for the longest extended prefix.
    shown = min(n, max(counted, n - need(n, percent) + 2 + n_classes(band)))
    tokens = (h[:shown] & ~U(31)) | U(band << 1)
    tokens[counted:] |= U(1)
    return tokens.view(np.int64), counted


def keys_of_set(n: int, band: int, counted: int, shared: list[tuple[int, int]], percent: int) -> list[int]:
    """Index keys of a set in a band from its tokens that other sets have: (frequency, token)."""
    missing = n - need(n, percent) + 1
    extra = sorted(t for _, t in shared if t & 1)
    known = sorted((df, t) for df, t in shared if not t & 1)
    missing -= counted - len(known)
    keys: list[int] = []
    classes: dict[int, list[int]] = {}
    split = n_classes(band)
    for df, token in known:
        if missing <= 0:
            return keys
        if df < FREQUENT or not split:
            keys.append(token)
            missing -= 1
            continue
        own = classes.setdefault((token >> 5) % split, [])
        keys += [_pair(t, token) for t in own]
        missing -= bool(own)
        own.append(token)
    # Extra tokens that no other set shows are missing here; indexing all is right, and they are few.
    return keys + extra if missing > 0 else keys


def _pair(a: int, b: int) -> int:
    a, b = sorted((a, b))
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x ^= x >> 32
    return x - 2**64 if x >= 2**63 else x


def _sets_pass(size: int, percent: int, id_kind: pa.DataType):
    """Per row: id, set size, set key, counted tokens in its bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for s in text_sets(batch.column(1).to_pylist(), size):
                n = len(s)
                counts = [band_tokens(s, b, percent)[1] for b in bands(n, percent)] if n else []
                rows.append((n, set_key(s) if n else 0, counts, sketch(s) if n else None))
            n, key, counts, bits = zip(*rows) if rows else ((), (), (), ())
            longs = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_kind), pa.array(n, longs), pa.array(key, longs), pa.array(counts, pa.list_(pa.int32())), pa.array(bits, pa.list_(longs))],
                ["id", "n", "key", "counted", "bits"],
            )

    return run


def _tokens_pass(size: int, percent: int):
    """Per set that the task has not seen: its tokens in its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            tokens, keys, lengths = [], [], []
            for s in text_sets(batch.column(0).to_pylist(), size):
                # Smaller sets are similar to equal ones only.
                if 100 * len(s) < percent * (len(s) + 1):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                for b in bands(len(s), percent):
                    t, _ = band_tokens(s, b, percent)
                    tokens.append(t)
                    keys.append(key)
                    lengths.append(len(t))
            if tokens:
                owner = np.repeat(np.array(keys, np.int64), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(owner)], ["token", "key"])

    return run


def _keys_pass(percent: int):
    """Per set with shared tokens: its index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple[int, int, int]] = []
            for key, n, counted, shared in zip(*(c.to_pylist() for c in batch.columns)):
                for b, c in zip(bands(n, percent), counted):
                    own = [(x["df"], x["token"]) for x in shared if (x["token"] >> 1) & 15 == b]
                    out += [(k, key, n) for k in keys_of_set(n, b, c, own, percent)]
            index, key, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["index", "key", "n"])

    return run


def _texts_pass(size: int):
    """Rows (key, text) whose text has the set of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = batch.column(0).to_pylist()
            fits = [set_key(s) == k for s, k in zip(text_sets(batch.column(1).to_pylist(), size), keys)]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return run


def _verify_pass(size: int):
    """Overlap and union of pairs of texts; a few sets are remembered, as hubs repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def get(key: int, text: str) -> np.ndarray:
            s = held.get(key)
            if s is None:
                s = held[key] = next(text_sets([text], size))
                if len(held) > 64:
                    held.popitem(last=False)
            else:
                held.move_to_end(key)
            return s

        for batch in sliced(batches):
            inter, union = [], []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = get(a, ta), get(b, tb)
                k = len(np.intersect1d(x, y, assume_unique=True))
                inter.append(k)
                union.append(len(x) + len(y) - k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "union"])

    return run


class _Join:
    """The steps over one table; ``docs`` has columns id and text."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        kind = docs.schema["id"].dataType
        schema = T.StructType([
            T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()),
            T.StructField("counted", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.LongType())),
        ])
        self.rows = materialize(docs.mapInArrow(_sets_pass(size, percent, to_arrow_type(kind)), schema))
        filled = self.rows.where(F.col("n") > 0)
        sets = filled.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "counted", "bits")])
        sets, _ = compacted(sets)
        self.sets, self.bits = sets.drop("bits"), sets.select("key", "bits")

    def index(self) -> DataFrame:
        """(index, key, n): the sets under every index key that several sets have."""
        tokens = self.docs.select("text").mapInArrow(_tokens_pass(self.size, self.percent), "token long, key long")
        # Tasks may repeat a set, so frequencies count distinct keys; both windows share one sort.
        by_token = Window.partitionBy("token")
        new = F.coalesce(F.lag("key").over(by_token.orderBy("key")) != F.col("key"), F.lit(True))
        tokens = tokens.withColumn("new", new.cast("int")).withColumn("df", F.sum("new").over(by_token))
        shared = tokens.where((F.col("df") >= 2) & (F.col("new") == 1))
        shared = shared.groupBy("key").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
        by_set = shared.join(self.sets, "key").select("key", "n", "counted", "shared")
        keys = by_set.mapInArrow(_keys_pass(self.percent), "index long, key long, n long")
        by_index = Window.partitionBy("index")
        # A set may show one key in two ways; it counts once.
        keys = keys.distinct().withColumn("members", F.count("*").over(by_index))
        return compacted(keys.where(F.col("members") >= 2).drop("members"))[0]

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Exact overlap of pairs (a, b) of keys: a, b, inter, union."""
        pairs, _ = compacted(pairs)
        nodes = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        ids, n_ids = compacted(nodes.join(self.sets, "key").select("key", "id"))
        wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
        texts = self.docs.join(wanted, "id").select("key", "text").mapInArrow(_texts_pass(self.size), "key long, text string")
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))
        left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return compacted(both.mapInArrow(_verify_pass(self.size), "a long, b long, inter long, union long"))[0]

    def links(self) -> DataFrame:
        """Enough verified links (a, b) to connect all similar sets."""
        groups = self.index()
        percent = self.percent
        links, done, outside = None, None, None
        for r in range(HUB_ROUNDS + 1):
            if links is None:
                # The same order everywhere, so that the groups of like sets share their first member.
                rank = F.xxhash64("key")
                rows = groups.withColumn("component", F.col("key"))
            else:
                rank, rows = F.struct("size", F.xxhash64("key", "index", F.lit(r))), self._open(groups, links)
            hubs = rows.groupBy("index").agg(F.max_by(F.struct("key", "n", "component"), rank).alias("hub"))
            rows = rows.join(hubs, "index").where("key = hub.key OR component <> hub.component")
            if links is not None:
                rows, _ = compacted(rows)
                before, outside = outside, rows.where("key <> hub.key").count()
                if not outside:
                    break
                if r == HUB_ROUNDS or (before is not None and 2 * outside > before):
                    pairs = self._rest(self._open(groups, links), rows)
                    links = self._grown(links, self.verify(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")))
                    break
            fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
            pairs = rows.where((F.col("key") != F.col("hub.key")) & fits)
            pairs = pairs.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
            if done is not None:
                pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
            checked = self.verify(pairs)
            done = checked if done is None else done.unionByName(checked)
            links = self._grown(links, checked)
        return links

    def _grown(self, links: DataFrame | None, checked: DataFrame) -> DataFrame:
        good = checked.where(100 * F.col("inter") >= self.percent * F.col("union")).select("a", "b")
        return good if links is None else compacted(links.unionByName(good))[0]

    def _open(self, groups: DataFrame, links: DataFrame) -> DataFrame:
        """Members of groups that span several components, with their component and its size."""
        parts = connected_components(links)
        sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
        parts = parts.join(sizes, "component").withColumnRenamed("node", "key")
        named = groups.join(parts, "key", "left")
        named = named.withColumns({"component": F.coalesce("component", "key"), "size": F.coalesce("size", F.lit(1))})
        by_index = Window.partitionBy("index")
        several = F.min("component").over(by_index) != F.max("component").over(by_index)
        return compacted(named.withColumn("several", several).where("several").drop("several"))[0]

    def _rest(self, groups: DataFrame, outside: DataFrame) -> DataFrame:
        """Pairs of a member outside its group's chosen component with all others of the group that the sketches allow."""
        percent = self.percent
        columns = ["index", "key", "n", "component", "bits"]
        left = outside.where("key <> hub.key").join(self.bits, "key").select(*[F.col(c).alias(f"x_{c}") for c in columns])
        right = groups.join(self.bits, "key").select(*[F.col(c).alias(f"y_{c}") for c in columns])
        fits = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
        differ = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
        # A similar pair leaves at most this share of both sets unshared.
        near = (100 + percent) * differ <= (100 - percent) * (F.col("x_n") + F.col("y_n"))
        apart = (F.col("x_component") != F.col("y_component")) & fits & near
        pairs = left.join(right, (F.col("x_index") == F.col("y_index")) & apart)
        return pairs.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more.

    One row per row of ``docs``: id, n_shingles (long), component_id (smallest id that
    links reach, itself included). Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z in
    lower case. Texts of fewer words are one shingle; null and wordless texts have
    none and link with nothing, their component is their own id. Rows of the same id
    are judged by their texts; rows without an id join components by theirs.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    join = _Join(plain, size, percent)
    parts = connected_components(join.links()).withColumnRenamed("node", "key")
    named = join.sets.select("key", "id").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    by_key = named.join(least, "component").select("key", "least")
    rows = join.rows.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    out = rows.join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
