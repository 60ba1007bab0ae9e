"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Tokenizing runs once per document inside Arrow batches and keeps only lengths and
checksums (or the ids, on request). Pieces of full length are sequences of their
own. The others, at most one per document, are dealt by hash into groups of about
``PER_GROUP`` pieces, and each group is packed by itself: a group leaves at most one
badly filled sequence, so the loss against packing all at once is under one sequence
in a thousand, whatever the number of documents.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.hashing import sliced
from quire.session import materialize

PER_GROUP = 8192
#: Word encodings that a Python worker remembers.
CACHED_WORDS = 250_000
#: A single space starts a token when a non-space follows; other places need the whole text.
_OTHER_SPACE = re.compile(r" (?=\s|\Z)")


@functools.lru_cache(maxsize=2)
def _rank_encoding(path: str):
    """The tokenizer of a rank file; its ids are those of the JSON file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Ids of words, as little-endian 32-bit bytes; ``before`` stands before each."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.before + word)).tobytes()
        if len(word) < 60:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _words(path: str) -> tuple:
    encode = _rank_encoding(path).encode_ordinary
    return encode, _Words(encode, " ")


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit bytes; nothing for null."""
    encode, words = _words(path)
    if not text:
        return b""
    if _OTHER_SPACE.search(text):
        return array("I", encode(text)).tobytes()
    first, *rest = text.split(" ")
    return array("I", encode(first)).tobytes() + b"".join(map(words.__getitem__, rest))


def tokenize_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_len: int = 2048,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32, and ``ids`` on request.

    A document is its ids and ``end_id``. Longer ones than ``max_len`` are cut into
    pieces of ``max_len``; the first takes the remainder. A null or empty text is the
    end id alone. Every row makes its own pieces, repeated ids included; the other
    columns of ``docs`` are not carried. Strings of special tokens are ordinary text.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType
    fields = [
        T.StructField(id_col, id_type),
        T.StructField("piece", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
        *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids,
    ]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in fields]
            source: list[int] = []
            for i, text in enumerate(batch.column(1)):
                data = token_bytes(text.as_py(), path) + end
                n = len(data) // 4
                cut = [0, *range(n % max_len or max_len, n + 1, max_len)] if n > max_len else [0, n]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    part = data[4 * a : 4 * b]
                    source.append(i)
                    for column, value in zip(rows[1:], (k, a, b - a, zlib.crc32(part))):
                        column.append(value)
                    if with_ids:
                        rows[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            ids = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(kinds[0]), *[pa.array(r, k) for r, k in zip(rows[1:], kinds[1:])]], names)

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins.

    A bin is filled greedily with the largest items that fit. Then its smallest item
    gives way to two unpacked ones, if some pair fills the gap better: the pair with
    the largest sum. Items of equal length are taken in their given order.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(int(lengths[i]), []).append(i)
    # Bit n of mask: an unpacked item of length n exists; bit capacity - n of turned likewise.
    mask = turned = 0
    for n in stacks:
        mask |= 1 << n
        turned |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal mask, turned
        item = stacks[n].pop()
        if not stacks[n]:
            mask &= ~(1 << n)
            turned &= ~(1 << (capacity - n))
        return item

    def give(n: int, item: int) -> None:
        nonlocal mask, turned
        stacks[n].append(item)
        mask |= 1 << n
        turned |= 1 << (capacity - n)

    def pair(room: int, more_than: int) -> tuple[int, int] | None:
        """Two unpacked lengths of the largest sum in (more_than, room]."""
        for total in range(room, more_than, -1):
            # Bit n stays where n and total - n both exist.
            both = mask & (turned >> (capacity - total)) & ((1 << total) - 1)
            while both:
                n = both.bit_length() - 1
                if 2 * n != total or len(stacks[n]) > 1:
                    return n, total - n
                both &= ~(1 << n)
        return None

    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while mask:
        held: list[tuple[int, int]] = []
        gap = capacity
        while fits := mask & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and mask and (two := pair(gap + held[-1][0], held[-1][0])):
            give(*held.pop())
            held += [(n, take(n)) for n in two]
        at = 0
        for n, item in held:
            bins[item], offsets[item] = n_bins, at
            at += n
        n_bins += 1
    return bins, offsets, n_bins


def pack(pieces: DataFrame, n_groups: int, id_col: str = "doc_id", max_len: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to pieces; columns of those names are replaced.

    Within a sequence the offsets are gapless from 0. Sequence ids are unique, not
    dense: full pieces take ids from their task, packed ones from their group. An
    empty table gives an empty one; equal rows are packed as separate pieces.
    """
    pieces = pieces.drop("sequence_id", "offset")
    full = F.col("length") >= max_len
    whole = pieces.where(full).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.expr("0L").alias("offset"))
    rest = pieces.where(~full)
    group = F.pmod(F.xxhash64(id_col, "piece", "length", "ids_crc32"), F.lit(n_groups))
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop(["_group"]).sort_by([(c, "ascending") for c in ("length", id_col, "piece", "ids_crc32")])
        bins, offsets, _ = best_two_fit(table.column("length").to_numpy(), max_len)
        # The top bit but one keeps these ids apart from those of the full pieces.
        ids = (1 << 62) + (int(key[0].as_py()) << 32) + bins
        return table.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    packed = rest.withColumn("_group", group).groupBy("_group").applyInArrow(fill, schema)
    return whole.unionByName(packed)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_len: int = 2048,
    end_id: int = 0, with_ids: bool = False, per_group: int = PER_GROUP,
) -> DataFrame:
    """Tokenize and pack: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The pieces are written to the checkpoint folder once, so that full pieces and
    packed ones come from one tokenizing pass and their ids survive lost executors.
    """
    pieces = materialize(tokenize_pieces(docs, id_col, text_col, path, max_len, end_id, with_ids))
    n_groups = max(1, -(-pieces.where(F.col("length") < max_len).count() // per_group))
    return pack(pieces, n_groups, id_col, max_len)
