"""Benchmark passages in documents: SimHash windows of item size, multi-index Hamming search, exact check.

Every window of a document, at every word, has a 64-bit SimHash of its words for
each item size of a geometric grid. An item is fingerprinted over the largest such size
at its start and its end, and over the next smaller one at its start, middle and end,
so that an edit near either end leaves a fingerprint as it was. The four 16-bit blocks
of a window are looked up in tables of the items' blocks with all values at distance 1.
Fingerprints within ``RADIUS`` = 7 agree up to one bit in at least one block, so none
within the radius is missed. What edits push beyond the radius (``by_shingles=False``
leaves it out) is found by shingles: a window of the similarity s shares s of the
item's weight, hence a shingle of any part of the item that weighs more than 1 - s;
every window that holds one is a candidate. Candidates are verified against the whole
item by weighted Jaccard similarity of five-word shingles, each weighing its
occurrences times its words' bytes; weights slide from one window to the next.

Words are runs of letters and digits, in lower case. Items of fewer than five words
have their whole sequence as the one shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.hashing import ALNUM_BYTES, Words, hash_words, in_runs, shingles, sliced

RADIUS = 7
SHINGLE = 5
SIMILARITY = 0.8
GRID = 1.25
LARGEST = 255  # words of a window: counts are kept in bytes
ITEMS_PER_PASS = 20_000
_BLOCK = 1 << 14  # windows handled at a time, so that their bits stay in the cache


def grid_size(n: int) -> int:
    """The largest size of the grid that is at most n words."""
    size = best = min(n, 4)
    while size <= min(n, LARGEST):
        best = size
        size = max(size + 1, int(size * GRID))
    return best


def places(n: int) -> list[tuple[int, int]]:
    """(words, first word) of the fingerprints of an item of n words."""
    large = grid_size(n)
    out = {(large, 0), (large, n - large)}
    # Items of fewer words than a shingle match as a whole only.
    if n >= SHINGLE:
        small = grid_size(large - 1)
        out |= {(small, 0), (small, (n - small) // 2), (small, n - small)}
    return sorted(out)


def simhash(bits: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words; bits has a row of 64 per word."""
    sums = np.zeros((len(bits) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=sums[1:])
    return _majority(sums, size, 0, len(bits) - size + 1)


def _majority(sums: np.ndarray, size: int, a: int, b: int) -> np.ndarray:
    # Counts are at most 255, so differences modulo 256 are exact.
    count = sums[a + size : b + size] - sums[a:b]
    return np.packbits(count > size // 2, axis=1).view(np.uint64)[:, 0]


def word_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)


@dataclass
class Table:
    """Fingerprints of a grid size: for each block, offsets of its values into their numbers."""

    size: int
    prints: np.ndarray
    numbers: np.ndarray
    offsets: list[np.ndarray]
    members: list[np.ndarray]
    taken: list[np.ndarray]

    @classmethod
    def of(cls, size: int, prints: np.ndarray, numbers: np.ndarray) -> Table:
        near = np.array([0, *[1 << b for b in range(16)]], np.uint16)
        offsets, members = [], []
        for block in prints.view(np.uint16).reshape(-1, 4).T:
            values = (block[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            offsets.append(np.searchsorted(values[order], np.arange(65537)))
            members.append((order // len(near)).astype(np.int64))
        return cls(size, prints, numbers, offsets, members, [np.diff(o) > 0 for o in offsets])

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and numbers of fingerprints at a distance up to the radius."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        found = []
        for k in range(4):
            hit = np.flatnonzero(self.taken[k][blocks[:, k]])
            value = blocks[hit, k].astype(np.int64)
            start = self.offsets[k][value]
            n = self.offsets[k][value + 1] - start
            window = np.repeat(hit, n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            item = self.members[k][at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(np.stack([window[close], item[close]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], self.numbers[pairs[:, 1]]


def weights(hashes: np.ndarray, sizes: np.ndarray, shingle: int = SHINGLE) -> Counter:
    """Weight of every shingle: occurrences times the bytes of its words."""
    k = min(shingle, len(hashes))
    out: Counter = Counter()
    if k:
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for s, w in zip(shingles(hashes, k).tolist(), (ends[k:] - ends[:-k]).tolist()):
            out[s] += w
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


class Index:
    """Items with a word, ready for searching."""

    def __init__(self, texts: list[str], similarity: float = SIMILARITY, by_shingles: bool = True):
        self.items: list[tuple[int, Counter]] = []
        prints: list[tuple[int, int]] = []  # item, first word
        by_size: dict[int, list[tuple[int, int]]] = {}
        for number, text in enumerate(texts):
            w = hash_words([text.lower().encode("utf-8", "replace")], ALNUM_BYTES)
            n = len(w.hashes)
            self.items.append((n, weights(w.hashes, w.end - w.start)))
            if n:
                for size, first in places(n):
                    mark = int(simhash(word_bits(w.hashes[first : first + size]), size)[0])
                    by_size.setdefault(size, []).append((mark, len(prints)))
                    prints.append((number, first))
        self.item_of, self.first_of = np.array(prints, np.int64).reshape(-1, 2).T
        self.tables = [
            Table.of(size, np.array([p for p, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64))
            for size, rows in sorted(by_size.items())
        ]
        self.shingles, self.holders = np.zeros(0, np.uint64), {}
        if by_shingles:
            self._index_shingles(similarity)

    def _index_shingles(self, similarity: float) -> None:
        """Of each item with a full shingle, those held by the fewest items, until what is left weighs too little."""
        held = Counter(s for n, want in self.items if n >= SHINGLE for s in want)
        rows = []
        for number, (n, want) in enumerate(self.items):
            if n < SHINGLE:  # it has one shingle: only equal words match, and their fingerprints are equal
                continue
            left = sum(want.values())
            least = similarity * left
            for s in sorted(want, key=lambda s: (held[s], s)):
                if left < least * (1 - 1e-9):
                    break
                rows.append((s, number))
                left -= want[s]
        self.shingles = np.array(sorted({s for s, _ in rows}), np.uint64)
        for s, number in rows:
            self.holders.setdefault(s, []).append(number)

    def _near_shingles(self, words: Words, owner: np.ndarray) -> set[tuple[int, int]]:
        """(first word, item) of all windows with an indexed shingle of the item."""
        out: set[tuple[int, int]] = set()
        if not len(self.shingles):
            return out
        own = shingles(words.hashes, SHINGLE)
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        hits = np.flatnonzero(self.shingles[at] == own)
        for p in hits[owner[hits] == owner[hits + SHINGLE - 1]].tolist():
            first = int(words.first[owner[p]])
            for item in self.holders[int(own[p])]:
                out.update((a, item) for a in range(max(first, p + SHINGLE - self.items[item][0]), p + 1))
        return out

    def _weigh(self, item: int, ats: list[int], hashes: np.ndarray, sizes: np.ndarray, end: int) -> Iterator[tuple[int, int, float]]:
        """(first word, words, similarity) of the windows of a text that begin at ``ats``, in order."""
        n, want = self.items[item]
        full, base = sum(want.values()), ats[0]
        last = min(ats[-1] + n, end)
        own = shingles(hashes[base:last], SHINGLE).tolist()
        bytes_to = np.concatenate([[0], np.cumsum(sizes[base:last])])
        weigh = (bytes_to[SHINGLE:] - bytes_to[:-SHINGLE]).tolist()
        held: Counter = Counter()
        both = total = lo = hi = 0
        for at in ats:
            stop = min(at + n, end)
            if min(n, stop - at) < SHINGLE:
                yield at, stop - at, weighted_jaccard(weights(hashes[at:stop], sizes[at:stop]), want)
                continue
            a, b = at - base, stop - base - SHINGLE + 1
            if a >= hi:
                held.clear()
                both = total = 0
                lo = hi = a
            for sign, part in ((-1, range(lo, a)), (1, range(hi, b))):
                for p in part:
                    s, w = own[p], sign * weigh[p]
                    total += w
                    if s in want:
                        before = min(held[s], want[s])
                        held[s] += w
                        both += min(held[s], want[s]) - before
            lo, hi = a, b
            yield at, stop - at, both / (total + full - both)

    def matches(self, words: Words, similarity: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each text and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        candidates: set[tuple[int, int]] = set()
        owner, sizes, total = words.owner(), words.end - words.start, len(words.hashes)
        reach = max((t.size for t in self.tables), default=0)
        for a in range(0, total, _BLOCK):
            bits = word_bits(words.hashes[a : a + _BLOCK + reach])
            sums = np.zeros((len(bits) + 1, 64), np.uint8)
            np.cumsum(bits, axis=0, dtype=np.uint8, out=sums[1:])
            for table in self.tables:
                n_windows = min(_BLOCK, total - a - table.size + 1)
                if n_windows <= 0:
                    continue
                windows, marks = table.search(_majority(sums, table.size, 0, n_windows))
                windows = windows + a
                text = owner[windows]
                inside = text == owner[windows + table.size - 1]
                # The item's own first word, within the text.
                begin = np.maximum(windows - self.first_of[marks], words.first[text])
                candidates.update(zip(begin[inside].tolist(), self.item_of[marks[inside]].tolist()))
        candidates |= self._near_shingles(words, owner)
        starts: dict[tuple[int, int], list[int]] = {}
        for at, item in sorted(candidates):
            starts.setdefault((int(owner[at]), item), []).append(at)
        for (text, item), ats in starts.items():
            for at, n, got in self._weigh(item, ats, words.hashes, sizes, int(words.first[text + 1])):
                if got >= similarity and (-got, at) < best.get((text, item), (1.0, 0))[:2]:
                    best[text, item] = (-got, at, n)
        return [(t, i, -s, at - int(words.first[t]), n) for (t, i), (s, at, n) in sorted(best.items())]


def _item_passes(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items with a text, at most about ``ITEMS_PER_PASS`` at a time."""
    items = items.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("_text"), F.lit(passes)) == p) if passes > 1 else items
        rows = sorted(map(tuple, part.collect()), key=lambda r: (r[1], str(r[0])))
        yield [r[0] for r in rows], [r[1] for r in rows]


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; see ``find_items`` for what counts."""
    at = docs.columns.index(text_col)
    for _, texts in _item_passes(items, item_col, item_text_col):
        docs = docs.mapInArrow(_cleaner(texts, at, similarity), docs.schema)
    return docs


def _cleaner(texts: list[str], at: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, similarity)
        for batch in sliced(batches):
            clean = np.ones(batch.num_rows, bool)
            for first, run_texts in in_runs([t.lower() if t else t for t in batch.column(at).to_pylist()]):
                for text, *_ in index.matches(hash_words(run_texts, ALNUM_BYTES), similarity):
                    clean[first + text] = False
            yield batch.filter(pa.array(clean))

    return run


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """Every document and item whose best window reaches the similarity.

    One row per row of ``docs`` and item: id, item, ``similarity`` (double),
    ``first_word`` and ``n_words`` (long, of the window), ``start`` and ``end`` (long,
    bytes of the UTF-8 text in lower case). Null, empty and wordless texts and items
    match nothing. Repeated documents or items repeat their rows. Whole texts are
    searched. Items are held by every task, ``ITEMS_PER_PASS`` at a time: larger
    benchmarks take several passes over the documents.
    """
    item_type = items.schema[item_col].dataType
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, item_type),
        T.StructField("similarity", T.DoubleType()),
        *[T.StructField(c, T.LongType()) for c in ("first_word", "n_words", "start", "end")],
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    out = None
    for ids, texts in _item_passes(items, item_col, item_text_col):
        found = docs.select(id_col, text_col).mapInArrow(_searcher(ids, texts, similarity, kinds, schema.names), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(ids: list, texts: list[str], similarity: float, kinds: list, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, similarity)
        for batch in sliced(batches):
            lower = [t.lower() if t else t for t in batch.column(1).to_pylist()]
            source: list[int] = []
            rows: list[list] = [[] for _ in names[1:]]
            for first, run_texts in in_runs(lower):
                words = hash_words(run_texts, ALNUM_BYTES)
                for text, item, got, at, n in index.matches(words, similarity):
                    w = int(words.first[text]) + at
                    base = int(words.text_at[text])
                    source.append(first + text)
                    values = (ids[item], got, at, n, int(words.start[w]) - base, int(words.end[w + n - 1]) - base)
                    for column, value in zip(rows, values):
                        column.append(value)
            own = batch.column(0).take(pa.array(source, pa.int64())).cast(kinds[0])
            yield pa.RecordBatch.from_arrays([own, *[pa.array(r, k) for r, k in zip(rows, kinds[1:])]], names)

    return run
