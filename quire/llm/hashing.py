"""Vectorized word hashes of whole texts, for use inside Arrow batches.

A word's hash is a polynomial in its bytes modulo 2**64, with fixed random
coefficients per byte value, mixed once more at the end; equal words have equal
hashes anywhere. All words of many texts are hashed with a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, 2**64 - 1
_UNBASE = pow(_BASE, -1, 2**64)

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits and every byte beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of texts: hash, byte range in ``data``, and the first word of each text (with the end)."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(texts: Sequence[bytes], in_word: np.ndarray) -> Words:
    """Hash the maximal runs of ``in_word`` bytes of every text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    # A line feed parts the texts; it is in no word of either kind.
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = in_word[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power(_UNBASE, n + 1)[start]
        hashes = mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return Words(data, hashes, start, end, np.searchsorted(start, text_at), text_at)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` words, in order of their words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = out * U(0x2545F4914F6CDD1D) + hashes[k : k + n]
        return mix(out)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made from a batch stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def in_runs(texts: Sequence[str | None], most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8, in runs of about ``most_bytes``, with the index of each run's first text."""
    run: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "replace") if t else b""
        if run and size + len(data) > most_bytes:
            yield first, run
            run, first, size = [], i, 0
        run.append(data)
        size += len(data)
    if run:
        yield first, run
