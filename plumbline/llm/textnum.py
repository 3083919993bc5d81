"""Words, word hashes and shingles of many texts at once, in numpy, from Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is looked at alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
U = np.uint64


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK + 1), base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about `size` bytes and at most `rows` rows."""
    if len(column) == 0:
        return
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    start: np.ndarray  # byte positions
    end: np.ndarray
    bound: np.ndarray  # index of each text's first word; one more at the end
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.bound)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), self.count)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie one after another, with a hash of each word's bytes, A-Z lower-cased."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start_at = inside.copy()
    start_at[1:] &= ~inside[:-1] | edge[1:n]
    end_at = inside.copy()
    end_at[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(start_at), np.flatnonzero(end_at) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + U(1)) * _power(_P, n), out=total[1:])
    h = mix((total[end] - total[start]) * _power(_PINV, n)[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return Words(start, end, np.searchsorted(start, offsets), h)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words; of a shorter text with words, its whole sequence. With repeats, in no order."""
    counts, bound = w.count, w.bound
    factors = [U(pow(0xA0761D6478BD642F, j + 1, 1 << 64)) for j in range(k)]
    docs, out = [], []
    if len(w.hash) >= k:
        doc = w.doc
        i = np.flatnonzero(np.arange(len(w.hash)) + k <= bound[1:][doc])
        acc = np.zeros(len(i), np.uint64)
        for j, f in enumerate(factors):
            acc += w.hash[i + j] * f
        docs.append(doc[i])
        out.append(mix(acc))
    for m in range(1, k):
        at = np.flatnonzero(counts == m)
        if len(at):
            acc = np.full(len(at), m * 0x1F83D9ABFB41BD6B % (1 << 64), np.uint64)
            for j in range(m):
                acc += w.hash[bound[at] + j] * factors[j]
            docs.append(at)
            out.append(mix(acc))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of the whole at the end."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
