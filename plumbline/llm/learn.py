"""Small linear learners in numpy and the byte n-grams that they read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import _LOWER, U


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def first_by_hash(ids: DataFrame, id_col: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows, those first in a seeded order: a bounded sample that is the same in every run.

    ids: distinct in id_col. Only rows whose hash is below what the count asks for are ordered, so that about `most` rows
    leave the tasks, however many tasks there are.
    """
    n = ids.count()
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 2)  # of 62 bits
    some = ids.withColumn("_key", key)
    share = (most + 10 * most**0.5 + 100) / max(n, 1)
    if share < 1:
        some = some.filter(F.col("_key") < int(share * (1 << 62)))
    return some.orderBy("_key", id_col).limit(most).drop("_key")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of `bits` bits) of every run of n bytes inside a text, A-Z lower-cased, white space as it is."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data].astype(np.uint64)
    key = low[: len(data) - n + 1].copy()
    for j in range(1, n):
        key = (key << U(8)) | low[j : len(data) - n + 1 + j]
    h = ((key * U(0x9E3779B97F4A7C15) + U(n)) * U(0xD6E8FEB86659FD93)) >> U(64 - bits)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(h)] == doc[n - 1 :]
    return doc[: len(h)][inside], h[inside].astype(np.int64)


def adam(grad: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and, last, the bias of an L2-regularised logistic regression."""
    s = np.ones(len(y)) if weight is None else weight
    s = s / s.sum()

    def grad(w: np.ndarray) -> np.ndarray:
        # Products in the rows' own type: a mixed product would copy all rows at every step.
        err = (sigmoid((x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]) - y) * s
        return np.append((err.astype(x.dtype) @ x).astype(float) + l2 * w[:-1], err.sum())

    return adam(grad, np.zeros(x.shape[1] + 1), steps)


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]


#: Values are told apart to a 256th, up to 64.
_BINS, _TOP = 256, 64


def surest(rows: DataFrame, value: Column, most: int, id_col: str, seed: str) -> DataFrame:
    """At most `most` rows, those with the greatest values; among equal 256ths, the first in a seeded order of ids.

    Counts by 256th come to the driver, a table of fixed size, instead of each task's greatest rows. Ids are distinct.
    """
    at = F.floor(F.least(value, F.lit(_TOP)) * _BINS).cast("long")
    counts = sorted(((r[0], r[1]) for r in rows.groupBy(at.alias("_at")).count().collect()), reverse=True)
    room = most
    for edge, n in counts:
        if n >= room:
            tied = first_by_hash(rows.filter(at == edge), id_col, room, seed)
            return rows.filter(at > edge).unionByName(tied)
        room -= n
    return rows
