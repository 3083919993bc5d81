"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers.

The benchmark's passages, as TF-IDF rows (word weights from document frequencies over all documents), are factored by a
distributed randomised SVD. Each document's overlapping windows of words are projected into that latent space. What they
are compared with are the items' own passages of a window's size, so that nothing depends on an item's length: windows
close to a passage by cosine, and with a share of its weight, are candidates for its item; most windows cannot reach that
share by the sum of their words' greatest contributions to any passage, and need no projection. A candidate is a leak if
the longest common subsequence of words, over the window and an item's length around it, covers enough of the item, and
enough of the item's answer (its last words).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty
from .textnum import U, chunks, runs, words

#: Bits of hashed words for document frequencies; latent dimensions; half a window; passages of items searched at once.
BITS, RANK, STEP, ITEMS = 18, 128, 16, 4096
#: Least cosine of a candidate, and least share of a passage's latent weight that its window holds (a window lies across
#: passages, and a paraphrase has less than all of one); least shares of item and answer that a common subsequence covers.
COSINE, WEIGHT, COVER, ANSWER_COVER = 0.2, 0.22, 0.6, 0.5
FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, start_word long"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def word_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts (column bytes) each word slot occurs: a table of fixed size, 2 ** BITS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                w = words(data, offsets)
                packed = np.sort((w.doc.astype(np.uint64) << U(BITS)) | _slot(w.hash).astype(np.uint64))
                total += np.bincount((packed[runs(packed)[:-1]] & U((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _tfidf(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of unit TF-IDF rows; column: of each word slot, -1 if it has none."""
    w = words(data, offsets)
    c = column[_slot(w.hash)]
    row, c = w.doc[c >= 0], c[c >= 0]
    value = idf[c]
    norm = np.sqrt(np.bincount(row, value**2, len(offsets) - 1))
    return row, c, value / np.maximum(norm[row], 1e-12)


def randomised_svd(passages: DataFrame, column: np.ndarray, idf: np.ndarray, rank: int, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """Right singular vectors (columns x rank) of the passages' TF-IDF rows, by subspace iteration.

    Each round sends the current basis to the tasks; a task returns its rows' part of A' (A basis), of fixed size.
    """
    n = len(idf)
    rank = max(1, min(rank, n))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, rank)))[0]
    for _ in range(rounds):

        # PySpark broadcasts a function as large as this one, so that each executor gets the basis once a round.
        def run(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(basis.shape)
            for batch in batches:
                for lo, hi, data, offsets in chunks(batch.column(0)):
                    row, c, v = _tfidf(data, offsets, column, idf)
                    y = np.zeros((hi - lo, basis.shape[1]))
                    np.add.at(y, row, basis[c] * v[:, None])
                    np.add.at(out, c, y[row] * v[:, None])
            at = np.flatnonzero(np.abs(out).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([out[i].tobytes() for i in at], pa.binary())], ["c", "v"])

        def merge(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"c": [key[0].as_py()], "v": pa.array([np.sum([np.frombuffer(x) for x in t.column("v").to_pylist()], axis=0).tobytes()], pa.binary())})

        got = passages.mapInArrow(run, "c long, v binary").groupBy("c").applyInArrow(merge, "c long, v binary").toArrow()
        image = np.zeros_like(basis)
        for c, v in zip(got.column("c").to_pylist(), got.column("v").to_pylist(), strict=True):
            image[c] = np.frombuffer(v)
        basis = np.linalg.qr(image)[0]
    return basis


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by the bits of one large number a word of b."""
    place: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        place[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := place.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def passages_of(n: int) -> list[int]:
    """Where the passages of an item of n words start: half-overlapping, of a window's size or the whole shorter item."""
    return [min(at, max(0, n - 2 * STEP)) for at in range(0, max(1, n - STEP), STEP)]


def answer(item: list[int]) -> list[int]:
    """An item's answer: its last quarter of words, three at least."""
    return item[-max(3, len(item) // 4) :]


def _best(item: list[int], region: list[int]) -> tuple[float, float]:
    return lcs(item, region) / len(item), lcs(answer(item), region) / len(answer(item))


Match = tuple[int, int, float, float, float, int]  # row, item, cosine, share of item, share of answer, first word


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = RANK, cosine: float = COSINE, cover: float = COVER, answer_cover: float = ANSWER_COVER, items_at_once: int = ITEMS) -> DataFrame:
    """One row per document and benchmark item that it leaks: FOUND; the best window of each.

    Items without words (or null) leak nowhere; documents without words leak nothing. Rows without an id count for the
    word frequencies and are found under a null doc_id; rows that repeat an id give the best of them. The benchmark is
    the stated query set: it is collected and searched in blocks of items with `items_at_once` passages or fewer (or one
    item), each against all windows of all documents. `cosine` is the least one of a window with a passage; the result's
    cosine is with the whole item.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for match in _matchers(base.select("bytes"), benchmark, text_col, item_col, rank, cosine, cover, answer_cover, items_at_once):

        def run(batches: Iterator[pa.RecordBatch], match: Callable = match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = match(batch.column(1))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                _, *rest = [pa.array(x, t) for x, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *rest], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "start_word"])

        out = out.unionByName(base.mapInArrow(run, FOUND))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share", "start_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share", "b.start_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that leak no benchmark item, with all columns; each row is judged by itself, with or without an id."""
    text = text_or_empty(text_col).cast("binary")
    out = docs
    for match in _matchers(docs.select(text.alias("bytes")), benchmark, text_col, item_col, RANK, COSINE, COVER, ANSWER_COVER, ITEMS):

        def leaks(column: pa.Array, match: Callable = match) -> pa.Array:
            found = np.zeros(len(column), bool)
            found[[m[0] for m in match(column)]] = True
            return pa.array(found)

        out = out.filter(~_arrow_flag(leaks)(text))
    return out


def _arrow_flag(f: Callable[[pa.Array], pa.Array]):
    def flag(column: pa.Array) -> pa.Array:
        return f(column)

    return F.arrow_udf(flag, "boolean")


def _matchers(texts: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, rank: int, cosine: float, cover: float, answer_cover: float, items_at_once: int) -> Iterator[Callable[[pa.Array], list[Match]]]:
    """For each block of items, what finds its leaks in an array of texts. texts: column bytes."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(text_col).cast("binary").alias("bytes")).filter("item_id is not null")
    frequency, n_docs = word_frequencies(texts), texts.count()
    n_words = F.size(F.regexp_extract_all(F.col("bytes").cast("string"), F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0)))
    sizes = [(i, sum(len(passages_of(n)) for n in ns)) for i, ns in items.groupBy("item_id").agg(F.collect_list(n_words)).orderBy("item_id").collect()]
    spans: list[list[int]] = []  # first item, last item, passages
    for i, n in sizes:
        if spans and spans[-1][2] + n <= items_at_once:
            spans[-1][1:] = i, spans[-1][2] + n
        else:
            spans.append([i, i, n])
    for first_id, last_id, _ in spans:
        block = items.filter(F.col("item_id").between(first_id, last_id))
        if (match := _matcher(block, frequency, n_docs, rank, cosine, cover, answer_cover)) is not None:
            yield match


def _matcher(items: DataFrame, frequency: np.ndarray, n_docs: int, rank: int, cosine: float, cover: float, answer_cover: float) -> Callable[[pa.Array], list[Match]] | None:
    got = items.toArrow()
    item_ids, texts = got.column("item_id").to_pylist(), got.column("bytes").combine_chunks()
    column = np.full(1 << BITS, -1, np.int32)
    told: list[tuple[int, list[int]]] = []
    slots = []
    for lo, hi, data, offsets in chunks(texts):
        w = words(data, offsets)
        slots.append(_slot(w.hash))
        for i in range(hi - lo):
            told.append((item_ids[lo + i], w.hash[w.bound[i] : w.bound[i + 1]].tolist()))
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *slots]))
    column[used] = np.arange(len(used), dtype=np.int32)
    told = [x for x in told if x[1]]
    if not told:
        return None
    idf = np.log((n_docs + 1) / (frequency[used] + 0.5)).clip(0.05)
    basis = randomised_svd(items.select("bytes"), column, idf, rank)
    vectors, parts, whose = np.zeros((len(told), basis.shape[1])), [], []
    for i, (_, item) in enumerate(told):
        c = column[_slot(np.array(item, np.uint64))]
        each = basis[c] * idf[c][:, None]
        vectors[i] = each.sum(0)
        for at in passages_of(len(item)):
            parts.append(each[at : at + 2 * STEP].sum(0))
            whose.append(i)
    queries, owner = np.array(parts), np.array(whose)
    vocabulary = [frozenset(item) for _, item in told]
    norm = np.maximum(np.linalg.norm(queries, axis=1), 1e-9)
    weighted = (basis * idf[:, None]).astype(np.float32)
    # A word's greatest contribution to a window's share of any passage, in blocks of passages to bound the memory.
    most = np.zeros(len(used))
    for lo in range(0, len(queries), 512):
        most = np.maximum(most, (weighted.astype(float) @ queries[lo : lo + 512].T / norm[lo : lo + 512] ** 2).max(1))
    least = (WEIGHT * norm).astype(np.float32)
    queries = (queries / norm[:, None]).astype(np.float32).T.copy()
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]).astype(np.float32)

    def match(texts: pa.Array) -> list[Match]:
        rows: list[Match] = []
        for lo, hi, data, offsets in chunks(texts, 1 << 18):
            w = words(data, offsets)
            blocks = -(-w.count // STEP)  # each text's words in blocks of STEP; two neighbours make a window
            first = np.concatenate(([0], np.cumsum(blocks)))
            if not first[-1]:
                continue
            c = column[_slot(w.hash)]
            place = np.flatnonzero(c >= 0)
            doc = w.doc[place]
            own = first[doc] + (place - w.bound[doc]) // STEP
            follows = np.ones(first[-1], bool)
            follows[first[1:][blocks > 0] - 1] = False  # a text's last block stands alone
            bound = np.bincount(own, most[c[place]], first[-1]).astype(float)  # of nothing it is whole numbers
            bound[:-1] += np.where(follows[:-1], bound[1:], 0.0)
            window_at = np.flatnonzero(bound >= WEIGHT)
            if not len(window_at):
                continue
            needed = np.zeros(first[-1] + 1, bool)
            needed[window_at] = True
            needed[window_at + 1] |= follows[window_at]
            keep = needed[own]
            own, place = own[keep], place[keep]
            at = runs(own)[:-1]
            sums = np.zeros((first[-1] + 1, weighted.shape[1]), np.float32)
            if len(at):
                sums[own[at]] = np.add.reduceat(weighted[c[place]], at, axis=0)
            window = sums[window_at] + np.where(follows[window_at][:, None], sums[window_at + 1], np.float32(0))
            size = np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            found = []  # window * items + item, each once
            for q in range(0, len(owner), ITEMS):
                dot = window @ queries[:, q : q + ITEMS]
                near = np.argwhere((dot >= cosine * size) & (dot >= least[q : q + ITEMS]))
                found.append(near[:, 0] * len(told) + owner[q + near[:, 1]])
            hit = np.stack(np.divmod(np.unique(np.concatenate(found)), len(told)), 1)
            if not len(hit):
                continue
            close = np.einsum("nr,nr->n", window[hit[:, 0]], vectors[hit[:, 1]]) / size[hit[:, 0], 0]
            hit[:, 0] = window_at[hit[:, 0]]
            of = np.searchsorted(first, hit[:, 0], "right") - 1
            best: dict[tuple[int, int], tuple] = {}
            seen: dict[int, list[int]] = {}
            for d, (b, i), near in zip(of.tolist(), hit.tolist(), close.tolist(), strict=True):
                item = told[i][1]
                start = (b - int(first[d])) * STEP
                if d not in seen:
                    seen[d] = w.hash[w.bound[d] : w.bound[d + 1]].tolist()
                region = seen[d][max(0, start - len(item)) : start + 2 * STEP + len(item)]
                if sum(map(vocabulary[i].__contains__, region)) < cover * len(item):
                    continue  # no subsequence can be long enough
                share, end = _best(item, region)
                if share >= cover and end >= answer_cover and best.get((d, i), (0.0,))[0] < share:
                    best[(d, i)] = (share, end, near, start)
            rows += [(lo + d, told[i][0], c_, s, e, at_) for (d, i), (s, e, c_, at_) in best.items()]
        return rows

    return match
