"""Removal of repeated 100-byte strings by suffix sorting with difference covers.

Dealing suffixes to tasks. Each window of `length` bytes has one anchor: of the k-byte runs that start in its first
length - k + 1 positions, the one with the least hash, the first of these. Equal windows have equal anchors at equal
places, so dealing anchors by hash brings equal windows together, and a window whose anchor occurs once is unique.
Which anchors occur in several texts, or several times, is found as in the n-gram join: from packed hashes by range.
The windows of one anchor are neighbours: an occurrence is a context, one stretch of text that holds them all. Equal
contexts collapse to their first occurrence before anything is sorted.

Sorting. An anchor with several contexts, up to SPLIT, is sorted whole in a task; the contexts of all others are sorted
together over all tasks (suffix_sort). A task sorts the suffixes at all positions: letters are runs of eight bytes, triples of letters at the positions of two of three residues (the difference cover) are sorted and named,
names are sorted in the same way one level up until a name stands for `length` bytes or more, and the remaining
positions are merged in by their first letter and the rank that follows. Suffixes next to each other are then compared
over `length` bytes, and of equal ones only the first in the corpus stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, skew_join, text_or_empty
from .ngram_join import PACKED, _pack, _shared, _unpack, signatures
from .suffix_sort import later_windows
from .textnum import U, _power, buffers, chunks, mix, runs

LENGTH, K = 100, 32
#: Contexts for a sorting task, about, and those that it sorts at once (which should fit a core's cache); contexts of an
#: anchor that are sorted in one task, at most.
TASK_CONTEXTS, BATCH, SPLIT = 8192, 512, 4096
#: Bytes of text for each range of anchors, and that are looked at together.
PART_BYTES, CHUNK = 4 << 20, 1 << 18
_LETTER = 8
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, start of its first window in the text, number of windows, place of the anchor in the first)."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * _power(_P, n), out=total[1:])
    h = mix((total[k:] - total[:-k]) * _power(_PINV, n)[: n - k + 1])
    bits = U(max(1, int(n).bit_length()))
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, size, count = length - k + 1, 1, n - length + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:count], least[width - size : width - size + count])
    at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(doc[:count] == doc[length - 1 :])
    at = at[start]
    edge = runs(at)
    first, windows = start[edge[:-1]], np.diff(edge)
    doc = doc[first]
    # Least hashes are small numbers; mixed anew they fall evenly into ranges.
    return doc, mix(h[at[edge[:-1]]] + U(1)), first - offsets[doc], windows, at[edge[:-1]] - first


def _name(*keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of tuples of numbers; equal for equal tuples."""
    top = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    key = keys[0].astype(np.uint64)
    bound = top[0]
    for k, t in zip(keys[1:], top[1:], strict=True):
        if bound * t >= 1 << 63:
            key = _name(key)
            bound = int(key.max()) + 1
            key = key.astype(np.uint64)
        key = key * U(t) + k.astype(np.uint64)
        bound *= t
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else 0
    return out


def _below(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many of the values are under each number asked for; all are small numbers."""
    size = max(int(values.max(initial=0)), int(asked.max(initial=0))) + 1
    return np.concatenate(([0], np.cumsum(np.bincount(values, minlength=size))))[asked]


def _merge(low: tuple[np.ndarray, ...], high: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For two lists of tuples, numbers in their common order."""
    both = _name(*[np.concatenate((a, b)) for a, b in zip(low, high, strict=True)])
    return both[: len(low[0])], both[len(low[0]) :]


def suffix_ranks(letters: np.ndarray, step: int, length: int, domain: np.ndarray, wanted: int) -> np.ndarray:
    """Ranks of the suffixes at the positions of `domain` below `wanted`, by `length` bytes at least; equal ones rank alike.

    letters: rows x positions, numbers in the order of the `step` bytes at a position, at the positions of domain; 0
    where a row has ended.
    """
    rows, width = letters.shape

    def at(x: np.ndarray, cols: np.ndarray, ahead: int) -> np.ndarray:
        """What stands `ahead` positions on, 0 past the end."""
        out = np.zeros((rows, len(cols)), x.dtype)
        inside = cols + ahead < width
        out[:, inside] = x[:, cols[inside] + ahead]
        return out.ravel()

    residue = domain // step % 3
    cover = domain[residue > 0]
    names = np.zeros((rows, width), np.int64)
    names[:, cover] = (_name(at(letters, cover, 0), at(letters, cover, step), at(letters, cover, 2 * step)) + 1).reshape(rows, -1)
    if 3 * step < length:
        # The cover's own suffixes: three letters to a letter, so what follows a name is three steps on.
        names = suffix_ranks(names, 3 * step, length, cover, wanted + 2 * step)
    near = domain[domain < wanted]
    rest, c1, c2 = (near[near // step % 3 == r] for r in (0, 1, 2))
    if not len(rest):
        return names

    def keys(cols: np.ndarray, two: bool) -> tuple[np.ndarray, ...]:
        if two:
            return at(letters, cols, 0), at(letters, cols, step), at(names, cols, 2 * step)
        return at(letters, cols, 0), at(names, cols, step)

    # A remaining position meets residue 1 by (letter, rank one step on) and residue 2 by (two letters, rank two on).
    low, high = _merge(keys(rest, False), keys(c1, False))
    low2, high2 = _merge(keys(rest, True), keys(c2, True))
    # A common scale: how many of each part come before, so that equal suffixes of all parts agree.
    first, second = at(names, c1, 0), at(names, c2, 0)
    own = np.concatenate((first, second))
    out = names if 3 * step < length else np.zeros((rows, width), np.int64)
    out[:, rest] = (_below(low, low) + _below(high, low) + _below(high2, low2) + 1).reshape(rows, -1)
    out[:, c1] = (_below(own, first) + _below(low, high) + 1).reshape(rows, -1)
    out[:, c2] = (_below(own, second) + _below(low2, high2) + 1).reshape(rows, -1)
    return out


def first_windows(contexts: list[bytes], order: list[tuple], length: int) -> list[np.ndarray]:
    """For each context (windows at 0 ... len - length), which windows come earlier in another; order: of their first windows."""
    width = max(len(c) for c in contexts)
    raw = np.zeros((len(contexts), width + 3 * length), np.uint8)
    size = np.array([len(c) for c in contexts])
    for i, c in enumerate(contexts):
        raw[i, : len(c)] = np.frombuffer(c, np.uint8)
    wide = np.zeros((len(contexts), width), np.uint64)
    for j in range(_LETTER):
        wide = (wide << U(8)) | raw[:, j : j + width].astype(np.uint64)
    letters = (_name(wide.ravel()) + 1).reshape(wide.shape)
    letters[np.arange(width)[None, :] >= size[:, None]] = 0
    wanted = max(1, int(size.max()) - length + 1)
    rank = suffix_ranks(letters, _LETTER, length, np.arange(width), wanted)
    row, col = np.nonzero(np.arange(wanted)[None, :] <= (size - length)[:, None])
    by = np.lexsort((col, row, rank[row, col]))
    row, col = row[by], col[by]
    text = np.lib.stride_tricks.sliding_window_view(raw, length, axis=1)
    same = np.zeros(len(row), bool)
    for lo in range(0, len(row), 1 << 16):  # compare each suffix's prefix with its neighbour's
        x = slice(max(lo, 1), lo + (1 << 16))
        y = slice(x.start - 1, min(x.stop, len(row)) - 1)
        same[x] = (text[row[x], col[x]] == text[row[y], col[y]]).all(1)
    group = np.cumsum(~same)
    place = {o: i for i, o in enumerate(sorted({o[:-1] for o in order}))}
    texts, starts = np.array([place[o[:-1]] for o in order]), np.array([o[-1] for o in order])
    by = np.lexsort((starts[row] + col, texts[row], group))
    row, col, group = row[by], col[by], group[by]
    later = np.concatenate(([False], group[1:] == group[:-1]))
    flags = np.zeros((len(contexts), wanted), bool)
    flags[row[later], col[later]] = True
    return [flags[i, : max(0, n - length + 1)] for i, n in enumerate(size)]


def _anchor_sets(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first anchor of each text and the end, anchors' hashes of 52 bits by text, text of each); repeats count as shared."""
    doc, h, *_ = anchors(data, offsets, length, k)
    packed = np.sort((doc.astype(np.uint64) << U(52)) | (h >> U(12)))
    doc = (packed >> U(52)).astype(np.int64)
    return np.searchsorted(doc, np.arange(len(offsets))), packed & U((1 << 52) - 1), doc


def _lists(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of a block, the texts that share anchors with others, with those anchors (40 bits each, sorted)."""
        ids, n, sig, token, doc, _ = _unpack(table, bits)
        order = np.lexsort((token, doc))
        token, ends = token[order], np.searchsorted(doc[order], np.arange(len(n) + 1))
        has = np.flatnonzero(np.diff(ends))
        blobs = [token[ends[i] : ends[i + 1]].tobytes() for i in has]
        return pa.table([pa.array(ids[has]), pa.array(sig[has, 0].view(np.int64)), pa.array(sig[has, 1].view(np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "sig1", "sig2", "tokens"])

    return run


def _contexts(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            lists = batch.column(5).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                bound, tokens, _ = _anchor_sets(data, offsets, length, k)
                sig = signatures(bound, tokens)
                # Of rows that repeat an id, each has the list of its own text only.
                own = (sig[0].view(np.int64) == one[lo:hi]) & (sig[1].view(np.int64) == two[lo:hi])
                held = [np.frombuffer(x, np.uint64) if o else np.zeros(0, np.uint64) for x, o in zip(lists[lo:hi], own, strict=True)]
                shared = np.concatenate(held) | (np.repeat(np.arange(hi - lo), [len(x) for x in held]).astype(np.uint64) << U(40))
                doc, h, start, windows, place = anchors(data, offsets, length, k)
                mine = (doc.astype(np.uint64) << U(40)) | (h >> U(24))
                at = np.minimum(np.searchsorted(shared, mine), max(len(shared) - 1, 0))
                keep = np.flatnonzero(shared[at] == mine) if len(shared) else np.zeros(0, np.int64)
                doc, h, start, windows, place = (x[keep] for x in (doc, h, start, windows, place))
                raw, begin = data.tobytes(), (offsets[doc] + start).tolist()
                ctx = [raw[a : a + n + length - 1] for a, n in zip(begin, windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(tags[lo:hi][doc]), pa.array(start.astype(np.int32)), pa.array((windows << 8 | place).astype(np.int32)), pa.array(ctx, pa.binary())], ["h", "doc_id", "tag", "start", "shape", "ctx"])

    return run


def _sort_task(length: int):
    """Sorts all contexts of a task's anchors."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = np.array(t.column("h").to_pylist(), np.int64)
        by = np.argsort(h, kind="stable")
        edge = runs(h[by])
        ctx, first = t.column("ctx").to_pylist(), t.column("first").to_pylist()
        gone: list[bytes] = [b""] * len(h)
        lo = 0
        while lo < len(edge) - 1:
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + BATCH, "right")) - 1)
            at = by[edge[lo] : edge[hi]]
            order = [(first[i]["doc_id"], first[i]["tag"], first[i]["start"]) for i in at]
            for i, bits in zip(at, first_windows([ctx[i] for i in at], order, length), strict=True):
                gone[i] = np.packbits(bits).tobytes() if bits.any() else b""
            lo = hi
        return pa.table([t.column("h"), t.column("c1"), t.column("c2"), pa.array(gone, pa.binary())], names=["h", "c1", "c2", "gone"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK << 2):
                out = _removed(batch.column(2).slice(lo, hi - lo), offsets, length)
                edges = np.concatenate(([0], np.cumsum(out)))
                removed = edges[offsets[1:]] - edges[offsets[:-1]]
                opens = out & ~np.concatenate(([False], out[:-1]))
                first = offsets[:-1][offsets[:-1] < len(out)]
                opens[first] = out[first]  # a run at a text's start is its own
                edges = np.concatenate(([0], np.cumsum(opens)))
                spans = edges[offsets[1:]] - edges[offsets[:-1]]
                left = data[~out].tobytes()
                ends = (offsets - np.concatenate(([0], np.cumsum(removed)))).tolist()
                kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sha), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _removed(found: pa.Array, offsets: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of some texts go. found: for each text, the occurrences with windows that go (gone: bits, null for all)."""
    flat, doc = found.flatten(), np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    start, shape = (flat.field(c).to_numpy() for c in ("start", "shape"))
    begin = offsets[doc] + start
    some = flat.field("gone").is_valid().to_numpy(zero_copy_only=False)
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    whole = begin[~some]
    np.add.at(change, whole, 1)
    np.add.at(change, whole + (shape[~some] >> 8) + length - 1, -1)
    if some.any():
        bits, at = buffers(flat.field("gone").filter(pa.array(some)))
        window = np.flatnonzero(np.unpackbits(bits[at[0] : at[-1]])).astype(np.int64)
        ends = (at[1:] - at[0]) * 8
        which = np.searchsorted(ends, window, "right")
        place = begin[some][which] + window - (at[:-1] - at[0])[which] * 8
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
    return np.cumsum(change[:-1]) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if a string of `length` bytes around it also starts earlier: in a smaller id, or earlier in the same
    text. Strings are judged on the input and never cross texts. Null text is empty; texts under `length` bytes stay
    whole. Rows without an id lose nothing and cost others nothing. Of rows that repeat an id, equal ones are one text
    that is written out for each, others are ordered by a checksum. An empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "suffix-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes")).withColumn("tag", (F.crc32("bytes") % 2147483647).cast("int"))
    long = base.filter((F.length("bytes") >= length) & F.col("doc_id").isNotNull())
    size = base.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    bits = min(16, max(0, (int(size) // PART_BYTES).bit_length()))
    packed = long.select("doc_id", "bytes").mapInArrow(_pack(partial(_anchor_sets, length=length, k=k), bits, CHUNK), PACKED)
    lists = packed.groupBy("part").applyInArrow(_shared, PACKED).groupBy("block").applyInArrow(_lists(bits), "doc_id long, sig1 long, sig2 long, tokens binary")
    lists = store.cut(lists, "lists")
    occ = long.join(lists, "doc_id").select("doc_id", "bytes", "tag", "sig1", "sig2", "tokens")
    occ = occ.mapInArrow(_contexts(length, k), "h long, doc_id long, tag int, start int, shape int, ctx binary")
    occ = occ.withColumn("c1", F.xxhash64("ctx", "shape")).withColumn("c2", F.xxhash64(F.lit(1), "ctx", "shape"))
    occ = store.cut(occ, "occurrences")
    classes = occ.groupBy("h", "c1", "c2").agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("ctx").alias("ctx"))
    classes = store.cut(classes, "classes")
    several = classes.groupBy("h").count().filter("count > 1").select("h", (F.col("count") > SPLIT).alias("wide"))
    mixed = store.cut(classes.join(several, "h").select("h", "c1", "c2", "first", "ctx", "wide"), "mixed")
    narrow = mixed.filter("not wide").drop("wide")
    tasks = max(1, -(-narrow.count() // TASK_CONTEXTS))
    sorted_ = narrow.groupBy(F.pmod(F.xxhash64("h"), F.lit(tasks)).alias("task")).applyInArrow(_sort_task(length), "h long, c1 long, c2 long, gone binary").filter("length(gone) > 0")
    if mixed.filter("wide").limit(1).count():
        sorted_ = sorted_.unionByName(later_windows(mixed.filter("wide").drop("wide"), store, length))
    sorted_ = store.cut(sorted_, "sorted")
    store.drop("mixed", "sort-gone")
    final = classes.drop("ctx").join(sorted_, ["h", "c1", "c2"], "left").filter("n > 1 or gone is not null")
    final = store.cut(final.select("h", "c1", "c2", "first", "n", "gone"), "final")
    total = occ.count()
    marked = skew_join(occ.select("h", "c1", "c2", "doc_id", "tag", "start", "shape"), final, ["h", "c1", "c2"], "n", total, F.xxhash64("doc_id", "start"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag")) & (F.col("start") == F.col("first.start"))
    marked = marked.filter("first is not null").filter(~is_first | F.col("gone").isNotNull())
    marked = marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "shape", F.when(is_first, F.col("gone")).alias("gone"))).alias("found"))
    marked = store.cut(marked, "marked")
    store.drop("occurrences", "classes", "final", "sorted", "lists")
    out = base.join(marked.withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"}), (F.col("doc_id") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "bytes", "found")
    return out.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
