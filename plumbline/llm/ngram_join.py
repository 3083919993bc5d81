"""Jaccard self-join on word shingles by filtering under several global orders, and the classes that its links make.

Two sets with Jaccard similarity of at least t share a token among the first n - ceil(t * n) + 1 tokens of each,
whatever order all tokens are put in. The first order is by document frequency, rarest first: documents that share such
a prefix token meet in that token's bucket. A pair's prefixes under two more orders (by two hashes) must meet too: they
travel alone, at a fifth of the sets' size, and only pairs that pass all filters are joined with whole sets.

Frequencies come from one pass: each task packs the tokens of a run of documents by token range, one task a range finds
which tokens occur in several documents, and only those return to their run of documents. A token that many documents
of a run share travels once, with its count.

Copies (equal sets) are one class from the start. In a bucket, all members are first compared with one member, and then
those that are still apart with another; all remaining pairs of a bucket that are not yet connected are compared last.
So a large group of near copies costs its size, not its square, and no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, keep_rows, salted_join, skew_join, text_or_empty
from .graph import components
from .textnum import CHUNK, U, chunks, mix, runs, shingles, words

#: Bytes of text whose tokens a task packs together, and code points of text for each range of tokens.
BLOCK, PART_CHARS = 8 << 20, 4 << 20
#: A token in so many documents of one block travels once for them all.
HEAVY = 256
_NONE = 0xFFFF
_ORDERS = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))  # odd: multiplying permutes the tokens
_BITS = U((1 << 52) - 1)
PACKED = "part long, block long, a binary, b binary, c binary, d binary"
FOUND = "token long, pos int, doc_id long, n int, sig1 long, sig2 long"


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token of each text and the end, tokens sorted by text, text of each token): distinct 52-bit shingle hashes."""
    doc, token = shingles(words(data, offsets), k)
    packed = np.sort((doc.astype(np.uint64) << U(52)) | (token >> U(12)))
    packed = packed[runs(packed)[:-1]]
    doc = (packed >> U(52)).astype(np.int64)
    return np.searchsorted(doc, np.arange(len(offsets))), packed & _BITS, doc


def signatures(bound: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that say which set a text has; 0 for the empty set."""
    full = np.flatnonzero(np.diff(bound))
    out = np.zeros((2, len(bound) - 1), np.uint64)
    if len(full):
        out[0, full] = np.add.reduceat(mix(tokens + U(0x632BE59BD9B4E019)), bound[:-1][full])
        out[1, full] = np.bitwise_xor.reduceat(mix(tokens * U(0x9E6C63D0876A9A47) + U(1)), bound[:-1][full])
    return out[0], out[1]


def _ends(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix of a set of n tokens."""
    return n - -(-percent * n // 100) + 1


def _pack(sets_of: Callable[[np.ndarray, np.ndarray], tuple], bits: int, size: int = CHUNK):
    """Packs blocks of documents by their sets (as `sets` gives them): a row for each token range, and one (part below 0) with the documents themselves."""

    def rows(block: int, ids: list, ns: list, sigs: list, toks: list) -> Iterator[tuple]:
        id_, n, sig = np.concatenate(ids), np.concatenate(ns), np.concatenate(sigs)
        doc = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        packed = np.sort((np.concatenate(toks) >> U(12) << U(24)) | doc)
        token, doc = packed >> U(24), (packed & U(0xFFFFFF)).astype(np.uint16)
        at = runs(token)
        length = np.diff(at)
        many = np.flatnonzero(length >= HEAVY)
        keep = np.ones(len(token), bool)
        held = []
        for r in many:
            held.append(doc[at[r] : at[r + 1]].copy())
            keep[at[r] + 1 : at[r + 1]] = False
            doc[at[r]] = _NONE
        heavy, size = token[at[many]], length[many].astype(np.uint32)
        yield -1 - (block >> 32) % 4096, block, id_.tobytes(), n.astype(np.int32).tobytes(), sig.tobytes(), heavy.tobytes() + np.concatenate([np.zeros(0, np.uint16), *held]).tobytes() + size.tobytes() + np.array([len(many)], np.int64).tobytes()
        token, doc = token[keep], doc[keep]
        cut = np.searchsorted(token, np.arange((1 << bits) + 1, dtype=np.uint64) << U(40 - bits))
        own = np.searchsorted(heavy, np.arange((1 << bits) + 1, dtype=np.uint64) << U(40 - bits))
        for p in range(1 << bits):
            lo, hi = cut[p], cut[p + 1]
            if hi > lo:
                yield p, block, (token[lo:hi] & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), doc[lo:hi].tobytes(), size[own[p] : own[p + 1]].tobytes(), (token[lo:hi] >> U(32)).astype(np.uint8).tobytes() if bits < 8 else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, docs, parts = TaskContext.get().partitionId() << 32, 0, 0, ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows(block, *parts), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "block", "a", "b", "c", "d"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in chunks(batch.column(1), size):
                bound, tokens, _ = sets_of(data, offsets)
                sig = np.stack(signatures(bound, tokens))
                for x, v in zip(parts, (ids[lo:hi], np.diff(bound), sig.T.copy(), tokens), strict=True):
                    x.append(v)
                held, docs = held + len(data), docs + hi - lo
                if held >= BLOCK or docs > 55_000:
                    yield from flush()
                    block, held, docs, parts = block + 1, 0, 0, ([], [], [], [])
        if docs:
            yield from flush()

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of a token range, the entries whose token is in several documents, by block; the documents' rows pass through."""
    part = key[0].as_py()
    if part < 0:
        return table
    rows = [table.column(c).to_pylist() for c in ("block", "a", "b", "c", "d")]
    token = np.concatenate([np.frombuffer(x, np.uint32) for x in rows[1]])
    doc = np.concatenate([np.frombuffer(x, np.uint16) for x in rows[2]])
    top = np.concatenate([np.frombuffer(x, np.uint8) if x else np.zeros(len(a) // 4, np.uint8) for x, a in zip(rows[4], rows[1], strict=True)])
    row = np.repeat(np.arange(len(rows[1])), [len(x) // 4 for x in rows[1]])
    weight = np.ones(len(token), np.int64)
    weight[doc == _NONE] = np.concatenate([np.frombuffer(x, np.uint32) for x in rows[3]])
    order = np.lexsort((token, top)) if top.any() and top.min() != top.max() else np.argsort(token, kind="stable")
    full = (top.astype(np.uint64) << U(32)) | token
    at = runs(full[order])
    df = np.repeat(np.add.reduceat(weight[order], at[:-1]), np.diff(at))
    several = order[df > 1]
    df, token, doc, row = df[df > 1], full[several], doc[several], row[several]
    by = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by], np.arange(len(rows[0]) + 1))
    out = []
    for r, block in enumerate(rows[0]):
        at = by[ends[r] : ends[r + 1]]
        if len(at):
            # df above 32 bits only orders tokens that are everywhere anyway
            out.append((part, block, token[at].tobytes(), doc[at].tobytes(), np.minimum(df[at], 0xFFFFFFFF).astype(np.uint32).tobytes(), b""))
    cols = list(zip(*out, strict=True)) or [()] * 6
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, table.schema, strict=True)], schema=table.schema)


def _unpack(table: pa.Table, bits: int) -> tuple[np.ndarray, ...]:
    """Of a block: (id, set size, signatures) of its documents, and (token, document, frequency) of what they share."""
    parts, a, b, c, d = (table.column(x).to_pylist() for x in ("part", "a", "b", "c", "d"))
    head = next(i for i, p in enumerate(parts) if p < 0)
    ids, n, sig = np.frombuffer(a[head], np.int64), np.frombuffer(b[head], np.int32).astype(np.int64), np.frombuffer(c[head], np.uint64).reshape(-1, 2)
    k = int(np.frombuffer(d[head][-8:], np.int64)[0])
    heavy, size = np.frombuffer(d[head][: 8 * k], np.uint64), np.frombuffer(d[head][len(d[head]) - 8 - 4 * k : len(d[head]) - 8], np.uint32)
    held = np.frombuffer(d[head][8 * k : len(d[head]) - 8 - 4 * k], np.uint16)
    rest = [i for i in range(len(parts)) if i != head]
    top = [np.full(len(a[i]) // 8, parts[i] << (40 - bits), np.uint64) if bits >= 8 else np.zeros(len(a[i]) // 8, np.uint64) for i in rest]
    token = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(a[i], np.uint64) | t for i, t in zip(rest, top, strict=True)]])
    doc = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(b[i], np.uint16) for i in rest]])
    df = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(c[i], np.uint32) for i in rest]])
    big = doc == _NONE
    if big.any():
        start = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        more = [held[start[i] : start[i + 1]] for i in np.searchsorted(heavy, token[big])]
        lengths = [len(x) for x in more]
        token, df = np.concatenate((token[~big], np.repeat(token[big], lengths))), np.concatenate((df[~big], np.repeat(df[big], lengths)))
        doc = np.concatenate((doc[~big], *more))
    return ids, n, sig, token, doc, df


def _prefixes(percent: int, bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of a block, a row for each document (token null) and for each shared token in its prefix by (frequency, token)."""
        ids, n, sig, token, doc, df = _unpack(table, bits)
        order = np.lexsort((token, df, doc))
        doc, token = doc[order].astype(np.int64), token[order]
        first = np.searchsorted(doc, np.arange(len(n) + 1))
        room = np.where(n > 0, _ends(n, percent), 0) - (n - np.diff(first))
        rank = np.arange(len(doc)) - first[doc]
        chosen = rank < room[doc]
        pos = (rank + (n - np.diff(first))[doc])[chosen]  # tokens of one document come first in the order
        doc, token = doc[chosen], token[chosen]
        every = np.concatenate((np.arange(len(n)), doc))
        tokens = pa.array(np.concatenate((np.zeros(len(n), np.int64), token.astype(np.int64))), mask=np.arange(len(every)) < len(n))
        places = pa.array(np.concatenate((np.zeros(len(n), np.int32), pos.astype(np.int32))))
        return pa.table([tokens, places, pa.array(ids[every]), pa.array(n[every].astype(np.int32)), pa.array(sig[every, 0].view(np.int64)), pa.array(sig[every, 1].view(np.int64))], names=["token", "pos", "doc_id", "n", "sig1", "sig2"])

    return run


def _whole_sets(k: int, percent: int):
    """Sets (tokens) and their prefixes under the two hash orders (pre: sorted keys of 32 bits, one order after the other)."""

    def prefixes(tokens: np.ndarray) -> bytes:
        if not len(tokens):
            return b""
        p = int(_ends(np.int64(len(tokens)), percent))
        keys = (tokens * o for o in _ORDERS)
        return b"".join(np.sort((key if p >= len(key) else np.partition(key, p - 1)[:p]) >> U(32)).astype(np.uint32).tobytes() for key in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                bound, tokens, _ = sets(data, offsets, k)
                one, two = signatures(bound, tokens)
                each = [tokens[bound[i] : bound[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([prefixes(x) for x in each], pa.binary())], ["doc_id", "sig1", "sig2", "tokens", "pre"])

    return run


WHOLE = "doc_id long, sig1 long, sig2 long, tokens binary, pre binary"


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two arrays share that have each number once (or a few more, where 32 bits of two numbers agree)."""
    z = np.sort(np.concatenate((x, y)))
    return int((z[1:] == z[:-1]).sum())


def _pairs(keep: Callable[[np.ndarray, np.ndarray], bool], kind: type):
    """Of pairs (a, b, xa, xb: arrays of both as bytes), those that keep accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            for a, b, xa, xb in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if keep(np.frombuffer(xa, kind), np.frombuffer(xb, kind)):
                    one.append(a)
                    two.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return run


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Both orders' prefixes have a key in common; keys of 32 bits that agree by chance only let a pair pass."""
    return all(_common(x[i], y[i]) for x, y in [(np.split(x, 2), np.split(y, 2))] for i in (0, 1))


def _linked(percent: int):
    def keep(x: np.ndarray, y: np.ndarray) -> bool:
        both = _common(x, y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    return keep


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, copies (rows with the same set, itself included).

    Words are runs of other than white space, A-Z lower-cased; a set is a text's distinct k-word shingles, or the whole
    sequence of a text with fewer words. Sets link when 100 * intersection >= percent * union; component_id is the
    smallest id that links reach. A text without words (null or empty too) has no shingles and is its own component.
    Rows without an id take no part: their component_id is null. Rows that repeat an id count by their own text.
    """
    spark = docs.sparkSession
    store = Store(spark, "ngram-join")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    known = base.filter("doc_id is not null")
    chars = docs.agg(F.sum(F.length(text_or_empty(text_col)))).first()[0] or 0
    bits = min(16, max(0, (int(chars) // PART_CHARS).bit_length()))
    packed = known.mapInArrow(_pack(partial(sets, k=k), bits), PACKED)
    shared = packed.groupBy("part").applyInArrow(_shared, PACKED)
    found = store.cut(shared.groupBy("block").applyInArrow(_prefixes(percent, bits), FOUND), "found")
    rows = found.filter("token is null").drop("token", "pos")
    classes = store.cut(rows.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    prefix_rows = found.filter("token is not null").count()

    def with_bucket(members: DataFrame, buckets: DataFrame) -> DataFrame:
        """Members with what is known of their buckets; buckets that hold a thousandth of all members are broadcast."""
        return skew_join(members, buckets, ["token"], "m", prefix_rows, F.xxhash64("rep")).filter("m is not null").drop("m")

    bucket = found.filter("token is not null").select("token", "pos", "sig1", "sig2").distinct().join(classes.filter("n > 0").select("sig1", "sig2", "rep", "n"), ["sig1", "sig2"])
    # A bucket's lead has the fewest tokens before this one: it is nearest to what a group of near copies has in common.
    several = bucket.groupBy("token").agg(F.min(F.struct("pos", "rep", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    bucket = store.cut(with_bucket(bucket, store.cut(several, "several")), "bucket")
    members = bucket.select("rep", "sig1", "sig2").distinct()
    whole = known.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_whole_sets(k, percent), WHOLE)
    whole = whole.join(members.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig1", "sig2"], "left_semi").select("doc_id", "tokens", "pre")
    whole = store.cut(whole, "sets")

    def fits(x: str, y: str, at_x: str, at_y: str):
        """Sizes are near enough, and if this is the first token two sets share, enough tokens follow it in both."""
        after = F.least(F.col(x) - F.col(at_x), F.col(y) - F.col(at_y))
        return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * after >= percent * (F.col(x) + F.col(y)))

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a stored table) that link. A text that leads a large group is in a pair with each of it."""
        for column, keep, kind in (("pre", _meet, np.uint32), ("tokens", _linked(percent), np.uint64)):
            side = {x: whole.select(F.col("doc_id").alias(x), F.col(column).alias(f"x{x}")) for x in "ab"}
            total, both = pairs.count(), pairs
            for x, other in (("b", "a"), ("a", "b")):
                both = salted_join(both, side[x], x, pairs.select(x), total, F.xxhash64(other))
            pairs = store.cut(both.select("a", "b", "xa", "xb").mapInArrow(_pairs(keep, kind), "a long, b long"), f"{name}-{column}")
        return pairs

    stars = bucket.filter("rep != lead.rep").filter(fits("n", "lead.n", "pos", "lead.pos"))
    tried = store.cut(stars.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct(), "tried1")
    links = check(tried, "links1")
    label = components(links, store, "round1")

    def apart(k: int) -> DataFrame:
        """Bucket rows with their components, of the buckets that still hold several."""
        now = bucket.select("token", "pos", "rep", "n").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        now = store.cut(now, f"labelled{k}")
        ends = now.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max(F.struct("comp", (-F.col("pos")).alias("near"), "rep", "n")).alias("_last"), F.count(F.lit(1)).alias("m"))
        return with_bucket(now, store.cut(ends.filter("_lo != _hi").select("token", "_last", "m"), f"ends{k}"))

    left = apart(2).filter("comp != _last.comp").withColumn("_at", -F.col("_last.near")).filter(fits("n", "_last.n", "pos", "_at"))
    left = left.select(F.least("rep", "_last.rep").alias("a"), F.greatest("rep", "_last.rep").alias("b")).distinct()
    second = store.cut(left.join(tried, ["a", "b"], "left_anti"), "tried2")
    links = links.unionByName(check(second, "links2"))
    label = components(links, store, "round2")
    rest = store.cut(apart(3).select("token", "pos", "rep", "n", "comp"), "apart")
    x = rest.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("pos").alias("pa"))
    y = rest.select(F.col("token").alias("t2"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("pos").alias("pb"))
    pairs = x.join(y, (F.col("token") == F.col("t2")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb", "pa", "pb")).select("a", "b").distinct()
    third = store.cut(pairs.join(tried.unionByName(second), ["a", "b"], "left_anti"), "tried3")
    links = links.unionByName(check(third, "links3"))
    label = components(links, store, "round3")
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig1", "sig2", F.coalesce("comp", "rep").alias("comp"), "copies")
    named = store.cut(named, "named")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = skew_join(rows, named, ["sig1", "sig2"], "copies", int(total), F.xxhash64("doc_id"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("copies"))
    lost = base.filter("doc_id is null").mapInArrow(_whole_sets(k, percent), WHOLE)
    lost = lost.select("doc_id", (F.length("tokens") / 8).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that lead their component, and those without words; with all columns."""
    found = ngram_classes(docs, id_col, text_col, k, percent)
    return keep_rows(docs, found.filter("component_id is null or component_id = doc_id").select("doc_id"), id_col, nulls=True)
