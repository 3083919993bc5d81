"""Language-model scores by logistic context mixing over bits, beside a word-frequency base score.

Each byte of a text is predicted bit by bit, given the 1 to 5 bytes before it. For each of these context lengths it is
known exactly how often each bit followed (context, bits of the byte so far) in the training texts. The logits of these
predictors are mixed with weights that two gates choose: which lengths have been seen, and the bits so far. The weights
are learned online, by gradient steps in a seeded order in each range of runs, and averaged over the ranges after each
epoch; each training byte is predicted from tables without itself. An adaptive table then maps (bits so far, mixed logit) to the share of ones seen there, and is averaged with the mixture.

All counts cover all training texts. Tasks sort the 6-byte runs of their texts, so that work goes by distinct run, and
what is shuffled are packed arrays of runs (or word hashes) with counts, by range. A range of runs has all runs with the
same two bytes before, so contexts of two bytes and more are counted inside it; the counts grow with the input and never
leave their range, to which blocks of texts send their runs to be predicted. Only gates, the adaptive table and the counts
of single bytes' followers are of fixed size.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, text_or_empty
from .learn import fold, sigmoid
from .textnum import U, chunks, mix, runs, words

ORDER = 5
#: Bytes of text in a block, that a training task sorts at once, and whose distinct runs it sends together.
BLOCK, PIECE, TAKE = 16 << 20, 2 << 20, 32 << 20
#: Bits of the ranges of runs and words, at least; more for more than 1 GB of text.
PART_BITS = 6
_END = 0xFF  # no byte of UTF-8: a text's end is predicted like a byte
_BATCH, _RATE, _EPOCHS, _BUCKETS = 1024, 1.0, 2, 32
END_WORD = U(0x5851F42D4C957F2D)
BLOB = "part int, block long, a binary, b binary"


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed run of each byte and each text's end, position of each text's first run): the next byte in the lowest
    8 bits, the byte before it in the highest of 48, older ones below; nothing (0) before a text's start."""
    n_docs = len(offsets) - 1
    at = offsets + np.arange(n_docs + 1)
    nxt = np.zeros(at[-1], np.uint8)
    own = np.ones(at[-1], bool)
    own[at[1:] - 1] = False
    nxt[own] = data
    nxt[at[1:] - 1] = _END
    key = nxt.astype(np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER + 1):
        before = np.zeros(at[-1], np.uint64)
        before[k:] = nxt[:-k]
        before[place < k] = 0
        key |= before << U(8 * (ORDER + 1 - k))
    return key, at


class Counts:
    """How often each bit followed each context, exactly, from a range's distinct runs with counts (sorted) and, for
    contexts of one byte, the counts of all (byte before, next byte)."""

    def __init__(self, key: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> None:
        self.by_order = [(np.arange(1 << 16, dtype=np.uint64), np.concatenate(([0], np.cumsum(pairs))))]
        for o in range(2, ORDER + 1):
            k, c = _sum_sorted(self.packed(key, o), count)
            self.by_order.append((k, np.concatenate(([0], np.cumsum(c)))))

    @staticmethod
    def packed(key: np.ndarray, o: int) -> np.ndarray:
        return (key >> U(8 * (ORDER + 1 - o))) << U(8) | (key & U(0xFF))

    def of(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(zeros, ones) by run and bit, for each order."""
        for o, (k, upto) in enumerate(self.by_order, 1):
            own = self.packed(key, o)
            node = own & ~U(0xFF)
            order = np.argsort(own, kind="stable")
            own, node = own[order], node[order]
            lo, hi = upto[np.searchsorted(k, node)], upto[np.searchsorted(k, node + U(256))]
            n = np.zeros((2, len(key), 8), np.float32)
            for j in range(8):
                half = node + U(128 >> j)
                mid = upto[np.searchsorted(k, half)]
                n[0, order, j], n[1, order, j] = mid - lo, hi - mid
                one = own >= half
                node, lo, hi = np.where(one, half, node), np.where(one, mid, lo), np.where(one, hi, mid)
            yield n[0], n[1]


def _nodes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits so far by run and bit; the bit) of runs."""
    nxt = (key & U(0xFF)).astype(np.int64)
    j = np.arange(8)
    return ((nxt[:, None] | 256) >> (8 - j)[None, :]).astype(np.int64), (nxt[:, None] >> (7 - j)[None, :]) & 1


class Model:
    """Gate weights and the adaptive table, beside a range's own counts."""

    def __init__(self, counts: Counts | None = None) -> None:
        self.counts = counts
        self.seen_w = np.full((ORDER + 1, 6, ORDER + 1), 0.15, np.float32)
        self.node_w = np.full((256, ORDER + 1), 0.15, np.float32)
        self.seen_w[..., -1] = self.node_w[..., -1] = 0
        self.refine = np.tile(sigmoid((np.arange(_BUCKETS + 1) - _BUCKETS / 2) / 2), (256, 1)).astype(np.float32)

    def inputs(self, key: np.ndarray, without: bool) -> tuple[np.ndarray, ...]:
        """(logits of the predictors and a 1, longest seen order, its count's class, bits so far, the bit), by bit."""
        node, bit = _nodes(key)
        x = np.ones((len(key), 8, ORDER + 1), np.float32)
        longest = np.zeros((len(key), 8), np.int64)
        size = np.zeros((len(key), 8), np.int64)
        for o, (n0, n1) in enumerate(self.counts.of(key)):
            if without:
                n0, n1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
            x[:, :, o] = np.log((n1 + 0.3) / (n0 + 0.3))
            n = n0 + n1
            longest = np.where(n > 0, o + 1, longest)
            size = np.where(n > 0, np.minimum(np.log2(np.maximum(n, 1)), 5).astype(np.int64), size)
        return x, longest, size, node, bit

    def mixed(self, x: np.ndarray, longest: np.ndarray, size: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.einsum("nbi,nbi->nb", x, self.seen_w[longest, size] + self.node_w[node])

    def bits(self, key: np.ndarray) -> np.ndarray:
        """log2 probability of each run's next byte."""
        out = np.zeros(len(key))
        for lo in range(0, len(key), 1 << 15):
            k = key[lo : lo + (1 << 15)]
            x, longest, size, node, bit = self.inputs(k, False)
            z = self.mixed(x, longest, size, node)
            p = np.clip((sigmoid(z) + self._refined(z, node)) / 2, 1e-5, 1 - 1e-5)
            out[lo : lo + (1 << 15)] = np.log2(np.where(bit == 1, p, 1 - p)).sum(1)
        return out

    @staticmethod
    def _bucket(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(z * 2 + _BUCKETS / 2, 0, _BUCKETS - 1e-3)
        return at.astype(np.int64), at - np.floor(at)

    def _refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        b, part = self._bucket(z)
        return self.refine[node, b] * (1 - part) + self.refine[node, b + 1] * part

    def learn(self, key: np.ndarray, count: np.ndarray, rate: float) -> None:
        """Online gradient steps over runs in a seeded order, each weighted by how often it occurs."""
        order = np.argsort(mix(key + U(17)), kind="stable")
        for lo in range(0, len(order), _BATCH):
            at = order[lo : lo + _BATCH]
            x, longest, size, node, bit = self.inputs(key[at], True)
            err = (bit - sigmoid(self.mixed(x, longest, size, node))) * count[at][:, None]
            flat, weight = x.reshape(-1, ORDER + 1), np.repeat(count[at], 8)
            for w, gate in ((self.seen_w.reshape(-1, ORDER + 1), (longest * 6 + size).ravel()), (self.node_w, node.ravel())):
                total = np.bincount(gate, weight, len(w)) + 64
                for i in range(ORDER + 1):
                    w[:, i] += rate * np.bincount(gate, err.ravel() * flat[:, i], len(w)) / total

    def refine_counts(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(bits so far, bucket, [ones, all]) by the mixture's own prediction without the byte itself."""
        out = np.zeros((256 * (_BUCKETS + 1), 2))
        for lo in range(0, len(key), 1 << 15):
            x, longest, size, node, bit = self.inputs(key[lo : lo + (1 << 15)], True)
            b, part = self._bucket(self.mixed(x, longest, size, node))
            w = np.repeat(count[lo : lo + (1 << 15)], 8).reshape(bit.shape)
            for side, share in ((0, 1 - part), (1, part)):
                where = (node * (_BUCKETS + 1) + b + side).ravel()
                out[:, 0] += np.bincount(where, (w * share * bit).ravel(), len(out))
                out[:, 1] += np.bincount(where, (w * share).ravel(), len(out))
        return out


def _blob_rows(names: list[str], rows: list[tuple], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], names)


_TYPES, _NAMES = (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ["part", "block", "a", "b"]


def _sum_sorted(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    return key[order][at[:-1]], np.add.reduceat(count[order], at[:-1]) if len(key) else count


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = runs(key)
    return key[at[:-1]], np.diff(at)


def _run_counts(parts: int):
    """Distinct byte runs of training texts (column bytes) with counts, in ranges of the two bytes before."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, count = _sum_sorted(*[np.concatenate(x) for x in zip(*held, strict=True)])
        part = (mix(key >> U(32)) % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, 0, key[x].tobytes(), count[x].astype(np.int64).tobytes()) for p in range(parts) for x in [order[ends[p] : ends[p + 1]]] if len(x)]
        return _blob_rows(_NAMES, rows, _TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), PIECE):
                held.append(_distinct(byte_runs(data, offsets)[0]))
                size += len(data)
                if size >= TAKE:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merge_runs(key: tuple, t: pa.Table) -> pa.Table:
    k, c = _sum_sorted(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("a").to_pylist()]), np.concatenate([np.frombuffer(x, np.int64) for x in t.column("b").to_pylist()]))
    step = 1 << 18
    rows = [(key[0].as_py(), i, k[i : i + step].tobytes(), c[i : i + step].tobytes()) for i in range(0, len(k), step)]
    return pa.Table.from_batches([_blob_rows(_NAMES, rows, _TYPES)])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of merged runs, how often each byte followed each: 256 * byte before + next byte."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            np.add.at(total, Counts.packed(np.frombuffer(a, np.uint64), 1).astype(np.int64), np.frombuffer(b, np.int64))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _whole(rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs and counts of a range's rows (block, runs, counts), sorted by run."""
    rows = sorted(rows)
    return np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(a, np.uint64) for _, a, _ in rows]]), np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, np.int64) for _, _, b in rows]])


def _range_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _whole(list(zip(*(t.column(x).to_pylist() for x in ("block", "a", "b")), strict=True)))


def _learning(model: Model, pairs: np.ndarray, rate: float):
    """The weights that a range learns, times its distinct runs, by place."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        m = copy.deepcopy(model)
        k, c = _range_of(t)
        m.counts = Counts(k, c, pairs)
        m.learn(k, c.astype(float), rate)
        w = np.concatenate((m.seen_w.ravel(), m.node_w.ravel())).astype(float)
        return pa.table({"i": np.arange(len(w), dtype=np.int32), "w": w * len(k), "n": np.full(len(w), float(len(k)))})

    return run


def _refining(model: Model, pairs: np.ndarray):
    """A range's part of the adaptive table, by place."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        m = copy.copy(model)
        k, c = _range_of(t)
        m.counts = Counts(k, c, pairs)
        out = m.refine_counts(k, c.astype(float))
        return pa.table({"i": np.arange(len(out), dtype=np.int32), "ones": out[:, 0], "n": out[:, 1]})

    return run


def train(texts: DataFrame, store: Store, bits: int = PART_BITS) -> tuple[Model, DataFrame, np.ndarray]:
    """texts: column bytes. Counts of all of them, then the gates' weights (averages of ranges' online learning) and the
    adaptive table: the model, the runs with counts by range, and the counts of (byte before, next byte)."""
    grams = store.cut(texts.mapInArrow(_run_counts(1 << bits), BLOB).groupBy("part").applyInArrow(_merge_runs, BLOB), "runs")
    got = grams.mapInArrow(_pair_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(1 << 16, np.int64)
    pairs[got.column("at").to_numpy()] = got.column("n").to_numpy()
    model = Model()
    # Each range learns by itself from where the last epoch ended, so the result does not depend on how ranges are dealt.
    for epoch in range(_EPOCHS):
        learn = _learning(model, pairs, _RATE / (1 + epoch))
        got = grams.groupBy("part").applyInArrow(learn, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
        if got.num_rows:
            w = np.zeros(got.num_rows)
            w[got.column("i").to_numpy()] = got.column("w").to_numpy()
            model = copy.deepcopy(model)
            model.seen_w, model.node_w = (x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(w, [model.seen_w.size]), (model.seen_w, model.node_w), strict=True))
    got = grams.groupBy("part").applyInArrow(_refining(model, pairs), "i int, ones double, n double").groupBy("i").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toArrow()
    total = np.zeros((256 * (_BUCKETS + 1), 2))
    total[got.column("i").to_numpy()] = np.stack([got.column("ones").to_numpy(), got.column("n").to_numpy()], 1)
    start = model.refine.ravel()
    model.refine = ((total[:, 0] + 20 * start) / (total[:, 1] + 20)).reshape(model.refine.shape).astype(np.float32)
    return model, grams, pairs


def _block_runs(parts: int):
    """Of a block of texts, its distinct runs by range."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.uint64)]
        for piece in t.column("bytes").chunks:
            for _, _, data, offsets in chunks(piece, PIECE):
                held.append(_distinct(byte_runs(data, offsets)[0])[0])
        k = _distinct(np.concatenate(held))[0]
        part = (mix(k >> U(32)) % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, key[0].as_py(), k[order[ends[p] : ends[p + 1]]].tobytes(), b"") for p in range(parts) if ends[p + 1] > ends[p]]
        return pa.Table.from_batches([_blob_rows(_NAMES, rows, _TYPES)])

    return run


def _run_bits(model: Model, pairs: np.ndarray):
    """Of a range, every block's runs with the log2 probabilities of their next bytes."""

    def run(key: tuple, asked: pa.Table, grams: pa.Table) -> pa.Table:
        m = copy.copy(model)
        m.counts = Counts(*_range_of(grams), pairs)
        a = [np.frombuffer(x, np.uint64) for x in asked.column("a").to_pylist()]
        k = _distinct(np.concatenate([np.zeros(0, np.uint64), *a]))[0]
        bits = m.bits(k).astype(np.float32)
        rows = [(-1, block, x.tobytes(), bits[np.searchsorted(k, x)].tobytes()) for block, x in zip(asked.column("block").to_pylist(), a, strict=True)]
        return pa.Table.from_batches([_blob_rows(_NAMES, rows, _TYPES)])

    return run


def _block_words(bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        return _words_of(key, t, bits)

    return run


def _words_of(key: tuple, t: pa.Table, bits: int) -> pa.Table:
    """Of a block of texts, the distinct words with how often training texts have them, by range of hashes."""
    held, count = [], []
    column, train_rows = t.column("bytes").combine_chunks(), t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for lo, hi, data, offsets in chunks(piece):
            w = words(data, offsets)
            learned = ~train_rows[lo:hi].astype(bool)
            packed = np.sort((w.hash & ~U(1)) | learned[w.doc].astype(np.uint64))
            at = runs(packed)
            held += [packed[at[:-1]], np.full(1, END_WORD & ~U(1), np.uint64)]
            count += [np.where(packed[at[:-1]] & U(1), np.diff(at), 0), np.array([learned.sum()])]
    k, c = _sum_sorted(np.concatenate(held) & ~U(1), np.concatenate(count).astype(np.int64))
    ends = np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(k)]
    rows = [(p, key[0].as_py(), k[ends[p] : ends[p + 1]].tobytes(), c[ends[p] : ends[p + 1]].astype(np.int64).tobytes()) for p in range(1 << bits) if ends[p + 1] > ends[p]]
    return pa.Table.from_batches([_blob_rows(_NAMES, rows, _TYPES)])


def _total_words(key: tuple, t: pa.Table) -> pa.Table:
    """Of a range of hashes, every block's words with their counts over all blocks; block -1 has (tokens, distinct words)."""
    part, blocks, a = key[0].as_py(), t.column("block").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("a").to_pylist()]
    k, c = _sum_sorted(np.concatenate(a), np.concatenate([np.frombuffer(x, np.int64) for x in t.column("b").to_pylist()]))
    rows = [(part, block, x.tobytes(), c[np.searchsorted(k, x)].tobytes()) for block, x in zip(blocks, a, strict=True)]
    rows.append((part, -1, b"", np.array([c.sum(), (c > 0).sum()], np.int64).tobytes()))
    return pa.Table.from_batches([_blob_rows(_NAMES, rows, _TYPES)])


def _log2_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """log2 probability of each text, from those of its block's distinct runs, sorted by run."""
    key, at = byte_runs(data, offsets)
    own, where = np.unique(key, return_inverse=True)
    total = np.concatenate(([0.0], np.cumsum(bits[np.searchsorted(known, own)].astype(float)[where])))
    return total[at[1:]] - total[at[:-1]]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0) -> DataFrame:
    """One row per row of docs: RESULT. Learns from rows whose crc32(id as text) modulo `folds` is not `held_out`.

    Base score: words (runs of other than white space, A-Z lower-cased), then one end, each log10((c + 0.1) / (N + 0.1 *
    (V + 1))). Score: log10 probability of the text's bytes and its end. Null text is empty: one token, and only its end
    is predicted. A row without an id counts as id ''. Rows that repeat an id are learned from and scored each. With
    nothing to learn from, N is 0 and every token unknown. An empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "lm-score")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    base = base.withColumn("held_out", fold("doc_id", folds) == held_out)
    size = base.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    bits = min(14, max(PART_BITS, (int(size) >> 24).bit_length()))
    model, grams, pairs = train(base.filter("not held_out").select("bytes"), store, bits)
    blocks = max(1, -(-int(size) // BLOCK))
    placed = base.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("bytes")), F.lit(blocks)))
    seen = placed.groupBy("block").applyInArrow(_block_words(bits), BLOB)
    counts = store.cut(seen.groupBy("part").applyInArrow(_total_words, BLOB), "counts")
    ends = [np.frombuffer(r[0], np.int64) for r in counts.filter("block = -1").select("b").collect()]
    n_train, v_train = (int(sum(e[i] for e in ends)) for i in (0, 1))
    below = np.log10(n_train + 0.1 * (v_train + 1))

    asked = placed.groupBy("block").applyInArrow(_block_runs(1 << bits), BLOB)
    told = asked.groupBy("part").cogroup(grams.groupBy("part")).applyInArrow(_run_bits(model, pairs), BLOB)

    def score(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True))
        runs_of = [x for x in rows if x[0] < 0]
        k = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(a, np.uint64) for _, a, _ in runs_of]])
        order = np.argsort(k, kind="stable")
        known, known_bits = k[order], np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(b, np.float32) for _, _, b in runs_of]])[order]
        by_range = rows[len(runs_of) :]
        vocabulary = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(a, np.uint64) for _, a, _ in by_range]])
        count = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, np.int64) for _, _, b in by_range]])
        c_end = int(count[np.searchsorted(vocabulary, END_WORD & ~U(1))]) if len(vocabulary) else 0
        out: list[list] = [[] for _ in range(5)]
        column = texts.column("bytes")
        for piece in column.chunks:
            for _, _, data, offsets in chunks(piece):
                w = words(data, offsets)
                hashed = w.hash & ~U(1)
                order = np.sort(hashed)
                order = order[runs(order)[:-1]]
                c = count[np.searchsorted(vocabulary, order)][np.searchsorted(order, hashed)] if len(hashed) else np.zeros(0, np.int64)
                logs = np.concatenate(([0.0], np.cumsum(np.log10(c + 0.1))))
                hits = np.concatenate(([0], np.cumsum(c > 0)))
                n = w.count + 1
                out[0].append(n)
                out[1].append(hits[w.bound[1:]] - hits[w.bound[:-1]] + (c_end > 0))
                out[2].append(logs[w.bound[1:]] - logs[w.bound[:-1]] + np.log10(c_end + 0.1) - n * below)
                bits = _log2_of(data, offsets, known, known_bits)
                out[3].append(bits * np.log10(2))
                out[4].append(-bits / np.maximum(np.diff(offsets), 1))
        cols = [pa.array(np.concatenate(x)) for x in out]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), cols[0], cols[1].cast(pa.int64()), pa.array(np.full(len(texts), n_train)), cols[2], cols[3], cols[4]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return placed.groupBy("block").cogroup(counts.filter("block >= 0").unionByName(told).groupBy("block")).applyInArrow(score, RESULT)
