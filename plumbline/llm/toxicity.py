"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; the training folds as a whole are the unlabelled texts, some of them toxic.
With class prior p, the risk is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)): the toxic share of the
unlabelled part is taken out of its negative risk, and that difference may not fall below zero.

Inputs are only which words and runs of four and five bytes a text has. All that positives have clearly more often than
training texts do are found over the whole table. The training texts are dealt into shards; in each a task fits a linear
classifier in numpy, on the shard's texts and the confirmed ones, and the weights are averaged over the shards.

The class prior is the share of toxic rows among the labelled ones: labels are used for that share and for which rows are
confirmed, and no row counts as a negative example.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, text_or_empty
from .learn import adam, byte_grams, first_by_hash, fold, sigmoid
from .textnum import U, buffers, chunks, runs, words

#: Slots of hashed features; confirmed rows fitted on at most; training texts of a shard, about.
BITS, SAMPLE, SHARD = 22, 20_000, 20_000
#: Scores before the bias are counted to a 1024th, between -_WIDE and _WIDE.
_FINE, _WIDE = 1024, 40
#: Bits of the bitmap of confirmed ids.
ID_BITS = 23
#: A feature's count among positives must be this unlikely by chance, and this share of the texts with it toxic.
LEAST_G, LEAST_SHARE = 9.0, 0.4
TRAIN_FOLDS, HELD_OUT = 4, 2


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    w = words(data, offsets)
    yield w.doc, (w.hash >> U(64 - BITS)).astype(np.int64)
    for n in (4, 5):
        yield byte_grams(data, offsets, n, BITS)


def _present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each once."""
    doc, f = (np.concatenate(x) for x in zip(*_features(data, offsets), strict=True))
    packed = np.sort((doc.astype(np.uint64) << U(BITS)) | f.astype(np.uint64))
    packed = packed[runs(packed)[:-1]]
    return (packed >> U(BITS)).astype(np.int64), (packed & U((1 << BITS) - 1)).astype(np.int64)


def _doc_counts(docs: DataFrame) -> DataFrame:
    """f, n: in how many texts (column bytes) each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(_present(data, offsets)[1], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            x = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(total[x].astype(np.int64))], ["f", "n"])

    return docs.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _may_have(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, bytes) with one of the ids, and few others, so that other texts need no shuffle: by a
    bitmap of hashed ids, of fixed size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    got = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (ID_BITS - 5), np.int64)
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    bitmap = bitmap.astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1))

    return docs.select("doc_id", "bytes", slot.alias("s")).mapInArrow(run, "doc_id long, bytes binary")


def _hits(slot: np.ndarray):
    """Of texts (id, bytes, held_out), the chosen features that they have, as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = [(d[c >= 0], c[c >= 0]) for d, f in _features(data, offsets) for c in [slot[f]]]
                doc, f = (np.concatenate(x) for x in zip(*found, strict=True))
                packed = np.sort((doc.astype(np.int64) << 32) | f)
                packed = packed[runs(packed)[:-1]]
                ends = (np.searchsorted(packed >> 32, np.arange(hi - lo + 1)) * 4).astype(np.int32)
                hits = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((packed & 0xFFFFFFFF).astype(np.int32).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), hits], ["doc_id", "held_out", "hits"])

    return run


#: Texts with their weights: (text of each hit, feature of each hit, weight of each text).
Texts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _texts(hits: pa.Array, weight: np.ndarray) -> Texts:
    data, offsets = buffers(hits)
    f = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int32).astype(np.int64)
    return np.repeat(np.arange(len(weight)), np.diff(offsets) // 4), f, weight.astype(float)


def logits(x: Texts, w: np.ndarray) -> np.ndarray:
    return np.bincount(x[0], w[x[1]], len(x[2])) + w[-1]


def nn_risk(w: np.ndarray, positive: Texts, unlabelled: Texts, prior: float, l2: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with logistic loss, and its gradient; w: weights and, last, the bias, which is not decayed."""
    zp, zu = logits(positive, w), logits(unlabelled, w)
    ap, au = positive[2] / positive[2].sum(), unlabelled[2] / unlabelled[2].sum()
    negative = (np.logaddexp(0, zu) * au).sum() - prior * (np.logaddexp(0, zp) * ap).sum()
    gp, gu = prior * (sigmoid(zp) - 1) * ap, np.zeros(len(zu))
    if negative > 0:
        gp, gu = gp - prior * sigmoid(zp) * ap, sigmoid(zu) * au
    # else the difference is held at zero, and only the positive risk has a gradient
    n = len(w) - 1
    g = np.bincount(positive[1], gp[positive[0]], n) + np.bincount(unlabelled[1], gu[unlabelled[0]], n) + l2 * w[:-1]
    risk = prior * (np.logaddexp(0, -zp) * ap).sum() + max(0.0, negative) + l2 / 2 * (w[:-1] ** 2).sum()
    return risk, np.append(g, gp.sum() + gu.sum())


def fit_nnpu(positive: Texts, unlabelled: Texts, prior: float, n_features: int, l2: float = 2e-4, steps: int = 400, members: int = 3) -> np.ndarray:
    """Mean weights (and bias, last) of linear classifiers of least non-negative risk: one on all texts, others on draws from them."""

    def drawn(x: Texts, rng: np.random.Generator) -> Texts:
        return x[0], x[1], rng.multinomial(int(x[2].sum()), x[2] / x[2].sum()).astype(float)

    start, out = np.zeros(n_features + 1), []
    start[-1] = np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))
    for member in range(members):
        rng = np.random.default_rng(member)
        p, u = (drawn(x, rng) if member else x for x in (positive, unlabelled))
        out.append(adam(lambda w, p=p, u=u: nn_risk(w, p, u, prior, l2)[1], start, steps))
    return np.mean(out, axis=0)


def _bias(z: np.ndarray, n: np.ndarray, prior: float) -> float:
    """The bias at which the mean score of n texts with z before it is the prior."""
    lo, hi = -60.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (sigmoid(z + mid) * n).sum() > prior * n.sum() else (mid, hi)
    return lo


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Rows whose crc32(id as text) modulo 4 is 2 are held out: neither their labels nor their texts are learned from. Of
    the confirmed rows at most `sample` are fitted on, first in a seeded order of ids; all else is over all training
    texts, copies included. Labels other than 0 and 1 are no labels; several labels of an id count as toxic if one does.
    Null text is empty and gets the score of a text without features. Without positives every score is the prior, 0.
    Rows without an id are scored and belong to no training fold. Extra columns are not read.
    """
    store = Store(docs.sparkSession, "toxicity")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    base = base.withColumn("held_out", fold("doc_id", TRAIN_FOLDS) == HELD_OUT)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(fold("doc_id", TRAIN_FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(0.9, n_toxic / n_known) if n_known else 0.0
    toxic = known.filter("y = 1").select("doc_id")
    slot = _chosen_features(base.filter("doc_id is not null and not held_out"), toxic, prior) if n_toxic else np.zeros(0, np.int32)
    if not len(slot):
        return base.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0.0 >= threshold).cast("int").alias("predicted"))
    hits = store.cut(base.select("doc_id", "bytes", "held_out").mapInArrow(_hits(slot), "doc_id long, held_out boolean, hits binary"), "hits")
    w = _fit(hits, first_by_hash(toxic, "doc_id", sample, "p"), prior, int(slot.max()) + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sigmoid(logits(_texts(batch.column(2), np.ones(batch.num_rows)), w))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return hits.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def _chosen_features(learn: DataFrame, toxic: DataFrame, prior: float) -> np.ndarray:
    """Of each slot, which feature it is (-1: none), or nothing: all that confirmed texts have clearly more often.

    Every confirmed training row counts, copies too, as they do in the counts of all training texts and in the prior.
    """
    confirmed = _may_have(learn, toxic).join(toxic, "doc_id", "left_semi")
    in_p = _doc_counts(confirmed.select("bytes")).withColumnRenamed("n", "a")
    in_u = _doc_counts(learn.select("bytes"))
    n_p, n_u = confirmed.count(), learn.count()
    if not n_p:
        return np.zeros(0, np.int32)
    # Expected count of a feature among the positives if it told nothing; g: how unlikely the count is by chance
    # (natural log of a Poisson tail); toxic share of the texts with it by Bayes' rule.
    expected = F.col("n") * F.lit(n_p / n_u)
    g = F.col("a") * F.log(F.col("a") / expected) - (F.col("a") - expected)
    share = F.lit(prior) * F.col("a") / expected
    top = in_p.filter("a >= 3").join(in_u, "f").filter((F.col("a") > expected) & (g >= LEAST_G) & (share >= LEAST_SHARE)).select("f").toArrow().column("f").to_numpy()
    slot = np.full(1 << BITS, -1, np.int32)
    slot[np.sort(top)] = np.arange(len(top), dtype=np.int32)
    return slot if len(top) else np.zeros(0, np.int32)


def _fit(hits: DataFrame, toxic: DataFrame, prior: float, n_features: int) -> np.ndarray:
    """Mean weights over the shards, and the bias at which the mean score of all training texts is the prior."""
    learn = hits.filter("doc_id is not null and not held_out")
    held = learn.join(toxic, "doc_id", "left_semi").groupBy("hits").agg(F.count(F.lit(1)).alias("n")).toArrow()
    positive = _texts(held.column("hits").combine_chunks(), held.column("n").to_numpy())
    shards = max(1, round(learn.count() / SHARD))
    # Equal texts of a shard count as one with a weight: copies of one text take no room.
    dealt = learn.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "hits").agg(F.count(F.lit(1)).alias("n"))

    def member(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("hits").combine_chunks()
        unlabelled = _texts(t.column("hits").chunk(0), t.column("n").to_numpy())
        w = fit_nnpu(positive, unlabelled, prior, n_features)
        return pa.table({"j": np.arange(len(w), dtype=np.int32), "w": w, "n": np.full(len(w), unlabelled[2].sum())})

    dealt = dealt.repartitionByRange(shards, "shard")  # a task each: a shard's rows are few, its fit is not
    got = dealt.groupBy("shard").applyInArrow(member, "j int, w double, n double").groupBy("j").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
    w = np.zeros(n_features + 1)
    w[got.column("j").to_numpy()] = got.column("w").to_numpy()
    w[-1] = 0

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * _WIDE * _FINE + 1, np.int64)
        for batch in batches:
            z = np.clip(logits(_texts(batch.column(0), np.ones(batch.num_rows)), w), -_WIDE, _WIDE)
            total += np.bincount(np.rint((z + _WIDE) * _FINE).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = learn.select("hits").mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    w[-1] = _bias(got.column("at").to_numpy() / _FINE - _WIDE, got.column("n").to_numpy(), prior)
    return w
