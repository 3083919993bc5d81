"""Document quality by co-training two views.

One classifier sees the text's content (frequencies of hashed runs of three bytes), the other its page metadata:
language, source, length and layout (lines, words, shares of kinds of characters, repeated words). In each round both
score every unlabelled text, in the tasks; the texts that one is surest of become pseudo-labels that the other learns
from. Afterwards both are calibrated on labelled rows that neither has seen, and a small logistic model combines the
calibrated views; it scores every document.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, text_or_empty
from .learn import byte_grams, first_by_hash, fold, linear, logistic, sigmoid, surest
from .textnum import U, buffers, chunks, runs, words

#: Hash bits of the content view; labelled rows fitted on at most; rounds; pseudo-labels that a view gets in a round.
BITS, SAMPLE, ROUNDS, GIVEN = 10, 8_000, 2, 1_000
_PAGE, _LANGS, _SOURCES = 12, 8, 32  # columns of the metadata view
_KIND = np.zeros(256, np.int64)  # 0: other, 1: lower, 2: upper, 3: digit, 4: punctuation, 5: space
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed three-byte runs."""
    n, size = len(offsets) - 1, 1 << BITS
    doc, f = byte_grams(data, offsets, 3, BITS)
    x = np.bincount(doc * size + f, minlength=n * size).reshape(n, size).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


def metadata(data: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 6 + _KIND[data], minlength=n * 6).reshape(n, 6) / np.maximum(size, 1)[:, None]
    lines = np.bincount(doc[data == 10], minlength=n) + 1.0
    w = words(data, offsets)
    count = w.count.astype(float)
    packed = np.sort((w.doc.astype(np.uint64) << U(52)) | (w.hash >> U(12)))
    distinct = np.bincount((packed[runs(packed)[:-1]] >> U(52)).astype(np.int64), minlength=n)
    edges = np.concatenate(([0], np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1))[1:] if len(w.hash) else np.zeros(0, np.int64)
    again = np.bincount(w.doc[edges], minlength=n) if len(edges) else np.zeros(n)
    safe = np.maximum(count, 1)
    out = np.zeros((n, _PAGE + _LANGS + _SOURCES), np.float32)
    out[:, :6] = kinds
    out[:, 6:_PAGE] = np.stack([np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(count) / 8, distinct / safe, again / safe, (size - kinds[:, 5] * size) / safe / 10], 1)
    for i, (a, b) in enumerate(zip(langs, sources, strict=True)):
        out[i, _PAGE + zlib.crc32((a or "").encode()) % _LANGS] = 1
        out[i, _PAGE + _LANGS + zlib.crc32((b or "").encode()) % _SOURCES] = 0.3
    return out


def _features(text: pa.Array, langs: list, sources: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, content view, metadata view) of runs of rows."""
    for lo, hi, data, offsets in chunks(text, rows=2048):
        yield lo, hi, content(data, offsets), metadata(data, offsets, langs[lo:hi], sources[lo:hi])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, a, b in _features(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = batch.slice(lo, hi - lo)
            blobs = [pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(4), own.column(5), *blobs], ["doc_id", "y0", "y1", "a", "b"])


class CoTrained:
    """The two classifiers, their calibration and the combination: a few thousand numbers."""

    def __init__(self, view: Callable[[int], np.ndarray], y: Sequence[np.ndarray], held: np.ndarray, labelled: int) -> None:
        """view: makes the rows of a view, which are let go before the next one's; y: for each view, 0, 1 or nan of rows that
        are not for it; held: rows kept for calibration; the first `labelled` rows have labels, the rest pseudo-labels."""
        self.mean, self.scale, self.w, z = [], [], [], []
        for i in (0, 1):
            x = view(i)
            self.mean.append(x[:labelled].mean(0))
            self.scale.append(np.maximum(x[:labelled].std(0), 1e-3))
            x -= self.mean[i]
            x /= self.scale[i]
            own = np.flatnonzero(~np.isnan(y[i]) & ~held)
            self.w.append(logistic(x[own], y[i][own], np.where(own < labelled, 1.0, 0.5)))
            z.append(linear(x[held], self.w[i]))
            del x
        learnt = y[0][:labelled][~held[:labelled]]
        self.prior = float(learnt.mean()) if len(learnt) else 1.0
        held_y = y[0][held]
        both = len(np.unique(held_y)) == 2
        self.platt = [logistic(v[:, None], held_y, l2=1e-4) for v in z] if both else [np.array([1.0, 0.0])] * 2
        cal = np.stack([linear(v[:, None], p) for v, p in zip(z, self.platt, strict=True)], 1)
        self.combine = logistic(cal, held_y, l2=1e-2) if both else np.array([0.5, 0.5, 0.0])

    def margins(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [linear(((v - self.mean[i]) / self.scale[i]).astype(np.float32), self.w[i]) for i, v in enumerate((a, b))]

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: combined, by content, by metadata."""
        cal = [linear(z[:, None], p) for z, p in zip(self.margins(a, b), self.platt, strict=True)]
        return sigmoid(linear(np.stack(cal, 1), self.combine)), sigmoid(cal[0]), sigmoid(cal[1])


def _rows_of(base: DataFrame, chosen: DataFrame, round_: int) -> DataFrame:
    """Both views of the ids in `chosen` (id, y0, y1), a row each; of rows that repeat an id, the least text."""
    own = [F.max("y0").alias("y0"), F.max("y1").alias("y1")]
    rows = base.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(F.struct("bytes", "lang", "source")).alias("r"), *own)
    return rows.select("doc_id", "r.*", "y0", "y1").mapInArrow(_sampled, "doc_id long, y0 double, y1 double, a binary, b binary").withColumn("round", F.lit(round_))


def _trained(t: pa.Table) -> pa.Table:
    """The pickled model of all rows (of round 0: labelled ones), in order of round and id; no row without both classes."""
    doc, rounds = t.column("doc_id").to_numpy(), t.column("round").to_numpy()
    order = np.lexsort((doc, rounds))
    y = [t.column(c).to_numpy()[order] for c in ("y0", "y1")]
    labelled = int((rounds == 0).sum())
    first = y[0][:labelled]
    if len(np.unique(first)) < 2:
        return pa.table({"model": pa.array([], pa.binary())})
    held = np.zeros(len(order), bool)
    held[:labelled] = [zlib.crc32(b"held%d" % i) % 4 == 0 for i in doc[order[:labelled]]]
    if len(np.unique(first[~held[:labelled]])) < 2:
        held[:] = False

    def view(i: int) -> np.ndarray:
        data, offsets = buffers(t.column("ab"[i]).combine_chunks())
        return data[offsets[0] : offsets[-1]].view(np.float16).reshape(len(order), -1)[order].astype(np.float32)

    return pa.table({"model": pa.array([pickle.dumps(CoTrained(view, y, held, labelled))], pa.binary())})


def _train(rows: DataFrame) -> CoTrained | None:
    """Fitted in one task on rows whose number is bounded (SAMPLE, GIVEN): the driver gets the model, never the rows."""
    got = rows.groupBy().applyInArrow(_trained, "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


def _pseudo_labels(model: CoTrained, free: DataFrame, known: DataFrame, store: Store, given: int, name: str) -> list[dict[int, float]]:
    """For each view, which ids the other view is surest of and its labels for them, in the labelled rows' proportion.

    Every row of `free` is scored; equal texts stand for one id, the least of them. Labelled ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, a, b in _features(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo), *[pa.array(z) for z in model.margins(a, b)]], ["doc_id", "text", "z0", "z1"])

    rows = free.withColumn("text", F.xxhash64("bytes")).mapInArrow(run, "doc_id long, text long, z0 double, z1 double")
    rows = rows.filter("abs(z0) > 1 or abs(z1) > 1")
    rows = store.cut(rows.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("text").agg(F.min(F.struct("doc_id", "z0", "z1")).alias("r")).select("r.*").groupBy("doc_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1")), name)
    out: list[dict[int, float]] = [{}, {}]
    high = int(given * model.prior)
    for i in (0, 1):
        z = F.col(f"z{i}")
        for sign, label, most in ((z, 1.0, high), (-z, 0.0, given - high)):
            if most:
                out[1 - i] |= {r[0]: label for r in surest(rows.filter(sign > 1), sign, most, "doc_id", "s").select("doc_id").collect()}
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained | None:
    """Fit on at most `sample` labelled rows, first in a seeded order of ids, and in each of `rounds` rounds on at most
    `given` pseudo-labels a view, chosen among all unlabelled rows; None without both classes.

    Rows whose crc32(id as text) modulo 4 is 2 are never fitted on.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(fold("doc_id", 4) != 2).groupBy("doc_id").agg(F.min("y").alias("y"))
    spark, store = docs.sparkSession, Store(docs.sparkSession, "quality")
    y = F.col("y").cast("double")
    told = store.cut(first_by_hash(known, "doc_id", sample, "q").select(F.col("doc_id").alias("id"), y.alias("y0"), y.alias("y1")), "told")
    base = _base(docs, id_col, text_col).filter("doc_id is not null").filter(fold("doc_id", 4) != 2)
    rows = store.cut(_rows_of(base, told, 0), "rows0")
    model = _train(rows)
    for r in range(rounds if model else 0):
        both = _pseudo_labels(model, base, known, store, given, f"margins{r}")
        if chosen := sorted({*both[0], *both[1]}):
            taught = spark.createDataFrame([(i, both[0].get(i), both[1].get(i)) for i in chosen], "id long, y0 double, y1 double")
            rows = rows.unionByName(store.cut(_rows_of(base, taught, r + 1), f"rows{r + 1}"))
            model = _train(rows)
    store.drop("")
    return model


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *_inputs(docs, text_col))


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    def optional(c: str) -> Column:
        return (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)

    return [text_or_empty(text_col).cast("binary").alias("bytes"), optional("lang"), optional("source")]


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int):
    """An Arrow function of (bytes, lang, source): struct<score, content_score, metadata_score>."""
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    only = 1.0
    if model is None:
        ends = labels.filter(fold(id_col, 4) != 2).filter(F.col(label_col).isin(0, 1)).agg(F.max(label_col)).first()[0]
        only = 0.0 if ends == 0 else 1.0

    @F.arrow_udf("score double, content_score double, metadata_score double")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        out = np.full((3, len(text)), only)
        if model is not None:
            for lo, hi, a, b in _features(text, lang.to_pylist(), source.to_pylist()):
                out[:, lo:hi] = model.scores(a, b)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["score", "content_score", "metadata_score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, score, content_score, metadata_score (each 0 to 1), good (score >= threshold).

    Null text is empty, null or missing language and source are a value of their own; all are scored. Labels other than
    0 and 1 are no labels, and an id with both counts as 0. If the labelled rows lack a class, every score is 1 (0 if
    all are 0). Rows that repeat an id are scored each; an empty table gives an empty result.
    """
    score = _scorer(docs, labels, id_col, text_col, label_col, sample)
    out = _base(docs, id_col, text_col).select("doc_id", score("bytes", "lang", "source").alias("s"))
    return out.select("doc_id", "s.*", (F.col("s.score") >= threshold).alias("good"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least threshold, with all columns; each row is judged by itself, with or without an id."""
    score = _scorer(docs, labels, id_col, text_col, "quality", SAMPLE)
    return docs.filter(score(*_inputs(docs, text_col))["score"] >= threshold)
