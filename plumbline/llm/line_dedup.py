"""Line deduplication over levelled sorted runs of line hashes.

A batch of documents has, for each line key, the number of its documents with it and the largest id. It is merge-joined
with the runs there are: keys that no run has (the anti join) are fresh and become a run of level 0, so that runs never
share a key; the others repeat a key that a run has, and only their counts are kept beside the runs, as updates. When a
level has `fanout` runs they are merged into one of the next level, so a lookup meets few runs however many batches came.
Runs are bucketed and sorted by key: joins with them move no run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, skew_join, text_or_empty

_STRIP = b" \t\n\x0b\x0c\r"
LINES = "doc_id long, h1 long, h2 long"


def _key(line: bytes) -> bytes:
    """ASCII only: bytes.lower leaves other letters alone."""
    return line.strip(_STRIP).lower()


def _hashes(line: bytes, min_chars: int) -> tuple[int, int] | None:
    key = _key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h1, h2: the keys of at least min_chars code points, once per row of docs. docs: doc_id, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one, two = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h1, h2 in {h for line in text.split(b"\n") if (h := _hashes(line, min_chars))}:
                    ids.append(doc)
                    one.append(h1)
                    two.append(h2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.mapInArrow(run, LINES)


KEY = ["h1", "h2"]


class LineRuns:
    """The levelled runs and the updates of their keys, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.store, self.fanout, self.made = Store(spark, "line-runs"), fanout, 0
        #: As many buckets as Spark deals shuffles into, so that both sides of a join lie alike.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.updates: list[DataFrame] = []

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        return self.store.cut_buckets(rows, f"run{self.made}", self.buckets, *KEY, partition_by="seen")

    def joined(self, lines: DataFrame, batch: int) -> DataFrame:
        """The keys of a batch with their counts; seen: a run has the key."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        hit = F.lit(False)
        for i, run in enumerate(self._runs()):
            own = own.join(run.select(*KEY, F.lit(True).alias(f"_in{i}")), KEY, "left")
            hit = hit | F.col(f"_in{i}").isNotNull()
        return own.select(*KEY, "n_docs", "max_doc", F.lit(batch).alias("first_batch"), hit.alias("seen"))

    def add(self, lines: DataFrame, batch: int) -> None:
        """Merge-anti-join a batch (doc_id, h1, h2 from documents that no other batch has) with the runs, and add it."""
        had_runs = bool(self._runs())
        rows = self._write(self.joined(lines, batch))
        self.levels[0].append(rows.filter("not seen"))
        if had_runs:
            self.updates.append(rows.filter("seen").select(*KEY, "n_docs", "max_doc"))
        self.compact()

    def compact(self) -> None:
        """Merge each level that has fanout runs into one of the next; runs share no key, so their rows stay as they are."""
        level = 0
        while level < len(self.levels):
            if len(runs := self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(_union(runs)).filter("not seen"))
                self.levels[level] = []
            level += 1

    def lookup(self) -> DataFrame:
        """h1, h2, n_docs, max_doc, first_batch over all runs and updates."""
        runs = self._runs()
        if not self.updates:
            return _union(runs).drop("seen")
        more = _union(self.updates).groupBy(*KEY).agg(F.sum("n_docs").alias("_n"), F.max("max_doc").alias("_max"))
        n, top = F.col("n_docs") + F.coalesce("_n", F.lit(0)), F.greatest("max_doc", "_max")
        return _union([run.join(more, KEY, "left").select(*KEY, n.alias("n_docs"), top.alias("max_doc"), "first_batch") for run in runs])

    def close(self) -> None:
        self.store.forget()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept (the text that stays).

    Lines end at \\n; a null or empty text is one empty line. Line keys are stripped of white space and lower-cased
    (A-Z). A key of at least min_chars code points in at least min_docs documents loses all its lines but those of the
    largest id with it. Rows that repeat an id are one document for the counts, and each is written out with its own
    text. Rows without an id count for nothing and lose nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, "line-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    found = line_keys(base.filter("doc_id is not null"), min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = store.cut(found.withColumn("batch", batch), "lines", "batch")
    own = lines.select("doc_id", "h1", "h2", "batch")
    if base.groupBy("doc_id").count().filter("doc_id is not null and count > 1").limit(1).count():
        own = own.distinct()  # rows that repeat an id
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(own.filter(F.col("batch") == b).select("doc_id", "h1", "h2"), b)
    drop = runs.lookup().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", "max_doc")
    drop = store.cut(drop, "drop")
    runs.close()
    total = lines.count()
    hit = skew_join(lines.select("doc_id", "h1", "h2"), drop, ["h1", "h2"], "n_docs", total, F.xxhash64("doc_id"))
    hit = hit.filter("max_doc is not null and doc_id != max_doc").groupBy("doc_id").agg(F.collect_set("h1").alias("gone"))
    joined = base.join(hit.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "bytes", "gone")

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc, text, gone in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n, dropped, kept = text.count(b"\n") + 1, 0, text
                if gone:
                    out, own = set(gone), []
                    for line in text.split(b"\n"):
                        h = _hashes(line, min_chars)
                        if h is not None and h[0] in out:
                            dropped += 1
                        else:
                            own.append(line)
                    kept = b"\n".join(own)
                rows.append((doc, n, dropped, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return joined.mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")
