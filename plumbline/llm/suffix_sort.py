"""A difference-cover sort of suffixes that no task holds whole.

Letters are runs of LETTER bytes. Of each text (context), the triples of letters at the positions of two of three
residues are sorted by range over all tasks and named in their order. Any two positions then have a place ahead, nearer
than three letters, at which both are sampled: residues 1 and 2 at once, 0 and 1 a letter on, 0 and 2 two letters on. So
three lists, one for each pair of residues, order all positions by the letters before that place, the names of the
triples from there (the triples of the next level) and the bytes that are left of `length`. Neighbours in a list are
compared over `length` bytes; of equal strings only the first in the corpus stays.

Texts lie in blocks of bounded size. A block sends each distinct triple and each distinct string once, so that a string
that all texts share is as many rows as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store
from .textnum import U, buffers

LETTER = 12
#: Bytes of text in a block, about, and rows of a range.
BLOCK, RANGE_ROWS = 1 << 20, 1 << 19
#: The pairs of residues and how many letters ahead both are sampled.
PAIRS = (((1, 2), 0), ((0, 1), 1), ((0, 2), 2))
TEXTS = "block int, id long, doc_id long, tag int, start int, ctx binary"


class _Block:
    """The texts of a block, by id, as one array of bytes."""

    def __init__(self, t: pa.Table, length: int) -> None:
        t = t.sort_by("id").combine_chunks()
        self.length = length
        self.id, self.doc, self.tag, self.start = (t.column(c).to_numpy() for c in ("id", "doc_id", "tag", "start"))
        data, offsets = buffers(t.column("ctx").chunk(0))
        self.at = offsets - offsets[0]
        size = np.diff(self.at)
        self.data = np.concatenate((data[offsets[0] : offsets[-1]], np.zeros(length + 8, np.uint8)))
        n = int(self.at[-1])
        self.wide = np.zeros(n + length, np.uint64)  # the eight bytes at each position, as a number
        for j in range(8):
            self.wide = (self.wide << U(8)) | self.data[j : j + len(self.wide)].astype(np.uint64)
        self.text = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - self.at[self.text]
        self.residue, left = place // LETTER % 3, size[self.text] - place
        self.sampled = np.flatnonzero((self.residue > 0) & (left >= 3 * LETTER))
        self.place, self.wanted = place, left >= length

    def raw(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n bytes at positions, a row each."""
        return self.data[at[:, None] + np.arange(n)]

    def distinct_triples(self) -> tuple[np.ndarray, np.ndarray]:
        """(a position of each distinct sampled triple, in order; which of them each sampled position has)."""
        at = self.sampled
        order = np.lexsort([self.wide[at + k] for k in (28, 24, 16, 8, 0)])  # 36 bytes, the last eight overlapping
        s = at[order]
        new = np.ones(len(s), bool)
        if len(s):
            new[1:] = np.any([self.wide[s[1:] + k] != self.wide[s[:-1] + k] for k in (0, 8, 16, 24, 28)], axis=0)
        which = np.empty(len(s), np.int64)
        which[order] = np.cumsum(new) - 1
        return s[new], which


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _triples(length: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = _Block(t, length)
        at, _ = block.distinct_triples()
        return pa.table([_binary(block.raw(at, 3 * LETTER)), pa.array(np.full(len(at), key[0].as_py(), np.int32)), pa.array(np.arange(len(at), dtype=np.int32))], names=["t", "block", "seq"])

    return run


def _runs_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by their first column (width bytes each), and which rows differ from the one before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            data, offsets = buffers(batch.column(0))
            rows = data[offsets[0] : offsets[-1]].reshape(-1, width)
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            new[0] = last is None or bool((rows[0] != last).any())
            last = rows[-1].copy()
            yield batch, new


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names in the order of triples: ranges lie in order, and so do the names within one."""
    name = TaskContext.get().partitionId() << 40
    for batch, new in _runs_of(batches, 3 * LETTER):
        names = name + np.cumsum(new)
        name = int(names[-1])
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names)], ["block", "seq", "name"])


STRINGS = "key binary, id long, place int, doc_id long, tag int, start int"


def _strings(length: int):
    def run(key: tuple, texts: pa.Table, names: pa.Table) -> pa.Table:
        """A block's distinct strings of each list with their first place, and (key null) the places that come after it."""
        block = _Block(texts, length)
        _, which = block.distinct_triples()
        given = np.zeros(names.num_rows, np.int64)
        given[names.column("seq").to_numpy()] = names.column("name").to_numpy()
        name = np.zeros(len(block.residue) + length, np.int64)
        name[block.sampled] = given[which] if len(which) else given[:0]
        tables = []
        for number, (residues, lead) in enumerate(PAIRS):
            at = np.flatnonzero(block.wanted & np.isin(block.residue, residues))
            many, tail = divmod(length - lead * LETTER, 3 * LETTER)
            named = [name[at + lead * LETTER + 3 * LETTER * i].astype(">i8").view(np.uint8).reshape(-1, 8) for i in range(many)]
            keys = np.concatenate([np.full((len(at), 1), number, np.uint8), block.raw(at, lead * LETTER), *named, block.raw(at + length - tail, tail)], axis=1)
            text = block.text[at]
            first = block.start[text] + block.place[at]
            as_one = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel()
            group = np.unique(as_one, return_inverse=True)[1] if len(at) else np.zeros(0, np.int64)
            order = np.lexsort((first, block.tag[text], block.doc[text], group))
            later = np.zeros(len(at), bool)
            later[order[1:]] = group[order[1:]] == group[order[:-1]]
            for rows, key_of in ((np.flatnonzero(~later), lambda r: _binary(keys[r])), (np.flatnonzero(later), lambda r: pa.nulls(len(r), pa.binary()))):
                t = text[rows]
                tables.append(pa.table([key_of(rows), pa.array(block.id[t]), pa.array(block.place[at[rows]].astype(np.int32)), pa.array(block.doc[t]), pa.array(block.tag[t]), pa.array(first[rows].astype(np.int32))], names=["key", "id", "place", "doc_id", "tag", "start"]))
        return pa.concat_tables(tables)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted with their places, all places but each string's first."""
    width = None
    held: list[pa.RecordBatch] = []

    def rows() -> Iterator[pa.RecordBatch]:
        yield from held
        yield from batches

    for batch in batches:
        held.append(batch)
        if batch.num_rows:
            width = len(batch.column(0)[0].as_py())
            break
    if width is not None:
        for batch, new in _runs_of(rows(), width):
            yield batch.select([1, 2]).filter(pa.array(~new))


def later_windows(contexts: DataFrame, store: Store, length: int) -> DataFrame:
    """id, gone (bits of the windows, by place) of contexts: h, c1, c2, first: struct<doc_id, tag, start>, ctx. id: h, c1, c2.

    A window is gone if an equal one, in any context, comes first by (doc_id, tag, start).
    """
    size = contexts.agg(F.coalesce(F.sum(F.length("ctx")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // BLOCK))
    dealt = contexts.repartitionByRange(n, "h", "c1", "c2").withColumns({"block": F.spark_partition_id(), "id": F.monotonically_increasing_id()})
    dealt = store.cut(dealt.select("h", "c1", "c2", "block", "id", "first.*", "ctx"), "sort-blocks")
    texts = dealt.select("block", "id", "doc_id", "tag", "start", "ctx")
    triples = store.cut(texts.groupBy("block").applyInArrow(_triples(length), "t binary, block int, seq int"), "sort-triples")
    ranges = max(1, -(-triples.count() // RANGE_ROWS))
    names = store.cut(triples.repartitionByRange(ranges, "t").sortWithinPartitions("t").mapInArrow(_names, "block int, seq int, name long"), "sort-names")
    store.drop("sort-triples")
    strings = store.cut(texts.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_strings(length), STRINGS), "sort-strings")
    store.drop("sort-names")
    known = strings.filter("key is not null")
    ranges = max(1, -(-known.count() // RANGE_ROWS))
    after = known.repartitionByRange(ranges, "key").sortWithinPartitions("key", "doc_id", "tag", "start").mapInArrow(_later, "id long, place int")
    gone = after.unionByName(strings.filter("key is null").select("id", "place")).groupBy("id").agg(F.collect_set("place").alias("places"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "gone"])

    found = gone.mapInArrow(bits, "id long, gone binary")
    out = store.cut(dealt.select("id", "h", "c1", "c2").join(found, "id").select("h", "c1", "c2", "gone"), "sort-gone")
    store.drop("sort-strings", "sort-blocks")
    return out
