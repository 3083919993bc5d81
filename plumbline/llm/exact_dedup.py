"""Exact deduplication by an extendible-hash index kept in shared files; DataFrame functions only.

Equal texts are those that agree after all white space (space, tab to carriage return) is deleted. The index has a
63-bit key a text. Its directory starts with as many slots as an even spread of keys needs; a slot that holds more than
`capacity` keys doubles until each of its buckets fits, however deep that goes, while a bucket of one key is never split.
A bucket is a range of keys, and one task owns it: it takes the bucket's entries, chains those with one key, compares
their bytes, and settles the size of each group and the row that stays. Before entries travel to their owner, copies
collapse inside a few lanes (by id), so that a text that fills a third of the table comes to its owner as LANES entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Store, keep_rows, skew_join, text_or_empty

#: Keys that a bucket may hold; lanes in which copies collapse; bits of a key; slots at the start, at most (more keys than
#: CAPACITY * 2 ** SLOT_BITS raise the capacity).
CAPACITY, LANES, KEY_BITS, SLOT_BITS = 16_384, 4, 63, 20
#: Doubled slots that are broadcast at most (each a few numbers); more are joined by Spark's own choice.
BROADCAST_SLOTS = 10_000
_WRAP = 18446744073709551616  # 2 ** 64


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), f"{SPACE}+", "")


def key_of(norm: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 1)


def directory(keys: DataFrame, key: str, capacity: int) -> tuple[int, dict[int, list[int]]]:
    """(depth of the slots at the start, for each doubled slot the first keys of its buckets after the first).

    keys: distinct. Only overfull ranges come to the driver; with keys that are hashes there are few.
    """
    n = keys.count()
    base = min(SLOT_BITS, max(0, (max(n, 1) // capacity).bit_length() - 1))
    capacity = max(capacity, n >> SLOT_BITS)

    def overfull(df: DataFrame, depth: int) -> list[int]:
        prefix = F.shiftright(F.col(key), KEY_BITS - depth)
        return [r[0] for r in df.groupBy(prefix.alias("p")).count().filter(F.col("count") > capacity).collect()]

    starts: dict[int, list[int]] = {}
    depth, over, rest = base, overfull(keys, base), keys
    while over and depth < KEY_BITS:
        full = keys.sparkSession.createDataFrame([(p,) for p in over], "p long")
        rest = rest.join(F.broadcast(full) if len(over) <= BROADCAST_SLOTS else full, F.shiftright(F.col(key), KEY_BITS - depth) == F.col("p"), "left_semi")
        depth += 1
        for p in over:
            starts.setdefault(p >> (depth - 1 - base), []).append((2 * p + 1) << (KEY_BITS - depth))
        over = overfull(rest, depth)
    return base, {slot: sorted(x) for slot, x in starts.items()}


def _with_bucket(df: DataFrame, key: str, base: int, starts: dict[int, list[int]]) -> DataFrame:
    """Adds slot and, of a doubled slot, which of its buckets (part, from 0)."""
    df = df.withColumn("slot", F.shiftright(F.col(key), KEY_BITS - base))
    if not starts:
        return df.withColumn("part", F.lit(0))
    doubled = df.sparkSession.createDataFrame(list(starts.items()), "slot long, _starts array<long>")
    df = df.join(F.broadcast(doubled) if len(starts) <= BROADCAST_SLOTS else doubled, "slot", "left")
    return df.withColumn("part", F.size(F.filter(F.coalesce("_starts", F.array().cast("array<long>")), lambda s: s <= F.col(key)))).drop("_starts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    bucket: slot and part of the text's bucket; chain: its place among texts with one key. Of equal
    texts the row with the most code points stays, then the smallest id. Null text counts as empty, and empty texts are
    equal to each other. Rows without an id stay only as a group of their own kind: keep_id is null if no row of the
    group has an id, and a row without an id is never kept where another has one. A row that repeats the kept row's id
    and length is kept too. An empty table gives an empty result; other columns are not looked at.
    """
    store = Store(docs.sparkSession, "exact-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    base = base.select("doc_id", F.length("_text").alias("n_cp"), normalised("_text").alias("norm"))
    base = base.withColumn("h", key_of("norm"))
    rows = store.cut(base.select("doc_id", "n_cp", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "rows")
    keys = store.cut(rows.select("h").distinct(), "keys")
    depth, starts = directory(keys, "h", capacity)
    store.drop("keys")
    # One number that is greatest for the row that stays: code points, then the smallest id.
    order = F.expr(f"cast(n_cp as decimal(38,0)) * cast({_WRAP} as decimal(20,0)) - cast(doc_id as decimal(20,0))").cast("decimal(38,0)")
    merged = [F.sum("group_size").alias("group_size"), F.max("_order").alias("_order")]
    lane = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(LANES))
    entries = base.select(lane.alias("lane"), "h", "norm", F.lit(1).alias("group_size"), order.alias("_order")).groupBy("lane", "h", "norm").agg(*merged)
    # The owner of a bucket: all its entries in one task, where equal keys chain and bytes are compared.
    owned = _with_bucket(entries, "h", depth, starts).repartition("slot", "part").groupBy("slot", "part", "h", "norm").agg(*merged)
    owned = owned.withColumn("chain", F.row_number().over(Window.partitionBy("slot", "part", "h").orderBy("norm")))
    top = F.expr(f"(_order + cast({_WRAP // 2} as decimal(38,0))) div cast({_WRAP} as decimal(38,0))").cast("decimal(38,0)")
    keep = F.expr(f"cast(cast(_top as decimal(38,0)) * cast({_WRAP} as decimal(20,0)) - _order as long)")
    index = owned.withColumn("_top", top).select("slot", "part", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", keep.alias("keep_id"), F.col("_top").cast("int").alias("keep_cp"), "chain")
    index = store.cut(index, "index")
    total = index.agg(F.sum("group_size")).first()[0] or 0
    out = skew_join(rows, index, ["h", "sha"], "group_size", total, F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1))
    kept = F.when(F.col("keep_id").isNull(), F.lit(True)).otherwise(F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")), F.lit(False)))
    bucket = F.concat_ws(".", "slot", "part").alias("bucket")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), bucket, "chain")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns. Ids should be unique and not null; a row without one goes where another of its text has one."""
    found = exact_dedup(docs, id_col, text_col, capacity)
    return keep_rows(docs, found.filter("kept").select("doc_id"), id_col, nulls=True)
