"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Leaves are the combinations of the level columns (domain, language, source). A token budget enters at the root; each
node splits its budget over its children by weight, and a child takes no more than its subtree can supply
(tokens times max_epochs). What a child cannot take goes to its siblings by weight, and only what all siblings
together cannot take is missing one level up, where it goes to the node's own siblings. A leaf then reads whole
epochs while its budget lasts and, of the last epoch, the prefix of a seeded order whose tokens fit.

Amounts are integers throughout, so a plan can be repeated exactly: a node may lose less than one token per child.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Store, skew_join, text_or_empty

#: Hex digits of the order key that cut a leaf's epoch into pieces: 2 make 256 pieces. The piece in which the budget ends
#: is cut again until it has about so many rows, which are then read one by one.
PIECE_DIGITS, EDGE_ROWS = 2, 1 << 14
_SEP = "\x1f"


def token_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def _weight(column: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(column == F.lit(value), F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling: nodes has parent columns, name, cap, w (over 0) and the parent's budget b; adds the node's own budget."""
    wide = "decimal(38,0)"
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("long"))
    df = df.withColumn("_w", (F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("long"))
    full = F.col("cap").cast(wide) * F.col("_w").cast("decimal(18,0)") <= (F.col("b") - F.col("_c")).cast(wide) * F.col("w").cast("decimal(18,0)")
    df = df.withColumn("_full", full)
    df = df.withColumn("_cf", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group))
    df = df.withColumn("_wf", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(group))
    share = F.expr(f"cast((cast(b - _cf as decimal(20,0)) * cast(w as decimal(18,0))) div cast(_wf as {wide}) as long)")
    return df.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_c", "_w", "_full", "_cf", "_wf")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], total: Column | int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """One row per leaf of weight over 0 on all levels: the level columns, supply, cap and budget. leaves: level columns and supply."""
    df = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("long"))
    for level, given in zip(levels, weights, strict=True):
        df = df.withColumn(f"_w_{level}", _weight(F.col(level), given, default_weight))
    for level in levels:
        df = df.filter(F.col(f"_w_{level}") > 0)
    df = df.filter("cap > 0")
    root = F.lit(total) if isinstance(total, int) else total
    df = df.withColumn("_b", root.cast("long"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = df.groupBy(*path).agg(F.sum("cap").cast("long").alias("cap"), F.max(f"_w_{level}").alias("w"), F.max("_b").alias("b"))
        filled = _fill(nodes, path[:-1], level).select(*path, F.col("budget").alias("_next"))
        df = df.join(filled, path).withColumn("_b", F.col("_next")).drop("_next")
    return df.select(*levels, "supply", "cap", F.col("_b").alias("budget"))


def _edge(placed: DataFrame, plan: DataFrame, ends: DataFrame | None, digits: int, rows: int, store: Store) -> tuple[DataFrame, int]:
    """The piece in which each leaf's budget ends (_end), the tokens before it (_before) and the digits of pieces.

    ends: those of fewer digits, whose pieces are cut here. Sums of pieces first, so a window has at most
    16 ** PIECE_DIGITS rows a leaf.
    """
    inside = placed.withColumn("_before", F.lit(0).cast("long"))
    if ends is not None:
        inside = skew_join(placed, ends, ["_leaf"], "_rows", rows, F.col("_key")).filter(F.substring("_key", 1, digits) == F.col("_end"))
    digits += PIECE_DIGITS
    sums = inside.groupBy("_leaf", F.substring("_key", 1, digits).alias("_piece")).agg(F.sum("n_tokens").alias("_t"), F.max("_rest").alias("_rest"), F.max("_before").alias("_before"))
    over = Window.partitionBy("_leaf").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("_to", F.sum("_t").over(over) + F.col("_before"))
    found = upto.filter("_to > _rest").groupBy("_leaf").agg(F.min(F.struct("_piece", (F.col("_to") - F.col("_t")).alias("_before"))).alias("_end"))
    found = found.select("_leaf", F.col("_end._piece").alias("_end"), F.col("_end._before").alias("_before")).join(plan.select("_leaf", "_rows"), "_leaf")
    return store.cut(found, f"ends{digits}"), digits


def mix(docs: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], share: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per selected document and epoch: doc_id, epoch, the level columns, n_tokens, leaf_budget.

    The budget is share[0] / share[1] of all tokens (words, unless `tokens` says otherwise). A null level value is the
    value ''. Values without a weight have weight 1, and weight 0 leaves them out. Documents without tokens cost
    nothing and come with the prefix around them. Rows that repeat an id are rows of their own, tied in the seeded
    order by their token count; rows without an id are ordered as id ''. An empty table gives an empty result.
    """
    spark, levels = docs.sparkSession, list(levels)
    store = Store(spark, "mixing")
    own = tokens if tokens is not None else token_count(text_col)
    light = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels], own.cast("long").alias("n_tokens"))
    light = store.cut(light.withColumn("_leaf", F.concat_ws(_SEP, *levels)), "light")
    leaves = light.groupBy("_leaf", *levels).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("_rows"))
    leaves = store.cut(leaves, "leaves")
    supply, rows = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    plan = budgets(leaves.drop("_leaf", "_rows"), levels, weights, int(supply) * share[0] // share[1], max_epochs)
    plan = plan.join(leaves.select(*levels, "_leaf", "_rows"), levels).drop(*levels)
    plan = plan.select("_leaf", "_rows", "supply", F.col("budget").alias("leaf_budget"), F.expr("cast(budget div supply as int)").alias("_full"), (F.col("budget") % F.col("supply")).alias("_rest"))
    plan = store.cut(plan, "plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = skew_join(light, plan, ["_leaf"], "_rows", int(rows), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = placed.filter("leaf_budget is not null").withColumn("_key", key)
    placed = store.cut(placed.drop("supply", "_rows"), "placed")
    largest = leaves.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]
    ends, digits = None, 0
    while ends is None or largest >> (4 * digits) > EDGE_ROWS and digits < 30:
        ends, digits = _edge(placed, plan, ends, digits, int(rows), store)
    marked = skew_join(placed, ends, ["_leaf"], "_rows", int(rows), F.col("_key")).drop("_rows").withColumn("_piece", F.substring("_key", 1, digits))
    row = Window.partitionBy("_leaf", "_piece").orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A leaf that only reads whole epochs (_rest is 0) has no prefix, not even of documents without tokens.
    edge = marked.filter("_piece = _end").withColumn("_to", F.sum("n_tokens").over(row) + F.col("_before")).withColumn("_in", (F.col("_to") <= F.col("_rest")) & (F.col("_rest") > 0)).drop("_to")
    plain = marked.filter("_end is null or _piece != _end").withColumn("_in", F.coalesce(F.col("_piece") < F.col("_end"), F.lit(True)) & (F.col("_rest") > 0))
    both = plain.unionByName(edge)
    last = F.when(F.col("_in"), F.col("_full")).otherwise(F.col("_full") - 1)
    epochs = both.withColumn("_last", last).filter("_last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return epochs.select("doc_id", "epoch", *levels, "n_tokens", "leaf_budget")
