"""Prices by the most specific rule, amounts, and the totals of an estimate."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, yen

#: Weight of each key that a rule fills; a rule's specificity is their sum.
WEIGHTS = {"vendor_id": 8, "spec": 4, "category": 2, "name": 1}
#: Rules that are reduced on the driver and broadcast; a larger table is joined as Spark chooses.
MAX_RULES = 20_000
_FIELDS = ("unit_price", "unit", "material_ratio", "spec", "category", "name", "vendor_id")
_PRICE = "unit_price double, unit string, material_ratio double, spec string, category string, name string, vendor_id string"


def quote(items: DataFrame, rules: DataFrame, vendor_id: Column | None = None) -> DataFrame:
    """Adds price: struct<unit_price, unit, material_ratio, spec, category, name, vendor_id>, null where no rule matches.

    All keys that a rule fills have to equal the item's; the most specific rule wins, then the earliest. There are at
    most 16 patterns of filled keys: each is an equality join on those keys, tried from the most specific. Up to MAX_RULES
    rules are read once and broadcast, so that the items are not shuffled. Units are not compared; unit_mismatch says
    where they differ.
    """
    base = items.withColumn("_vendor", vendor_id.cast("string") if vendor_id is not None else F.lit(None).cast("string"))
    mine = {"vendor_id": "_vendor", "spec": "spec", "category": "category", "name": "name"}
    shape = sum((F.when(F.col(k).isNotNull(), w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0))
    rules = rules.withColumn("_s", shape)
    few = rules.select("ord", "_s", *_FIELDS).limit(MAX_RULES + 1).collect()
    small = len(few) <= MAX_RULES
    there = {r["_s"] for r in few} if small else {r[0] for r in rules.select("_s").distinct().collect()}
    found = []
    for pattern in sorted(product((1, 0), repeat=4), reverse=True):
        keys = [k for k, on in zip(WEIGHTS, pattern, strict=True) if on]
        s = sum(WEIGHTS[k] for k in keys)
        if s not in there:
            continue
        if small:
            first = {tuple(r[k] for k in keys): r for r in sorted((r for r in few if r["_s"] == s), key=lambda r: r["ord"], reverse=True)}
            part = items.sparkSession.createDataFrame([tuple(r[f] for f in _FIELDS) for r in first.values()], _PRICE)
            best = F.broadcast(part.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.struct(*_FIELDS).alias(f"_p{s}")))
        else:
            best = rules.filter(F.col("_s") == s).groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.min_by(F.struct(*_FIELDS), "ord").alias(f"_p{s}"))
        if keys:
            on = [F.col(mine[k]) == F.col(f"_r_{k}") for k in keys]
            base = base.join(best, on, "left").drop(*[f"_r_{k}" for k in keys])
        else:
            base = base.crossJoin(F.broadcast(best))  # one row: the rule without keys
        found.append(f"_p{s}")
    price = F.coalesce(*[F.col(c) for c in found]) if found else F.lit(None).cast(f"struct<{_PRICE.replace(' ', ':').replace(',:', ',')}>")
    out = base.withColumn("price", price).drop("_vendor", *found)
    return out.withColumn("unit_mismatch", F.coalesce(F.col("price.unit") != F.col("unit"), F.lit(False)))


def amounts(priced: DataFrame) -> DataFrame:
    """Adds amount, material and labor in whole yen, each rounded by itself (so they need not add up); 0 without a price."""
    total = F.col("price.unit_price") * F.col("quantity")
    ratio = F.col("price.material_ratio")
    zero = F.lit(0).cast("long")
    return priced.withColumns({"amount": F.coalesce(yen(total), zero), "material": F.coalesce(yen(total * ratio), zero), "labor": F.coalesce(yen(total * (F.lit(1.0) - ratio)), zero)})


def totals(lines: DataFrame, keys: list[str] | None = None, overhead_rate: float = 0.10, tax_rate: float = 0.10) -> DataFrame:
    """Subtotal, overhead, total before tax, tax and total; one row, or one for each value of keys."""
    df = lines.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("subtotal"), F.coalesce(F.sum("material"), F.lit(0)).cast("long").alias("material"), F.coalesce(F.sum("labor"), F.lit(0)).cast("long").alias("labor"))
    df = df.withColumn("overhead", half_even(F.col("subtotal") * F.lit(overhead_rate)).cast("long"))
    df = df.withColumn("total_ex_tax", F.col("subtotal") + F.col("overhead"))
    df = df.withColumn("tax", half_even(F.col("total_ex_tax") * F.lit(tax_rate)).cast("long"))
    return df.withColumn("total", F.col("total_ex_tax") + F.col("tax"))


def unpriced(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("price").isNull())


def order_lines(lines: DataFrame) -> DataFrame:
    """Lines of a purchase order: priced, with material."""
    return lines.filter(F.col("price").isNotNull() & (F.col("material") > 0))


def source_label(price: Column) -> Column:
    """Which keys of a rule gave the price."""
    labels = {"vendor_id": "vendor", "spec": "spec", "category": "cat", "name": "name"}
    label = F.concat_ws(", ", *[F.concat(F.lit(f"{v}="), F.nullif(price[k], F.lit(""))) for k, v in labels.items()])
    return F.when(price.isNull(), F.lit("")).when(label == "", F.lit("デフォルト")).otherwise(label)
