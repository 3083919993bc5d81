"""How extracted items compare with the truth, and what corrections say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import close_to_truth, norm

UNKNOWN_CATEGORY = "未分類"


def keyed(items: DataFrame, unicode: bool = True) -> DataFrame:
    """Adds key: normalised name, spec and location."""
    return items.withColumn("key", F.concat_ws("\x1f", *[norm(F.col(c), unicode) for c in ("name", "spec", "location")]))


def first_by_key(items: DataFrame, ties: list[Column]) -> DataFrame:
    """The first row of each key by ties."""
    rest = [c for c in items.columns if c != "key"]
    return items.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("_r")).select("key", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _paired(found: DataFrame, truth: DataFrame, ties: list[Column], unicode: bool) -> DataFrame:
    """One row per key of either side, in one pass over each: the first row of each side (f and t: quantity, category; null
    without one) by ties, and how many rows each has."""

    def side(df: DataFrame, of: str) -> DataFrame:
        value, place = F.struct("quantity", "category"), F.struct(*ties)
        none = [F.lit(None).alias(f"{x}{o}") for o in {"f", "t"} - {of} for x in ("_v", "_p")]
        return keyed(df, unicode).select("key", value.alias(f"_v{of}"), place.alias(f"_p{of}"), *none)

    both = side(found, "f").unionByName(side(truth, "t"))
    return both.groupBy("key").agg(*[c for o in "ft" for c in (F.min_by(f"_v{o}", f"_p{o}").alias(o), F.count(f"_p{o}").alias(f"n_{o}"))])


def matches(found: DataFrame, truth: DataFrame, ties: list[Column], tolerance: float = 0.05, unicode: bool = True) -> DataFrame:
    """One row per distinct truth key: category, matched, quantity_ok."""
    return _matches(_paired(found, truth, ties, unicode).filter("n_t > 0"), tolerance).drop("n_f", "n_t")


def _matches(pairs: DataFrame, tolerance: float) -> DataFrame:
    ok = F.coalesce(close_to_truth(F.col("f.quantity"), F.col("t.quantity"), tolerance), F.lit(False))
    return pairs.select("key", F.coalesce(F.nullif(F.col("t.category"), F.lit("")), F.lit(UNKNOWN_CATEGORY)).alias("category"), ((F.col("n_t") > 0) & F.col("f.quantity").isNotNull()).alias("matched"), ((F.col("n_t") > 0) & ok).alias("quantity_ok"), "n_f", "n_t")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(found: DataFrame, truth: DataFrame, ties: list[Column], tolerance: float = 0.05, unicode: bool = True) -> DataFrame:
    """Precision over all found rows and recall over all truth rows (repeated keys count), F1 and quantity rate."""
    m = _matches(_paired(found, truth, ties, unicode), tolerance)
    one = m.agg(F.count_if("matched").alias("matched"), F.count_if("quantity_ok").alias("qty_match"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("n_f", "n_ai"), ("n_t", "n_truth"))])
    one = one.withColumns({"precision": _share(F.col("matched"), F.col("n_ai")), "recall": _share(F.col("matched"), F.col("n_truth")), "qty_rate": _share(F.col("qty_match"), F.col("matched"))})
    return one.withColumn("f1", _share(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")))


def metrics_by_category(found: DataFrame, truth: DataFrame, ties: list[Column], tolerance: float = 0.05, unicode: bool = True) -> DataFrame:
    m = matches(found, truth, ties, tolerance, unicode).groupBy("category").agg(F.count(F.lit(1)).alias("truth"), F.count_if("matched").alias("matched"), F.count_if("quantity_ok").alias("qty"))
    return m.select("category", "truth", "matched", _share(F.col("matched"), F.col("truth")).alias("recall"), _share(F.col("qty"), F.col("matched")).alias("qty_rate"))


def only_in(left: DataFrame, right: DataFrame, ties: list[Column], unicode: bool = True) -> DataFrame:
    """First rows of the keys that right lacks: missing items (truth, found) or extra ones (found, truth)."""
    return first_by_key(keyed(left, unicode), ties).join(keyed(right, unicode).select("key").distinct(), "key", "left_anti")


def correction_stats(corrections: DataFrame) -> DataFrame:
    """Corrections, those that change the quantity (null-safe), and distinct projects, null being one."""
    changed = ~F.col("before.quantity").eqNullSafe(F.col("after.quantity"))
    return corrections.agg(F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("quantity_fixes"), F.countDistinct(F.struct("project")).alias("projects"))


def training_pairs(corrections: DataFrame) -> DataFrame:
    return corrections.select(F.col("before").alias("input"), F.col("after").alias("label"), "project", "ts")
