"""Operators on takeoff items: deduplication, summaries, remarks and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import caliber, norm, pipe_material
from ..rules import DEFAULT_CATEGORY


def dedupe_keep_best(items: DataFrame, scope: list[str], ties: list[Column], unicode: bool = True) -> DataFrame:
    """One item for each key within scope: the most confident, then the first by ties. Quantities are never summed.

    The key is (spec, location) where a spec is there, else (category, name, location), all normalised. first_ord has
    the place (by ties, as a struct) at which the key was first seen, which is the order of the result.
    """
    with_spec = F.coalesce(F.trim("spec") != "", F.lit(False))
    key = F.when(with_spec, F.concat_ws("\x1f", F.lit("spec"), norm(F.col("spec"), unicode), norm(F.col("location"), unicode))).otherwise(F.concat_ws("\x1f", F.lit("name"), norm(F.col("category"), unicode), norm(F.col("name"), unicode), norm(F.col("location"), unicode)))
    group = Window.partitionBy(*scope, "_key")
    df = items.withColumn("_key", key)
    df = df.withColumn("first_ord", F.min(F.struct(*ties)).over(group)).withColumn("_rn", F.row_number().over(group.orderBy(F.desc("confidence"), *ties)))
    return df.filter("_rn = 1").drop("_key", "_rn")


def category_summary(items: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """By category: rows, and the quantity with its unit if there is one unit; else unit 混在 and no quantity."""
    df = items.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(DEFAULT_CATEGORY)))
    one = F.min("unit") == F.max("unit")
    return df.groupBy(*(scope or []), "category").agg(F.count(F.lit(1)).alias("n_items"), F.when(one, F.sum("quantity")).alias("quantity"), F.when(one, F.min("unit")).otherwise(F.lit("混在")).alias("unit"))


def summarize_pipes(items: DataFrame, categories: tuple[str, ...], scope: list[str] | None = None, unit: str = "m") -> DataFrame:
    """By system and calibre: metres, and the pipe materials in order."""
    df = items.filter(F.col("category").isin(*categories) & (F.col("unit") == unit))
    df = df.select(*(scope or []), F.col("category").alias("system"), caliber(F.col("spec")).alias("caliber"), "quantity", F.nullif(pipe_material(F.col("spec")), F.lit("")).alias("_m"))
    out = df.groupBy(*(scope or []), "system", "caliber").agg(F.sum("quantity").alias("length"), F.concat_ws("、", F.sort_array(F.collect_set("_m"))).alias("material"))
    return out.withColumn("material", F.coalesce(F.nullif("material", F.lit("")), F.lit("—")))


def summarize_fixtures(items: DataFrame, category: str = "衛生器具", scope: list[str] | None = None) -> DataFrame:
    return items.filter(F.col("category") == category).groupBy(*(scope or []), "name").agg(F.sum("quantity").alias("quantity"))


def material_by_category(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Of purchase-order lines, rows and material cost by category."""
    df = lines.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(DEFAULT_CATEGORY)))
    return df.groupBy(*(scope or []), "category").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("material").alias("material"))


# Remarks by a row's source.
SOURCE_NOTES = {"reconciled": "機器表で数量確定", "text_table": "機器表から抽出", "legend_count": "凡例から記号カウント"}


def takeoff_note(confidence: Column, source: Column, low: float = 0.7) -> Column:
    """Low confidence first, then where the row came from."""
    out = F.lit("")
    for k, v in SOURCE_NOTES.items():
        out = F.when(source == k, v).otherwise(out)
    return F.when(confidence < low, F.format_string("要確認(信頼度%.2f)", confidence)).otherwise(out)


def estimate_note(price: Column, confidence: Column, low: float = 0.7) -> Column:
    return F.when(price.isNull(), "単価未設定").when(confidence >= low, "").otherwise(F.format_string("要確認(信頼度%.2f)", confidence))


def list_order(*ties: str) -> list[Column]:
    """Category ('zzz' where there is none), page, name."""
    return [F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("zzz")), F.col("page"), F.col("name"), *[F.col(t) for t in ties]]


def in_tenant(rows: DataFrame, memberships: DataFrame, user_id: int | str) -> DataFrame:
    """Rows of the organisations that a user belongs to."""
    mine = memberships.filter(F.col("user_id") == F.lit(user_id)).select("org_id")
    return rows.join(mine, "org_id", "left_semi")
