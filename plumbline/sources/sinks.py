"""Sinks: sheets as CSV folders, merged tables, the corrections log and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators.items import category_summary, estimate_note, list_order, material_by_category, takeoff_note
from ..operators.pricing import order_lines, totals

STORED = ("project_id", "org_id", "category", "name", "spec", "location", "quantity", "unit", "confidence")


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet as CSV with a header; Excel files need a library that is not part of this package."""
    df.write.mode("overwrite").csv(path, header=True)


def takeoff_sheet(items: DataFrame, scope: list[str], *ties: str) -> DataFrame:
    """Numbered list of items by category, page and name, with remarks."""
    no = F.row_number().over(Window.partitionBy(*scope).orderBy(*list_order(*ties)))
    return items.select(*scope, no.alias("no"), F.coalesce("category", F.lit("")).alias("category"), "name", F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("location", F.lit("")).alias("location"), "quantity", "unit", "page", takeoff_note(F.col("confidence"), F.col("source")).alias("note"))


def takeoff_book(items: DataFrame, scope: list[str], *ties: str) -> dict[str, DataFrame]:
    return {"items": takeoff_sheet(items, scope, *ties), "categories": category_summary(items, scope)}


def estimate_sheet(lines: DataFrame, scope: list[str], *ties: str) -> DataFrame:
    order = [F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("zzz")), F.col("name"), *[F.col(t) for t in ties]]
    no = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return lines.select(*scope, no.alias("no"), "category", "name", "spec", "location", "quantity", "unit", F.col("price.unit_price").alias("unit_price"), "amount", "material", "labor", estimate_note(F.col("price"), F.col("confidence")).alias("note"))


def estimate_book(lines: DataFrame, scope: list[str], *ties: str, overhead_rate: float = 0.10, tax_rate: float = 0.10) -> dict[str, DataFrame]:
    """The lines, and a summary of four rows."""
    t = totals(lines, scope, overhead_rate, tax_rate)
    parts = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), F.col(c).alias("amount")) for i, (label, c) in enumerate((("小計", "subtotal"), ("諸経費", "overhead"), ("消費税", "tax"), ("合計", "total")))])
    return {"lines": estimate_sheet(lines, scope, *ties), "summary": t.select(*scope, F.explode(parts).alias("_row")).select(*scope, "_row.*")}


def purchase_order_book(lines: DataFrame, scope: list[str], *ties: str) -> dict[str, DataFrame]:
    wanted = order_lines(lines)
    order = [F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("zzz")), F.col("name"), *[F.col(t) for t in ties]]
    no = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return {"lines": wanted.select(*scope, no.alias("no"), "category", "name", "spec", "quantity", "unit", "material"), "categories": material_by_category(wanted, scope)}


def ledger_sheet(rows: DataFrame, scope: list[str], *ties: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy(*scope).orderBy("remaining", *ties))
    return rows.select(*scope, no.alias("no"), "category", "name", "label", "spec", "quantity", "unit", "installed_year", "service_life", "recommend_year", "remaining", "state")


def json_rows(items: DataFrame, keep: list[str]) -> DataFrame:
    """Items as JSON text: seven columns, confidence to two digits."""
    row = F.struct("category", "name", "spec", "location", "quantity", "unit", F.bround("confidence", 2).alias("confidence"))
    return items.select(*keep, F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def dump_session(items: DataFrame, path: str) -> None:
    """Whole rows as JSON lines, nulls included, for files.load_session."""
    items.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_correction(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append rows (ts, project, source, note, before, after) to the corrections log."""
    spark.createDataFrame(rows, schema.CORRECTION).coalesce(1).write.mode("append").json(path)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], latest: Column) -> DataFrame:
    """table with new rows merged in on keys; of rows with one key the one with the greatest `latest` stays, new ones before old."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), latest.desc()))
    return both.withColumn("_rn", rn).filter("_rn = 1").drop("_rn", "_new")


def replace_items(table: DataFrame, new: DataFrame, projects: DataFrame) -> DataFrame:
    """table with the items of `projects` (project_id) replaced by new: one statement, so no state without either is seen.

    A project without new items loses its old ones.
    """
    stay = table.join(projects.select("project_id").distinct(), "project_id", "left_anti")
    return stay.unionByName(new.select(*table.columns))


def write_replacing(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Overwrite the partitions (project_id) that new has, and no others."""
    new.repartition("project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
