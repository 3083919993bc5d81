"""Pipe ledger: service life, renewal years and the maintenance plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import norm, norm_text
from ..rules import DEFAULT_LIFE_LABEL, DEFAULT_YEARS, LEDGER_CATEGORIES


def service_life(text: Column, rules: list[tuple[list[str], int, str]], default_years: int = DEFAULT_YEARS) -> Column:
    """struct<years, label> of the first rule with a keyword (normalised by the caller) in the text, else the default."""
    value = F.struct(F.lit(default_years).alias("years"), F.lit(DEFAULT_LIFE_LABEL).alias("label"))
    for words, years, label in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        value = F.when(hit, F.struct(F.lit(int(years)).alias("years"), F.lit(label).alias("label"))).otherwise(value)
    return value


def ledger(items: DataFrame, lives: DataFrame, installed_year: Column, current_year: Column | int, unicode: bool = True, categories: tuple[str, ...] = LEDGER_CATEGORIES, unit: str = "m") -> DataFrame:
    """Items by the metre, machines and fixtures, with label, service_life, recommend_year, remaining and state.

    Life rules are configuration of a few rows: they become one CASE, which stops at the first that holds.
    """
    rows = lives.orderBy("ord").select("keywords", "years", "label").collect()
    now = F.lit(current_year) if isinstance(current_year, int) else current_year
    df = items.filter((F.col("unit") == unit) | F.col("category").isin(*categories))
    df = df.withColumn("_hay", norm(F.concat_ws(" ", F.col("name"), F.coalesce("spec", F.lit(""))), unicode))
    df = df.withColumn("_life", service_life(F.col("_hay"), [([norm_text(w, unicode) for w in r[0]], r[1], r[2]) for r in rows]))
    df = df.withColumns({"label": F.col("_life.label"), "service_life": F.col("_life.years"), "installed_year": installed_year.cast("int")}).drop("_hay", "_life")
    df = df.withColumn("recommend_year", F.col("installed_year") + F.col("service_life")).withColumn("remaining", F.col("recommend_year") - now)
    return df.withColumn("state", F.when(F.col("remaining") <= 0, "★更新時期").when(F.col("remaining") <= 5, "要注意").otherwise(""))


def due(rows: DataFrame) -> DataFrame:
    return rows.filter("remaining <= 0")


def recommend_plan(rows: DataFrame, plans: DataFrame, scope: list[str]) -> DataFrame:
    """By scope, the least remaining years and the plan: the most frequent visits if due, the second within five years, else the least frequent."""
    names = [r[0] for r in plans.orderBy("interval_months", "ord").select("name").collect()]
    least = rows.groupBy(*scope).agg(F.min("remaining").alias("min_remaining"), F.count(F.lit(1)).alias("n_rows"))
    if not names:
        return least.withColumn("plan", F.lit(None).cast("string"))
    return least.withColumn("plan", F.when(F.col("min_remaining") <= 0, names[0]).when(F.col("min_remaining") <= 5, names[min(1, len(names) - 1)]).otherwise(names[-1]))
