"""Whole flows: from replies, pages or measured rows to classified, priced and summarised items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..operators import advice, extract, items, ledger, pricing, produce, reconcile
from ..operators.classify import classify


@dataclass
class RuleSet:
    dictionary: DataFrame
    prices: DataFrame
    lives: DataFrame
    plans: DataFrame


def takeoff(pages: DataFrame, replies: DataFrame, dictionary: DataFrame, keys: list[str], tiled: bool = False) -> DataFrame:
    """Items of a drawing: from model replies (keys, page, reply), corrected by the pages' text tables (keys, page, text), classified.

    Replies to tiles repeat what lies on their edges, so tiled ones are deduplicated, before there are categories.
    """
    where = [*keys, "page"]
    df = extract.json_items(replies.withColumnRenamed("page", "_page_no"), "reply", [*keys, "_page_no"], F.col("_page_no"))
    df = df.withColumns({"category": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "ord": F.col("pos").cast("long")})
    if tiled:
        df = items.dedupe_keep_best(df, where, [F.col("ord"), F.col("name"), F.col("quantity")])
    table = extract.table_lines(pages, "text", where).withColumns({"ord": F.col("line_no").cast("long"), "location": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    return classify(reconcile.reconcile(df, table, where), dictionary)


def estimate(found: DataFrame, prices: DataFrame, vendor_id: Column | None = None) -> DataFrame:
    """Priced lines of classified items."""
    return pricing.amounts(pricing.quote(found, prices, vendor_id))


def measured(rows: DataFrame, kind: str, rule_set: RuleSet, keep: list[str], scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Measured rows of text ('measures', 'rooms' or 'risers') to priced lines and totals."""
    made = {
        "measures": lambda: produce.measure_items(rows, keep),
        "rooms": lambda: produce.room_items(produce.read_rooms(rows, keep), keep),
        "risers": lambda: produce.riser_items(produce.read_risers(rows, keep), keep),
    }[kind]()
    lines = estimate(classify(made, rule_set.dictionary), rule_set.prices)
    return lines, pricing.totals(lines, scope)


def counted(pages: DataFrame, rule_set: RuleSet, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Symbols counted by the legends of text pages, priced."""
    lines = estimate(classify(extract.legend_items(pages, "text", [*keys, "page"]), rule_set.dictionary), rule_set.prices)
    return lines, pricing.totals(lines, keys)


def maintenance(found: DataFrame, rule_set: RuleSet, installed_year: int, current_year: int, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = ledger.ledger(found, rule_set.lives, F.lit(installed_year), current_year)
    return rows, ledger.recommend_plan(rows, rule_set.plans, scope)


def application(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supply pipes, drainage pipes and fixtures."""
    return items.summarize_pipes(found, rules.SUPPLY), items.summarize_pipes(found, rules.DRAINAGE), items.summarize_fixtures(found)


def emergency(symptoms: DataFrame, jobs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return advice.diagnose(symptoms, jobs, text, keep)
