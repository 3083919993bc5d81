"""Checks of a dictionary: one row per finding, with the rule that it breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import MIN_PARTIAL, STANDARD_CATEGORIES, STANDARD_UNITS


def validate(entries: DataFrame) -> DataFrame:
    """severity, rule, canonical, detail. An entry without canonical name breaks V1 and is looked at no further.

    V1-V3 empty canonical, category, unit; V4 repeated canonical; V5, V6 category or unit not standard; V7 empty alias;
    V8 alias is the canonical; V9 alias repeated; V10 alias too short for partial matches; V11 alias that the last
    earlier entry with it gives another canonical; V12 alias is another entry's canonical.
    """

    def blank(c: Column) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    def issue(df: DataFrame, severity: str, rule: str, detail: Column) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("canonical"), detail.cast("string").alias("detail"))

    named = entries.filter(~blank(F.col("canonical")))
    repeated = named.withColumn("_n", F.row_number().over(Window.partitionBy("canonical").orderBy("ord"))).filter("_n > 1")
    aliases = named.select("ord", "canonical", F.posexplode("aliases").alias("pos", "alias"))
    full = aliases.filter(~blank(F.col("alias")))
    in_entry = Window.partitionBy("ord", "canonical", "alias").orderBy("pos")
    over_all = Window.partitionBy("alias").orderBy("ord", "pos")
    known = named.select(F.col("canonical").alias("_c")).distinct()
    out = [
        issue(entries.filter(blank(F.col("canonical"))).withColumn("canonical", F.lit(None).cast("string")), "error", "V1", F.col("ord")),
        issue(named.filter(blank(F.col("category"))), "error", "V2", F.lit("")),
        issue(named.filter(blank(F.col("unit"))), "error", "V3", F.lit("")),
        issue(repeated, "error", "V4", F.lit("")),
        issue(named.filter((F.col("category") != "") & ~F.col("category").isin(*STANDARD_CATEGORIES)), "warning", "V5", F.col("category")),
        issue(named.filter((F.col("unit") != "") & ~F.col("unit").isin(*STANDARD_UNITS)), "warning", "V6", F.col("unit")),
        issue(aliases.filter(blank(F.col("alias"))), "error", "V7", F.lit("")),
        issue(full.filter(F.col("alias") == F.col("canonical")), "warning", "V8", F.col("alias")),
        issue(full.withColumn("_n", F.row_number().over(in_entry)).filter("_n > 1"), "warning", "V9", F.col("alias")),
        issue(full.filter(F.length("alias") < MIN_PARTIAL), "warning", "V10", F.col("alias")),
        issue(full.withColumn("_before", F.lag("canonical").over(over_all)).filter("_before != canonical"), "error", "V11", F.col("alias")),
        issue(aliases.join(known, F.col("alias") == F.col("_c")).filter("alias != canonical"), "error", "V12", F.col("alias")),
    ]
    return reduce(DataFrame.unionByName, out)


def require_valid(entries: DataFrame) -> DataFrame:
    """The entries, if no check finds an error."""
    bad = validate(entries).filter("severity = 'error'").limit(20).collect()
    if bad:
        raise ValueError("dictionary: " + "; ".join(f"{r['rule']} {r['canonical']} {r['detail']}" for r in bad))
    return entries
