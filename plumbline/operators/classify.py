"""Dictionary lookup: an item's name to its canonical name and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm, truthy
from ..rules import DEFAULT_CATEGORY, MIN_PARTIAL

#: Keys that are tried inside one expression; with more, distinct names are joined to the keys instead. Up to CHAINED
#: keys are compiled as one chain of comparisons.
MAX_INLINE, CHAINED = 2000, 128


def _every_key(entries: DataFrame, unicode: bool) -> DataFrame:
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entries.select("ord", "canonical", "category", "unit", F.posexplode(names).alias("pos", "raw"))
    return keys.select((F.col("ord").cast("long") * 100_000 + F.col("pos")).alias("ord"), norm(F.col("raw"), unicode).alias("key"), "canonical", "category", "unit").filter("key != ''")


def dictionary_keys(entries: DataFrame, unicode: bool = True) -> DataFrame:
    """ord, key, canonical, category, unit: canonical names and aliases in the order in which lookup tries them, each once."""
    keys = _every_key(entries, unicode)
    # A key that several entries have keeps the first one's place and the last one's meaning, as in an updated mapping.
    return keys.groupBy("key").agg(F.min("ord").alias("ord"), F.max_by(F.struct("canonical", "category", "unit"), "ord").alias("e")).select("ord", "key", "e.*")


def classify(items: DataFrame, entries: DataFrame, unicode: bool = True, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """Sets name and category, and the unit where the item has none; column matched says how ('exact', 'partial', 'default').

    A name is looked up whole, then for the first key of three characters or more that it contains. Items without a
    match keep their name and get the default category. A small dictionary is looked up without join or shuffle.
    """
    rows = _every_key(entries, unicode).limit(MAX_INLINE + 1).collect()
    base = items.withColumn("_n", norm(F.col("name"), unicode))
    base = _inline(base, _once(rows)) if len(rows) <= MAX_INLINE else _joined(base, dictionary_keys(entries, unicode))
    hit = F.coalesce(F.col("_exact"), F.col("_part"))
    return (
        base.withColumn("_e", hit)
        .withColumn("matched", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_part").isNotNull(), "partial").otherwise("default"))
        .withColumn("name", F.coalesce("_e.canonical", "name"))
        .withColumn("category", F.coalesce("_e.category", F.lit(default)))
        .withColumn("unit", F.coalesce(truthy(F.col("unit")), "_e.unit", "unit"))
        .drop("_n", "_exact", "_part", "_e")
    )


def _once(rows: list) -> list[dict]:
    """What dictionary_keys gives, of a small dictionary: a key's first place and last meaning."""
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(r["key"], {"key": r["key"]}).update(canonical=r["canonical"], category=r["category"], unit=r["unit"])
    return list(out.values())


def _inline(base: DataFrame, rows: list[dict]) -> DataFrame:
    entry = "struct<canonical:string,category:string,unit:string>"
    if not rows:
        return base.withColumn("_exact", F.lit(None).cast(entry)).withColumn("_part", F.lit(None).cast(entry))

    def value(r: dict):
        return F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("canonical", "category", "unit")])

    if len(rows) <= CHAINED:

        def first(hit) -> Column:
            return F.coalesce(F.lit(None).cast("int"), *[F.when(hit(r["key"]), F.lit(i)) for i, r in enumerate(rows) if hit(r["key"]) is not None])

        entries = F.array(*[value(r) for r in rows])
        exact_at = first(lambda k: F.col("_n") == F.lit(k))
        part_at = first(lambda k: F.contains(F.col("_n"), F.lit(k)) if len(k) >= MIN_PARTIAL else None)
        out = base.withColumn("_exact", F.get(entries, exact_at))
        return out.withColumn("_part", F.when(F.col("_exact").isNull(), F.get(entries, part_at)))
    exact = F.create_map(*[x for r in rows for x in (F.lit(r["key"]), value(r))])
    long = [r for r in rows if len(r["key"]) >= MIN_PARTIAL]
    out = base.withColumn("_exact", F.try_element_at(exact, F.col("_n")))
    if not long:
        return out.withColumn("_part", F.lit(None).cast(entry))
    every = F.array(*[F.struct(F.lit(r["key"]).alias("key"), value(r).alias("e")) for r in long])
    return out.withColumn("_part", F.when(F.col("_exact").isNull(), F.get(F.filter(every, lambda k: F.contains(F.col("_n"), k["key"])), 0)["e"]))


def _joined(base: DataFrame, keys: DataFrame) -> DataFrame:
    entry = F.struct("canonical", "category", "unit")
    exact = keys.select(F.col("key").alias("_n"), entry.alias("_exact"))
    names = base.select("_n").distinct()
    long = keys.filter(F.length("key") >= MIN_PARTIAL).select("ord", "key", entry.alias("e"))
    part = names.join(long, F.contains(F.col("_n"), F.col("key"))).groupBy("_n").agg(F.min_by("e", "ord").alias("_part"))
    return base.join(exact, "_n", "left").join(part, "_n", "left")


def number_within(df: DataFrame, partition: list[str], order: list, name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
