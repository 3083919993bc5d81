"""Symptom diagnosis and the authority that an application goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hits, norm, norm_text, yen


def price_range_incl_tax(lo: Column, hi: Column, tax: float = 0.10) -> tuple[Column, Column]:
    return yen(lo * F.lit(1 + tax)), yen(hi * F.lit(1 + tax))


def diagnose(texts: DataFrame, jobs: DataFrame, text: str, keep: list[str], top: int = 3, unicode: bool = True) -> DataFrame:
    """For each text the `top` jobs by number of keywords in it, in catalogue order on ties; the fallback job if none.

    Jobs are a catalogue of a few rows: they are scored as an array inside the row, without join, window or shuffle.
    """
    rows = jobs.select("ord", "name", "keywords", "price_min", "price_max", "warranty_months").orderBy("ord").collect()
    real, back = [r for r in rows if r["ord"] >= 0], [r for r in rows if r["ord"] < 0]
    hay = F.col("_hay")

    def job(r, score: Column) -> Column:
        lo, hi = price_range_incl_tax(F.lit(r["price_min"]), F.lit(r["price_max"]))
        return F.struct((-score).alias("minus"), F.lit(r["ord"]).alias("ord"), F.lit(r["name"]).alias("job"), score.alias("score"), lo.alias("price_min"), hi.alias("price_max"), F.lit(r["warranty_months"]).alias("warranty_months"))

    def words(r) -> Column:
        return F.array(*[F.lit(norm_text(w, unicode)) for w in r["keywords"]]) if r["keywords"] else F.array().cast("array<string>")

    scored = F.filter(F.array(*[job(r, hits(hay, words(r))) for r in real]), lambda j: j["score"] > 0)
    best = F.slice(F.array_sort(scored), 1, top)
    if back:
        best = F.when(F.size(best) == 0, F.array(job(back[0], F.lit(0)))).otherwise(best)
    out = texts.withColumn("_hay", norm(F.col(text), unicode)).select(*keep, F.posexplode(best).alias("_pos", "_job"))
    return out.select(*keep, (F.col("_pos") + 1).alias("rank"), "_job.job", "_job.score", "_job.price_min", "_job.price_max", "_job.warranty_months")


def resolve_authority(rows: DataFrame, municipalities: DataFrame, name: str) -> DataFrame:
    """Adds form_name and authority of the first municipality of which a name or alias equals, contains or is in the text; else the default's."""
    found = municipalities.orderBy("ord").collect()
    back = next((m for m in found if m["ord"] < 0), None)
    target = F.trim(F.coalesce(F.col(name), F.lit("")))

    def value(m) -> Column:
        return F.struct(F.lit(m["form_name"] if m else None).cast("string").alias("form_name"), F.lit(m["authority"] if m else None).cast("string").alias("authority"))

    out = value(back)
    for m in reversed([m for m in found if m["ord"] >= 0]):
        hit = F.lit(False)
        for n in [m["name"], *m["aliases"]]:
            if n:
                hit = hit | F.contains(target, F.lit(n)) | F.contains(F.lit(n), target)
        out = F.when((target != "") & hit, value(m)).otherwise(out)
    return rows.withColumn("_a", out).withColumns({"form_name": F.col("_a.form_name"), "authority": F.col("_a.authority")}).drop("_a")
