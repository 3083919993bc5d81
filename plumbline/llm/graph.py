"""Connected components of a link table, by the smallest label among neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """node, comp (smallest node reachable) for every node of links (a, b). Each round is written out, which ends its lineage."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store.cut(both, f"{name}-edges")
    label = store.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("comp", F.coalesce("near", "comp")).alias("low"), "comp")
        jump = label.select(F.col("node").alias("_n"), F.col("comp").alias("_up"))
        new = low.join(jump, F.col("low") == F.col("_n"), "left").select("node", F.least("low", F.coalesce("_up", "low")).alias("comp"), (F.least("low", F.coalesce("_up", "low")) != F.col("comp")).alias("moved"))
        new = store.cut(new, f"{name}-{k}")
        moved = new.filter("moved").limit(1).count()
        label = new.select("node", "comp")
        store.drop(f"{name}-{k - 1}")
        if not moved:
            store.drop(f"{name}-edges")
            return label
