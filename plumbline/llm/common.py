"""What the operators of this subpackage share: stored intermediates, reading, and a join that keeps hot keys out of the shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words and that stripping removes.
SPACE = r"[\x20\x09-\x0D]"

#: A key is hot if it holds more than one in so many of all rows; so there are at most so many hot keys.
HOT_PARTS = 1000

#: The least number of rows for which it pays to cut the rows of one key into pieces.
PIECE = 65_536

#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


_scratch: ContextVar[list[Store] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators store inside this context go at its end; what was read from them must be written by then."""
    made: list[Store] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for store in made:
            store.drop("")


class Store:
    """Tables written to the shared folder: a lost executor costs no more than the tasks that read its shuffle files.

    What an operator returns may still read them, so they go with the application, or at the end of scratch().
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        files, path = self._files("")
        files.mkdirs(path)
        files.deleteOnExit(path)
        if (made := _scratch.get()) is not None:
            made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}" if table else self.root

    def _files(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def cut(self, df: DataFrame, table: str, *partition_by: str) -> DataFrame:
        """Write df and return it as read back; this ends its lineage, so its shuffle files go when it is written."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        with self._freeing():
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(table))
        return self.read(table, df)

    def cut_buckets(self, df: DataFrame, table: str, buckets: int, *keys: str, partition_by: str) -> DataFrame:
        """Write df bucketed and sorted by keys, in a partition for each value of a column, and return it as read back.

        Joins on keys with what is dealt into as many parts need no exchange of it. The table's name is in the catalogue
        until forget().
        """
        self.tables[table] = f"{self.root.rsplit('/', 1)[-1]}_{table}".replace("-", "_")
        dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
        writer = dealt.write.format("parquet").mode("overwrite").option("compression", "zstd").option("path", self.path(table))
        with self._freeing():
            writer.partitionBy(partition_by).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(self.tables[table])
        return self.spark.table(self.tables[table])

    def forget(self, *tables: str) -> None:
        """Drop bucketed tables from the catalogue, and their files."""
        for table in tables or tuple(self.tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(table)}")
            self.drop(table)

    @contextmanager
    def _freeing(self) -> Iterator[None]:
        before = self.spark.conf.get(CLEAN_SHUFFLES)
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            files, path = self._files(table)
            files.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left outer join to a right side with unique keys, of which column `weight` says how many left rows each has.

    Keys with more than total / HOT_PARTS left rows are at most HOT_PARTS, so they are broadcast; left rows
    that they serve go through the shuffle under a scattered key (`spread`) and meet nothing there.
    """
    rest = [c for c in right.columns if c not in keys]
    hot = right.filter(F.col(weight) * HOT_PARTS > F.lit(total))
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[F.col(c).alias(f"_hot_{c}") for c in rest])
    cold = right.filter(F.col(weight) * HOT_PARTS <= F.lit(total)).select(*[F.col(k).alias(f"_cold_{k}") for k in keys], *[F.col(c).alias(f"_cold_{c}") for c in rest])
    on_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    out = left.join(F.broadcast(hot), on_hot, "left")
    hit = F.col(f"_hot_{keys[0]}").isNotNull()
    kinds = dict(left.dtypes)
    out = out.withColumn("_k0", F.when(hit, spread.cast(kinds[keys[0]])).otherwise(F.col(keys[0])))
    out = out.withColumn("_none", F.when(hit, F.lit(1)).otherwise(F.lit(0)))
    on_cold = [F.col("_k0") == F.col(f"_cold_{keys[0]}"), F.col("_none") == F.col("_zero"), *[F.col(k) == F.col(f"_cold_{k}") for k in keys[1:]]]
    out = out.join(cold.withColumn("_zero", F.lit(0)), on_cold, "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in rest])


def salted_join(left: DataFrame, right: DataFrame, key: str, keys: DataFrame, total: int, spread: Column) -> DataFrame:
    """Inner join to a right side with unique keys whose rows may be too large to broadcast.

    keys holds the keys of the left rows, of which there are `total`. A key with more than a HOT_PARTS-th of them (and
    more than PIECE) is cut into pieces of that size by `spread`, and its right row goes to every piece. Only those keys,
    at most HOT_PARTS, are broadcast, with their numbers of pieces. Where no key can have so many, nothing is cut.
    """
    piece = max(PIECE, total // HOT_PARTS)
    if total <= piece:
        return left.join(right, key)
    cut = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > F.lit(piece))
    cut = F.broadcast(cut.select(key, F.ceil(F.col("_rows") / F.lit(piece)).cast("int").alias("_cuts")))
    dealt = left.join(cut, key, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_cuts")), F.lit(0)).cast("int")).drop("_cuts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))
    return dealt.join(right.join(cut, key, "left").withColumn("_salt", salts).drop("_cuts"), [key, "_salt"]).drop("_salt")


def drop_rows(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is none of `ids` (one column, any name); rows without an id stay. No column of docs can clash."""
    return docs.join(_aside(docs, ids), F.col(id_col).cast("long") == F.col(_free(docs)), "left_anti")


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str, nulls: bool = False) -> DataFrame:
    """The rows of docs whose id is one of `ids`; nulls: a null among ids keeps the rows without one."""
    own, other = F.col(id_col).cast("long"), F.col(_free(docs))
    return docs.join(_aside(docs, ids), own.eqNullSafe(other) if nulls else own == other, "left_semi")


def _free(docs: DataFrame) -> str:
    """A column name that docs does not have, in any case."""
    return "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "id"


def _aside(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.toDF(_free(docs)).distinct()
