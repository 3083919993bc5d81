"""The corrections log as a stream: an extension, as batch readers are all that the published engine has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.CORRECTION).json(path)


def fixes_by_window(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Corrections and quantity changes by window of ts; rows later than the watermark are left out."""
    timed = stream.withColumn("at", F.col("ts").try_cast("timestamp")).withWatermark("at", late)
    changed = ~F.col("before.quantity").eqNullSafe(F.col("after.quantity"))
    return timed.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("quantity_fixes"))
