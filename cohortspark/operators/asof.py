"""As-of join: the latest right row at or before each left row, without a single-task sort.

Both sides are sorted together over ranges of time; every range first learns the last right value
of the ranges before it (one small row per range), so ranges run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, time: str, value: str, tie: str, ranges: int = 64) -> DataFrame:
    """``left`` with ``value`` of the latest right row (ties in time: the one with the largest ``tie``); null before the first."""
    bounds = right.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).select(F.unix_micros(F.col("lo").cast("timestamp")).alias("lo"), F.unix_micros(F.col("hi").cast("timestamp")).alias("hi"))
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType), "__tie": F.lit(None).cast(right.schema[tie].dataType)})
    b = right.select(F.col(time), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(tie).alias("__tie"))
    both = a.unionByName(b, allowMissingColumns=True).crossJoin(F.broadcast(bounds))  # one row of bounds
    width = F.greatest((F.col("hi") - F.col("lo")) / ranges, F.lit(1.0))
    part = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.col("lo")) / width)
    both = both.withColumn("__part", F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(ranges - 1)))
    last = both.where("__side = 0").groupBy("__part").agg(F.max(F.struct(time, "__tie", "__v")).alias("l"))
    parts = F.broadcast(left.sparkSession.range(ranges).withColumnRenamed("id", "__part"))  # a fixed number of ranges
    carried = parts.join(last, "__part", "left").withColumn("__c", F.last("l", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("__part").orderBy(F.col(time).asc(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("__side") == 0, F.struct(F.col("__v"))), ignorenulls=True).over(w)
    out = both.withColumn("__hit", hit).where("__side = 1").join(F.broadcast(carried.select("__part", F.col("__c.__v").alias("__before"))), "__part")
    return out.select(*left.columns, F.when(F.col("__hit").isNotNull(), F.col("__hit.__v")).otherwise(F.col("__before")).alias(value))
