"""As-of joins: for every row the newest version published by its time, over ranges of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.session import table


def newest_before(rows: DataFrame, versions: DataFrame, time: str, published: str, payload: list[str]) -> DataFrame:
    """STM-04: rows with the payload of the newest version published at or before their time, null before the first.

    Both sides are dealt to ranges by (time, version before row, hash), so rows of one instant
    spread over several ranges. A range looks back to its own versions, and what the ranges
    before it published last is carried over: one row for each range, no cross product and no
    sort of all rows in one task. Of versions of one instant the greatest payload counts; rows
    without a time get none.
    """
    names = rows.columns
    held = F.struct(*(F.col(f"`{c}`") for c in payload))
    left = rows.select(F.col(f"`{time}`").alias("_t"), F.lit(1).alias("_kind"), F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("_h"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    right = versions.where(F.col(f"`{published}`").isNotNull()).select(F.col(f"`{published}`").alias("_t"), F.lit(0).alias("_kind"), held.alias("_held"))
    order = ["_t", "_kind", "_held", "_h"]
    both = left.unionByName(right, allowMissingColumns=True)
    dealt = table(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "asof")
    last = dealt.where("_kind = 0").groupBy("_part").agg(F.max(F.struct("_t", "_held")).alias("_last"))
    parts = dealt.select("_part").distinct().join(last, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = F.broadcast(parts.select("_part", F.last("_last._held", ignorenulls=True).over(before).alias("_carried")))
    here = Window.partitionBy("_part").orderBy("_t", "_kind", "_held").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.last("_held", ignorenulls=True).over(here)).where("_kind = 1").join(carried, "_part", "left")
    got = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carried"))
    return found.select("_row.*", *(got[c].alias(c) for c in payload))
