"""Connected components of large edge tables, and joins against key lists of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.session import table

#: Key lists up to this many longs are broadcast (16 MB); longer ones are joined by shuffle.
MAX_BROADCAST_KEYS = 1_000_000


def bounded(keys: DataFrame, limit: int = MAX_BROADCAST_KEYS, longs: Column | None = None) -> DataFrame:
    """Mark a materialised list for broadcast if it is short enough: in longs, of which a row holds one or as many as given."""
    if keys.limit(limit + 1).count() > limit:
        return keys
    if longs is not None and (keys.agg(F.sum(longs)).first()[0] or 0) > limit:
        return keys
    return F.broadcast(keys)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every end of edges(u, v): comp is the smallest id reachable.

    Alternates the large-star and small-star steps, each an aggregation by key and a join, until
    the edges no longer change; every round is written to the shared folder.
    """
    e = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    was = _mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v")
        e = table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = _mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
