"""Values of training steps: losses and rewards of a batch, and batches drawn from the refresh pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import dists
from calibrant.operators.selection import sample_with_replacement


def step_metrics(rows: DataFrame, keys: list[str], now: Column, ref: Column, delta: Column, behaviour: Column | None = None, kl_weight: float = 0.1, clip: float = 0.2, delta_clip: float = 5.0) -> DataFrame:
    """STM-10: loss, policy loss, KL, expected reward and mean difference of each batch.

    now, ref and delta are dense arrays of a position; behaviour, where given, is what the rollout
    was drawn from (else now, so that ratios are one).
    """
    each = rows.select(
        *keys, dists.pg_token(now, behaviour if behaviour is not None else now, delta, clip=clip, delta_clip=delta_clip).alias("pg"), dists.kl_k3(now, ref).alias("kl"), dists.expected(now, delta).alias("reward"),
        (F.aggregate(delta, F.lit(0.0), lambda a, x: a + x) / F.size(delta)).alias("adv"),
    )
    out = each.groupBy(*keys).agg(F.count("*").alias("batch"), F.avg("pg").alias("pg_loss"), F.avg("kl").alias("kl_loss"), F.avg("reward").alias("reward"), F.avg("adv").alias("adv_mean"))
    return out.withColumn("loss", F.col("pg_loss") + F.lit(float(kl_weight)) * F.col("kl_loss"))


def refresh_batches(pool: DataFrame, key: str, steps: int, batch: int, seed: int = 0) -> DataFrame:
    """STM-09: for each step a batch drawn with replacement from the refresh pool; nothing from an empty one."""
    return sample_with_replacement(pool, key, steps * batch, seed).withColumn("step", F.floor(F.col("draw") / batch).cast("int"))


def skip_reason(pool_size: Column, least: int) -> Column:
    """PRJ-11: why a refresh step is skipped, or null."""
    return F.when(pool_size == 0, "empty pool").when(pool_size < least, "too few")
