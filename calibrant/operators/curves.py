"""Budget curves: widths, areas, budgets to reach an accuracy, gains. The grid is small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def widths(grid: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """WIN-03: full gap at the ends, half the sum of gaps inside, 1 for a single budget."""
    w = Window.partitionBy(*keys).orderBy("budget")
    lo, hi = F.lag("budget").over(w), F.lead("budget").over(w)
    span = (F.coalesce(hi, F.col("budget")) - F.coalesce(lo, F.col("budget"))) / F.when(lo.isNull() | hi.isNull(), F.lit(1.0)).otherwise(F.lit(2.0))
    return grid.select("*", F.when(lo.isNull() & hi.isNull(), F.lit(1.0)).otherwise(span).alias("width"))


def area(curve: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-21/22: sum of accuracy times width over the grid, a missing budget counts 0; and its share of the whole."""
    g = widths(grid.select("budget").distinct())
    cells = curve.select(*keys).distinct().crossJoin(F.broadcast(g))  # the grid has a few budgets
    got = cells.join(curve, [*keys, "budget"], "left")
    auc = F.sum(F.coalesce("accuracy", F.lit(0.0)) * F.col("width"))
    return got.groupBy(*keys).agg(auc.alias("auc"), F.coalesce(F.try_divide(auc, F.sum("width")), F.lit(0.0)).alias("nauc"))


def budget_at(curve: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """WIN-02: first budget that reaches the target, interpolated from the present point before it; null if none does."""
    rows = curve.where(F.col("accuracy").isNotNull())
    w = Window.partitionBy(*keys).orderBy("budget")
    rows = rows.withColumn("prev", F.lag(F.struct("budget", "accuracy")).over(w))
    pa, pb = F.col("prev.accuracy"), F.col("prev.budget")
    inner = (pa < target) & (F.col("accuracy") > target)
    value = F.when(inner, pb + (F.lit(target) - pa) / (F.col("accuracy") - pa) * (F.col("budget") - pb)).otherwise(F.col("budget").cast("double"))
    return rows.groupBy(*keys).agg(F.min_by(F.when(F.col("accuracy") >= target, value), F.when(F.col("accuracy") >= target, F.col("budget"))).alias("budget_at"))


def point_efficiency(curve: DataFrame) -> DataFrame:
    """AGG-23."""
    return curve.select("*", F.coalesce(F.col("accuracy") / (F.col("avg_tokens") + F.lit(1e-6)), F.lit(0.0)).alias("efficiency"))


def gain_over(curve: DataFrame, base: str) -> DataFrame:
    """JOIN-06: gain over a base label at the same budget, a missing base counts 0."""
    b = curve.where(F.col("label") == base).select("budget", F.col("accuracy").alias("base_accuracy"))
    out = curve.join(b, "budget", "left")
    gain = F.col("accuracy") - F.coalesce("base_accuracy", F.lit(0.0))
    return out.select("label", "budget", gain.alias("gain"), (gain / (F.col("avg_tokens") + F.lit(1e-6))).alias("gain_per_token"))


def difference(curve: DataFrame, a: str, b: str) -> DataFrame:
    """JOIN-07: difference of two labels where both have the budget."""
    x = curve.where(F.col("label") == a).select("budget", F.col("accuracy").alias("x"))
    y = curve.where(F.col("label") == b).select("budget", F.col("accuracy").alias("y"))
    return x.join(y, "budget").select("budget", (F.col("x") - F.col("y")).alias("difference"))
