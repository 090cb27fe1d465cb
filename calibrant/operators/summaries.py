"""Summaries of metric tables whose columns are not known beforehand and mostly null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numbers(rows: DataFrame, leave: list[str]) -> list[str]:
    """Numeric columns; booleans are none."""
    return [c for c, kind in rows.dtypes if c not in leave and kind.split("(")[0] in _NUMBERS]


def melt(rows: DataFrame, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, order, key, value): a row for each number there is, the order's own too; one pass, no shuffle."""
    cols = numbers(rows, by)
    at = rows.select(*by, F.col(order).alias("_at"), *(F.col(f"`{c}`").cast("double").alias(c) for c in cols))
    return at.unpivot([*by, "_at"], cols, "key", "value").where(F.col("value").isNotNull()).withColumnRenamed("_at", order if order not in cols else "at")


def _position(order: str, rows: DataFrame) -> str:
    return "at" if order in numbers(rows, []) else order


def mean_and_last(rows: DataFrame, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """AGG-09: (by, n, key, mean, last) for the keys that the first row has; booleans and texts are no values."""
    at = _position(order, rows)
    keys = melt(rows, order, by).groupBy(*by, "key").agg(F.avg("value").alias("mean"), F.max_by("value", at).alias("last"), F.min(at).alias("_first"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(order).alias("_start"))
    joined = keys.join(F.broadcast(whole), F.col("_first") == F.col("_start")) if not by else keys.join(whole, by).where("_first = _start")
    return joined.select(*by, "n", "key", "mean", "last")


def present_means(rows: DataFrame, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """AGG-10: (by, key, mean, n) over the rows that have the key."""
    return melt(rows, order, by).groupBy(*by, "key").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def zero_means(rows: DataFrame, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """AGG-11: (by, key, mean) where a missing value counts as 0; a key that no row has is not listed."""
    sums = melt(rows, order, by).groupBy(*by, "key").agg(F.sum("value").alias("_sum"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = sums.join(whole, by) if by else sums.join(F.broadcast(whole))  # one row
    return joined.select(*by, "key", (F.col("_sum") / F.col("_n")).alias("mean"))


def run_summary(rows: DataFrame, order: str, means: list[str], counters: dict[str, str], phase: str = "phase", by: list[str] = []) -> DataFrame:  # noqa: B006
    """AGG-10: a run's row: steps outside the rollout phase, means over rows that have the key, and the last value of each counter; keys that no row has give null."""
    have = set(rows.columns)
    value = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("double")
    last: list[Column] = [F.max_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(name) for c, name in counters.items()]
    steps = F.count_if(~F.col(phase).eqNullSafe(F.lit("rollout"))) if phase in have else F.count("*")
    return rows.groupBy(*by).agg(steps.alias("n_steps"), *(F.avg(value(c)).alias(f"{c}_mean") for c in means), *last)


def accuracy_percent(lines: DataFrame, keys: list[str], line: str = "line", field: str = "correct") -> DataFrame:
    """AGG-14: right rows in percent from lines of JSON; lines that are none are left out, NaN where none is left."""
    ok = F.try_parse_json(line)
    right = F.coalesce(F.try_variant_get(ok, f"$.{field}", "boolean"), F.lit(False))
    return lines.groupBy(*keys).agg(F.coalesce(100 * F.avg(F.when(ok.isNotNull(), right.cast("int"))), F.lit(float("nan"))).alias("accuracy"), F.count_if(ok.isNull()).alias("bad_lines"))
