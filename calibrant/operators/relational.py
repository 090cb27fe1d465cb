"""Joins and projections with rules of their own: ordered gathers, differences of settings, aliases, positional zips."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.errors import DataError
from calibrant.operators.selection import positions
from calibrant.session import few, table

#: Names that mean the same in results of different tools (fixed values).
ALIASES = {"budget": ("budget", "B", "max_tokens"), "accuracy": ("accuracy", "acc", "pass@1")}
#: Settings that may differ between a run and its export (fixed values).
HARMLESS = ("_name_or_path", "model_type", "architectures", "transformers_version")


def gather_rows(rows: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """PRJ-10: rows at an index(place, key): in any order and as often as they are named; places of absent rows are left out."""
    return index.join(rows, key)


def config_diff(a: DataFrame, b: DataFrame, key: str, value: str, ignore: Iterable[str] = HARMLESS) -> DataFrame:
    """PRJ-12: settings that differ between two tables of (key, value), one side null where it has none; harmless ones aside."""
    x, y = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    return x.join(y, key, "full").where(~F.col("left").eqNullSafe(F.col("right")) & ~F.col(key).isin(*ignore))


def first_of(df: DataFrame, field: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """PRJ-15: the first non-null of a field's names that the table has; null if it has none."""
    there = [F.col(f"`{n}`") for n in aliases[field] if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def three_way(samples: DataFrame, rl: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """JOIN-05: samples with both teachers' rows, joined once and written; an empty result is an error."""
    out = table(samples.join(rl, key).join(ref, key), "three")
    if out.isEmpty():
        raise DataError(f"no {key} is in all three tables")
    return out


def after_minus_before(rows: DataFrame, keys: list[str], phase: str, before: str, after: str, value: str) -> DataFrame:
    """JOIN-08: difference of means after and before, in one pass; blank where either is missing."""
    mean = lambda name: F.avg(F.when(F.col(phase) == name, F.col(value)))
    return rows.groupBy(*keys).agg(mean(before).alias("before"), mean(after).alias("after")).withColumn("gain", F.col("after") - F.col("before"))


def zip_samples(problems: DataFrame, problem_key: str, outputs: DataFrame, output_key: str, n: int) -> DataFrame:
    """JOIN-10: problems in order with outputs in order, n outputs for each problem; a surplus on either side is left out.

    Ordinals come from counts by range partition, so neither side is sorted in one task.
    """
    p = positions(problems, problem_key)[0].withColumnRenamed("position", "problem")
    o = positions(outputs, output_key)[0].withColumn("problem", F.floor(F.col("position") / n)).withColumn("sample_idx", (F.col("position") % n).cast("int")).drop("position")
    return p.join(o, "problem")


def ids_by(rows: DataFrame, group: str, key: str) -> DataFrame:
    """AGG-36: (group, key, place, n): every id with its place in its group's ascending order and the group's size.

    Rows are dealt to ranges of (group, key), and a range's places begin where the group's rows of
    the ranges before it end: no group's ids are held or sorted together.
    """
    dealt = table(rows.select(group, key).repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()), "ids")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    here = Window.partitionBy(group, "_part").orderBy(key)
    joined = dealt.withColumn("_r", F.row_number().over(here) - 1).join(few(starts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(group, key, (F.col("_before") + F.col("_r")).alias("place"), "n")
