"""Tables in numbered versions: a writer adds one, readers take the newest, and nothing is overwritten while it is read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest_number(spark: SparkSession, path: str) -> int | None:
    """The newest version's number, from the folders' names; null where there is none."""
    got = _read(spark, path)
    return got.agg(F.max("version")).first()[0] if got is not None else None


def newest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None]:
    """STM-04: the newest version and its number."""
    n = newest_number(spark, path)
    return (spark.read.parquet(f"{path}/version={n}"), n) if n is not None else (None, None)


def if_newer(spark: SparkSession, path: str, known: int | None) -> tuple[DataFrame | None, int | None]:
    """STM-04: the newest version if it is newer than the known one, else nothing and the known number."""
    got, n = newest(spark, path)
    return (got, n) if n is not None and (known is None or n > known) else (None, known if n is None else n)


def publish(df: DataFrame, path: str, version: int | None = None) -> int:
    """STM-04: write df as the next version, or as the given one, which replaces what a failed attempt left of it."""
    n = newest_number(df.sparkSession, path) if version is None else None
    at = version if version is not None else 1 if n is None else n + 1
    df.write.mode("overwrite").parquet(f"{path}/version={at}")
    return at
