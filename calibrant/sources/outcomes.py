"""Resumable evaluation: results and failures of items, written run by run; one bad item fails itself alone."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.errors import StateError


def isolated(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(keys, attempt, schema, error): fn of rows, batch by batch; where it raises, of halves, and only the rows that raise alone carry an error.

    Once some items have failed, fn gets as many at a time as are likely to be all good, down to one.
    """
    held = [*keys, "attempt"]
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = failed = 0
        for pdf in batches:
            good, bad = defaultdict(list), []  # good by dtypes: integers stay what they are beside parts with nulls
            n = len(pdf)
            step = max(1, min(n, int(0.7 * tried / failed))) if failed else max(1, n)
            todo = [(lo, min(lo + step, n), -1) for lo in range(0, n, step)][::-1]
            while todo:
                lo, hi, before = todo.pop()
                error = None
                if hi - lo == 1 or len(bad) != before:  # else the bad one is in this half, as none was in the other
                    try:
                        got = fn(pdf if hi - lo == n else pdf.iloc[lo:hi])
                        if len(got) != hi - lo:
                            raise ValueError(f"{len(got)} results for {hi - lo} items")
                        columns = [got[c] for c in names]
                        good[tuple(c.dtype for c in columns)].append((lo, hi, columns))
                        continue
                    except Exception as e:  # an item of it is bad, whatever it raised
                        error = e
                if hi - lo == 1:
                    bad.append((lo, f"{type(error).__name__}: {error}"[:500]))
                else:
                    mid = (lo + hi) // 2
                    todo += [(mid, hi, len(bad)), (lo, mid, -1)]
            tried, failed = tried + n, failed + len(bad)
            for dtypes, parts in good.items():
                out = pdf[held].iloc[np.concatenate([np.arange(lo, hi) for lo, hi, _ in parts])].reset_index(drop=True)
                for c, dtype, values in zip(names, dtypes, zip(*(columns for *_, columns in parts)), strict=True):
                    out[c] = np.concatenate([v.to_numpy() for v in values]) if isinstance(dtype, np.dtype) else pd.concat(values, ignore_index=True)
                yield out.assign(error=None)
            if bad:
                yield pdf[held].iloc[[i for i, _ in bad]].reset_index(drop=True).reindex(columns=[*held, *names, "error"]).assign(error=[e for _, e in bad])

    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in held) + f", {schema}, error string")


def outcomes(spark: SparkSession, path: str) -> DataFrame | None:
    """All that was written: (keys, attempt, values, error, run)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def results(done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that have a result: the one of their first attempt that had any."""
    first = Window.partitionBy(*keys).orderBy("run", "attempt")
    return done.where(F.col("error").isNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "error")


def dead_letters(done: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt, error): items without a result, with their last attempt and what it raised."""
    each = done.groupBy(*keys).agg(F.bool_or(F.col("error").isNull()).alias("_ok"), F.max("attempt").alias("attempt"), F.max_by("error", "attempt").alias("error"))
    return each.where(~F.col("_ok")).drop("_ok")


def evaluate(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, run: int | None = None, attempts: int = 3, same: str = "n_samples") -> DataFrame:
    """SRC-15: evaluate the items that have no result yet and fewer than `attempts` failures; returns all outcomes.

    Items are dealt out evenly first: they are few bytes, and what fn does with them is not.
    A run's outcomes, good and bad, are one write of one pass, in a folder of the run's own. A run
    that is repeated, by its number, does not count what it left behind and replaces it. Items of
    earlier runs must agree in the column `same`, if rows have it.
    """
    was = outcomes(spark, path)
    if run is None:
        run = ((was.agg(F.max("run")).first()[0] or 0) if was is not None else 0) + 1
    if was is not None:
        was = was.where(F.col("run") < run)
    todo = rows.withColumn("attempt", F.lit(1))
    if was is not None:
        if same in rows.columns and same in was.columns:
            other = was.where(F.col(same).isNotNull()).select(same).distinct().join(rows.select(same).distinct(), same, "left_anti").first()
            if other:
                raise StateError(f"{same} differs from what was written: {other[0]}")
        state = was.groupBy(*keys).agg(F.bool_or(F.col("error").isNull()).alias("_ok"), F.max("attempt").alias("_tries"))
        todo = rows.join(state, keys, "left").where(~F.coalesce("_ok", F.lit(False)) & (F.coalesce("_tries", F.lit(0)) < attempts))
        todo = todo.withColumn("attempt", F.coalesce("_tries", F.lit(0)) + 1).drop("_ok", "_tries")
    kept = [*keys, same] if same in rows.columns else keys
    isolated(todo.repartition(3 * spark.sparkContext.defaultParallelism), kept, fn, schema).write.mode("overwrite").parquet(f"{path}/run={run}")
    return outcomes(spark, path)
