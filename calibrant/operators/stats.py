"""Rank statistics and signal distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from calibrant.session import table


def _below(counts: DataFrame, x: str, n: str) -> DataFrame:
    """counts with `below`: how many rows have a smaller value. Sorted by ranges, never in one task.

    The ranges are written before their totals are taken: a range partitioning that is computed
    again may cut elsewhere.
    """
    parts = table(counts.repartitionByRange(x).withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part").agg(F.sum(n).alias("t"))
    totals = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    w = Window.partitionBy("part").orderBy(x)
    # a row for each partition
    return parts.join(F.broadcast(totals), "part").withColumn("below", F.col("before") + F.sum(n).over(w) - F.col(n)).drop("part", "before")


def value_ranks(rows: DataFrame, x: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """WIN-01: average rank of each distinct value, from counts of values."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"))
    if by:
        counts = counts.withColumn("below", F.sum("c").over(Window.partitionBy(*by).orderBy(x)) - F.col("c"))
    else:
        counts = _below(counts, x, "c")
    return counts.select(*by, x, (F.col("below") + (F.col("c") + 1) / F.lit(2.0)).alias(f"{x}_rank"))


def correlate(rows: DataFrame, score: str, correct: str) -> DataFrame:
    """AGG-18/19/20: n, Spearman's rho, ROC-AUC, mean score, accuracy; rho 0 and AUC 0.5 below three rows.

    Ties share their average rank; one class gives AUC 0.5 and rho 0. All comes from the counts
    of right and all rows at each distinct score.
    """
    r = rows.where(F.col(score).isNotNull() & F.col(correct).isNotNull()).select(F.col(score).cast("double").alias("x"), F.col(correct).cast("long").alias("y"))
    c = _below(r.groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("p")), "x", "c")
    rank = F.col("below") + (F.col("c") + 1) / F.lit(2.0)
    d = lambda v: F.coalesce(v.cast("double"), F.lit(0.0))
    s = c.agg(
        d(F.sum("c")).alias("n"), d(F.sum("p")).alias("n1"), d(F.sum(rank * F.col("c"))).alias("sr"), d(F.sum(rank * rank * F.col("c"))).alias("srr"),
        d(F.sum(rank * F.col("p"))).alias("s1"), F.sum(F.col("x") * F.col("c")).alias("sx"),
    )
    n, n1, s1 = F.col("n"), F.col("n1"), F.col("s1")
    n0, mean = n - n1, (n + 1) / F.lit(2.0)
    y0, y1 = (n0 + 1) / F.lit(2.0), n0 + (n1 + 1) / F.lit(2.0)
    cov = F.try_divide(y1 * s1 + y0 * (F.col("sr") - s1), n) - mean * mean
    spread = F.sqrt((F.try_divide(F.col("srr"), n) - mean * mean) * (F.try_divide(n0 * y0 * y0 + n1 * y1 * y1, n) - mean * mean))
    rho = F.coalesce(F.try_divide(cov, spread), F.lit(0.0))
    auc = F.coalesce(F.try_divide(s1 - n1 * (n1 + 1) / F.lit(2.0), n1 * n0), F.lit(0.5))
    return s.select(
        n.cast("long").alias("n"), F.when(n < 3, F.lit(0.0)).otherwise(rho).alias("rho"), F.when(n < 3, F.lit(0.5)).otherwise(auc).alias("auc"),
        F.try_divide(F.col("sx"), n).alias("mean_score"), F.try_divide(n1, n).alias("accuracy"),
    )


#: Groups whose quantiles are narrowed down on the driver, bins of a round, and values that a last round may sort there.
MAX_GROUPS, BINS, MAX_VALUES = 16, 1024, 200_000


def quantiles(rows: DataFrame, x: str, qs: list[float], groups: list[Row], keys: list[str]) -> list[list[float | None]]:
    """Exact quantiles of a column, a list for each of some groups (rows of keys, `n` non-null values, `low`, `high`).

    Each round counts the values of the intervals that hold the wanted ranks in equal bins, and
    keeps the bins they lie in; when few values are left they are sorted. Only counts are
    shuffled: no group's values meet in one task, however many of them are distinct.
    """
    spark = rows.sparkSession
    value = rows.select(*keys, F.col(x).cast("double").alias("x"))
    want: dict[tuple[int, int], list] = {}  # (group, rank): low, high, values below low
    ranks = []
    for g, r in enumerate(groups):
        ranks.append([(r["n"] - 1) * q for q in qs] if r["n"] else [])
        for p in ranks[-1]:
            for k in {math.floor(p), math.ceil(p)}:
                want[g, k] = [r["low"], r["high"], 0]
    found = {at: w[0] for at, w in want.items() if w[0] == w[1]}
    sizes = {(g, r["low"], r["high"]): r["n"] for g, r in enumerate(groups)}
    while open_ := {at: w for at, w in want.items() if at not in found}:
        spans = sorted({(at[0], w[0], w[1]) for at, w in open_.items()})
        table_ = spark.createDataFrame([(*[groups[g][k] for k in keys], i, lo, hi) for i, (g, lo, hi) in enumerate(spans)], StructType([*(rows.schema[k] for k in keys), StructField("i", IntegerType()), StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
        span = table_.select(*(F.col(f"`{k}`").alias(f"g_{n}") for n, k in enumerate(keys)), "i", "lo", "hi")
        on = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        for n, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"g_{n}"))
        held = value.join(F.broadcast(span), on)  # MAX_GROUPS * 2 * len(qs) rows at most
        if sum(sizes[s] for s in spans) <= MAX_VALUES:
            lists: dict[int, list[float]] = {}
            for r in held.select("i", "x").collect():  # MAX_VALUES at most
                lists.setdefault(r["i"], []).append(r["x"])
            for i in lists:
                lists[i].sort()
            for at, (lo, hi, below) in open_.items():
                found[at] = lists[spans.index((at[0], lo, hi))][at[1] - below]
            break
        b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins: dict[int, list] = {}
        for r in held.groupBy("i", b.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # BINS for each interval
            bins.setdefault(r["i"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
        for at, w in open_.items():
            below = w[2]
            for _, n, lo, hi in sorted(bins[spans.index((at[0], w[0], w[1]))]):
                if at[1] < below + n:
                    sizes[at[0], lo, hi] = n
                    want[at] = [lo, hi, below]
                    if lo == hi or at[1] == below:
                        found[at] = lo
                    elif at[1] == below + n - 1:
                        found[at] = hi
                    break
                below += n
    mid = lambda g, p: found[g, math.floor(p)] + (found[g, math.ceil(p)] - found[g, math.floor(p)]) * (p - math.floor(p))
    return [[mid(g, p) for p in ps] or [None] * len(qs) for g, ps in enumerate(ranks)]


def signal_stats(rows: DataFrame, x: str, keys: list[str], clip: float = 1.0) -> DataFrame:
    """AGG-15/16: share over 0, 0.5 and 1, clipped share, mean, median, population deviation, deciles.

    A few groups get their quantiles by narrowing intervals; with more than MAX_GROUPS each is
    small against the whole, and has them from its own task.
    """
    v = F.col(x).cast("double")
    plain = [F.count(v).alias("n"), *(F.avg((v > t).cast("int")).alias(f"over_{str(t).replace('.', '_')}") for t in (0, 0.5, 1)), F.avg((F.abs(v) > clip).cast("int")).alias("clipped"), F.avg(v).alias("mean")]
    names = [*keys, "n", "over_0", "over_0_5", "over_1", "clipped", "mean", "median", "std", "p10", "p90"]
    one = rows.groupBy(*keys).agg(*plain, F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    groups = one.limit(MAX_GROUPS + 1).collect()
    odd = any(r["high"] is not None and not math.isfinite(r["high"] - r["low"]) for r in groups)
    if len(groups) > MAX_GROUPS or odd or not groups:
        return rows.groupBy(*keys).agg(*plain, F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90")).select(*names)
    got = quantiles(rows.where(v.isNotNull()), x, [0.5, 0.1, 0.9], groups, keys)
    schema = StructType([one.schema[n] if n in one.columns else StructField(n, DoubleType()) for n in names])
    say = {"median": 0, "p10": 1, "p90": 2}
    return rows.sparkSession.createDataFrame([tuple(qs[say[n]] if n in say else r[n] for n in names) for r, qs in zip(groups, got)], schema)


def verdict(positive: Column, over: Column) -> Column:
    """AGG-40."""
    return F.when((positive >= 0.2) & (over < 0.5), "PASS").when(positive >= 0.05, "BOUNDARY").otherwise("FAIL")


def sequence_delta(rl: Column, ref: Column, start: Column) -> Column:
    """AGG-17: sum, mean and count of rl - ref from `start` on, where both are finite."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    n = F.least(F.size(rl), F.size(ref))
    cut = lambda a: F.slice(a, start + 1, F.greatest(n - start, F.lit(0)))
    d = F.filter(F.zip_with(cut(rl), cut(ref), lambda a, b: F.when(ok(a) & ok(b), a - b)), lambda v: v.isNotNull())
    total = F.aggregate(d, F.lit(0.0), lambda s, v: s + v)
    return F.struct(F.bround(total, 6).alias("delta_sum"), F.coalesce(F.bround(F.try_divide(total, F.size(d)), 6), F.lit(0.0)).alias("delta_mean"), F.size(d).alias("n_tokens"))


def k_calibration(slots: DataFrame, ks: list[int], top: int) -> DataFrame:
    """AGG-31: mass, pooled correlation and errors of keeping k of `top` slots; one scan for all k.

    slots: (pos, rank from 0, rl, delta), a row for each slot.
    """
    d = F.col("delta")
    sums = [F.count_distinct("pos").alias("npos"), F.sum(d).alias("sy"), F.sum(d * d).alias("syy")]
    for k in ks:
        kept = F.col("rank") < k
        zero = lambda v, kept=kept: F.sum(F.when(kept, v).otherwise(F.lit(0.0)))
        sums += [zero(F.exp("rl")).alias(f"mass_{k}"), zero(d).alias(f"sx_{k}"), zero(d * d).alias(f"sxx_{k}"), F.sum(F.when(kept, F.lit(0.0)).otherwise(F.abs(d))).alias(f"err_{k}")]
    one = slots.agg(*sums)
    rows = one.select("npos", "sy", "syy", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"mass_{k}").alias("mass"), F.col(f"sx_{k}").alias("sx"), F.col(f"sxx_{k}").alias("sxx"), F.col(f"err_{k}").alias("err")) for k in ks))).alias("s")).select("npos", "sy", "syy", "s.*")
    n = F.col("npos") * F.lit(float(top))
    rho = (n * F.col("sxx") - F.col("sx") * F.col("sy")) / F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))
    return rows.select("k", (F.col("mass") / F.col("npos")).alias("mass"), F.when(F.col("k") >= top, F.lit(1.0)).otherwise(rho).alias("rho"), (F.col("err") / n).alias("mae"), F.when(F.col("k") < top, F.col("err") / (F.col("npos") * (top - F.col("k")))).alias("tail_mae"))
