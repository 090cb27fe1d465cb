"""Evaluation analytics over sample rows: pass@1, ave@n, majority votes, result rows, lengths, efficiency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(cond: Column) -> Column:
    return F.avg(cond.cast("int"))


def pass_at_1(rows: DataFrame, keys: list[str], problem: str = "problem_id", correct: str = "correct") -> DataFrame:
    """AGG-01: share of problems with any right sample."""
    per = rows.groupBy(*keys, problem).agg(F.bool_or(F.coalesce(correct, F.lit(False))).alias("any_right"))
    return per.groupBy(*keys).agg(F.count("*").alias("n"), rate(F.col("any_right")).alias("pass_at_1"))


def ave_at_n(rows: DataFrame, keys: list[str], problem: str = "problem_id", correct: str = "correct") -> DataFrame:
    """AGG-02: mean over problems of the share of right samples; null if any row lacks the field."""
    per = rows.groupBy(*keys, problem).agg(rate(F.col(correct)).alias("share"), F.count_if(F.col(correct).isNull()).alias("lacking"))
    return per.groupBy(*keys).agg(F.when(F.sum("lacking") == 0, F.avg("share")).alias("ave_at_n"))


def majority(rows: DataFrame, keys: list[str], answer: str = "answer", order: str = "sample_idx") -> DataFrame:
    """AGG-03: most frequent answer without nulls, ties to the first seen; (null, 0) if there is none."""
    per = rows.groupBy(*keys, answer).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    per = per.withColumn("c", F.when(F.col(answer).isNull(), F.lit(0)).otherwise(F.col("c")).cast("long"))
    best = F.max_by(F.struct(F.col(answer).alias("a"), F.col("c")), F.struct("c", -F.col("first")))
    return per.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.a").alias("majority"), F.col("b.c").alias("votes"))


def _same(answer: Column, truth: Column) -> Column:
    return answer == truth


def voted(rows: DataFrame, keys: list[str], grade: Callable[[Column, Column], Column] = _same) -> DataFrame:
    """AGG-04: rows, one for each sample, with the majority answer of their problem and whether it is right. Distinct (answer, truth) pairs are graded once."""
    votes = majority(rows, [*keys, "problem_id"])
    truth = rows.groupBy(*keys, "problem_id").agg(F.max("ground_truth").alias("_truth"))
    each = votes.join(truth, [*keys, "problem_id"])
    right = each.select("majority", "_truth").distinct().withColumn("majority_correct", F.coalesce(grade(F.col("majority"), F.col("_truth")), F.lit(False)))
    on = F.col("majority").eqNullSafe(F.col("_m")) & F.col("_truth").eqNullSafe(F.col("_g"))
    each = each.join(right.select(F.col("majority").alias("_m"), F.col("_truth").alias("_g"), "majority_correct"), on).select(*keys, "problem_id", F.col("majority").alias("majority_answer"), "majority_correct")
    return rows.join(each, [*keys, "problem_id"])


def problem_results(rows: DataFrame, keys: list[str], metric: str = "majority", grade: Callable[[Column, Column], Column] = _same) -> DataFrame:
    """AGG-04: one row a cell, n = problems; status rates and tokens from sample 0.

    Accuracy is that of the majority answers as `grade` sees them, or with metric `ave` the mean
    over problems of the share of right samples, or with `single` that of sample 0.
    """
    right = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    if metric == "majority":
        score = voted(rows, keys, grade).groupBy(*keys, "problem_id").agg(F.max(right("majority_correct")).alias("score"))
    elif metric == "ave":
        score = rows.groupBy(*keys, "problem_id").agg(F.avg(right("correct")).alias("score"))
    elif metric == "single":
        score = rows.groupBy(*keys, "problem_id").agg(F.max(F.when(F.col("sample_idx") == 0, right("correct"))).alias("score"))
    else:
        raise ValueError(f"unknown metric: {metric}")
    cells = score.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("accuracy"))
    zero = rows.where("sample_idx = 0").groupBy(*keys).agg(
        rate(F.col("status") == "eos").alias("eos_rate"), rate(F.col("status") != "eos").alias("budget_stop_rate"), rate(F.col("answer").isNull()).alias("no_answer_rate"), F.avg("tokens").alias("avg_tokens")
    )
    return cells.join(zero, keys).withColumn("metric", F.lit(metric))


def sample_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-05: one row a cell, n = samples; prefix accuracy over rows without an answer, null if none."""
    none = F.col("answer").isNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rate(F.coalesce(F.col("correct"), F.lit(False))).alias("accuracy"),
        F.try_divide(F.sum(F.when(none & F.col("prefix_correct"), 1).otherwise(0)), F.sum(none.cast("int"))).alias("prefix_accuracy"),
        rate(none).alias("no_answer_rate"), rate(F.col("status") == "eos").alias("eos_rate"), rate(F.col("status") == "budget_stop").alias("budget_stop_rate"),
        F.avg("tokens").alias("avg_reasoning_tokens"),
    )


def length_stats(rows: DataFrame, keys: list[str], length: str = "tokens", wall: str = "wall_s", cap: int = 8192) -> DataFrame:
    """AGG-06: totals, quantiles (p90 and p95 exclusive), shares over limits, speed.

    All comes from counts by length: a group's quantiles are picked at running counts of its
    distinct lengths, so no group's rows are held together.
    """
    x, c = F.col(length), F.col("c")
    counts = rows.groupBy(*keys, length).agg(F.count("*").alias("c"), F.sum(wall).alias("w"), F.count_if(F.col("status") == "eos").alias("e"))
    group = Window.partitionBy(*keys)
    known = F.when(x.isNotNull(), c).otherwise(0)
    counts = counts.withColumn("below", F.sum(known).over(group.orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - known).withColumn("m", F.sum(known).over(group))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + known), x))

    def exclusive(p: float) -> tuple[Column, Column]:
        """Rank below p(m + 1), ends clamped, and how far from it to the next."""
        place = F.lit(p) * (F.col("m") + 1)
        k = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(F.col("m") - 1, F.lit(1)))
        return k - 1, place - k

    picks, ends = [], {}
    half = F.lit(0.5) * (F.col("m") - 1)
    for name, rank, weight in (("p50", F.floor(half), half - F.floor(half)), ("p90", *exclusive(0.9)), ("p95", *exclusive(0.95))):
        picks += [at(rank).alias(f"{name}_lo"), F.coalesce(at(rank + 1), at(rank)).alias(f"{name}_hi"), F.max(weight).alias(f"{name}_w")]
        between = F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_w")
        none = F.lit(None if name == "p50" else 0.0).cast("double")
        ends[name] = F.when(F.col("m") == 0, none).when(F.col("m") == 1, F.col(f"{name}_lo").cast("double")).otherwise(between)
    n, total, seconds = F.sum("c"), F.sum(c * x), F.sum("w")
    share = lambda cond: F.coalesce(F.sum(F.when(cond, c).otherwise(0)) / F.sum("c"), F.lit(0.0))
    out = counts.groupBy(*keys).agg(
        n.alias("n"), total.alias("total"), F.try_divide(total, F.sum(known)).alias("mean"), F.max(x).alias("longest"), F.max("m").alias("m"), *picks,
        F.coalesce(F.sum("e") / F.sum("c"), F.lit(0.0)).alias("eos_rate"), share(x > 2048).alias("over_2048"), share(x > 4096).alias("over_4096"), share(x == cap).alias("at_cap"),
        F.coalesce(F.try_divide(total, seconds), F.lit(0.0)).alias("tokens_per_s"), F.coalesce(F.try_divide(n, seconds), F.lit(0.0)).alias("samples_per_s"),
    )
    return out.withColumns(ends).select(*keys, "n", "total", "mean", "p50", "longest", "eos_rate", "over_2048", "over_4096", "at_cap", "tokens_per_s", "samples_per_s", "p90", "p95")


def efficiency(counts: DataFrame) -> DataFrame:
    """AGG-07: ratios of rollout counters; 0 on a zero divisor, utilisation 1 without a budget."""
    d = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counts.select(
        "*", F.when(F.coalesce(F.col("budget_tokens"), F.lit(0)) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("generated_tokens") / F.col("budget_tokens"))).alias("utilisation"),
        d("n_budget", "n_total").alias("truncation_rate"), d("n_loop", "n_total").alias("loop_rate"), d("n_eos", "n_total").alias("eos_rate"),
        d("n_appended", "n_total").alias("accuracy_proxy"), d("generated_tokens", "wall_s").alias("raw_tok_per_s"), d("valid_tokens", "wall_s").alias("valid_tok_per_s"),
        d("n_appended", "valid_tokens").alias("useful_per_token"),
    )


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-08: counts by status; teacher tokens are twice the valid ones."""
    bad = F.col("status").isin("loop", "invalid", "empty")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    valid = F.sum(F.when(bad, 0).otherwise(F.col("tokens")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_total"), *(n(s) for s in ("eos", "budget_stop", "loop", "invalid", "empty")), valid.alias("valid_tokens"), (valid * 2).alias("teacher_tokens"))


def pool_share(rows: DataFrame, phase: str | None = "pool") -> DataFrame:
    """AGG-13: shares of steps whose phase names refresh, or else base, and of others; without a phase column nulls and a note."""
    if phase is None or phase not in rows.columns:
        none = F.lit(None).cast("double")
        return rows.agg(F.count("*").alias("n")).select("n", *(none.alias(c) for c in ("base", "refresh", "other")), F.lit("no phase column").alias("note"))
    v = F.lower(F.coalesce(F.col(phase).cast("string"), F.lit("")))
    refresh = F.contains(v, F.lit("refresh"))
    base = ~refresh & F.contains(v, F.lit("base"))
    share = lambda c: F.bround(F.count_if(c) / F.greatest(F.lit(1), F.count("*")), 4)
    return rows.agg(F.count("*").alias("n"), share(base).alias("base"), share(refresh).alias("refresh"), share(~base & ~refresh).alias("other")).withColumn("note", F.lit(None).cast("string"))
