"""Calibration reports: staleness, support coverage, loop detectors, templates, cost of a corpus.

Each takes rows and gives a small table, the detector sweep also a row for each case; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.tokens import has_tail_loop
from calibrant.session import table

#: Stages of a corpus: name, rows, longest response (fixed values).
STAGES = (("pilot", 5000, 2048), ("scale-1", 10000, 4096), ("scale-2", 25000, 8192), ("full", 50000, 8192))


def age_histogram(rows: DataFrame, age: str = "age") -> DataFrame:
    """AGG-30: consumed rows by age."""
    return rows.groupBy(age).agg(F.count("*").alias("n"))


def waste(results: DataFrame, result: str = "result") -> DataFrame:
    """AGG-30: what became of rollouts. results holds one row for each, `consumed`, `stale` (at put), `stale_late` (at get), `full`, or anything else for those still queued at the end."""
    n = lambda *names: F.count_if(F.col(result).isin(*names))
    total = F.greatest(F.count("*"), F.lit(1))
    return results.agg(
        F.count("*").alias("rollouts"), n("consumed").alias("trained"), n("stale").alias("dropped_at_put"), n("stale_late").alias("dropped_at_consume"), n("full").alias("dropped_queue_full"),
        (F.count("*") - n("consumed", "stale", "stale_late", "full")).alias("shutdown_tail"), (n("stale", "stale_late") / total).alias("stale_discard_ratio"), ((F.count("*") - n("consumed")) / total).alias("waste_ratio"),
    )


def chosen_coverage(rows: DataFrame, rank: str, ks: Iterable[int]) -> DataFrame:
    """AGG-31, C_K: share of valid positions whose chosen token is among the first k; rank is null or beyond where it is in none."""
    ks = list(ks)
    one = rows.agg(*(F.coalesce(F.avg(F.coalesce(F.col(rank) < k, F.lit(False)).cast("int")), F.lit(0.0)).alias(str(k)) for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("coverage")) for k in ks))).alias("s")).select("s.*")


def loop_report(rows: DataFrame, ids: str, eos: int, least: int = 16, periods: Iterable[int] = range(2, 9), share: float = 0.05) -> DataFrame:
    """AGG-32: for each period the share of sequences that end in a loop of it, and whether it is worth detecting; beside sequences with an end token and their lengths."""
    periods, size = list(periods), F.size(ids)
    hits = [F.avg(has_tail_loop(F.col(ids), [p], least).cast("int")).alias(f"p{p}") for p in periods]
    one = rows.agg(
        F.count("*").alias("n"), F.count_if(F.array_contains(ids, eos)).alias("n_eos"), F.coalesce(F.min(size), F.lit(0)).alias("shortest"), F.coalesce(F.max(size), F.lit(0)).alias("longest"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_length"), *hits,
    )
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.coalesce(F.col(f"p{p}"), F.lit(0.0)).alias("rate")) for p in periods)))
    return one.select("n", "n_eos", "shortest", "longest", "mean_length", each.alias("s")).select("s.*", (F.col("s.rate") > share).alias("suggested"), "n", "n_eos", "shortest", "longest", "mean_length")


def suggested_config(report: DataFrame, eos: int | None) -> str:
    """SRC-25: a YAML fragment with the periods that a loop report suggests."""
    found = sorted(r["period"] for r in report.where("suggested").select("period").collect())  # one row for each period
    lines = ["l2:", "  rollout:", "    loop_periods:" + ("" if found else " []"), *(f"    - {p}" for p in found), f"    eos_token_id: {'null' if eos is None else eos}"]
    return "\n".join(lines) + "\n"


def _swept(rows: DataFrame, key: str, ids: str, configs: list[tuple[tuple[int, ...], int]], label: str | None) -> DataFrame:
    each = [F.struct(F.lit(f"periods={p if len(p) != 1 else f'({p[0]},)'},min_len={m}").alias("config"), has_tail_loop(F.col(ids), list(p), m).alias("hit")) for p, m in configs]
    return rows.select(key, *([label] if label else []), F.explode(F.array(*each)).alias("s")).select("*", "s.config", "s.hit")


def detector_sweep(rows: DataFrame, key: str, ids: str, configs: list[tuple[tuple[int, ...], int]], label: str | None = None) -> DataFrame:
    """AGG-33: for each (periods, least length) how many sequences are flagged, and against labels the false-positive rate and how many are missed; beside these, a row for each one flagged or missed (key, kind).

    A configuration without any has one row, with null key and kind. No row or group holds a configuration's keys.
    """
    hit, y = F.col("hit"), F.col(label) if label else F.lit(None).cast("boolean")
    figures = table(_swept(rows, key, ids, configs, label).groupBy("config").agg(
        F.count_if(hit).alias("detected"), F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("rate"),
        (F.coalesce(F.try_divide(F.count_if(hit & ~y), F.count_if(~y)), F.lit(0.0)) if label else F.lit(None).cast("double")).alias("false_positive_rate"),
        (F.count_if(~hit & y) if label else F.lit(None).cast("long")).alias("missed"),
    ), "sweep")
    each = F.broadcast(figures).join(detector_ids(rows, key, ids, configs, label), "config")  # a row for each configuration
    none = figures.where((F.col("detected") == 0) & (F.coalesce("missed", F.lit(0)) == 0))
    return each.unionByName(none, allowMissingColumns=True)


def detector_ids(rows: DataFrame, key: str, ids: str, configs: list[tuple[tuple[int, ...], int]], label: str | None = None) -> DataFrame:
    """AGG-33: (config, key, kind) of the sequences flagged, and of labelled ones missed; a row for each, whatever their number."""
    missed = ~F.col("hit") & F.coalesce(F.col(label), F.lit(False)) if label else F.lit(False)
    kind = F.when(F.col("hit"), "flagged").when(missed, "missed")
    return _swept(rows, key, ids, configs, label).select("config", key, kind.alias("kind")).where(F.col("kind").isNotNull())


def template_audit(rows: DataFrame, keys: list[str], rl_student: str, rl_own: str, ref_student: str, ref_own: str) -> DataFrame:
    """AGG-34: four mean log-probabilities, the difference under either template, and what they say."""
    out = rows.groupBy(*keys).agg(*(F.avg(c).alias(a) for c, a in ((rl_student, "a_rl_student"), (rl_own, "b_rl_own"), (ref_student, "c_ref_student"), (ref_own, "d_ref_own"))))
    student, teacher = F.col("a_rl_student") - F.col("c_ref_student"), F.col("b_rl_own") - F.col("d_ref_own")
    out = out.withColumn("delta_student", student).withColumn("delta_teacher", teacher)
    return out.withColumn("template_matters", F.col("delta_teacher") - F.col("delta_student") > 0.3).withColumn("teacher_negative", F.col("delta_teacher") < -0.5)


def support_audit(rows: DataFrame, expected: str, teacher: str, hit: str, valid: str) -> DataFrame:
    """AGG-35: mean reward on the student's support and mean difference on the teacher's, over valid positions; hit rate over all, padding included."""
    ok = lambda c: F.avg(F.when(F.col(valid), F.col(c)))
    return rows.agg(ok(expected).alias("student_expected"), ok(teacher).alias("teacher_mean"), F.avg(hit).alias("hit_mean"), F.min(hit).alias("hit_min"), F.max(hit).alias("hit_max"))


def lookup_counters(rows: DataFrame, keys: list[str], sample: str, hit: Column, invalid: Column, duplicate: Column) -> DataFrame:
    """AGG-37: lookups, hits, misses, invalid and duplicate ones, hit rate, and the most reuses of one sample."""
    each = rows.groupBy(*keys, sample).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"), F.count_if(invalid).alias("i"), F.count_if(duplicate).alias("d"))
    total = F.sum("n")
    return each.groupBy(*keys).agg(total.alias("total"), F.sum("h").alias("hit"), (total - F.sum("h")).alias("miss"), F.sum("i").alias("invalid"), F.sum("d").alias("duplicate"), (F.sum("h") / F.greatest(total, F.lit(1))).alias("hit_rate"), F.max("n").alias("most_reused"))


def corpus_cost(groups: DataFrame, workers: int = 1, stages: tuple = STAGES) -> DataFrame:
    """JOIN-16 and AGG-38: each stage with the fastest measured group of its longest length, tokens and hours; `missing` where none was measured.

    groups: (max_len, mean_len, tok_per_s).
    """
    plan = groups.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(stages)], "place int, stage string, n long, max_len int")
    best = groups.where("tok_per_s > 0").groupBy("max_len").agg(F.max_by(F.struct("mean_len", "tok_per_s"), F.struct("tok_per_s", "mean_len")).alias("g"))
    length = F.least(F.col("g.mean_len"), F.col("max_len").cast("double"))
    tokens = F.col("n") * length
    rows = F.broadcast(plan).join(best, "max_len", "left")  # a row for each stage
    return rows.select("place", "stage", "n", "max_len", length.alias("mean_len"), F.col("g.tok_per_s").alias("tok_per_s"), tokens.cast("long").alias("total_tokens"), (tokens / (F.col("g.tok_per_s") * workers) / 3600).alias("hours"), F.col("g").isNull().alias("missing"))


def smoke_report(rows: DataFrame, length: str, eos: Column, seconds: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """AGG-39: mean length of all and of ended ones, truncated and ended shares, speed, extremes."""
    x = F.col(length)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bround(F.avg(x), 1).alias("mean_length"), F.bround(F.avg(F.when(eos, x)), 1).alias("mean_length_eos"), F.bround(F.avg((~eos).cast("int")), 4).alias("truncated"),
        F.bround(F.avg(eos.cast("int")), 4).alias("eos_rate"), F.bround(F.try_divide(F.sum(x), F.sum(seconds)), 1).alias("tokens_per_s"), F.sum(x).alias("total_tokens"), F.max(x).alias("longest"), F.min(x).alias("shortest"),
    )


def fits(weights_gb: float, cache_gb: float, gpu_gb: float, same_card: bool, prompt_len: int, response_len: int, context: int, headroom: float = 0.9) -> list[str]:
    """PRJ-16: why a run cannot start: memory of one card, lengths beyond the context; empty if it can."""
    out = []
    need = weights_gb + cache_gb if same_card else max(weights_gb, cache_gb)
    if need > gpu_gb * headroom:
        out.append(f"{need:.1f} GB are needed, {gpu_gb * headroom:.1f} GB can be used")
    if prompt_len + response_len > context:
        out.append(f"{prompt_len} + {response_len} tokens exceed a context of {context}")
    return out
