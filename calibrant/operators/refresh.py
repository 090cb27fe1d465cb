"""The refresh phase: selected prompts are rolled out, filtered, scored, appended and remembered.

Generation and scoring are plug-ins, functions from DataFrame to DataFrame, as models are not
run here: a table of outputs, a mapInPandas around a service, or a test double.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import tokens
from calibrant.operators import state
from calibrant.operators.selection import enforce_budget

Plug = Callable[[DataFrame], DataFrame]
#: Statuses of rollouts that are not kept (fixed values).
BAD = ("loop", "invalid", "empty")


@dataclass
class Refresh:
    """What a phase made: every rollout with its status, the slots of kept ones, the new prompt state, one row of counters."""

    rollouts: DataFrame
    slots: DataFrame
    state: DataFrame
    summary: DataFrame


def copies(selected: DataFrame, n: int) -> DataFrame:
    """SET-05: n copies of each prompt, numbered; the order is copy first, prompt second."""
    return selected.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy"))


def observe(old: DataFrame | None, seen: DataFrame, decay: float = 0.9) -> DataFrame:
    """WIN-05 from a state on: rows of seen(prompt_id, copy, step, reward, disagreement) move each prompt's averages.

    A phase has a few rollouts of a prompt, so these fit an array.
    """
    news = seen.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("step", "copy", F.coalesce("reward", F.lit(0.0)).alias("r"), F.coalesce("disagreement", F.lit(0.0)).alias("d")))).alias("news"))
    names = ("reward_ema", "reward_var", "disagreement_ema")
    if old is None:
        both = news.select("*", F.lit(0).alias("seen"), F.lit(None).cast("long").alias("last"), *(F.lit(0.0).alias(c) for c in names))
    else:
        both = old.join(news, "prompt_id", "full").select("prompt_id", "news", F.coalesce("seen", F.lit(0)).alias("seen"), "last", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    keep, add = F.lit(decay), F.lit(1 - decay)

    def step(s: Column, x: Column) -> Column:
        mean = keep * s["m"] + add * x["r"]
        return F.struct(mean.alias("m"), (keep * s["v"] + add * F.abs(x["r"] - mean)).alias("v"), (keep * s["d"] + add * x["d"]).alias("d"))

    none = F.array().cast("array<struct<step:bigint,copy:int,r:double,d:double>>")
    items = F.coalesce(F.col("news").cast("array<struct<step:bigint,copy:int,r:double,d:double>>"), none)
    out = both.withColumn("s", F.aggregate(items, F.struct(F.col("reward_ema").alias("m"), F.col("reward_var").alias("v"), F.col("disagreement_ema").alias("d")), step))
    return out.select("prompt_id", (F.col("seen") + F.size(items)).alias("seen"), F.coalesce(F.try_element_at(items, F.lit(-1))["step"], F.col("last")).alias("last"), F.col("s.m").alias("reward_ema"), F.col("s.v").alias("reward_var"), F.col("s.d").alias("disagreement_ema"))


def refresh(selected: DataFrame, generate: Plug, score: Plug, *, step: int, eos: int, capacity: int, n_rollout: int = 1, limit: int | None = None, periods: list[int] = [2, 3, 4], least: int = 16, old: DataFrame | None = None, saved: dict | None = None) -> Refresh:  # noqa: B006
    """STM-08: select -> generate -> filter -> score -> append -> state.

    selected: (prompt_id, budget, value). With a limit, budgets are lowered to it and each prompt
    has one rollout; else n_rollout copies. generate adds `ids` to (prompt_id, budget, copy);
    score adds `reward` and `disagreement`, of which the latter may be null (counts as 0).
    """
    if limit is not None:
        plan = enforce_budget(selected.withColumn("all", F.lit(0)), ["all"], "prompt_id", "budget", "value", limit).where(~F.col("dropped"))
        plan = plan.select("prompt_id", F.col("granted").alias("budget"), F.lit(0).alias("copy"))
    else:
        plan = copies(selected.select("prompt_id", "budget"), n_rollout)
    ids = F.col("ids")
    rolled = generate(plan).withColumn("status", tokens.status(ids, eos, periods, least)).withColumn("length", tokens.train_length(ids, eos))
    rolled = rolled.withColumn("kept", ~F.col("status").isin(*BAD))
    kept = score(rolled.where("kept")).withColumn("disagreement", F.coalesce("disagreement", F.lit(0.0)))
    make = lambda: state.RingBuffer.load(saved) if saved else state.RingBuffer(capacity)
    numbered = kept.select(F.lit(0).alias("buffer"), "copy", "prompt_id", "disagreement")
    slots = state.fold(numbered, ["buffer"], ["copy", "prompt_id"], make, ["prompt_id", "disagreement"], "slot int, evicted long, protected boolean").drop("buffer")
    seen = kept.select("prompt_id", "copy", F.lit(step).cast("long").alias("step"), "reward", "disagreement")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    valid = F.coalesce(F.sum(F.when(F.col("kept"), F.col("length"))), F.lit(0))
    summary = rolled.agg(F.count("*").alias("n_total"), F.count_if("kept").alias("n_appended"), *(n(s) for s in ("eos", "budget_stop", "loop", "empty")), valid.alias("valid_tokens"), (2 * valid).alias("teacher_forward_tokens"))
    return Refresh(rolled, slots, observe(old, seen), summary)
