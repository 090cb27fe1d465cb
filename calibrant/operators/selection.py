"""Selection and budgets: prompt values, seeded sampling, budget bands, greedy enforcement, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators import order, stats
from calibrant.session import table

LEVELS = (256, 512, 1024, 2048)


def seeded(key: Column, seed: int) -> Column:
    """A hash order that other engines share."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def budget_bands(rows: DataFrame, value: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """WIN-07: budget by quartile of the value; all equal gives the middle level. Quartiles come from counts, not from a list of all values."""
    v = F.col(value).cast("double")
    whole = rows.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    if not whole["n"] or whole["low"] == whole["high"]:
        return rows.withColumn("budget", F.lit(levels[len(levels) // 2] if whole["n"] else levels[3]))
    q = stats.quantiles(rows.where(v.isNotNull()), value, [0.25, 0.5, 0.75], [whole], [])[0]
    return rows.withColumn("budget", F.when(v < q[0], levels[0]).when(v < q[1], levels[1]).when(v < q[2], levels[2]).otherwise(levels[3]))


def prompt_value(var: Column, dis: Column, seen: Column, ema: Column | None = None, cost: Column | None = None, weights: tuple[float, ...] = (0.4, 0.4, 0.2, 0.0)) -> Column:
    """TOP-05."""
    wu, wd, wn, wr = (F.lit(float(w)) for w in weights)
    v = wu * var + wd * dis + wn / F.sqrt(F.lit(1.0) + seen)
    v = v if ema is None else v + wr * ema
    return v if cost is None else v / (cost + F.lit(1e-8))


def hash_order(key: Column, seed: int) -> Column:
    """The first 60 bits of the hash order, as a number; rows of equal ones go by key."""
    return F.conv(F.substring(seeded(key, seed), 1, 15), 16, 10).cast("long")


def two_stage(rows: DataFrame, key: str, value: str, m: int, seed: int = 0) -> DataFrame:
    """TOP-04: from a seeded pool of 4m rows, the round(0.8 m) highest values and, in hash order, coverage.

    Each step takes the first rows of an order, found by counting (`order.first_rows`), so nothing
    is sorted as a whole however large m is. The key must be a number that no two rows share; null
    values come last.
    """
    some = rows.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_v", F.coalesce(-F.col(value).cast("double"), F.lit(1e300)))
    pool = table(order.first_rows(some, ["_h", key], 4 * m), "pool")
    n_high = round(0.8 * m)
    high = table(order.first_rows(pool, ["_v", "_h", key], n_high), "high")
    rest = order.first_rows(pool.join(high.select(key), key, "left_anti"), ["_h", key], m - n_high)
    return high.select(key, F.lit("high").alias("kind")).unionByName(rest.select(key, F.lit("coverage").alias("kind")))


def select(rows: DataFrame, key: str, value: str, seen: str, m: int, seed: int = 0, share: float = 0.05) -> DataFrame:
    """TOP-04 in full: m picks as (pick, key, kind).

    Cold start, when nothing was seen yet or m is as many as there are keys or more: m draws with
    replacement (kind `cold`). Else two stages; a pool that is used up fills coverage with its
    highest again (`again`). No key has more than max(1, int(m * share)) picks: what is beyond is
    left out, and draws with replacement fill up (`pad`). Picks are numbered high, coverage,
    again, pad; within a kind in hash order.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(seen), F.lit(0))).first()
    if not n:
        return rows.select(F.lit(0).cast("long").alias("pick"), key, F.lit("").alias("kind")).limit(0)
    if total == 0 or m >= n:
        return sample_with_replacement(rows.select(key), key, m, seed).select(F.col("draw").alias("pick"), key, F.lit("cold").alias("kind"))
    most = max(1, int(m * share))
    chosen = table(two_stage(rows.select(key, value), key, value, m, seed), "chosen")
    have = chosen.count()
    again = chosen.where("kind = 'high'").select(key, F.lit("again").alias("kind"))
    if have < m and most > 1:  # each key is there once, and once more at most
        chosen = chosen.unionByName(order.first_rows(again.withColumn("_h", hash_order(F.col(key), seed)), ["_h", key], m - have).select(key, "kind"))
        have = chosen.count()
    rank = F.when(F.col("kind") == "high", 0).when(F.col("kind") == "coverage", 1).otherwise(2)
    placed, _ = positions(chosen.withColumns({"_r": rank.cast("long"), "_h": hash_order(F.col(key), seed)}), ["_r", "_h", key])
    out = placed.select(F.col("position").alias("pick"), key, "kind")
    if have == m:
        return out
    pad = sample_with_replacement(rows.select(key), key, m - have, seed + 1).select((F.col("draw") + have).alias("pick"), key, F.lit("pad").alias("kind"))
    return out.unionByName(pad)


def enforce_budget(rows: DataFrame, keys: list[str], order: str, budget: str, value: str, limit: int, least_share: float = 0.0, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """TOP-06: rows with `granted` budgets whose sum in each group of keys is within the limit, and `dropped`.

    Every lowering of a row by one level is a move that saves something. Moves are ranked by how
    many the row has had before, then by value; the first that save enough together are made. If
    all do not, rows are dropped, the worst value for what it costs first, until the rest fits or
    round(n * least_share) rows are left. Both are running sums over sorted groups; order must
    be unique in a group.
    """
    group = Window.partitionBy(*keys)
    lower = F.array(*(F.lit(x) for x in sorted(levels, reverse=True)))
    ladder = F.filter(lower, lambda x: x < F.col(budget))
    steps = F.transform(ladder, lambda x, i: F.struct(i.alias("turn"), (F.when(i == 0, F.col(budget)).otherwise(F.get(ladder, i - 1)) - x).alias("saves")))
    total = rows.withColumn("excess", F.sum(budget).over(group) - limit)
    moves = total.where("excess > 0").select(*keys, order, value, "excess", F.explode(steps).alias("move")).select(*keys, order, value, "excess", "move.*")
    before = F.sum("saves").over(group.orderBy("turn", value, order).rowsBetween(Window.unboundedPreceding, -1))
    made = moves.withColumn("before", F.coalesce(before, F.lit(0))).where("before < excess").groupBy(*keys, order).agg(F.sum("saves").alias("saved"))
    out = rows.join(made, [*keys, order], "left").withColumn("granted", (F.col(budget) - F.coalesce("saved", F.lit(0))).cast("int"))
    # what is still too much goes row by row
    paid = F.when(F.col("granted") > 0, F.col(value) / F.col("granted"))
    worst = group.orderBy(paid.asc_nulls_last(), order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("over", F.sum("granted").over(group) - limit).withColumn("spare", F.sum((F.col("granted") > 0).cast("int")).over(group) - F.bround(F.count("*").over(group) * F.lit(float(least_share))))
    goes = (F.col("granted") > 0) & (F.coalesce(F.sum("granted").over(worst), F.lit(0)) < F.col("over")) & (F.coalesce(F.count("*").over(worst), F.lit(0)) < F.col("spare"))
    out = out.withColumn("goes", goes).withColumn("granted", F.when(F.col("goes"), 0).otherwise(F.col("granted")).cast("int"))
    return out.withColumn("dropped", F.col("granted") == 0).select(*rows.columns, "granted", "dropped")


def select_and_budget(rows: DataFrame, key: str, value: str, m: int, mode: str = "fixed", fixed: int = 1024, limit: int | None = None, seed: int = 0, least_share: float = 0.2) -> DataFrame:
    """TOP-07: two-stage selection of m rows and their budgets, one for all or by quartile of the value, lowered to a limit if there is one."""
    if mode not in ("fixed", "adaptive"):
        raise ValueError(f"unknown budget mode: {mode}")
    some = two_stage(rows.select(key, value), key, value, m, seed).join(rows.select(key, value), key)
    out = some.withColumn("budget", F.lit(fixed)) if mode == "fixed" else budget_bands(some, value)
    if limit is None:
        return out.withColumn("granted", F.col("budget")).withColumn("dropped", F.lit(False))
    return enforce_budget(out.withColumn("all", F.lit(0)), ["all"], key, "budget", value, limit, least_share).drop("all")


def number(key: Column, seed: int) -> Column:
    """32 bits of the hash order."""
    return F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long")


def shard(rows: DataFrame, key: str, n: int, rank: int, seed: int = 0) -> DataFrame:
    """TOP-09: one of n disjoint shards that make up the whole."""
    return rows.where(F.pmod(number(F.col(key), seed), F.lit(n)) == rank)


def sampled_shard(rows: DataFrame, key: str, size: int, n: int, rank: int, seed: int = 0) -> DataFrame:
    """TOP-09: one of n shards of a seeded sample of `size` rows, whose sizes differ by one at most."""
    some = rows.withColumn("_h", seeded(F.col(key), seed)).orderBy("_h", key).limit(size)
    placed = some.withColumn("_p", F.row_number().over(Window.orderBy("_h", key)) - 1)  # the sample has `size` rows
    return placed.where(F.col("_p") % n == rank).drop("_h", "_p")


def sample_with_replacement(rows: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """TOP-10: draws of rows by hashed numbers of their positions in order of the key, from the whole of rows.

    Positions come from counts by range partition, so no sort meets in one task.
    """
    placed, n = positions(rows, key)
    if not n:
        return placed.withColumn("draw", F.lit(0).cast("long")).limit(0)
    d = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.pmod(number(F.col("id"), seed), F.lit(n)).alias("position"))
    return d.join(placed, "position")


def positions(rows: DataFrame, key: str | list[str]) -> tuple[DataFrame, int]:
    """rows with `position`, 0 to n - 1 in order of a unique key, and n."""
    key = [key] if isinstance(key, str) else key
    own = table(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "placed")
    counts = sorted((r["part"], r["n"]) for r in own.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    if not counts:
        return own.withColumn("position", F.lit(0).cast("long")).drop("part"), 0
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    before = rows.sparkSession.createDataFrame(starts, "part int, before long")
    within = Window.partitionBy("part").orderBy(*key)
    return own.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.row_number().over(within) - 1).drop("part", "before"), at


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-16: rows of new replace those of old with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-09."""
    return rows.join(done.select(*keys), keys, "left_anti")
