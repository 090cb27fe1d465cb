"""Distribution algebra, selection, joins, set operations and ordered state."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import dists as f
from calibrant.operators import relational, selection, state, stats, training
from calibrant.plans.views import DISTS, METRICS, dists, metrics, read
from calibrant.sources import files

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


D = f"WITH {DISTS}"
_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)


def both(s, d):
    x = dists(s, d)
    return x.select("vec_id", f.log_softmax(F.col("s_logits")).alias("s"), f.log_softmax(F.col("t_logits")).alias("t"))


def top(s, d, k=8):
    x = both(s, d)
    ss, tt = f.top_k(F.col("s"), k), f.top_k(F.col("t"), k)
    return x.select("vec_id", "s", "t", ss.alias("ss"), tt.alias("tt"))


add("arr01_log_softmax", lambda s, d: both(s, d).select("vec_id", F.posexplode("s").alias("i", "lp")).select("vec_id", "i", F.round("lp", 6).alias("lp")), D + " SELECT vec_id, i::INT AS i, round(s, 6) AS lp FROM st")
add("top02_top_k", lambda s, d: top(s, d).select("vec_id", F.posexplode("ss").alias("rank", "p")).select("vec_id", "rank", F.col("p.id").alias("id")), D + " SELECT vec_id, rs::INT AS rank, i::INT AS id FROM tk WHERE rs < 8")
add("top01_cache_build", lambda s, d: top(s, d).select("vec_id", F.explode(f.by_id("tt")).alias("p"), "s", "t").select("vec_id", F.col("p.id").alias("id"), F.round(F.element_at("t", F.col("p.id") + 1) - F.element_at("s", F.col("p.id") + 1), 6).alias("delta")),
    D + " SELECT vec_id, i::INT AS id, round(t - s, 6) AS delta FROM tk WHERE rt < 8")
add("top03_teacher_support_delta", lambda s, d: both(s, d).select("vec_id", F.explode(f.teacher_support_delta(F.col("t"), F.col("s"), 8)).alias("p")).select("vec_id", "p.id", F.round("p.v", 6).alias("delta")), D + " SELECT vec_id, i::INT AS id, round(t - s, 6) AS delta FROM tk WHERE rt < 8")


def found(s, d, k=8, fill=0.0):
    """Teacher values at the student's k likeliest tokens."""
    return f.look_up(top(s, d).select("vec_id", F.slice("ss.id", 1, k).alias("ids"), F.slice("tt", 1, k).alias("tt")), "ids", "tt", "found", fill)


add("join02_support_lookup", lambda s, d: found(s, d).select("vec_id", F.round(_sum(F.col("found")), 6).alias("total")), D + " SELECT vec_id, round(coalesce(sum(t) FILTER (rt < 8), 0), 6) AS total FROM tk WHERE rs < 8 GROUP BY vec_id")
add("join03_tail_lookup", lambda s, d: found(s, d, 8, f.TAIL).select("vec_id", F.round(_sum(F.col("found")), 6).alias("total")), D + " SELECT vec_id, round(sum(CASE WHEN rt < 8 THEN t ELSE -100 END), 6) AS total FROM tk WHERE rs < 8 GROUP BY vec_id")
add("join01_dense_lookup", lambda s, d: found(s, d).select("vec_id", F.round(_sum(f.scatter(F.col("ids"), F.col("found"), 64)), 6).alias("total")), D + " SELECT vec_id, round(coalesce(sum(t) FILTER (rt < 8), 0), 6) AS total FROM tk WHERE rs < 8 GROUP BY vec_id")
add("join04_truncated_lookup", lambda s, d: found(s, d, 4, f.TAIL).select("vec_id", F.round(_sum(F.col("found")), 6).alias("total")), D + " SELECT vec_id, round(sum(CASE WHEN rt < 4 THEN t ELSE -100 END), 6) AS total FROM tk WHERE rs < 4 GROUP BY vec_id")
add("join17_student_support_delta", lambda s, d: top(s, d).select("vec_id", F.round(_sum(F.zip_with(f.gather(F.slice("t", 1, 60), F.col("ss.id"), 0.0), f.gather(F.transform(F.slice("s", 1, 60), lambda x: x), F.col("ss.id"), 0.0), lambda a, b: a - b)), 6).alias("total")),
    D + " SELECT vec_id, round(sum(CASE WHEN i < 60 THEN t - s ELSE 0 END), 6) AS total FROM tk WHERE rs < 8 GROUP BY vec_id")
add("join18_chosen_gather", lambda s, d: both(s, d).select("vec_id", F.round(F.element_at("s", (F.col("vec_id") % 64 + 1).cast("int")), 6).alias("lp")), D + " SELECT vec_id, round(s, 6) AS lp FROM st WHERE i = vec_id % 64")
add("join12_hit_rate", lambda s, d: top(s, d).select("vec_id", F.round(F.size(F.array_intersect("ss.id", "tt.id")) / F.lit(8.0), 6).alias("rate")), D + " SELECT vec_id, round(count(*) FILTER (rt < 8) / 8e0, 6) AS rate FROM tk WHERE rs < 8 GROUP BY vec_id")
add("agg24_disagreement", lambda s, d: both(s, d).select("vec_id", F.round(f.disagreement(F.col("s"), F.col("t"), F.transform("s", lambda x, i: (i < 48).cast("double"))), 6).alias("d")), D + " SELECT vec_id, round(sum(abs(s - t)) FILTER (i < 48) / (48 + 1e-8), 6) AS d FROM st GROUP BY vec_id")
add("agg25_mean_disagreement", lambda s, d: both(s, d).agg(F.round(F.coalesce(F.avg(f.disagreement(F.col("s"), F.col("t"), F.transform("s", lambda x: F.lit(1.0)))), F.lit(0.0)), 6).alias("d")), D + " SELECT round(avg(d), 6) AS d FROM (SELECT sum(abs(s - t)) / (64 + 1e-8) AS d FROM st GROUP BY vec_id)")
_R = "least(greatest(s - t, -5), 5)"
add("agg26_policy_loss", lambda s, d: both(s, d).select("vec_id", F.round(f.pg_token(F.col("s"), F.col("t"), F.zip_with("t", "s", lambda a, b: a - b), delta_clip=2.0), 6).alias("pg")),
    D + f" SELECT vec_id, round(-sum(CASE WHEN t < -20 THEN 0 ELSE exp(t) * least(exp({_R}) * least(greatest(t - s, -2), 2), least(greatest(exp({_R}), 0.8::DOUBLE), 1.2::DOUBLE) * least(greatest(t - s, -2), 2)) END), 6) AS pg FROM st GROUP BY vec_id")
add("agg27_k3_dense", lambda s, d: both(s, d).select("vec_id", F.round(f.kl_k3(F.col("s"), F.col("t")), 6).alias("kl")), D + " SELECT vec_id, round(sum(exp(s) * (exp(t - s) - (t - s) - 1)), 6) AS kl FROM st GROUP BY vec_id")
add("agg28_k3_support", lambda s, d: top(s, d).select("vec_id", F.round(f.kl_k3_support(F.col("ss.v"), f.gather(F.col("t"), F.col("ss.id")), True), 6).alias("kl")), D + " SELECT vec_id, round(sum(exp(s) * (exp(t - s) - (t - s) - 1)) / (sum(exp(s)) + 1e-8), 6) AS kl FROM tk WHERE rs < 8 GROUP BY vec_id")
add("agg29_expected_reward", lambda s, d: both(s, d).select("vec_id", F.round(f.expected(F.col("s"), F.zip_with("t", "s", lambda a, b: a - b)), 6).alias("r")), D + " SELECT vec_id, round(sum(exp(s) * (t - s)), 6) AS r FROM st GROUP BY vec_id")


def slots(s, d):
    x = both(s, d).select("vec_id", f.top_k(F.col("t"), 32).alias("tt"), "s")
    x = x.select(F.col("vec_id").alias("pos"), F.posexplode("tt").alias("rank", "p"), "s")
    return x.select("pos", "rank", F.col("p.v").alias("rl"), (F.col("p.v") - F.element_at("s", F.col("p.id") + 1)).alias("delta"))


add("agg31_k_calibration", lambda s, d: (lambda r: r.select("k", *(F.round(c, 6).alias(c) for c in ("mass", "rho", "mae", "tail_mae"))))(stats.k_calibration(slots(s, d), [4, 8, 16, 32], 32)),
    D + """, sl AS (SELECT vec_id, rt, t, t - s AS y FROM tk WHERE rt < 32), ks AS (SELECT unnest([4, 8, 16, 32]) AS k), np AS (SELECT count(DISTINCT vec_id) AS np FROM sl),
x AS (SELECT k, np, np * 32e0 AS n, sum(CASE WHEN rt < k THEN exp(t) ELSE 0 END) AS m, sum(CASE WHEN rt < k THEN y ELSE 0 END) AS sx, sum(CASE WHEN rt < k THEN y * y ELSE 0 END) AS sxx, sum(y) AS sy, sum(y * y) AS syy, sum(CASE WHEN rt < k THEN 0 ELSE abs(y) END) AS e FROM sl, ks, np GROUP BY k, np)
SELECT k::INT AS k, round(m / np, 6) AS mass, round(CASE WHEN k >= 32 THEN 1 ELSE (n * sxx - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 6) AS rho, round(e / n, 6) AS mae, round(CASE WHEN k < 32 THEN e / (np * (32 - k)) END, 6) AS tail_mae FROM x""")  # fmt: skip


def delta_rows(s, d):
    x = both(s, d).select("vec_id", F.posexplode(F.zip_with("t", "s", lambda a, b: a - b)).alias("i", "delta"))
    return x.withColumn("part", F.when(F.col("i") / 63 < 0.25, "early").when(F.col("i") / 63 < 0.75, "mid").otherwise("late"))


_SIG = """count(x) AS n, round(avg((x > 0)::INT), 6) AS over_0, round(avg((x > 0.5)::INT), 6) AS over_0_5, round(avg((x > 1)::INT), 6) AS over_1, round(avg((abs(x) > 1)::INT), 6) AS clipped,
  round(avg(x), 6) + 0e0 AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90"""


def signal(s, d, keys):
    r = stats.signal_stats(delta_rows(s, d), "delta", keys)
    return r.select(*keys, "n", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in r.columns if c not in (*keys, "n")))


add("agg15_signal_stats", lambda s, d: signal(s, d, []), D + f" SELECT {_SIG} FROM (SELECT t - s AS x FROM st)")
add("agg16_signal_by_position", lambda s, d: signal(s, d, ["part"]), D + f" SELECT CASE WHEN i / 63e0 < 0.25 THEN 'early' WHEN i / 63e0 < 0.75 THEN 'mid' ELSE 'late' END AS part, {_SIG} FROM (SELECT i, t - s AS x FROM st) GROUP BY 1")
add("agg17_sequence_delta", lambda s, d: both(s, d).select("vec_id", stats.sequence_delta(F.col("t"), F.slice("s", 1, 50), F.lit(10)).alias("z")).select("vec_id", (F.round("z.delta_sum", 4) + F.lit(0.0)).alias("delta_sum"), (F.round("z.delta_mean", 4) + F.lit(0.0)).alias("delta_mean"), F.col("z.n_tokens").cast("long").alias("n_tokens")),
    D + " SELECT vec_id, round(round_even(sum(t - s), 6), 4) + 0e0 AS delta_sum, round(round_even(avg(t - s), 6), 4) + 0e0 AS delta_mean, count(*) AS n_tokens FROM st WHERE i >= 10 AND i < 50 GROUP BY vec_id")
add("agg40_verdict", lambda s, d: stats.signal_stats(delta_rows(s, d), "delta", ["part"]).select("part", stats.verdict(F.col("over_0"), F.col("clipped")).alias("verdict")), D + " SELECT part, CASE WHEN o >= 0.2 AND c < 0.5 THEN 'PASS' WHEN o >= 0.05 THEN 'BOUNDARY' ELSE 'FAIL' END AS verdict FROM (SELECT CASE WHEN i / 63e0 < 0.25 THEN 'early' WHEN i / 63e0 < 0.75 THEN 'mid' ELSE 'late' END AS part, avg((t > s)::INT) AS o, avg((abs(t - s) > 1)::INT) AS c FROM st GROUP BY 1)")

M = f"WITH {METRICS} "


def observations(s, d):
    return metrics(s, d).withColumn("dis", F.col("k") / 100)


_r4 = lambda df, *c: df.select(*[x for x in df.columns if x not in c], *(F.round(x, 4).alias(x) for x in c))
_r7 = lambda df, *c: df.select(*[x for x in df.columns if x not in c], *(F.round(x, 7).alias(x) for x in c))
_r6 = lambda df, *c: df.select(*[x for x in df.columns if x not in c], *(F.round(x, 6).alias(x) for x in c))
add("win05_prompt_state", lambda s, d: _r6(state.prompt_state(observations(s, d), "user_id", ["step"], "reward", "dis", length="k"), "reward_ema", "reward_var", "disagreement_ema"), f"WITH {METRICS}" + """
, o AS (SELECT user_id, list(reward ORDER BY step) AS r, list(k / 100e0 ORDER BY step) AS d, max(step) AS last, max_by(k, step) AS length FROM metrics GROUP BY user_id),
e AS (SELECT user_id, r, d, last, length, list_transform(range(1, len(r) + 1), lambda n: list_sum(list_transform(r[1:n], lambda x, j: 0.1::DOUBLE * x * pow(0.9::DOUBLE, n - j)))) AS e FROM o)
SELECT user_id, len(r)::INT AS seen, last, round(e[-1], 6) AS reward_ema, round(list_sum(list_transform(r, lambda x, j: 0.1::DOUBLE * abs(x - e[j]) * pow(0.9::DOUBLE, len(r) - j))), 6) AS reward_var,
  round(list_sum(list_transform(d, lambda x, j: 0.1::DOUBLE * x * pow(0.9::DOUBLE, len(d) - j))), 6) AS disagreement_ema, length::BIGINT AS length FROM e""")
add("win04_last_non_null", lambda s, d: metrics(s, d).groupBy("user_id").agg(F.max_by(F.when(F.col("k") % 2 == 0, F.col("k")), F.when(F.col("k") % 2 == 0, F.col("step"))).alias("last_k")), M + "SELECT user_id, max_by(k, step) FILTER (k % 2 = 0) AS last_k FROM metrics GROUP BY user_id")
add("win06_novelty", lambda s, d: metrics(s, d).groupBy("user_id").agg(F.round(1 / F.sqrt(1.0 + F.count("*")), 9).alias("novelty")), M + "SELECT user_id, round(1 / sqrt(1e0 + count(*)), 9) AS novelty FROM metrics GROUP BY user_id")
add("win07_budget_bands", lambda s, d: selection.budget_bands(metrics(s, d).select("step", "reward"), "reward").select("step", "budget"), M + "SELECT step, (CASE WHEN reward < q[1] THEN 256 WHEN reward < q[2] THEN 512 WHEN reward < q[3] THEN 1024 ELSE 2048 END)::INT AS budget FROM metrics, (SELECT quantile_cont(reward, [0.25, 0.5, 0.75]) AS q FROM metrics)")
add("win12_utility", lambda s, d: metrics(s, d).select("step", F.round(state.utility(F.col("k") / 100, F.col("reward"), F.col("step") - 5000), 6).alias("u")), M + "SELECT step, round(0.5::DOUBLE * (k / 100e0) + 0.3::DOUBLE * reward - 0.2::DOUBLE * greatest(step - 5000, 0), 6) AS u FROM metrics")
_RATIO = "alpha double"
_TURNS = f"WITH RECURSIVE {METRICS}, o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY step) AS n FROM metrics), "
add("win08_ratio_controller", lambda s, d: _r6(state.fold(observations(s, d).withColumn("saved", 1 + F.col("dis")), ["pool"], ["step"], lambda: state.ratio_controller(warmup=20), ["k", "reward", "dis", "saved"], _RATIO), "alpha"), _TURNS + """
r AS (SELECT pool, step, n, 0e0 AS a, 0e0 AS b, 0e0 AS c, 0e0 AS e, 0.3::DOUBLE AS alpha FROM o WHERE n = 1 UNION ALL
  SELECT pool, step, n, a, b, c, e, CASE WHEN n <= 20 THEN 0.3::DOUBLE ELSE least(0.5::DOUBLE, greatest(0.1::DOUBLE, least(alpha + 0.05::DOUBLE, greatest(alpha - 0.05::DOUBLE,
    least(0.5::DOUBLE, greatest(0.1::DOUBLE, 0.3::DOUBLE + 0.1::DOUBLE * (a / (1 + abs(a)) - b / (1 + abs(b)) + c / (1 + abs(c)) + e / (1 + abs(e))))))))) END
  FROM (SELECT o.pool, o.step, o.n, r.alpha, CASE WHEN o.n > 20 THEN 0.9::DOUBLE * a + 0.1::DOUBLE * k ELSE 0 END AS a, CASE WHEN o.n > 20 THEN 0.9::DOUBLE * b + 0.1::DOUBLE * reward ELSE 0 END AS b,
    CASE WHEN o.n > 20 THEN 0.9::DOUBLE * c + 0.1::DOUBLE * k / 100 ELSE 0 END AS c, CASE WHEN o.n > 20 THEN 0.9::DOUBLE * e + 0.1::DOUBLE * k / 100 ELSE 0 END AS e FROM r JOIN o ON o.pool = r.pool AND o.n = r.n + 1) x)
SELECT pool, step, round(alpha, 6) AS alpha FROM r""")
add("win09_kl_coefficient", lambda s, d: _r7(state.fold(observations(s, d).withColumn("sign", F.col("k") - 50), ["pool"], ["step"], state.kl_coefficient, ["sign"], _RATIO), "alpha"), _TURNS + """
r AS (SELECT pool, step, n, least(2.5::DOUBLE, greatest(0.5::DOUBLE, 1 + 0.01::DOUBLE * sign(k - 50))) AS alpha FROM o WHERE n = 1 UNION ALL
  SELECT o.pool, o.step, o.n, least(2.5::DOUBLE, greatest(0.5::DOUBLE, alpha * (1 + 0.01::DOUBLE * sign(k - 50)))) FROM r JOIN o ON o.pool = r.pool AND o.n = r.n + 1)
SELECT pool, step, round(alpha, 7) AS alpha FROM r""")
_LIM = {"hit_rate": (0.9, 0.2), "refresh_age_p95": (60.0, 95.0)}


def _health(s, d):
    status, reason = state.health({"hit_rate": 1 - F.col("dis") / 2, "refresh_age_p95": F.col("k")}, _LIM)
    rows = observations(s, d).withColumn("status", status).withColumn("reason", reason)
    counts = state.fold(rows, ["pool"], ["step"], state.alert_count, ["step", "status"], "record_count int")
    return rows.select("pool", "step", "status", "reason").join(counts, ["pool", "step"])


add("win10_health_status", _health, _TURNS + """
h AS (SELECT pool, step, n, CASE WHEN 1 - k / 200e0 < 0.2 OR k > 95 THEN 'CRITICAL' WHEN 1 - k / 200e0 < 0.9 OR k > 60 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
  CASE WHEN k > 95 THEN 'refresh_age_p95 critical (' || k || ')' WHEN 1 - k / 200e0 < 0.9 OR k > 60 THEN 'unknown' ELSE '' END AS reason FROM o),
r AS (SELECT pool, step, n, status, reason, step AS mark, 1 AS record_count FROM h WHERE n = 1 UNION ALL
  SELECT h.pool, h.step, h.n, h.status, h.reason, CASE WHEN h.status <> 'HEALTHY' AND h.status = r.status AND h.step - r.mark < 10 THEN r.mark ELSE h.step END,
    record_count + (NOT (h.status <> 'HEALTHY' AND h.status = r.status AND h.step - r.mark < 10))::INT FROM r JOIN h ON h.pool = r.pool AND h.n = r.n + 1)
SELECT pool, step, status, reason, record_count FROM r""")
add("win11_ring_buffer", lambda s, d: state.fold(observations(s, d).withColumn("item", F.col("step")), ["pool"], ["step"], lambda: state.RingBuffer(32), ["item", "reward"], "slot int, evicted long, protected boolean"))
_KIND = lambda: F.when(F.col("k") % 3 == 0, "advance").when(F.col("k") % 3 == 1, "put").otherwise("get")
add("stm01_stale_queue", lambda s, d: state.fold(metrics(s, d).withColumn("kind", _KIND()).withColumn("version", (F.col("step") / 40).cast("int")), ["user_id"], ["step"], lambda: state.StaleQueue(3), ["kind", "version"], "result string, age double, rejected int"))
add("agg36_ids_by_budget", lambda s, d: relational.ids_by(metrics(s, d).withColumn("budget", F.col("k") % 4), "budget", "step"), M + "SELECT k % 4 AS budget, step, row_number() OVER (PARTITION BY k % 4 ORDER BY step) - 1 AS place, count(*) OVER (PARTITION BY k % 4) AS n FROM metrics")


def values(s, d):
    p = state.prompt_state(observations(s, d), "user_id", ["step"], "reward", "dis")
    return p.withColumn("value", selection.prompt_value(F.col("reward_var"), F.col("disagreement_ema"), F.col("seen")))


add("top05_prompt_value", lambda s, d: observations(s, d).groupBy("user_id").agg(F.round(selection.prompt_value(F.stddev_pop("reward"), F.avg("dis"), F.count("*")), 6).alias("value")), M + "SELECT user_id, round(0.4::DOUBLE * stddev_pop(reward) + 0.4::DOUBLE * avg(k / 100e0) + 0.2::DOUBLE / sqrt(1e0 + count(*)), 6) AS value FROM metrics GROUP BY user_id")
add("top04_two_stage", lambda s, d: selection.two_stage(metrics(s, d).select("step", "k"), "step", "k", 50), f"WITH {METRICS}" + ", p AS (SELECT step, k, md5(step::VARCHAR || ':0') AS h FROM metrics ORDER BY h LIMIT 200), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, h) AS v FROM p) SELECT step, 'high' AS kind FROM r WHERE v <= 40 UNION ALL SELECT step, 'coverage' FROM (SELECT * FROM r WHERE v > 40 ORDER BY h LIMIT 10)")


def _selected(s, d, m, seen):
    users = metrics(s, d).groupBy("user_id").agg(F.count("*").alias("seen"), F.sum("k").alias("total"))
    return selection.select(users.withColumn("seen", F.col("seen") * seen), "user_id", "total", "seen", m, share=2.5 / m)


_POOL = f"""WITH {METRICS}, us AS (SELECT user_id, sum(k) AS total, md5(user_id::VARCHAR || ':0') AS h FROM metrics GROUP BY user_id), cn AS (SELECT count(*) AS n FROM us),
pl AS (SELECT * FROM us QUALIFY row_number() OVER (ORDER BY h) <= 4 * {{m}}), rk AS (SELECT *, row_number() OVER (ORDER BY total DESC, h) AS r FROM pl),
hi AS (SELECT *, 0 AS g FROM rk WHERE r <= round_even({{m}} * 0.8, 0)), co AS (SELECT *, 1 AS g FROM rk WHERE r > round_even({{m}} * 0.8, 0) QUALIFY row_number() OVER (ORDER BY h) <= {{m}} - round_even({{m}} * 0.8, 0)),
ch AS (SELECT user_id, h, g FROM hi UNION ALL SELECT user_id, h, g FROM co), ag AS (SELECT user_id, h, 2 AS g FROM hi QUALIFY row_number() OVER (ORDER BY h) <= {{m}} - (SELECT count(*) FROM ch)),
pk AS (SELECT * FROM ch UNION ALL SELECT * FROM ag), po AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place FROM us),
pa AS (SELECT i + (SELECT count(*) FROM pk) AS pick, (('0x' || substr(md5(i::VARCHAR || ':1'), 1, 8))::BIGINT % (SELECT n FROM cn)) AS place FROM range({{m}}) r(i) WHERE i < {{m}} - (SELECT count(*) FROM pk))
SELECT row_number() OVER (ORDER BY g, h) - 1 AS pick, user_id, CASE g WHEN 0 THEN 'high' WHEN 1 THEN 'coverage' ELSE 'again' END AS kind FROM pk UNION ALL SELECT pick, user_id, 'pad' FROM pa JOIN po USING (place)"""
add("top04_select", lambda s, d: _selected(s, d, 10, 1), _POOL.format(m=10))
add("top04_cold_start", lambda s, d: _selected(s, d, 40, 0),
    f"WITH {METRICS}, po AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM metrics)), dr AS (SELECT i AS pick, ('0x' || substr(md5(i::VARCHAR || ':0'), 1, 8))::BIGINT AS x FROM range(40) r(i)) SELECT pick, user_id, 'cold' AS kind FROM dr, (SELECT any_value(n) AS n FROM po) c JOIN po ON place = x % c.n")
_B = "(256 * pow(2, k % 4))::INT"
_ENFORCE = """, u AS (SELECT *, sum(budget) OVER (PARTITION BY g) - {limit} AS excess FROM b),
mv AS (SELECT g, step, v, excess, t AS turn, greatest(budget / pow(2, t), 256) - greatest(budget / pow(2, t + 1), 256) AS saves FROM u, range(3) r(t) WHERE excess > 0 AND budget / pow(2, t + 1) >= 256),
md AS (SELECT g, step, sum(saves) AS saved FROM (SELECT *, coalesce(sum(saves) OVER (PARTITION BY g ORDER BY turn, v, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mv) WHERE before < excess GROUP BY g, step),
gr AS (SELECT b.*, (budget - coalesce(saved, 0))::INT AS granted FROM b LEFT JOIN md USING (g, step)),
ov AS (SELECT *, sum(granted) OVER (PARTITION BY g) - {limit} AS over, count(*) OVER (PARTITION BY g) - round_even(count(*) OVER (PARTITION BY g) * {share}, 0) AS spare,
  coalesce(sum(granted) OVER w, 0) AS cost, coalesce(count(*) OVER w, 0) AS ahead FROM gr WINDOW w AS (PARTITION BY g ORDER BY v / granted, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
done AS (SELECT *, cost < over AND ahead < spare AS dropped FROM ov)"""
add("top06_enforce_budget", lambda s, d: selection.enforce_budget(metrics(s, d).select("user_id", "step", (F.lit(256) * F.pow(F.lit(2), F.col("k") % 4)).cast("int").alias("budget"), "reward"), ["user_id"], "step", "budget", "reward", 20000, 0.2),
    M + f", b AS (SELECT user_id AS g, step, {_B} AS budget, reward AS v FROM metrics)" + _ENFORCE.format(limit=20000, share=0.2) + " SELECT g AS user_id, step, budget, v AS reward, CASE WHEN dropped THEN 0 ELSE granted END AS granted, dropped FROM done")
_PICKED = f"WITH {METRICS}" + ", p AS (SELECT step, k, md5(step::VARCHAR || ':0') AS h FROM metrics ORDER BY h LIMIT 200), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, h) AS v FROM p), pk AS (SELECT step, k, 'high' AS kind FROM r WHERE v <= 40 UNION ALL SELECT step, k, 'coverage' FROM (SELECT * FROM r WHERE v > 40 ORDER BY h LIMIT 10))"
add("top07_select_and_budget", lambda s, d: selection.select_and_budget(metrics(s, d), "step", "k", 50, "adaptive", limit=20000).select("step", "kind", "budget", "granted", "dropped"),
    _PICKED + ", q AS (SELECT quantile_cont(k, [0.25, 0.5, 0.75]) AS q FROM pk), b AS (SELECT 0 AS g, step, kind, k AS v, (CASE WHEN k < q[1] THEN 256 WHEN k < q[2] THEN 512 WHEN k < q[3] THEN 1024 ELSE 2048 END)::INT AS budget FROM pk, q)" + _ENFORCE.format(limit=20000, share=0.2) + " SELECT step, kind, budget, CASE WHEN dropped THEN 0 ELSE granted END AS granted, dropped FROM done")
add("top07_fixed_budget", lambda s, d: selection.select_and_budget(metrics(s, d), "step", "k", 50, "fixed").select("step", "kind", "budget", "granted", "dropped"), _PICKED + " SELECT step, kind, 1024::INT AS budget, 1024::INT AS granted, false AS dropped FROM pk")
add("top08_head_limit", lambda s, d: read(s, d, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
add("top09_shard", lambda s, d: functools.reduce(DataFrame.unionByName, (selection.shard(read(s, d, "customer").select("c_custkey"), "c_custkey", 3, k).withColumn("rank", F.lit(k)) for k in range(3))),
    "SELECT c_custkey, (('0x' || substr(md5(c_custkey::VARCHAR || ':0'), 1, 8))::BIGINT % 3)::INT AS rank FROM customer")
add("top09_sampled_shard", lambda s, d: functools.reduce(DataFrame.unionByName, (selection.sampled_shard(read(s, d, "customer").select("c_custkey"), "c_custkey", 100, 3, k).withColumn("rank", F.lit(k)) for k in range(3))),
    "SELECT c_custkey, ((row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':0'), c_custkey) - 1) % 3)::INT AS rank FROM customer ORDER BY md5(c_custkey::VARCHAR || ':0'), c_custkey LIMIT 100")
_DRAW = "(('0x' || substr(md5(i::VARCHAR || ':0'), 1, 8))::BIGINT % (SELECT count(*) FROM {t}))"
add("top10_with_replacement", lambda s, d: selection.sample_with_replacement(read(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 400).select("draw", "position", "c_name"),
    "WITH p AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) SELECT i AS draw, position, c_name FROM range(400) r(i) JOIN p ON position = " + _DRAW.format(t="customer"))
add("top10_positions", lambda s, d: selection.positions(read(s, d, "customer").select("c_custkey", "c_name"), "c_custkey")[0], "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
add("top11_ordered_results", lambda s, d: read(s, d, "nation").orderBy("n_regionkey", "n_name").select("n_regionkey", "n_name"), "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2")
add("set01_intersect", lambda s, d: read(s, d, "documents").select("doc_id").intersect(read(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
add("set02_except", lambda s, d: read(s, d, "documents").select("doc_id").join(read(s, d, "labels").select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
add("set03_union_keys", lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("set05_replicate", lambda s, d: read(s, d, "nation").select("n_nationkey").crossJoin(s.range(4).select(F.col("id").alias("iteration"))), "SELECT n_nationkey, iteration FROM nation, range(4) r(iteration)")
add("set06_concat", lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(read(s, d, "supplier").select(F.col("s_suppkey").alias("k"))), "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
add("join05_three_way", lambda s, d: relational.three_way(read(s, d, "documents").select("doc_id", "lang"), read(s, d, "labels"), read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id"), "SELECT doc_id, lang, quality, toxic, label FROM documents JOIN labels USING (doc_id) JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id)")
add("join08_after_minus_before", lambda s, d: _r4(relational.after_minus_before(read(s, d, "orders"), ["o_custkey"], "o_orderstatus", "P", "F", "o_totalprice"), "before", "after", "gain"),
    "SELECT o_custkey, round(b, 4) AS before, round(a, 4) AS after, round(a - b, 4) AS gain FROM (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS b, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a FROM orders GROUP BY 1)")
add("join09_todo", lambda s, d: selection.todo(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("join10_positional_zip", lambda s, d: relational.zip_samples(read(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", read(s, d, "customer").select("c_custkey"), "c_custkey", 4).select("problem", "sample_idx", "s_name", "c_custkey"),
    "SELECT p AS problem, (o % 4)::INT AS sample_idx, s_name, c_custkey FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o FROM customer) ON p = o // 4")
add("join11_length_match", lambda s, d: read(s, d, "documents").select("doc_id", F.length("text").alias("a"), "n_chars").agg(F.round(F.avg((F.col("a") == F.col("n_chars")).cast("int")), 6).alias("rate")).withColumn("ok", F.col("rate") >= 0.9), "SELECT round(avg((length(text) = n_chars)::INT), 6) AS rate, round(avg((length(text) = n_chars)::INT), 6) >= 0.9 AS ok FROM documents")
add("join13_scatter_back", lambda s, d: (lambda m: m.join(m.groupBy((F.col("k") % 4).alias("b")).agg(F.count("*").alias("n")), F.col("k") % 4 == F.col("b")).select("step", "n"))(metrics(s, d)), M + "SELECT step, n FROM metrics JOIN (SELECT k % 4 AS b, count(*) AS n FROM metrics GROUP BY 1) ON k % 4 = b")
add("join15_matrix", lambda s, d: read(s, d, "region").select("r_name").crossJoin(read(s, d, "nation").select("n_name")).crossJoin(s.range(3).select((F.col("id") * 512).alias("budget"))), "SELECT r_name, n_name, b * 512 AS budget FROM region, nation, range(3) r(b)")
add("src16_upsert", lambda s, d: selection.upsert(read(s, d, "orders").select("o_orderkey", F.lit("old").alias("v")), read(s, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("new").alias("v")), ["o_orderkey"]), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS v FROM orders")
add("src13_truncate_at_step", lambda s, d: (lambda m: files.truncate_at(m.select("step", "reward"), (m.agg(F.max("step")).first()[0] or 0) * 3 // 4))(metrics(s, d)), M + "SELECT step, reward FROM metrics WHERE step < (SELECT max(step) * 3 // 4 FROM metrics)")


def _steps(x, keys):
    return _r6(training.step_metrics(x, keys, F.col("s"), F.col("t"), F.zip_with("t", "s", lambda a, b: a - b), F.col("t"), delta_clip=2.0), "pg_loss", "kl_loss", "reward", "adv_mean", "loss")


_STEP = f""", v AS (SELECT vec_id, -sum(CASE WHEN t < -20 THEN 0 ELSE exp(t) * least(exp({_R}) * least(greatest(t - s, -2), 2), least(greatest(exp({_R}), 0.8::DOUBLE), 1.2::DOUBLE) * least(greatest(t - s, -2), 2)) END) AS pg,
  sum(exp(s) * (exp(t - s) - (t - s) - 1)) AS kl, sum(exp(s) * (t - s)) AS r, avg(t - s) AS adv FROM st GROUP BY vec_id)"""
_MEANS = "count(*) AS batch, round(avg(pg), 6) AS pg_loss, round(avg(kl), 6) AS kl_loss, round(avg(r), 6) AS reward, round(avg(adv), 6) AS adv_mean, round(avg(pg) + 0.1::DOUBLE * avg(kl), 6) AS loss"
add("stm10_base_step", lambda s, d: _steps(both(s, d).withColumn("step", (F.col("vec_id") % 8).cast("int")), ["step"]), D + _STEP + f" SELECT (vec_id % 8)::INT AS step, {_MEANS} FROM v GROUP BY 1")
add("stm09_refresh_step", lambda s, d: _steps(training.refresh_batches(both(s, d), "vec_id", 5, 32), ["step"]),
    D + _STEP + ", p AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM v) SELECT (i // 32)::INT AS step, " + _MEANS + " FROM range(160) r(i) JOIN p ON position = " + _DRAW.format(t="v") + " GROUP BY 1")
