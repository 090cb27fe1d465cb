"""Evaluation and rank-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.functions import rationals
from calibrant.operators import curves, evaluation, stats
from calibrant.plans.views import CURVE, GENERATIONS, GRADED, METRICS, curve, generations, graded, metrics

K = ["label", "budget"]
QUERIES, ORACLE = {}, {}


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


_BOTH = f"WITH {GENERATIONS}"
add("agg01_pass_at_1", lambda s, d: rounded(evaluation.pass_at_1(generations(s, d), K), "pass_at_1"), _BOTH + """
SELECT label, budget, count(*) AS n, round(avg(r::INT), 6) AS pass_at_1 FROM (SELECT label, budget, problem_id, bool_or(correct) AS r FROM gen GROUP BY ALL) GROUP BY label, budget""")
add("agg02_ave_at_n", lambda s, d: rounded(evaluation.ave_at_n(generations(s, d), K), "ave_at_n"), _BOTH + """
SELECT label, budget, round(avg(r), 6) AS ave_at_n FROM (SELECT label, budget, problem_id, avg(correct::INT) AS r FROM gen GROUP BY ALL) GROUP BY label, budget""")
_MAJ = """, c AS (SELECT label, budget, problem_id, answer, CASE WHEN answer IS NULL THEN 0 ELSE count(*) END AS c, min(sample_idx) AS f FROM gen GROUP BY label, budget, problem_id, answer),
v AS (SELECT label, budget, problem_id, answer AS majority, c AS votes FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, f) AS r FROM c) WHERE r = 1)"""
add("agg03_majority", lambda s, d: evaluation.majority(generations(s, d), [*K, "problem_id"]), _BOTH + _MAJ + " SELECT * FROM v")
add("agg04_problem_results", lambda s, d: rounded(evaluation.problem_results(generations(s, d), K), "accuracy", "eos_rate", "no_answer_rate", "avg_tokens").drop("budget_stop_rate", "metric"), _BOTH + _MAJ + """
, a AS (SELECT v.label, v.budget, count(*) AS n, round(avg(coalesce(majority = problem_id % 4, false)::INT), 6) AS accuracy FROM v GROUP BY ALL),
z AS (SELECT label, budget, round(avg((status = 'eos')::INT), 6) AS eos_rate, round(avg((answer IS NULL)::INT), 6) AS no_answer_rate, round(avg(tokens), 6) AS avg_tokens FROM gen WHERE sample_idx = 0 GROUP BY ALL)
SELECT * FROM a JOIN z USING (label, budget)""")
_ZERO = """z AS (SELECT label, budget, round(avg((status = 'eos')::INT), 6) AS eos_rate, round(avg((status <> 'eos')::INT), 6) AS budget_stop_rate, round(avg((answer IS NULL)::INT), 6) AS no_answer_rate, round(avg(tokens), 6) AS avg_tokens FROM gen WHERE sample_idx = 0 GROUP BY ALL)"""
_RATES = ("accuracy", "eos_rate", "budget_stop_rate", "no_answer_rate", "avg_tokens")
add("agg04_ave", lambda s, d: rounded(evaluation.problem_results(generations(s, d), K, "ave"), *_RATES), _BOTH + f", {_ZERO}, a AS (SELECT label, budget, count(*) AS n, round(avg(r), 6) AS accuracy FROM (SELECT label, budget, problem_id, avg(correct::INT) AS r FROM gen GROUP BY ALL) GROUP BY ALL) SELECT *, 'ave' AS metric FROM a JOIN z USING (label, budget)")
add("agg04_single", lambda s, d: rounded(evaluation.problem_results(generations(s, d), K, "single"), *_RATES), _BOTH + f", {_ZERO}, a AS (SELECT label, budget, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM gen WHERE sample_idx = 0 GROUP BY ALL) SELECT *, 'single' AS metric FROM a JOIN z USING (label, budget)")


def _written(n, form):
    """A whole number in one of six forms: plain, decimal, fraction, ratio, in dollars, wrapped."""
    text = n.cast("string")
    two, three = (n * 2).cast("string"), (n * -3).cast("string")
    forms = [text, F.concat(text, F.lit(".0")), F.concat(F.lit("\\frac{"), two, F.lit("}{2}")), F.concat(three, F.lit("/-3")), F.concat(F.lit("$"), text, F.lit("$")), F.concat(F.lit("\\text{"), text, F.lit(".00}"))]
    return F.get(F.array(*forms), form)


def texts(s, d):
    """Generations whose answers and truths are texts, in forms that depend on the row."""
    g = generations(s, d)
    return g.withColumn("answer", _written(F.col("answer") * 1000, (F.col("tokens") % 6).cast("int"))).withColumn("ground_truth", _written(F.col("ground_truth") * 1000, (F.col("problem_id") % 6).cast("int")))


_FORMS = """CASE tokens % 6 WHEN 0 THEN n::VARCHAR WHEN 1 THEN n || '.0' WHEN 2 THEN '\\frac{' || 2 * n || '}{2}' WHEN 3 THEN (-3 * n) || '/-3' WHEN 4 THEN '$' || n || '$' ELSE '\\text{' || n || '.00}' END"""
add("agg04_graded_majority", lambda s, d: rounded(evaluation.problem_results(texts(s, d), K, "majority", rationals.equal), *_RATES), _BOTH + f""", w AS (SELECT *, {_FORMS} AS said FROM (SELECT *, answer * 1000 AS n FROM gen)),
c AS (SELECT label, budget, problem_id, said, any_value(answer) AS number, CASE WHEN said IS NULL THEN 0 ELSE count(*) END AS c, min(sample_idx) AS f FROM w GROUP BY label, budget, problem_id, said),
v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, f) = 1), {_ZERO},
a AS (SELECT label, budget, count(*) AS n, round(avg(coalesce(number = problem_id % 4, false)::INT), 6) AS accuracy FROM v GROUP BY ALL) SELECT *, 'majority' AS metric FROM a JOIN z USING (label, budget)""")
add("agg04_voted_rows", lambda s, d: evaluation.voted(texts(s, d), K, rationals.equal).select("label", "budget", "problem_id", "sample_idx", "majority_answer", "majority_correct"), _BOTH + f""", w AS (SELECT *, {_FORMS} AS said FROM (SELECT *, answer * 1000 AS n FROM gen)),
c AS (SELECT problem_id, said, any_value(answer) AS number, CASE WHEN said IS NULL THEN 0 ELSE count(*) END AS c, min(sample_idx) AS f FROM w GROUP BY problem_id, said),
v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY c DESC, f) = 1)
SELECT label, budget, problem_id, sample_idx, v.said AS majority_answer, coalesce(number = problem_id % 4, false) AS majority_correct FROM gen JOIN v USING (problem_id)""")
_SAMPLE = """count(*) AS n, round(avg(correct::INT), 6) AS accuracy,
  round(sum((answer IS NULL AND prefix_correct)::INT) / nullif(sum((answer IS NULL)::INT), 0)::DOUBLE, 6) AS prefix_accuracy, round(avg((answer IS NULL)::INT), 6) AS no_answer_rate,
  round(avg((status = 'eos')::INT), 6) AS eos_rate, round(avg((status = 'budget_stop')::INT), 6) AS budget_stop_rate, round(avg(tokens), 6) AS avg_reasoning_tokens"""
_SC = ("accuracy", "prefix_accuracy", "no_answer_rate", "eos_rate", "budget_stop_rate", "avg_reasoning_tokens")
add("agg05_sample_results", lambda s, d: rounded(evaluation.sample_results(generations(s, d), K), *_SC), _BOTH + f" SELECT label, budget, {_SAMPLE} FROM gen GROUP BY label, budget")
add("agg06_length_stats", lambda s, d: rounded(evaluation.length_stats(generations(s, d), K), "mean", "p50", "p90", "p95", "eos_rate", "over_2048", "over_4096", "at_cap", "tokens_per_s", "samples_per_s"), _BOTH + """
, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label, budget ORDER BY tokens) AS r, count(*) OVER (PARTITION BY label, budget) AS c FROM gen),
q AS MATERIALIZED (SELECT label, budget, p, greatest(least(floor(p * (max(c) + 1)), max(c) - 1), 1) AS k, p * (max(c) + 1) AS x FROM o, (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) t(p) GROUP BY label, budget, p),
e AS MATERIALIZED (SELECT q.label, q.budget, p, lo.tokens + (hi.tokens - lo.tokens) * (x - k) AS v FROM q JOIN o lo ON lo.label = q.label AND lo.budget = q.budget AND lo.r = k JOIN o hi ON hi.label = q.label AND hi.budget = q.budget AND hi.r = k + 1)
SELECT label, budget, count(*) AS n, sum(tokens)::BIGINT AS total, round(avg(tokens), 6) AS mean, round(quantile_cont(tokens, 0.5), 6) AS p50, max(tokens) AS longest,
  round(avg((status = 'eos')::INT), 6) AS eos_rate, round(avg((tokens > 2048)::INT), 6) AS over_2048, round(avg((tokens > 4096)::INT), 6) AS over_4096, round(avg((tokens = 8192)::INT), 6) AS at_cap,
  round(sum(tokens) / sum(wall_s)::DOUBLE, 6) AS tokens_per_s, round(count(*) / sum(wall_s)::DOUBLE, 6) AS samples_per_s,
  round(any_value(a.v), 6) AS p90, round(any_value(b.v), 6) AS p95
FROM gen JOIN (SELECT * FROM e WHERE p = 0.9) a USING (label, budget) JOIN (SELECT * FROM e WHERE p = 0.95) b USING (label, budget) GROUP BY label, budget""")


def _efficiency(s, d):
    g = generations(s, d)
    n = lambda x: F.count_if(F.col("status") == x)
    c = g.groupBy(*K).agg(F.count("*").alias("n_total"), n("eos").alias("n_eos"), n("budget_stop").alias("n_budget"), n("loop").alias("n_loop"), F.count_if("correct").alias("n_appended"), F.sum("tokens").alias("generated_tokens"),
                          F.sum(F.when(F.col("status") != "loop", F.col("tokens")).otherwise(0)).alias("valid_tokens"), F.sum("wall_s").alias("wall_s"), F.sum(F.col("budget") * 20).alias("budget_tokens"))
    out = evaluation.efficiency(c).select(*K, "utilisation", "truncation_rate", "loop_rate", "eos_rate", "accuracy_proxy", "raw_tok_per_s", "valid_tok_per_s", "useful_per_token")
    return rounded(out, *out.columns[2:], digits=9)


add("agg07_efficiency", _efficiency, _BOTH + """
, c AS (SELECT label, budget, count(*)::DOUBLE AS n, sum((status='eos')::INT) AS e, sum((status='budget_stop')::INT) AS b, sum((status='loop')::INT) AS l, sum(correct::INT) AS a, sum(tokens)::DOUBLE AS g, sum(CASE WHEN status <> 'loop' THEN tokens ELSE 0 END)::DOUBLE AS v, sum(wall_s)::DOUBLE AS w, sum(budget * 20)::DOUBLE AS bt FROM gen GROUP BY label, budget)
SELECT label, budget, round(least(1, g / bt), 9) AS utilisation, round(b / n, 9) AS truncation_rate, round(l / n, 9) AS loop_rate, round(e / n, 9) AS eos_rate, round(a / n, 9) AS accuracy_proxy, round(g / w, 9) AS raw_tok_per_s, round(v / w, 9) AS valid_tok_per_s, round(a / v, 9) AS useful_per_token FROM c""")
add("agg08_status_counts", lambda s, d: evaluation.status_counts(generations(s, d), K), _BOTH + """
SELECT label, budget, count(*) AS n_total, count(*) FILTER (status='eos') AS n_eos, count(*) FILTER (status='budget_stop') AS n_budget_stop, count(*) FILTER (status='loop') AS n_loop, 0::BIGINT AS n_invalid, 0::BIGINT AS n_empty,
  sum(CASE WHEN status='loop' THEN 0 ELSE tokens END)::BIGINT AS valid_tokens, 2 * sum(CASE WHEN status='loop' THEN 0 ELSE tokens END)::BIGINT AS teacher_tokens FROM gen GROUP BY label, budget""")
_M = f"WITH {METRICS} "
add("agg09_mean_and_last", lambda s, d: rounded(metrics(s, d).agg(F.avg("reward").alias("reward_mean"), F.max_by("reward", "step").alias("reward_last"), F.avg("k").alias("k_mean"), F.max_by("k", "step").alias("k_last")), "reward_mean", "k_mean"),
    _M + "SELECT round(avg(reward), 6) AS reward_mean, max_by(reward, step) AS reward_last, round(avg(k), 6) AS k_mean, max_by(k, step) AS k_last FROM metrics")
_having = lambda: F.when(F.col("pool") == "purchase", F.col("reward"))
add("agg10_mean_where_present", lambda s, d: rounded(metrics(s, d).groupBy("user_id").agg(F.avg(_having()).alias("mean"), F.max_by(_having(), F.when(_having().isNotNull(), F.col("step"))).alias("last")), "mean"),
    _M + "SELECT user_id, round(avg(reward) FILTER (pool = 'purchase'), 6) AS mean, max_by(reward, step) FILTER (pool = 'purchase') AS last FROM metrics GROUP BY user_id")
add("agg11_mean_missing_zero", lambda s, d: rounded(metrics(s, d).groupBy("user_id").agg(F.avg(F.coalesce(_having(), F.lit(0.0))).alias("mean")), "mean"),
    _M + "SELECT user_id, round(avg(CASE WHEN pool = 'purchase' THEN reward ELSE 0 END), 6) AS mean FROM metrics GROUP BY user_id")
add("agg12_performance_summary", lambda s, d: rounded(metrics(s, d).groupBy("pool").agg(F.coalesce(F.avg("reward"), F.lit(0.0)).alias("performance"), F.sum("k").alias("rollout_tokens"), F.coalesce(F.try_divide(F.avg("reward"), F.sum("k")), F.lit(0.0)).alias("eff")), "performance", "eff", digits=9),
    _M + "SELECT pool, round(coalesce(avg(reward), 0), 9) AS performance, sum(k)::BIGINT AS rollout_tokens, round(coalesce(avg(reward) / sum(k), 0), 9) AS eff FROM metrics GROUP BY pool")
_phase = lambda: F.when(F.col("pool") == "view", " Base ").when(F.col("pool") == "click", "refresh").otherwise(F.col("pool"))
add("agg13_pool_share", lambda s, d: evaluation.pool_share(metrics(s, d).withColumn("pool", _phase())),
    _M + "SELECT count(*) AS n, round_even(avg((pool = 'view')::INT), 4) AS base, round_even(avg((pool = 'click')::INT), 4) AS refresh, round_even(avg((pool NOT IN ('view', 'click'))::INT), 4) AS other, NULL::VARCHAR AS note FROM metrics")
add("agg13_no_phase", lambda s, d: evaluation.pool_share(metrics(s, d).drop("pool")), _M + "SELECT count(*) AS n, NULL::DOUBLE AS base, NULL::DOUBLE AS refresh, NULL::DOUBLE AS other, 'no phase column' AS note FROM metrics")
add("agg14_accuracy_percent", lambda s, d: rounded(generations(s, d).groupBy("label").agg((100 * F.avg(F.coalesce("correct", F.lit(False)).cast("int"))).alias("accuracy")), "accuracy"), _BOTH + "SELECT label, round(100 * avg(correct::INT), 6) AS accuracy FROM gen GROUP BY label")

_G = f"WITH {GRADED}"
_RANKS = ", r AS (SELECT *, correct::INT AS hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rs, rank() OVER (ORDER BY correct) + (count(*) OVER (PARTITION BY correct) - 1) / 2e0 AS rc FROM graded)"
_AUC = "(sum(CASE WHEN correct THEN rs ELSE 0 END) - sum(hit) * (sum(hit) + 1) / 2e0) / (sum(hit) * (count(*) - sum(hit)))"
add("win01_average_ranks", lambda s, d: stats.value_ranks(graded(s, d), "score"), _G + _RANKS + " SELECT DISTINCT score, rs AS score_rank FROM r")
add("agg18_roc_auc", lambda s, d: stats.correlate(graded(s, d), "score", "correct").select(F.round("auc", 9).alias("auc")), _G + _RANKS + f" SELECT round({_AUC}, 9) AS auc FROM r")
add("agg19_spearman", lambda s, d: stats.correlate(graded(s, d), "score", "correct").select(F.round("rho", 9).alias("rho")), _G + _RANKS + " SELECT round(corr(rs, rc), 9) AS rho FROM r")
add("agg20_correlate", lambda s, d: rounded(stats.correlate(graded(s, d), "score", "correct"), "rho", "auc", "mean_score", "accuracy", digits=9), _G + _RANKS + f" SELECT count(*) AS n, round(corr(rs, rc), 9) AS rho, round({_AUC}, 9) AS auc, round(avg(score), 9) AS mean_score, round(avg(hit), 9) AS accuracy FROM r")
add("join14_pair_comparison", lambda s, d: stats.correlate(graded(s, d), "score", "correct").select(F.round("auc", 6).alias("auc")),
    _G + " SELECT round(avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END), 6) AS auc FROM graded a, graded b WHERE a.correct AND NOT b.correct")

_C = f"WITH {CURVE}"
_W = ", g AS (SELECT DISTINCT budget FROM curve), gw AS (SELECT budget, (coalesce(lead(budget) OVER (ORDER BY budget), budget) - coalesce(lag(budget) OVER (ORDER BY budget), budget)) / CASE WHEN lead(budget) OVER (ORDER BY budget) IS NULL OR lag(budget) OVER (ORDER BY budget) IS NULL THEN 1e0 ELSE 2e0 END AS width FROM g)"
add("win03_widths", lambda s, d: curves.widths(curve(s, d).select("budget").distinct()), _C + _W + " SELECT budget, width FROM gw")


def _keep(s, d):
    c = curve(s, d)
    return c.where(~((F.col("label") == "m1") & (F.col("budget") == 512)))


add("agg21_budget_auc", lambda s, d: rounded(curves.area(_keep(s, d), curve(s, d), ["label"]), "auc", "nauc"), _C + _W + """
SELECT label, round(sum(a * width), 6) AS auc, round(sum(a * width) / sum(width), 6) AS nauc FROM (SELECT l.label, gw.width, CASE WHEN l.label = 'm1' AND gw.budget = 512 THEN 0 ELSE coalesce(c.accuracy, 0) END AS a FROM (SELECT DISTINCT label FROM curve) l CROSS JOIN gw LEFT JOIN curve c ON c.label = l.label AND c.budget = gw.budget) GROUP BY label""")
add("agg22_normalised_auc", lambda s, d: rounded(curves.area(curve(s, d), curve(s, d), ["label"]), "nauc").select("label", "nauc"), _C + _W + " SELECT label, round(sum(accuracy * width) / (SELECT sum(width) FROM gw), 6) AS nauc FROM curve JOIN gw USING (budget) GROUP BY label")
add("win02_budget_at", lambda s, d: rounded(curves.budget_at(curve(s, d), 0.25, ["label"]), "budget_at"), _C + """
, p AS (SELECT *, lag(budget) OVER w AS pb, lag(accuracy) OVER w AS pa FROM curve WINDOW w AS (PARTITION BY label ORDER BY budget)),
h AS (SELECT label, budget, CASE WHEN pa < 0.25 AND accuracy > 0.25 THEN pb + (0.25 - pa) / (accuracy - pa) * (budget - pb) ELSE budget END::DOUBLE AS v, row_number() OVER (PARTITION BY label ORDER BY budget) AS r FROM p WHERE accuracy >= 0.25)
SELECT l.label, round(v, 6) AS budget_at FROM (SELECT DISTINCT label FROM curve) l LEFT JOIN (SELECT * FROM h WHERE r = 1) h USING (label)""")
add("agg23_efficiency", lambda s, d: rounded(curves.point_efficiency(curve(s, d)), "accuracy", "avg_tokens", "efficiency", digits=9), _C + " SELECT label, budget, round(accuracy, 9) AS accuracy, round(avg_tokens, 9) AS avg_tokens, round(accuracy / (avg_tokens + 1e-6), 9) AS efficiency FROM curve")
add("join06_gain_over_base", lambda s, d: rounded(curves.gain_over(curve(s, d), "m0"), "gain", "gain_per_token", digits=9), _C + " SELECT c.label, c.budget, round(c.accuracy - coalesce(b.accuracy, 0), 9) AS gain, round((c.accuracy - coalesce(b.accuracy, 0)) / (c.avg_tokens + 1e-6), 9) AS gain_per_token FROM curve c LEFT JOIN curve b ON b.label = 'm0' AND b.budget = c.budget")
add("join07_difference", lambda s, d: rounded(curves.difference(curve(s, d), "m2", "m1"), "difference", digits=9), _C + " SELECT a.budget, round(a.accuracy - b.accuracy, 9) AS difference FROM curve a JOIN curve b USING (budget) WHERE a.label = 'm2' AND b.label = 'm1'")


def _rollup(s, d):
    g = generations(s, d).rollup("label", "dataset", "budget").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    return g


add("ext05_rollup", _rollup, _BOTH + " SELECT label, dataset, budget, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM gen GROUP BY ROLLUP (label, dataset, budget)")
