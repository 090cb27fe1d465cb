"""Calibration reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.functions import dists as f
from calibrant.operators import calibration as cal
from calibrant.plans.signals import D, M, top
from calibrant.plans.text import _T, toks
from calibrant.plans.views import metrics, read

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def r6(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


add("agg30_age_histogram", lambda s, d: cal.age_histogram(metrics(s, d).withColumn("age", F.col("k") % 7)), M + "SELECT k % 7 AS age, count(*) AS n FROM metrics GROUP BY 1")
_RESULT = lambda: F.element_at(F.array(*(F.lit(x) for x in ("consumed", "stale", "stale_late", "full", "queued", "consumed"))), F.col("k") % 6 + 1)
add("agg30_waste", lambda s, d: r6(cal.waste(metrics(s, d).withColumn("result", _RESULT())), "stale_discard_ratio", "waste_ratio"),
    M + """SELECT count(*) AS rollouts, count(*) FILTER (k % 6 IN (0, 5)) AS trained, count(*) FILTER (k % 6 = 1) AS dropped_at_put, count(*) FILTER (k % 6 = 2) AS dropped_at_consume, count(*) FILTER (k % 6 = 3) AS dropped_queue_full,
count(*) FILTER (k % 6 = 4) AS shutdown_tail, round(count(*) FILTER (k % 6 IN (1, 2)) / greatest(count(*), 1)::DOUBLE, 6) AS stale_discard_ratio, round(count(*) FILTER (k % 6 NOT IN (0, 5)) / greatest(count(*), 1)::DOUBLE, 6) AS waste_ratio FROM metrics""")  # fmt: skip


def _chosen(s, d):
    rows = top(s, d, 32).select((F.array_position("tt.id", (F.col("vec_id") % 64).cast("int")) - 1).alias("at"))
    return r6(cal.chosen_coverage(rows.select(F.when(F.col("at") >= 0, F.col("at")).alias("rank")), "rank", [4, 8, 16, 32]), "coverage")


add("agg31_chosen_coverage", _chosen, D + " SELECT k::INT AS k, round(avg((rt < k)::INT), 6) AS coverage FROM tk, (VALUES (4), (8), (16), (32)) v(k) WHERE i = vec_id % 64 GROUP BY k")
_TAIL = "(len(ids) >= 2 * p AND len(ids) >= {m} AND ids[len(ids) - p + 1 : len(ids)] = ids[len(ids) - 2 * p + 1 : len(ids) - p])"
add("agg32_loop_report", lambda s, d: r6(cal.loop_report(toks(s, d), "ids", 4), "rate", "mean_length"),
    _T + f"""SELECT p::INT AS period, round(avg({_TAIL.format(m=16)}::INT), 6) AS rate, avg({_TAIL.format(m=16)}::INT) > 0.05 AS suggested, count(*) AS n, count(*) FILTER (list_contains(ids, 4)) AS n_eos,
min(len(ids))::INT AS shortest, max(len(ids))::INT AS longest, round(avg(len(ids)), 6) AS mean_length FROM tk, range(2, 9) r(p) GROUP BY p""")  # fmt: skip


_CONFIGS = [((1, 2, 3), 4), ((2,), 16), ((3, 4), 64)]


def _labelled(s, d):
    return toks(s, d).withColumn("label", F.col("doc_id") % 2 == 0)


_ANY = lambda ps, m: f"list_bool_or(list_transform({ps}, lambda p: {_TAIL.format(m=m)}))"
_HITS = _T + f""", h AS (SELECT doc_id, 'periods=(1, 2, 3),min_len=4' AS config, {_ANY('[1, 2, 3]', 4)} AS hit FROM tk UNION ALL SELECT doc_id, 'periods=(2,),min_len=16', {_ANY('[2]', 16)} FROM tk
UNION ALL SELECT doc_id, 'periods=(3, 4),min_len=64', {_ANY('[3, 4]', 64)} FROM tk) """
add("agg33_detector_sweep", lambda s, d: r6(cal.detector_sweep(_labelled(s, d), "doc_id", "ids", _CONFIGS, "label"), "rate", "false_positive_rate"),
    _HITS + """, g AS (SELECT config, count(*) FILTER (hit) AS detected, round(avg(hit::INT), 6) AS rate, round(count(*) FILTER (hit AND doc_id % 2 = 1) / count(*) FILTER (doc_id % 2 = 1)::DOUBLE, 6) AS false_positive_rate, count(*) FILTER (NOT hit AND doc_id % 2 = 0) AS missed FROM h GROUP BY config)
SELECT g.*, i.doc_id, i.kind FROM g LEFT JOIN (SELECT config, doc_id, CASE WHEN hit THEN 'flagged' ELSE 'missed' END AS kind FROM h WHERE hit OR (NOT hit AND doc_id % 2 = 0)) i USING (config)""")  # fmt: skip
add("agg33_detector_ids", lambda s, d: cal.detector_ids(_labelled(s, d), "doc_id", "ids", _CONFIGS, "label"), _HITS + "SELECT config, doc_id, CASE WHEN hit THEN 'flagged' ELSE 'missed' END AS kind FROM h WHERE hit OR doc_id % 2 = 0")
_FOUR = ("a_rl_student", "b_rl_own", "c_ref_student", "d_ref_own", "delta_student", "delta_teacher")
add("agg34_template_audit", lambda s, d: r6(cal.template_audit(metrics(s, d).select("pool", "reward", (F.col("k") / 10).alias("b"), (F.col("reward") / 2).alias("c"), (F.col("k") / F.lit(7.0)).alias("e")), ["pool"], "reward", "b", "c", "e"), *_FOUR),
    M + """, a AS (SELECT pool, avg(reward) AS a, avg(k / 10e0) AS b, avg(reward / 2) AS c, avg(k / 7e0) AS e FROM metrics GROUP BY pool)
SELECT pool, round(a, 6) AS a_rl_student, round(b, 6) AS b_rl_own, round(c, 6) AS c_ref_student, round(e, 6) AS d_ref_own, round(a - c, 6) AS delta_student, round(b - e, 6) AS delta_teacher, b - e - (a - c) > 0.3 AS template_matters, b - e < -0.5 AS teacher_negative FROM a""")  # fmt: skip


def _support(s, d):
    x = top(s, d)
    teacher = F.zip_with(F.col("tt.v"), f.gather(F.col("s"), F.col("tt.id")), lambda a, b: a - b)
    rows = x.select(
        f.expected(F.col("ss.v"), F.zip_with(f.gather(F.col("t"), F.col("ss.id")), F.col("ss.v"), lambda a, b: a - b)).alias("e"), (F.aggregate(teacher, F.lit(0.0), lambda a, b: a + b) / F.size("tt")).alias("m"),
        (F.size(F.array_intersect("ss.id", "tt.id")) / F.lit(8.0)).alias("h"), (F.col("vec_id") % 3 != 0).alias("ok"),
    )
    return r6(cal.support_audit(rows, "e", "m", "h", "ok"), "student_expected", "teacher_mean", "hit_mean", "hit_min", "hit_max")


add("agg35_support_audit", _support, D + """, v AS (SELECT vec_id, sum(exp(s) * (t - s)) FILTER (rs < 8) AS e, avg(t - s) FILTER (rt < 8) AS m, count(*) FILTER (rs < 8 AND rt < 8) / 8e0 AS h FROM tk GROUP BY vec_id)
SELECT round(avg(e) FILTER (vec_id % 3 <> 0), 6) AS student_expected, round(avg(m) FILTER (vec_id % 3 <> 0), 6) AS teacher_mean, round(avg(h), 6) AS hit_mean, round(min(h), 6) AS hit_min, round(max(h), 6) AS hit_max FROM v""")
add("agg37_lookup_counters", lambda s, d: r6(cal.lookup_counters(metrics(s, d), ["pool"], "user_id", F.col("k") < 70, F.col("k") % 10 == 3, F.col("k") % 10 == 5), "hit_rate"),
    M + """SELECT pool, sum(n)::BIGINT AS total, sum(h)::BIGINT AS hit, (sum(n) - sum(h))::BIGINT AS miss, sum(i)::BIGINT AS invalid, sum(d)::BIGINT AS duplicate, round(sum(h) / sum(n)::DOUBLE, 6) AS hit_rate, max(n) AS most_reused
FROM (SELECT pool, user_id, count(*) AS n, count(*) FILTER (k < 70) AS h, count(*) FILTER (k % 10 = 3) AS i, count(*) FILTER (k % 10 = 5) AS d FROM metrics GROUP BY pool, user_id) GROUP BY pool""")  # fmt: skip


#: Stages for lengths up to 6,000; parts are measured up to 5,000.
_SIZES = tuple((f"s{i}", 1000, 100 * i) for i in range(1, 61))


def _parts(s, d):
    """Measured groups: a part's size is its longest length, its price the mean one."""
    return read(s, d, "part").select((F.col("p_size") * 100).alias("max_len"), F.col("p_retailprice").alias("mean_len"), (F.col("p_partkey") % 501).cast("double").alias("tok_per_s"))


def _groups(s, d):
    longest = F.when(F.col("pool") == "click", 2048).when(F.col("pool").isin("view", "purchase"), 8192).otherwise(512)
    return metrics(s, d).groupBy("pool").agg((F.avg("k") * 300).alias("mean_len"), (F.sum("k") % 97 + 1).cast("double").alias("tok_per_s")).withColumn("max_len", longest)


add("agg38_corpus_cost", lambda s, d: r6(cal.corpus_cost(_groups(s, d), 2), "mean_len", "hours").drop("total_tokens"),
    M + """, g AS (SELECT CASE pool WHEN 'click' THEN 2048 WHEN 'view' THEN 8192 WHEN 'purchase' THEN 8192 ELSE 512 END AS max_len, avg(k) * 300 AS mean_len, (sum(k) % 97 + 1)::DOUBLE AS tok_per_s FROM metrics GROUP BY pool),
b AS (SELECT max_len, mean_len, tok_per_s FROM g QUALIFY row_number() OVER (PARTITION BY max_len ORDER BY tok_per_s DESC, mean_len DESC) = 1),
st AS (SELECT * FROM (VALUES (0, 'pilot', 5000, 2048), (1, 'scale-1', 10000, 4096), (2, 'scale-2', 25000, 8192), (3, 'full', 50000, 8192)) v(place, stage, n, max_len))
SELECT place::INT AS place, stage, n::BIGINT AS n, max_len::INT AS max_len, round(least(mean_len, max_len), 6) AS mean_len, tok_per_s, round(n * least(mean_len, max_len) / (tok_per_s * 2) / 3600, 6) AS hours, tok_per_s IS NULL AS missing FROM st LEFT JOIN b USING (max_len)""")  # fmt: skip
add("join16_stage_match", lambda s, d: cal.corpus_cost(_parts(s, d), 1, _SIZES).select("stage", "max_len", F.round("mean_len", 6).alias("mean_len"), "tok_per_s", "missing"),
    """WITH g AS (SELECT p_size * 100 AS max_len, p_retailprice AS mean_len, (p_partkey % 501)::DOUBLE AS tok_per_s FROM part), b AS (SELECT * FROM g WHERE tok_per_s > 0 QUALIFY row_number() OVER (PARTITION BY max_len ORDER BY tok_per_s DESC, mean_len DESC) = 1),
st AS (SELECT 's' || i AS stage, i * 100 AS max_len FROM range(1, 61) r(i)) SELECT stage, max_len::INT AS max_len, round(least(mean_len, max_len), 6) AS mean_len, tok_per_s, tok_per_s IS NULL AS missing FROM st LEFT JOIN b USING (max_len)""")  # fmt: skip
add("agg39_smoke_report", lambda s, d: cal.smoke_report(metrics(s, d), "k", F.col("k") < 90, F.col("k") + 1, ["pool"]),
    M + """SELECT pool, count(*) AS n, round_even(avg(k), 1) AS mean_length, round_even(avg(k) FILTER (k < 90), 1) AS mean_length_eos, round_even(avg((k >= 90)::INT), 4) AS truncated, round_even(avg((k < 90)::INT), 4) AS eos_rate,
round_even(sum(k) / sum(k + 1)::DOUBLE, 1) AS tokens_per_s, sum(k)::BIGINT AS total_tokens, max(k) AS longest, min(k) AS shortest FROM metrics GROUP BY pool""")  # fmt: skip
