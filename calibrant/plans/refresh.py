"""The refresh phase over the driver's tables: documents are prompts and outputs, vectors their distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.functions import dists as f
from calibrant.operators import selection
from calibrant.operators.refresh import refresh
from calibrant.plans.signals import D, both
from calibrant.plans.text import _LOOP, _T, toks
from calibrant.plans.views import read
from calibrant.session import table

QUERIES, ORACLE = {}, {}


def phase(s, d):
    docs = read(s, d, "documents").select("doc_id", "n_chars")
    picked = table(selection.select_and_budget(docs, "doc_id", "n_chars", 50, "adaptive"), "picked")
    selected = picked.select(F.col("doc_id").alias("prompt_id"), "budget", F.col("n_chars").cast("double").alias("value"))
    texts = toks(s, d).withColumnRenamed("doc_id", "prompt_id")
    x = both(s, d)
    judged = x.select(F.col("vec_id").alias("prompt_id"), f.expected(F.col("s"), F.zip_with("t", "s", lambda a, b: a - b)).alias("reward"), f.disagreement(F.col("s"), F.col("t"), F.transform("s", lambda v: F.lit(1.0))).alias("disagreement"))
    generate = lambda plan: plan.join(texts, "prompt_id").withColumn("ids", F.slice("ids", F.lit(1), F.col("budget")))
    return refresh(selected, generate, lambda kept: kept.join(judged, "prompt_id", "left"), step=7, eos=4, capacity=64, periods=[1, 2, 3], least=4)


def rows(s, d):
    r = phase(s, d)
    out = r.rollouts.select("prompt_id", "budget", "status", "length", "kept").join(r.slots.select("prompt_id", "slot"), "prompt_id", "left").join(r.state.select("prompt_id", "seen", "reward_ema", "disagreement_ema"), "prompt_id", "left")
    return out.withColumn("reward_ema", F.round("reward_ema", 6)).withColumn("disagreement_ema", F.round("disagreement_ema", 6))


_PHASE = f"""{D}, pool AS (SELECT doc_id, n_chars, md5(doc_id::VARCHAR || ':0') AS h FROM documents ORDER BY h LIMIT 200), ranked AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, h) AS v FROM pool),
pk AS (SELECT doc_id, n_chars FROM ranked WHERE v <= 40 UNION ALL SELECT doc_id, n_chars FROM (SELECT * FROM ranked WHERE v > 40 ORDER BY h LIMIT 10)), q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM pk),
sel AS (SELECT doc_id, (CASE WHEN n_chars < q[1] THEN 256 WHEN n_chars < q[2] THEN 512 WHEN n_chars < q[3] THEN 1024 ELSE 2048 END)::INT AS budget FROM pk, q),
ro AS (SELECT doc_id, budget, list_transform(string_split(text, ' '), lambda w: (len(w) % 5)::INT)[1:budget] AS ids FROM sel JOIN documents USING (doc_id)),
st2 AS (SELECT doc_id, budget, CASE WHEN {_LOOP} THEN 'loop' WHEN len(ids) = 0 THEN 'empty' WHEN list_contains(ids, 4) THEN 'eos' ELSE 'budget_stop' END AS status, coalesce(list_position(ids, 4), len(ids))::BIGINT AS length FROM ro),
jd AS (SELECT vec_id AS doc_id, sum(exp(s) * (t - s)) AS r, sum(abs(s - t)) / (64 + 1e-8) AS d FROM st GROUP BY vec_id),
al AS (SELECT *, status NOT IN ('loop', 'empty') AS kept FROM st2)"""
QUERIES["stm08_refresh_phase"] = rows
ORACLE["stm08_refresh_phase"] = _PHASE + """
SELECT doc_id AS prompt_id, budget, status, length, kept, CASE WHEN kept THEN (row_number() OVER (PARTITION BY kept ORDER BY doc_id) - 1)::INT END AS slot, CASE WHEN kept THEN 1 END AS seen,
  CASE WHEN kept THEN round(0.1::DOUBLE * coalesce(r, 0), 6) END AS reward_ema, CASE WHEN kept THEN round(0.1::DOUBLE * coalesce(d, 0), 6) END AS disagreement_ema FROM al LEFT JOIN jd USING (doc_id)"""
QUERIES["stm08_refresh_summary"] = lambda s, d: phase(s, d).summary
ORACLE["stm08_refresh_summary"] = _PHASE + """
SELECT count(*) AS n_total, count(*) FILTER (kept) AS n_appended, count(*) FILTER (status = 'eos') AS n_eos, count(*) FILTER (status = 'budget_stop') AS n_budget_stop, count(*) FILTER (status = 'loop') AS n_loop,
  count(*) FILTER (status = 'empty') AS n_empty, coalesce(sum(length) FILTER (kept), 0)::BIGINT AS valid_tokens, (2 * coalesce(sum(length) FILTER (kept), 0))::BIGINT AS teacher_forward_tokens FROM al"""
