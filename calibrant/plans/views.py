"""Roles that the driver's tables play, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of problems: a line item is a sample, its order the problem."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    li = read(spark, sf_dir, "lineitem").withColumn("sample_idx", F.row_number().over(w) - 1)
    q = F.col("l_quantity").cast("int")
    out = li.select(
        F.col("l_orderkey").alias("problem_id"), "sample_idx", F.concat(F.lit("m"), (F.col("l_orderkey") % 3).cast("string")).alias("label"),
        (F.col("l_orderkey") % 2).cast("int").alias("dataset"), (F.lit(256) * F.pow(F.lit(2), F.col("l_orderkey") % 5)).cast("int").alias("budget"),
        F.when(q % 10 == 0, F.lit(None)).otherwise(q % 4).alias("answer"), (F.col("l_orderkey") % 4).cast("int").alias("ground_truth"),
        F.when(F.col("l_returnflag") == "A", "eos").when(F.col("l_returnflag") == "N", "budget_stop").otherwise("loop").alias("status"),
        (F.col("l_extendedprice") / 10).cast("int").alias("tokens"), (F.col("l_discount") * 100).cast("int").alias("wall_s"), (F.col("l_linestatus") == "F").alias("prefix_correct"),
    )
    return out.withColumn("correct", F.coalesce(F.col("answer") == F.col("ground_truth"), F.lit(False)))


GENERATIONS = """
gen0 AS (SELECT l_orderkey AS problem_id,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_returnflag, l_linestatus) - 1)::INT AS sample_idx,
  'm' || (l_orderkey % 3)::VARCHAR AS label, (l_orderkey % 2)::INT AS dataset, (256 * pow(2, l_orderkey % 5))::INT AS budget,
  CASE WHEN l_quantity::INT % 10 = 0 THEN NULL ELSE l_quantity::INT % 4 END AS answer, (l_orderkey % 4)::INT AS ground_truth,
  CASE l_returnflag WHEN 'A' THEN 'eos' WHEN 'N' THEN 'budget_stop' ELSE 'loop' END AS status,
  trunc(l_extendedprice / 10)::INT AS tokens, trunc(l_discount * 100)::INT AS wall_s, l_linestatus = 'F' AS prefix_correct FROM lineitem),
gen AS (SELECT *, coalesce(answer = ground_truth, false) AS correct FROM gen0)
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("correct"))


GRADED = "graded AS (SELECT doc_id, n_chars::DOUBLE AS score, quality = 1 AS correct FROM documents JOIN labels USING (doc_id))"


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).groupBy("label", "budget").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("tokens").alias("avg_tokens"))


CURVE = GENERATIONS + ", curve AS (SELECT label, budget, avg(correct::INT) AS accuracy, avg(tokens) AS avg_tokens FROM gen GROUP BY label, budget)"


def dists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student and teacher logits: a vector and the next one by id."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(t, "vec_id").select("vec_id", F.col("embedding").alias("s_logits"), F.col("other").alias("t_logits"))


DISTS = """
ex AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mx AS (SELECT vec_id, max(x) AS m FROM ex GROUP BY vec_id),
nz AS (SELECT ex.vec_id, ln(sum(exp(x - m))) AS z FROM ex JOIN mx USING (vec_id) GROUP BY ex.vec_id),
lp AS (SELECT ex.vec_id, i, x - m - z AS lp FROM ex JOIN mx USING (vec_id) JOIN nz USING (vec_id)),
st AS (SELECT a.vec_id, a.i, a.lp AS s, b.lp AS t FROM lp a JOIN lp b ON b.vec_id = a.vec_id + 1 AND a.i = b.i),
tk AS (SELECT vec_id, i, s, t, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) - 1 AS rs, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, i) - 1 AS rt FROM st)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training metric rows: events in order of time; steps are their ids, as these are in that order."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("pool"), F.col("value").alias("reward"), F.get_json_object("props", "$.k").cast("int").alias("k"))


METRICS = "metrics AS (SELECT event_id AS step, ts, user_id, event_type AS pool, value AS reward, (props->>'$.k')::INT AS k FROM events)"
