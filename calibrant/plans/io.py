"""Sources, sinks and grading, as round trips over the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from calibrant.functions.text import hash_answer
from calibrant.operators import selection
from calibrant.plans.views import read
from calibrant.session import shared_dir, ship
from calibrant.sources import files, outcomes, versions
from calibrant.streaming import live

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def at(s, what):
    return f"{shared_dir(s)}/calibrant/io-{what}-{uuid.uuid4().hex}"


def _jsonl(s, d):
    """Rows of benchmark as JSON lines, every seventh line broken and every fifth response empty."""
    row = F.to_json(F.struct(F.col("text").alias("prompt"), F.when(F.col("item_id") % 5 == 0, F.lit("")).otherwise(F.col("item_id").cast("string")).alias("response")))
    path = at(s, "jsonl")
    read(s, d, "benchmark").select(F.when(F.col("item_id") % 7 == 0, F.lit('{"prompt": "x", ')).otherwise(row).alias("value")).write.text(path)
    return path


add("src01_jsonl", lambda s, d: files.read_jsonl(s, _jsonl(s, d)).select("prompt", "response"), "SELECT text AS prompt, item_id::VARCHAR AS response FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0")
add("src02_synthetic", lambda s, d: files.load(s, "synthetic", 100, 16, 50))
add("src04_nested_chat", lambda s, d: files.nested_chat(read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("prompt"), F.struct(F.max("text").alias("ground_truth")).alias("reward_model"))),
    "SELECT any_value(text) AS prompt, max(text) AS ground_truth FROM conversations GROUP BY conv_id HAVING count(*) = 1 AND any_value(role) = 'user' AND any_value(text) <> ''")
add("src05_candidate_columns", lambda s, d: (lambda o: o.select("o_orderkey", files.first_of(o, ["missing", "o_orderstatus", "o_orderpriority"], "v")))(read(s, d, "orders")), "SELECT o_orderkey, coalesce(o_orderstatus, o_orderpriority) AS v FROM orders")


def _registry(s, d):
    reg = files.Registry({"Bench": files.DatasetSpec(f"{d}/benchmark.parquet", problem=["problem", "text"], answer=["answer", "item_id"], extract=lambda c: hash_answer(F.concat(F.lit("why #### "), c.cast("string"))), aliases=("b40",))})
    return reg.problems(s, "B40")


add("src06_registry", _registry, "SELECT text AS problem, item_id::VARCHAR AS ground_truth FROM benchmark")


_STAGES = (("A", "teacher", ""), ("N", "student_post", "/step_100"), ("R", "student_baseline", ""))


def _tree(s, d):
    path = at(s, "tree")
    for flag, stage, step in _STAGES:
        for half in (0, 1):
            read(s, d, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_orderkey") % 2 == half)).select("l_orderkey", "l_quantity").write.json(f"{path}/{stage}/m{half}{step}")
    got = files.read_results_tree(s, path, "l_orderkey long, l_quantity double", kind="json")
    return got.groupBy("stage", "model", "step").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


add("src08_results_tree", _tree, "SELECT CASE l_returnflag WHEN 'A' THEN 'teacher' WHEN 'N' THEN 'student_post' ELSE 'student_baseline' END AS stage, 'm' || (l_orderkey % 2)::VARCHAR AS model, CASE l_returnflag WHEN 'N' THEN 'step_100' END AS step, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL")


def _cache(s, d):
    """Supports of all 64 ids, of which every other vector's was saved by an older writer that did not sort."""
    path = at(s, "cache")
    e = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct((63 - i).alias("id"), x.alias("v"))).alias("pairs"))
    files.save_cache(e.where("vec_id % 2 = 0"), path, {"k": 64})
    e.where("vec_id % 2 = 1").write.mode("append").parquet(f"{path}/data")
    back, meta = files.load_cache(s, path)
    return back.select("vec_id", F.posexplode("pairs").alias("place", "p"), F.lit(meta["k"]).alias("k")).select("vec_id", "place", F.col("p.id").alias("id"), F.col("p.v").cast("double").alias("v"), "k")


add("src10_cache_round_trip", _cache, "SELECT vec_id, i::INT AS place, i::INT AS id, embedding[64 - i]::DOUBLE AS v, 64::INT AS k FROM embeddings, range(64) r(i)")


def _metrics(s, d):
    """All events in two appends, the second with a new column; a resume truncates near the end."""
    path = at(s, "metrics")
    e = read(s, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    files.append_metrics(e.where("step % 2 = 0"), path)
    files.append_metrics(e.where("step % 2 = 1").withColumn("kl", F.col("loss") / 2), path)
    last = e.agg(F.max("step")).first()[0] or 0
    return files.truncate_at(files.read_metrics(s, path), last - 10).select("step", "loss", "kl")


add("src11_growing_metrics", _metrics, "SELECT event_id AS step, value AS loss, CASE WHEN event_id % 2 = 1 THEN value / 2 END AS kl FROM events WHERE event_id < (SELECT max(event_id) - 10 FROM events)")


def _metrics_csv(s, d):
    """Metrics to CSV and back, with a line cut short."""
    path, out = at(s, "metrics"), at(s, "csv")
    e = read(s, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("pool"))
    files.append_metrics(e.where("step % 2 = 0"), path)
    files.append_metrics(e.where("step % 2 = 1").withColumn("kl", F.col("loss") / 2), path)
    files.export_metrics(s, path, out)
    s.createDataFrame([("step,loss,pool,kl",), ("77777777,1.5",)], "value string").coalesce(1).write.mode("append").text(out)
    back = files.read_metrics_csv(s, out)
    return back.groupBy(F.col(files.phase_column(back)).alias("phase")).agg(F.count("*").alias("n"), F.max("step").cast("long").alias("last"), F.count("kl").alias("with_kl"), F.round(F.sum(F.col("loss").cast("double")), 3).alias("loss"))


add("src12_metrics_csv", _metrics_csv, "SELECT event_type AS phase, count(*) AS n, max(event_id) AS last, count(*) FILTER (event_id % 2 = 1) AS with_kl, round(sum(value), 3) AS loss FROM events GROUP BY 1")


def _first_valid(s, d):
    path = at(s, "first")
    b = read(s, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 2, F.lit("oops")).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"), F.when(F.col("item_id") % 7 == 3, F.lit("")).otherwise(F.col("item_id").cast("string")).alias("response")))).alias("value"))
    b.coalesce(1).orderBy("item_id").select("value").write.text(path)
    return files.first_valid(s, path, 12).select(F.col("response").alias("id"), "prompt")


add("src28_first_valid", _first_valid, "SELECT item_id::VARCHAR AS id, text AS prompt FROM benchmark WHERE item_id % 5 <> 2 AND item_id % 7 <> 3 ORDER BY item_id LIMIT 12")


def _cells(s, d):
    path = at(s, "cells")
    rows = read(s, d, "orders").select(F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 2).alias("dataset"), F.lit(512).alias("budget"), "o_orderkey")
    files.write_cells(rows, path)
    return s.read.schema("o_orderkey long, label string, dataset long, budget int").json(path).groupBy("label", "dataset", "budget").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


add("src14_cells", _cells, "SELECT o_orderstatus AS label, o_orderkey % 2 AS dataset, 512::INT AS budget, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1, 2")


def _resume(s, d):
    path = at(s, "resume")
    rows = read(s, d, "customer").select("c_custkey", F.lit(4).alias("n_samples"))
    files.append_missing(s, rows.where("c_custkey % 3 = 0"), path, ["c_custkey"])
    files.append_missing(s, rows, path, ["c_custkey"])
    return s.read.parquet(path).groupBy("n_samples").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("ids"))


add("src15_resume", _resume, "SELECT 4::INT AS n_samples, count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer")


def _graded():
    """A worker that cannot do some items: every seventh at first, every fifth of these ever."""

    def fn(pdf):
        k = pdf["c_custkey"].to_numpy()
        if ((k % 7 == 3) & ((pdf["attempt"].to_numpy() < 2) | (k % 5 == 1))).any():
            raise ValueError("no answer")
        return pd.DataFrame({"value": k * 2})

    return fn


def _dead_letters(s, d):
    """Four runs over customers, the second of them repeated: results, and what stays without one."""
    ship(s)
    path = at(s, "outcomes")
    rows = read(s, d, "customer").select("c_custkey", F.lit(4).alias("n_samples"))
    for run in (1, 2, 2, 3, 4):
        done = outcomes.evaluate(s, rows if run > 1 else rows.where("c_custkey % 2 = 0"), path, ["c_custkey"], _graded(), "value long", run)
    good = outcomes.results(done, ["c_custkey"]).select("c_custkey", "attempt", F.col("value").cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(outcomes.dead_letters(done, ["c_custkey"]).select("c_custkey", "attempt", F.lit(None).cast("string").alias("value"), "error"))


add("src15_dead_letters", _dead_letters, """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 3 THEN 1 WHEN c_custkey % 5 <> 1 THEN 2 ELSE 3 END::INT AS attempt,
CASE WHEN c_custkey % 7 <> 3 OR c_custkey % 5 <> 1 THEN (c_custkey * 2)::VARCHAR END AS value, CASE WHEN c_custkey % 7 = 3 AND c_custkey % 5 = 1 THEN 'ValueError: no answer' END AS error FROM customer""")
add("src17_shard_merge", lambda s, d: files.merge_shards(read(s, d, "customer").select("c_custkey", F.lit("-").alias("v")), read(s, d, "orders").where("o_orderkey % 2 = 0").select((F.col("o_orderkey")).alias("c_custkey"), F.col("o_orderstatus").alias("v")), "c_custkey", "v"),
    "SELECT c_custkey, coalesce(o_orderstatus, '-') AS v FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = c_custkey")


def _summaries(s, d):
    path = at(s, "sum")
    n = read(s, d, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("v")))).alias("value"))
    n.repartition(30, "value").write.option("maxRecordsPerFile", 1).text(path)
    return files.merge_summaries(s, [path], "name string, v int").orderBy("name")


add("src18_merge_summaries", _summaries, "SELECT n_name AS name, n_nationkey AS v FROM nation WHERE n_nationkey % 4 <> 0")
add("src24_rename_head", lambda s, d: read(s, d, "benchmark").orderBy("item_id").limit(10).select(F.col("text").alias("prompt")), "SELECT text AS prompt FROM benchmark ORDER BY item_id LIMIT 10")


def _aligned(s, d):
    """Orders as lines in a file for each of 8 buckets, one in six broken, in order of their keys."""
    path = at(s, "lines")
    o = read(s, d, "orders").select((F.col("o_orderkey") % 8).alias("b"), "o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, F.lit('{"o_comment')).otherwise(F.to_json(F.struct("o_orderkey", "o_orderstatus"))).alias("value"))
    o.repartition(8, "b").sortWithinPartitions("b", "o_orderkey").select("b", "value").write.partitionBy("b").text(path)
    got = files.read_aligned(s, f"{path}/*", "o_orderkey long, o_orderstatus string")
    return got.select(F.regexp_extract("file", r"/b=(\d+)/", 1).cast("long").alias("bucket"), "idx", "row.o_orderkey", "row.o_orderstatus", "corrupt")


add("src27_aligned_lines", _aligned, "SELECT o_orderkey % 8 AS bucket, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderkey % 6 = 0 AS corrupt FROM orders")
add("src29_summary_json", lambda s, d: read(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.to_json(F.struct("o_orderstatus", "n")).alias("line")), """SELECT '{"o_orderstatus":"' || o_orderstatus || '","n":' || count(*) || '}' AS line FROM orders GROUP BY o_orderstatus""")


def _versioned(s, d):
    """All orders, then a version with some replaced; readers get the newest, and know when there is none newer."""
    path = at(s, "version")
    versions.publish(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    old, n = versions.if_newer(s, path, None)
    new = read(s, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"))
    versions.publish(selection.upsert(old, new, ["o_orderkey"]), path)
    got, m = versions.if_newer(s, path, n)
    again, _ = versions.if_newer(s, path, m)
    return got.withColumn("version", F.lit(m)).withColumn("newer", F.lit(again is not None))


add("stm04_published_versions", _versioned, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, 2::INT AS version, false AS newer FROM orders")


def _truncate(s, d):
    """Metrics cut at half of their steps twice: the backup has all of them."""
    path = at(s, "cut")
    e = read(s, d, "events").select(F.when(F.col("event_id") % 50 != 7, F.col("event_id")).alias("step"), F.col("value").alias("loss"))
    half = (e.agg(F.max("step")).first()[0] or 0) // 2
    versions.publish(e, path)
    for _ in range(2):
        left = files.truncate_metrics(s, path, half)
    kept, n = versions.newest(s, f"{path}_pre_resume_step{half}")
    return left.withColumn("part", F.lit("left")).unionByName(kept.withColumn("part", F.lit(f"backup {n}")))


add("src13_truncate_with_backup", _truncate, "WITH e AS (SELECT CASE WHEN event_id % 50 <> 7 THEN event_id END AS step, value AS loss FROM events) SELECT step, loss, 'backup 1' AS part FROM e UNION ALL SELECT step, loss, 'left' FROM e WHERE step IS NULL OR step < (SELECT max(step) // 2 FROM e)")


def _stale_stream(s, d):
    """The staleness queue as a stream with state, replayed to its end."""
    ship(s)
    path = at(s, "stale")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 3 == 0, "advance").when(k % 3 == 1, "put").otherwise("get")
    read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") / 40).cast("int").alias("version")).write.parquet(f"{path}/in")
    stream = s.readStream.schema("key long, seq long, kind string, version int").parquet(f"{path}/in")
    live.run_available(live.stale_queue(stream, "key", 3), live.once_per_batch(path, "out"), f"{path}/checkpoint")
    return s.read.parquet(f"{path}/out").select("key", "seq", "result", "age")


add("stm02_stale_stream", _stale_stream)
add("win05_stream_average", lambda s, d: _average(s, d), """WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS r FROM events GROUP BY user_id)
SELECT user_id, round(list_sum(list_transform(r, lambda x, j: 0.1::DOUBLE * x * pow(0.9::DOUBLE, len(r) - j))), 6) AS ema, len(r)::BIGINT AS seen FROM o""")


def _average(s, d):
    ship(s)
    path = at(s, "ema")
    live.run_available(live.keyed_average(s.readStream.schema(live.EVENTS).parquet(f"{d}/events*").withColumn("ts", F.col("ts").cast("timestamp"))), live.once_per_batch(path, "out"), f"{path}/checkpoint", "update")
    return s.read.parquet(f"{path}/out").select("user_id", F.round("ema", 6).alias("ema"), "seen")
