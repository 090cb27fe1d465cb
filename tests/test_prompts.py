"""Averages in order of event time: files in any order, stops after each batch, state of older versions."""

import random

import pytest
from pyspark.sql import functions as F

from calibrant.streaming import prompts


def events(n, seed):
    r = random.Random(seed)
    return [(r.randrange(3), 1_700_000_000 + 60 * k, k, r.gauss(0, 1), r.random(), r.randrange(50)) for k in range(n)]


def want(rows, start=None, decay=0.9):
    out = {k: list(v) for k, v in (start or {}).items()}
    for key, _, seq, x, d, n in sorted(rows, key=lambda e: (e[1], e[2])):
        s = out.setdefault(key, [0, -1, 0.0, 0.0, 0.0, 0])
        s[0], s[1], s[5] = s[0] + 1, seq, n
        s[2] = decay * s[2] + (1 - decay) * x
        s[3] = decay * s[3] + (1 - decay) * abs(x - s[2])
        s[4] = decay * s[4] + (1 - decay) * d
    return {k: tuple(round(x, 9) for x in v) for k, v in out.items()}


def got(spark, checkpoint):
    return {r["key"]: tuple(round(r[c], 9) for c in ("seen", "last", "reward_ema", "spread", "disagreement_ema", "length")) for r in prompts.saved(spark, checkpoint).collect()}


def add(spark, path, rows):
    df = spark.createDataFrame(rows, "key long, t long, seq long, reward double, disagreement double, length long")
    df.select("key", F.timestamp_seconds("t").alias("ts"), "seq", "reward", "disagreement", "length").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def stream(spark, tmp_path):
    path = str(tmp_path / "in")
    add(spark, path, [])
    return path, lambda: spark.readStream.schema(prompts.ROWS).option("maxFilesPerTrigger", 1).parquet(path)


def test_files_in_any_order_give_the_rows_of_an_ordered_run(spark, tmp_path, stream):
    path, read = stream
    rows = events(60, 1)
    files = [rows[k : k + 10] for k in range(0, 60, 10)]
    for k in (1, 0, 2, 4, 3, 5):  # each file's span is 10 minutes
        add(spark, path, random.Random(k).sample(files[k], 10))
    check = str(tmp_path / "c")
    prompts.run(read(), str(tmp_path / "out"), check, "25 minutes")
    assert got(spark, check) == want(rows)
    released = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < released.agg(F.max("seen")).first()[0] < max(v[0] for v in want(rows).values())  # the last ones wait until they are read


def test_a_run_stopped_after_each_batch_equals_an_uninterrupted_one(spark, tmp_path, stream):
    path, read = stream
    rows = events(40, 2)
    check = str(tmp_path / "c")
    for k in range(0, 40, 20):
        add(spark, path, rows[k : k + 20])
        prompts.run(read(), str(tmp_path / "out"), check, "5 minutes")
    assert got(spark, check) == want(rows)


def test_state_goes_on_elsewhere_and_older_rows_load(spark, tmp_path, stream):
    """Saved rows begin another run; rows of version 1 have no spread and no length."""
    path, read = stream
    first, then = events(30, 3)[:15], events(30, 3)[15:]
    add(spark, path, first)
    one = str(tmp_path / "c1")
    prompts.run(read(), str(tmp_path / "o1"), one, "5 minutes")
    kept = spark.createDataFrame(prompts.saved(spark, one).collect(), prompts.saved(spark, one).schema)
    other = str(tmp_path / "in2")
    add(spark, other, then)
    read2 = lambda: spark.readStream.schema(prompts.ROWS).parquet(other)
    two = str(tmp_path / "c2")
    prompts.run(read2(), str(tmp_path / "o2"), two, "5 minutes", kept)
    assert got(spark, two) == want([*first, *then])
    old = kept.drop("spread", "length").withColumn("version", F.lit(1))
    three = str(tmp_path / "c3")
    prompts.run(read2(), str(tmp_path / "o3"), three, "5 minutes", old)
    begun = {r["key"]: [r["seen"], r["last"], r["reward_ema"], 0.0, r["disagreement_ema"], 0] for r in kept.collect()}
    assert got(spark, three) == want(then, begun)
