"""Product codes against brute force: ties, equal vectors, hot labels, nulls, misfits, empty tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept)[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(p, cut(v)[p])[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), a in zip(kept, at[p]) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, labels = {}, {}
    for i, v, g in kept:
        got = [near(p, cut(v)[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), g)
        labels[g] = labels.get(g, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, labels[g], digest) for i, (c, e, g) in out.items()}


def result(df):
    codes, books = vector_codes.compress(df)
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], books.digest()) for r in vector_codes.label_errors(codes).collect()}


def vectors(n, seed, steps=None):
    r = random.Random(seed)
    draw = (lambda: r.randrange(-steps, steps + 1) / 256) if steps else (lambda: float(np.float32(r.gauss(0, 0.2))))
    return [(3 * i - 50, [draw() for _ in range(32)], r.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("steps", [None, 1, 2])
def test_matches_brute_force(spark, steps):
    """With few steps most parts are equally near to several entries, and many entries are equal."""
    rows = vectors(230, 4, steps)
    rows += [(1000 + k, rows[0][1], 1) for k in range(120)]
    rows += [(2000, None, 0), (2001, [None] * 32, 0), (2002, [math.nan] + [0.0] * 31, 0), (2003, [math.inf] + [0.0] * 31, 1), (2004, [-math.inf] * 32, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == brute(rows)


def test_query_matches_sql(spark, tmp_path):
    rows = vectors(150, 9, 3)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.query(spark, str(tmp_path)).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == brute(rows)
    sql = duckdb.connect().sql(vector_codes.ORACLE.replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(sql)


@pytest.mark.parametrize("seed", range(6))
def test_tree_search_equals_a_full_scan(seed):
    """Equal distances in every other box: the lowest index wins."""
    r = np.random.default_rng(seed)
    entries, points = r.integers(-3, 4, (64, 4)), r.integers(-4, 5, (500, 4))
    entries[40:50] = entries[5]
    at, far = vector_codes.nearest(vector_codes.build(entries), entries, points)
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (far == d.min(1)).all()


def test_a_box_at_the_best_distance_is_visited():
    """Index 0 lies in the far child, as near as the entry of the near child found first."""
    entries = np.array([[4], [5], [6], [7], [8], [0], [-1], [-2], [-3], [-4]])
    at, far = vector_codes.nearest(vector_codes.build(entries), entries, np.array([[2]]))
    assert (at[0], far[0]) == (0, 4)


def test_few_rows_repeated_ids_and_misfits(spark):
    v = lambda x, n=32: [x] * n
    rows = [(1, v(0.5), 1), (1, v(0.5), 1), (1, v(0.25), 2), (None, v(0.75), None), (7, v(0.1, 31), 1), (8, v(0.1, 16), 2), (9, [], 1), (10, v(3e38), 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    codes, books = vector_codes.compress(df, rounds=0)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.label_errors(codes).collect()), key=str)
    # entries: the smallest vector of vec_id 1, then the null vec_id's; 0.5 lies half way, so the lower index wins
    assert books.entries.shape == (16, 2, 2) and books.entries[0].tolist() == [[64, 64], [192, 192]]
    half = 32 * 64 * 64
    want = [(1, "00" * 16, half, 2 * half)] * 2 + [(1, "00" * 16, 0, 0), (None, "01" * 16, 0, 0), (7, None, None, 2 * half), (8, None, None, 0), (9, None, None, 2 * half), (10, None, None, 0)]
    assert got == sorted(want, key=str)
    back = {r["vec_id"]: r["vector"] for r in vector_codes.decode(codes, books).collect()}
    assert back[None] == [192.5 / 256] * 32 and back[7] is None


def test_nothing_to_code(spark, tmp_path):
    empty = spark.createDataFrame([(1, None, 1), (2, [None], None)], SCHEMA)
    empty.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.query(spark, str(tmp_path)).count() == 0 and vector_codes.compress(empty.limit(0))[1] is None


def test_negative_means_round_down(spark):
    rows = [(0, [-0.5] * 16, 0), (1, [-0.5] * 16, 0), (2, [-0.5 - 1 / 256] * 16, 0)]
    _, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=1)
    assert set(books.entries.ravel().tolist()) == {-129}  # the mean is -128 and a third
