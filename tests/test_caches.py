"""Teacher caches, versions as of a time and sparse summaries against literal and brute-force results."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from calibrant.operators import asof, evaluation, summaries, vocabulary


def blocks(spark, rows, size):
    return vocabulary.blocks_of(spark.createDataFrame([(p, i, float(v)) for p, vs in rows.items() for i, v in enumerate(vs)], "pos long, id long, value double"), size)


@pytest.mark.parametrize("size,k", [(1, 3), (7, 5), (16, 40), (1000, 4)])
def test_cache_over_blocks_equals_whole_rows(spark, size, k):
    """Ties to the lower id, blocks of any size, k beyond the vocabulary, more than one level of merging."""
    r = random.Random(size)
    rl = {p: [r.choice([-1.0, 0.0, 2.5, r.gauss(0, 3)]) for _ in range(300)] for p in range(5)}
    ref = {p: [r.gauss(0, 2) for _ in range(300)] for p in range(5)}
    got = {x["pos"]: x["pairs"] for x in vocabulary.teacher_cache(blocks(spark, rl, size), blocks(spark, ref, size), size, k).collect()}
    for p in range(5):
        z = lambda v: math.log(sum(math.exp(x) for x in v))
        top = sorted(sorted(range(300), key=lambda i: (-rl[p][i], i))[:k])
        assert [x["id"] for x in got[p]] == top
        for x in got[p]:
            a, b = rl[p][x["id"]] - z(rl[p]), ref[p][x["id"]] - z(ref[p])
            assert math.isclose(x["rl"], a, abs_tol=1e-9) and math.isclose(x["ref"], b, abs_tol=1e-9) and math.isclose(x["delta"], a - b, abs_tol=1e-9)


def test_teachers_that_differ_are_refused(spark):
    """Another vocabulary or another number of positions raises, unless consistency is not asked for."""
    a, short, fewer = {0: [1, 2, 3, 4], 1: [1, 2, 3, 4]}, {0: [1, 2, 3, 4], 1: [1, 2, 3]}, {0: [1, 2, 3, 4]}
    for other in (short, fewer):
        with pytest.raises(vocabulary.TeacherMismatch):
            vocabulary.teacher_cache(blocks(spark, a, 2), blocks(spark, other, 2), 2, 2)
    got = vocabulary.teacher_cache(blocks(spark, a, 2), blocks(spark, fewer, 2), 2, 2, consistent=False).collect()
    assert [x["pos"] for x in got] == [0]


def test_newest_version_by_brute_force(spark):
    """Equal times, versions at a row's own time, rows before the first version and without a time."""
    r = random.Random(3)
    versions = [(r.randrange(40), k) for k in range(30)] + [(None, 99)]
    rows = [(k, r.randrange(-5, 45)) for k in range(400)] + [(1000 + k, 20) for k in range(300)] + [(2000, None)]
    got = asof.newest_before(spark.createDataFrame(rows, "id long, t int"), spark.createDataFrame(versions, "t int, version int"), "t", "t", ["version"]).collect()
    assert len(got) == len(rows)
    for x in got:
        known = [v for v in versions if v[0] is not None and x["t"] is not None and v[0] <= x["t"]]
        assert x["version"] == (max(known)[1] if known else None)
    none = spark.createDataFrame([], "t int, version int")
    assert [x["version"] for x in asof.newest_before(spark.createDataFrame(rows[:3], "id long, t int"), none, "t", "t", ["version"]).collect()] == [None] * 3


ROWS = "step long, loss double, n int, ok boolean, phase string, late double"
DATA = [(1, 1.0, None, True, "rollout", None), (2, 3.0, 4, False, "train", 7.0), (3, None, 6, None, None, 9.0)]


def test_summary_of_the_first_rows_keys(spark):
    got = {r["key"]: (r["n"], r["mean"], r["last"]) for r in summaries.mean_and_last(spark.createDataFrame(DATA, ROWS), "step").collect()}
    assert got == {"step": (3, 2.0, 3.0), "loss": (3, 2.0, 3.0)}  # n and late are not in the first row; ok is a boolean


def test_means_of_present_and_of_missing_values(spark):
    df = spark.createDataFrame(DATA, ROWS)
    assert {r["key"]: (r["mean"], r["n"]) for r in summaries.present_means(df, "step").collect()} == {"step": (2.0, 3), "loss": (2.0, 2), "n": (5.0, 2), "late": (8.0, 2)}
    assert {r["key"]: round(r["mean"], 9) for r in summaries.zero_means(df, "step").collect()} == {"step": 2.0, "loss": round(4 / 3, 9), "n": round(10 / 3, 9), "late": round(16 / 3, 9)}
    got = summaries.run_summary(df, "step", ["loss", "absent"], {"n": "n_last", "gone": "n_gone"}).first()
    assert tuple(got) == (2, 2.0, None, 6, None)
    assert summaries.run_summary(df.limit(0), "step", ["loss"], {}).first()["n_steps"] == 0


def test_shares_of_phases_and_percent_of_lines(spark):
    p = spark.createDataFrame([(" Base ",), ("refresh-2",), ("base_refresh",), (None,), ("warm",)], "phase string")
    assert tuple(evaluation.pool_share(p, "phase").first()) == (5, 0.2, 0.4, 0.4, None)
    assert tuple(evaluation.pool_share(p, None).first()) == (5, None, None, None, "no phase column")
    lines = spark.createDataFrame([("a", '{"correct": true}'), ("a", '{"correct": false}'), ("a", "{"), ("b", "oops")], "m string, line string")
    got = {r["m"]: r for r in summaries.accuracy_percent(lines, ["m"]).collect()}
    assert got["a"]["accuracy"] == 50.0 and got["a"]["bad_lines"] == 1 and math.isnan(got["b"]["accuracy"])


def test_top_k_of_equal_values(spark):
    from calibrant.functions import dists

    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "x array<double>")
    assert [p["id"] for p in df.select(dists.top_k(F.col("x"), 3).alias("t")).first()["t"]] == [1, 2, 3]


def test_look_up_in_batches(spark):
    """Supports in any order, empty ones, nulls, ids outside, other columns kept."""
    from calibrant.functions import dists

    data = [(1, [3, 9, 4], [(9, 0.9), (3, 0.3)]), (2, [3], []), (3, [], [(3, 1.0)]), (4, None, [(3, 1.0)]), (5, [3], None), (6, [7, 7], [(6, 0.6), (7, 0.7), (8, 0.8)])]
    df = spark.createDataFrame(data, "k int, ids array<int>, t array<struct<id:int,v:double>>").repartition(2)
    got = {r["k"]: r["v"] for r in dists.look_up(df, "ids", "t", "v", -100.0).collect()}
    assert got == {1: [0.3, 0.9, -100.0], 2: [-100.0], 3: [], 4: None, 5: None, 6: [0.7, 0.7]}
    assert dists.look_up(df, "ids", "t", "v", keep=["k"]).columns == ["k", "v"] and dists.look_up(df.limit(0), "ids", "t", "v").count() == 0
    some = df.where("t is not null and ids is not null")
    assert {r["k"]: r["v"] for r in some.select("k", dists.lookup(F.col("ids"), F.col("t"), -100.0).alias("v")).collect()} == {k: v for k, v in got.items() if v is not None}


def test_result_rows_by_mode(spark):
    """Two problems of three samples: majority, mean and the first sample; a grader of numbers, an answer that none decides."""
    from calibrant.functions import rationals

    rows = [("c", p, i, a, "6", s, 10 * i + p, a in ("6", "12/2")) for p, answers in ((0, ["12/2", "12/2", "7"]), (1, ["7", "6", "7"])) for i, (a, s) in enumerate(zip(answers, ["eos", "loop", "eos"]))]
    rows += [("c", 2, i, None, "6", "budget_stop", 0, False) for i in range(3)]
    df = spark.createDataFrame(rows, "cell string, problem_id int, sample_idx int, answer string, ground_truth string, status string, tokens int, correct boolean")
    get = lambda **kw: evaluation.problem_results(df, ["cell"], **kw).first()
    assert get()["accuracy"] == 0.0 and math.isclose(get(grade=rationals.equal)["accuracy"], 1 / 3) and get()["n"] == 3
    assert math.isclose(get(metric="ave")["accuracy"], (2 / 3 + 1 / 3) / 3) and math.isclose(get(metric="single")["accuracy"], 1 / 3)
    r = get(metric="ave")
    assert math.isclose(r["eos_rate"], 2 / 3) and math.isclose(r["budget_stop_rate"], 1 / 3) and math.isclose(r["no_answer_rate"], 1 / 3)
    with pytest.raises(ValueError):
        get(metric="best")
    voted = {x["problem_id"]: (x["majority_answer"], x["majority_correct"]) for x in evaluation.voted(df, ["cell"], rationals.equal).collect()}
    assert voted == {0: ("12/2", True), 1: ("7", False), 2: (None, False)}


def test_rational_answers(spark):
    """Equal as texts or numbers, unequal, and left open."""
    from calibrant.functions import rationals

    yes = [("1/2", "0.5"), (r"\frac{1}{2}", "0.50"), (r"\dfrac{-3}{6}", "-1/2"), ("1,234", "1234"), ("$5$", "5."), (r"\text{yes}", "yes"), (r"50\%", "50"), ("-.5", r"-\frac{1}{2}"), ("3.000", "3"), (r"\left(1,2\right)", "(1,2)"), ("x+1", "x + 1"), ("90^\\circ", "90"), ("0/5", "0")]
    no = [("1/2", "1/3"), ("3", "-3"), ("0.333", "1/3"), ("yes", "1"), (None, "1"), ("2", None), ("123456789012345678", "123456789012345679")]
    unknown = [("x+1", "1+x"), (r"\sqrt{8}", r"2\sqrt{2}"), ("1/0", "2/0"), ("1" * 30, "2" * 30)]
    df = spark.createDataFrame([*yes, *no, *unknown], "a string, t string")
    got = [r["e"] for r in df.select(rationals.equal(F.col("a"), F.col("t")).alias("e")).collect()]
    assert got == [True] * len(yes) + [False] * len(no) + [None] * len(unknown)


def test_cache_where_teachers_are_asked_equals_tables(spark):
    """The same pairs as from tables of both teachers' logits, for blocks and k of any size; teachers that answer for too few tokens are refused."""
    from calibrant.session import ship

    ship(spark)
    r = random.Random(5)
    data = [(p, *([r.choice([-1.0, 0.0, 2.5, r.gauss(0, 3)]) for _ in range(90)] for _ in range(2))) for p in range(7)]
    rows, tables = spark.createDataFrame(data, "pos long, rl array<double>, ref array<double>"), [{x[0]: x[i] for x in data} for i in (1, 2)]
    said = lambda df: {x["pos"]: [(y["id"], *(round(y[c], 9) for c in ("rl", "ref", "delta"))) for y in x["pairs"]] for x in df.collect()}
    for size, k in ((1, 3), (7, 5), (16, 40), (1000, 100)):
        got = vocabulary.asked_cache(rows, (lambda x, lo, hi: x[:, lo:hi],) * 2, 90, size, k)
        assert said(got) == said(vocabulary.teacher_cache(*(blocks(spark, t, size) for t in tables), size, k))
    with pytest.raises(Exception, match="TeacherMismatch"):
        vocabulary.asked_cache(rows, (lambda x, lo, hi: x[:, lo:hi], lambda x, lo, hi: x[:, lo : hi - 1]), 90, 16, 3).collect()


def test_blocks_of_odd_vectors_without_tables_of_logits(spark, tmp_path):
    """Null, short and repeated vectors, components that are null or not finite, against the SQL; nothing is written on the way."""
    import duckdb

    from calibrant import registry
    from calibrant.session import shared_dir
    from tests.test_queries import canon

    r = random.Random(2)
    vectors = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    vectors[1][3], vectors[3][5], vectors[5][:60], vectors[7], vectors[9], vectors[11] = None, float("nan"), [None] * 60, None, vectors[9][:3], [1.0] * 64
    vectors[4][0], vectors[8][1] = float("inf"), float("-inf")
    rows = [*enumerate(vectors), (0, [r.gauss(0, 1) for _ in range(64)]), (40, vectors[0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    folder = shared_dir(spark).removeprefix("file://") + "/calibrant"
    before = os.listdir(folder) if os.path.isdir(folder) else []
    got = registry.queries()["top01_blocks"](spark, str(tmp_path)).toPandas()
    assert (os.listdir(folder) if os.path.isdir(folder) else []) == before
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert canon(got) == canon(c.sql(registry.oracle_sql()["top01_blocks"]).df())
