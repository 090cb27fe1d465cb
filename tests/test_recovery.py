"""Line numbers over splits, versions, resumable evaluation, selection by counting, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from calibrant.errors import StateError
from calibrant.operators import order, selection
from calibrant.sources import files, outcomes, versions


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Files read in splits of 100 bytes: blank, corrupt and long lines, a carriage return, no line feed at the end."""
    r = random.Random(1)
    want = {}
    for k in range(4):
        lines = [r.choice(['{"prompt": "p%d"}' % i, "", "oops", '{"prompt": "%s"}' % ("x" * 300), "a\rb"]) for i in range(60 * k)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + ("\n" if k % 2 else ""))
        for i, x in enumerate(lines if k % 2 or not lines or lines[-1] else lines[:-1]):
            want[f"f{k}", i] = x
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).select(F.regexp_extract("file", r"(f\d)\.jsonl", 1).alias("f"), "idx", "value")
        got = {(x["f"], x["idx"]): x["value"] for x in rows.collect()}
        assert rows.rdd.getNumPartitions() > 20 and got == want
        aligned = files.read_aligned(spark, str(tmp_path), "prompt string").collect()
        assert sum(x["corrupt"] for x in aligned) == sum(not x.startswith("{") for x in want.values())
        first = files.first_valid(spark, str(tmp_path), 5, "prompt string", "prompt", "prompt").collect()
        valid = [v for _, v in sorted(want.items()) if v.startswith("{")]
        assert [f'{{"prompt": "{x["prompt"]}"}}' for x in first] == valid[:5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_results_tree_with_and_without_steps(spark, tmp_path):
    for at in ("teacher/m/aime2024.jsonl", "student_post/a_b/step_50/aime2025.jsonl", "student_post/a_b/plain.jsonl"):
        p = tmp_path / "res" / at
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text('{"v": 1}\n{"v": \n')
    got = {tuple(r) for r in files.read_results_tree(spark, str(tmp_path / "res"), "v int").collect()}
    assert got == {(1, "teacher", "m", None, "2024"), (1, "student_post", "a_b", "step_50", "2025"), (1, "student_post", "a_b", None, None)}


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.newest(spark, path) == (None, None) and versions.if_newer(spark, path, None) == (None, None)
    assert [versions.publish(spark.range(n), path) for n in (3, 5)] == [1, 2]
    got, n = versions.if_newer(spark, path, 1)
    assert (got.count(), n) == (5, 2) and versions.if_newer(spark, path, 2) == (None, 2)
    versions.publish(spark.range(7), path, 2)  # the attempt is repeated
    assert versions.newest(spark, path)[0].count() == 7
    kept = files.truncate_metrics(spark, path, 0) if "step" in got.columns else None
    assert kept is None
    cut = str(tmp_path / "m")
    versions.publish(spark.createDataFrame([(1, 1.0), (5, 2.0), (None, 3.0)], "step int, loss double"), cut)
    for _ in range(2):
        left = files.truncate_metrics(spark, cut, 5)
    assert {r["step"] for r in left.collect()} == {1, None} and versions.newest(spark, f"{cut}_pre_resume_step5")[0].count() == 3


def test_resumed_evaluation_isolates_failures(spark, tmp_path):
    """A bad item fails alone, is tried again, and is left after its attempts; a repeated run replaces itself."""
    from calibrant.session import ship

    ship(spark)

    def fn(pdf):
        for k, a in zip(pdf["k"], pdf["attempt"]):
            if k == 7 or (k == 4 and a < 2):
                raise KeyError(int(k))
        return pdf.assign(y=pdf["k"] + 0.5)

    rows, path = spark.range(20).select(F.col("id").alias("k"), F.lit(2).alias("n_samples")), str(tmp_path / "o")
    done = outcomes.evaluate(spark, rows, path, ["k"], fn, "y double")
    assert outcomes.results(done, ["k"]).count() == 18
    assert sorted(map(tuple, outcomes.dead_letters(done, ["k"]).collect())) == [(4, 1, "KeyError: 4"), (7, 1, "KeyError: 7")]
    for _ in range(2):
        done = outcomes.evaluate(spark, rows, path, ["k"], fn, "y double", run=2)
    assert done.where("run = 2").count() == 2 and {r["k"]: r["y"] for r in outcomes.results(done, ["k"]).collect()} == {k: k + 0.5 for k in range(20) if k != 7}
    for run in (3, 4, 5):
        done = outcomes.evaluate(spark, rows, path, ["k"], fn, "y double", run=run)
    assert sorted(map(tuple, outcomes.dead_letters(done, ["k"]).collect())) == [(7, 3, "KeyError: 7")] and done.where("run > 3").count() == 0
    with pytest.raises(StateError):
        outcomes.evaluate(spark, rows.withColumn("n_samples", F.lit(3)), path, ["k"], fn, "y double")


@pytest.mark.parametrize("n", [0, 1, 7, 100, 299, 300, 301])
def test_first_rows_by_counting(spark, n):
    """Many equal values, negative and huge ones; the next columns choose among equals."""
    r = random.Random(n)
    data = [(r.choice([-1e300, -2.5, 0.0, 0.0, 0.0, 1.0, 1e-9]), r.randrange(5), k) for k in range(300)]
    df = spark.createDataFrame(data, "a double, b int, k long").repartition(4)
    got = sorted((x["a"], x["b"], x["k"]) for x in order.first_rows(df, ["a", "b", "k"], n).collect())
    assert got == sorted(data)[:n]


def picks(spark, n, m, share=0.05, seen=1):
    df = spark.createDataFrame([(k, float(k % 10), seen) for k in range(n)], "k long, v double, seen int")
    rows = selection.select(df, "k", "v", "seen", m, share=share).orderBy("pick").collect()
    assert [r["pick"] for r in rows] == list(range(m)) and {r["k"] for r in rows} <= set(range(n))
    return rows


def test_selection_kinds_caps_and_padding(spark):
    from collections import Counter

    whole = picks(spark, 500, 20)
    assert Counter(r["kind"] for r in whole) == {"high": 16, "coverage": 4} and len({r["k"] for r in whole}) == 20
    # pool of 4m covers all keys, so the highest values are known
    best = picks(spark, 60, 20)
    assert sorted((r["k"] % 10 for r in best if r["kind"] == "high"), reverse=True) == sorted((k % 10 for k in range(60)), reverse=True)[:16]
    assert {r["kind"] for r in picks(spark, 30, 40)} == {"cold"} and {r["kind"] for r in picks(spark, 50, 10, seen=0)} == {"cold"}
    assert picks(spark, 500, 20) == whole and selection.select(spark.createDataFrame([], "k long, v double, seen int"), "k", "v", "seen", 5).count() == 0


class Batches:
    """Stands for a DataFrame: mapInPandas gives the function back."""

    dtypes = [("k", "bigint"), ("attempt", "int")]

    def mapInPandas(self, run, schema):
        return run


@pytest.mark.parametrize("bad,most", [([500], 25), ([0], 25), ([999], 25), (range(3, 1000, 7), 900), (range(1000), 1500), ([], 1)])
def test_failing_items_are_found_in_few_calls(bad, most):
    """Batches of 1,000: halves where something fails, fewer at a time where much does; values stay exact integers beside nulls."""
    import numpy as np
    import pandas as pd

    calls = []

    def fn(pdf):
        calls.append(len(pdf))
        if (pdf["k"] % 1000).isin(list(bad)).any():
            raise ValueError("no")
        return pd.DataFrame({"y": pdf["k"].to_numpy() + 2**53 + 1, "z": [None if k % 2 else "z" for k in pdf["k"]]})

    run = outcomes.isolated(Batches(), ["k"], fn, "y long, z string")
    each = list(run(iter([pd.DataFrame({"k": np.arange(lo, lo + 1000), "attempt": 1}) for lo in (0, 1000)])))
    assert len(calls) <= 2 * most
    got = [r for df in each for r in df.itertuples(index=False)]
    assert sorted(r.k for r in got) == list(range(2000))
    for r in got:
        assert (r.error == "ValueError: no") if r.k % 1000 in bad else (r.error is None and r.y == r.k + 2**53 + 1 and r.z == (None if r.k % 2 else "z"))


def test_items_of_one_file_are_dealt_out(spark, tmp_path):
    from calibrant.session import ship

    ship(spark)
    rows = spark.range(200).coalesce(1).select(F.col("id").alias("k"))
    done = outcomes.evaluate(spark, rows, str(tmp_path / "o"), ["k"], lambda pdf: pdf.assign(y=pdf["k"]), "y long")
    assert done.count() == 200 and done.select(F.input_file_name()).distinct().count() > 2
