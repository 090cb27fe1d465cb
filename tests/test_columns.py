"""Column files: files of the raw layout, parts, pruning, ranges, broken files, round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.sources import columns


def raw(path, n=50, t=3, k=2):
    ids, delta = np.arange(n * t * k, dtype="<i4").reshape(n, t * k), np.linspace(-1, 1, n * t * k, dtype="<f4").reshape(n, t * k)
    lengths = (np.arange(n) * 7 % (t + 1)).astype("<u4")
    for name, x in (("ids_sorted", ids), ("delta_k_sorted", delta), ("lengths", lengths)):
        (path / f"c.{name}.dat").write_bytes(x.tobytes())
    (path / "c.meta.json").write_text(json.dumps({"num_samples": n, "top_k": k, "student": "x"}))
    return ids, delta, lengths


def test_raw_files_by_ranges(spark, tmp_path):
    ids, delta, lengths = raw(tmp_path)
    df = columns.read(spark, str(tmp_path / "c"), bytesPerPartition=500)
    assert df.rdd.getNumPartitions() > 4
    got = df.orderBy("sample_id").collect()
    assert [r["sample_id"] for r in got] == list(range(50)) and [r["ids"] for r in got] == ids.tolist() and [r["response_len"] for r in got] == lengths.tolist()
    assert np.array_equal(np.array([r["delta"] for r in got], "<f4"), delta)


def test_only_files_of_asked_columns_are_opened(spark, tmp_path):
    _, _, lengths = raw(tmp_path)
    (tmp_path / "c.delta_k_sorted.dat").unlink()
    got = columns.read(spark, str(tmp_path / "c"), ["response_len", "sample_id"]).orderBy("sample_id").collect()
    assert [r["response_len"] for r in got] == lengths.tolist()
    with pytest.raises(Exception, match="delta_k_sorted"):
        columns.read(spark, str(tmp_path / "c")).collect()


def test_ranges_choose_the_partitions(spark, tmp_path):
    """Only the range's partitions are made; two ranges of one file in one plan do not meet."""
    raw(tmp_path)
    c = str(tmp_path / "c")
    df = columns.read(spark, c, ["sample_id", "response_len"], bytesPerPartition=40)
    some = columns.read(spark, c, ["sample_id", "response_len"], 7, 20, bytesPerPartition=40)
    assert sorted(r["sample_id"] for r in some.collect()) == list(range(7, 21)) and some.rdd.getNumPartitions() == 3 and df.rdd.getNumPartitions() == 10
    assert df.join(some.select("sample_id"), "sample_id", "left_anti").count() == 36 and df.where("sample_id > 30").join(df.where("sample_id < 40"), "sample_id").count() == 9
    assert columns.read(spark, c, first=45, last=90).count() == 5 and columns.read(spark, c, first=60).count() == 0


@pytest.mark.parametrize("n", [0, 1, 37])
def test_round_trip_in_parts(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("sample_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i + F.col("id")).cast("int")).alias("ids"), F.array(*[F.rand(3).cast("float")] * 6).alias("delta"), (F.col("id") % 4).alias("response_len")).cache()
    prefix = str(tmp_path / "out" / "cache")
    columns.write(rows.repartition(3), prefix, 2, partitions=4)
    meta = json.loads((tmp_path / "out" / "cache.meta.json").read_text())
    assert meta["num_samples"] == n and sum(p["rows"] for p in meta["parts"]) == n
    assert sorted(columns.read(spark, prefix).collect()) == sorted(rows.collect())
    columns.write(rows, prefix, 2, partitions=2)  # overwrites
    assert columns.read(spark, prefix).count() == n


def test_gaps_and_broken_files_are_refused(spark, tmp_path):
    gap = spark.createDataFrame([(0, [1], [1.0], 1), (2, [1], [1.0], 1)], "sample_id long, ids array<int>, delta array<float>, response_len long")
    with pytest.raises(Exception, match="sample_id must rise|are missing"):
        columns.write(gap, str(tmp_path / "gap"), 1, partitions=1)
    raw(tmp_path)
    (tmp_path / "c.lengths.dat").write_bytes(b"\x00" * 40)
    with pytest.raises(Exception, match="ends before"):
        columns.read(spark, str(tmp_path / "c")).collect()
    with pytest.raises(Exception, match="not there"):
        columns.read(spark, str(tmp_path / "none")).collect()
