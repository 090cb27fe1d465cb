"""Fingerprints against brute force: bins, densification, packing, order of documents, correction for chance, odd rows."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from calibrant.llm import fingerprints as fp
from tests.llm.test_operators import ODD, prose

SCHEMA = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    h = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else struct.pack("<i", x[0]) if isinstance(x, tuple) else struct.pack("<q", x)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return signed(h)


def shingles(text):
    ws = [hashed(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {hashed(*ws)} if 0 < len(ws) < 5 else {hashed(*ws[i : i + 5]) for i in range(len(ws) - 4)}


_ORDERS = [sorted(range(256), key=lambda b, i=i: hashed((i,), (b,), "order")) for i in range(256)]


def fingerprint(text):
    bins = {}
    for h in shingles(text):
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    if not bins:
        return ""
    return "".join(f"{bins[next(b for b in [i, *_ORDERS[i]] if b in bins)] & 15:x}" for i in range(256))


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b)) / 256
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def brute(rows):
    rows = sorted(((d is not None, d or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), t or "") for d, t in rows))
    out = []
    for k, (has, d, _, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((d if has else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def result(spark, tmp_path, rows, name="t"):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("packed", F.lit("clash")).withColumn("next", F.lit(1)).withColumn("k", F.lit(2))
    df.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = fp.query(spark, f"{tmp_path}/{name}")
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got.collect())), key=str)


@pytest.mark.parametrize("per_bucket", [1, 4, 512])
def test_matches_brute_force_in_any_number_of_buckets(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(fp, "PER_BUCKET", per_bucket)
    r = random.Random(2)
    rows = [(7 * k - 90, t) for k, t in enumerate(ODD + [prose(r.randrange(1, 300), 90 + k) for k in range(40)])]
    rows += [(500, prose(50, 1)), (500, prose(50, 1)), (500, "other"), (None, prose(40, 5)), (None, None)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_one_row_none_and_repeats(spark, tmp_path):
    assert result(spark, tmp_path, [], "none") == []
    one = [(5, prose(30, 2))]
    got = result(spark, tmp_path, one, "one")
    assert got == brute(one) and got[0][6] == 1.0
    many = [(None, None)] * 40 + [(3, prose(30, 2))] * 30
    assert result(spark, tmp_path, many, "many") == brute(many)


def test_likeness_is_corrected_for_chance(spark):
    """Mean estimates over pairs of known similarity; nothing alike is near 0, not near a sixteenth."""
    pairs, want = [], []
    for k in range(120):
        a = [f"w{k}x{i}" for i in range(400)]
        keep = (0, 100, 300, 400)[k % 4]
        b = a[:keep] + [f"v{k}x{i}" for i in range(400 - keep)]
        pairs.append((k, " ".join(a), " ".join(b)))
        x, y = shingles(pairs[-1][1]), shingles(pairs[-1][2])
        want.append(len(x & y) / len(x | y))
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    table = fp.probes(spark)
    both = fp.with_fingerprint(fp.with_fingerprint(df, "a", "fa", table), "b", "fb", table)
    got = {r["k"]: r["x"] for r in both.select("k", fp.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()}
    for kind in range(4):
        ks = range(kind, 120, 4)
        assert abs(sum(got[k] for k in ks) / 30 - sum(want[k] for k in ks) / 30) < 0.025
    assert all(got[k] == 1.0 for k in range(3, 120, 4))


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    plan = fp.query(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Window [") == plan.count("Window [lead")
