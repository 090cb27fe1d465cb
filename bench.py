"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.stdout.flush()
_OUT = os.dup(1)
os.dup2(2, 1)  # whatever else prints goes to stderr

HEADLINE = [
    "agg20_correlate", "agg03_majority", "agg05_sample_results", "agg06_length_stats", "agg15_signal_stats", "agg16_signal_by_position", "agg21_budget_auc", "agg26_policy_loss",
    "agg31_k_calibration", "join02_support_lookup", "join05_three_way", "str01_extract_answer", "arr02_tail_loop", "win05_prompt_state", "ext02_tumbling",
]


def _median(run, times: int = 3) -> float:
    took = []
    for _ in range(times):
        began = time.time()
        run()
        took.append(time.time() - began)
    return round(statistics.median(took[1:]), 3)  # the first warms up


def _at_scale(spark, sf: str) -> dict[str, float]:
    """The two operations with published figures, over tens of millions of values: embeddings replicated with noise.

    As in those figures the differences and both supports are there beforehand, in files.
    """
    from pyspark.sql import functions as F

    from calibrant.functions import dists
    from calibrant.operators import stats
    from calibrant.session import table

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(159)))
    wide = e.select("vec_id", "x", copies.alias("copy")).repartition(16).select("vec_id", F.transform("x", lambda v, i: v + F.sin(i * 7 + F.col("copy") * 13 + F.col("vec_id"))).alias("d"))
    deltas = table(wide, "deltas")
    n = deltas.count() * 64
    scan = deltas.select(F.explode("d").alias("delta"))
    out = {"delta_values": n, "delta_s": _median(lambda: stats.signal_stats(scan, "delta", []).collect())}
    out["delta_values_per_s"] = round(n / out["delta_s"])
    # supports of k out of 5k ids, in order of id, and as many ids to look up, a fifth of them there
    rows = deltas.count()
    for k in (32, 64, 128, 256):
        at = lambda salt: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i * 5 + F.pmod(F.xxhash64("vec_id", i, F.lit(salt)), F.lit(5))).cast("int"))  # noqa: B023, E731
        pairs = table(deltas.select(at(1).alias("ids"), F.transform(at(2), lambda i: F.struct(i.alias("id"), (i / F.lit(7.0)).alias("v"))).alias("t")), "pairs")
        looked = dists.look_up(pairs, "ids", "t", "v", keep=[])
        took = _median(lambda: looked.write.format("noop").mode("overwrite").save())  # noqa: B023
        out |= {f"lookup_k{k}_s": took, f"lookup_k{k}_positions_per_s": round(rows / took)}
    out["lookup_positions"] = rows
    return out


def main() -> None:
    from calibrant import registry
    from calibrant.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        took[name] = _median(lambda name=name: queries[name](spark, sf).write.format("noop").mode("overwrite").save())
    line = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "at_scale": _at_scale(spark, sf)}
    os.write(_OUT, (json.dumps(line) + "\n").encode())
    spark.stop()


if __name__ == "__main__":
    main()
