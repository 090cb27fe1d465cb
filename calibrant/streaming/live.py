"""Structured Streaming: windows with watermarks, keyed averages, the staleness queue, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators.state import StaleQueue

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """STM-05: files as they come, a bounded number at a time."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """EXT-01/02/03: counts and sums by tumbling or sliding window and type; rows later than the watermark are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """EXT-04: sessions of a user, closed by a gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def keyed_average(events: DataFrame, decay: float = 0.9) -> DataFrame:
    """WIN-05 on a stream: each user's moving average after every micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema, seen = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            ema, seen = decay * ema + (1 - decay) * v, seen + 1
        state.update((ema, seen))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [ema], "seen": [seen]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ema double, seen long", "ema double, seen long", "update", "NoTimeout")


def stale_queue(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """STM-01/02 on a stream of (key, seq, kind, version): the queue lives in the key's state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        q = StaleQueue(threshold)
        if state.exists:
            q.version, q.rejected, items = state.get
            q.items = list(items)
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = [q(a, int(b)) for a, b in zip(pdf["kind"], pdf["version"])]
        state.update((q.version, q.rejected, q.items))
        yield pd.DataFrame({key: k[0], "seq": pdf["seq"].to_numpy(), "result": [x["result"] for x in out], "age": [x["age"] for x in out]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, seq long, result string, age double", "version int, rejected int, items array<int>", "append", "NoTimeout")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """STM-06/07/11/12: process what is there, batch by batch, from the checkpoint on; a failure stops and raises."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def once_per_batch(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own: a batch that is run again replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


class Snapshots:
    """STM-04: versioned side tables; fetch gives a table only if it is newer."""

    def __init__(self) -> None:
        self.version, self.table = 0, None

    def publish(self, table: DataFrame) -> int:
        self.version, self.table = self.version + 1, table
        return self.version

    def fetch(self, known: int) -> tuple[int, DataFrame | None]:
        return self.version, self.table if self.version > known else None
