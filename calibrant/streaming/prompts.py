"""Moving averages by key on a stream, in order of event time, with state that outlives the query.

Rows wait in the key's state until the watermark has passed them, and a timer then releases them
in order of (ts, seq), however the files came. The state has a type and a version; rows of an
older version, saved without some of the fields, begin with the defaults of these. State is read
back with the state data source, so that a run can end under one checkpoint and go on under
another, or elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of the stream.
ROWS = "key long, ts timestamp, seq long, reward double, disagreement double, length long"
#: Version 1 had neither the spread nor the length.
VERSION = 2
_FIELDS = {"version": ("int", VERSION), "seen": ("long", 0), "last": ("long", -1), "reward_ema": ("double", 0.0), "spread": ("double", 0.0), "disagreement_ema": ("double", 0.0), "length": ("long", 0)}
STATE = ", ".join(f"{c} {kind}" for c, (kind, _) in _FIELDS.items())
_WAITING = "ts timestamp, seq long, reward double, disagreement double, length long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Averages(StatefulProcessor):
    """WIN-05: times seen, last seq, averages of reward, of its spread (from the updated mean) and of disagreement, last length."""

    def __init__(self, decay: float = 0.9) -> None:
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("prompt", STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        values = [row[c] if c in initialState.columns and not pd.isna(row[c]) else default for c, (_, default) in _FIELDS.items()]
        self.state.update((VERSION, *(float(v) if kind == "double" else int(v) for v, (kind, _) in list(zip(values, _FIELDS.values()))[1:])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for pdf in rows:
            new += [(ts.to_pydatetime(), int(seq), float(r), float(d), int(n)) for ts, seq, r, d, n in pdf[["ts", "seq", "reward", "disagreement", "length"]].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_ms(min(x[0] for x in new)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if _ms(x[0]) <= now]
        if not due:
            return
        _, seen, last, mean, spread, dis, length = self.state.get() if self.state.exists() else tuple(d for _, d in _FIELDS.values())
        for _, seq, r, d, n in due:
            mean = self.decay * mean + (1 - self.decay) * r
            spread = self.decay * spread + (1 - self.decay) * abs(r - mean)
            dis = self.decay * dis + (1 - self.decay) * d
            seen, last, length = seen + 1, seq, n
        self.state.update((VERSION, seen, last, mean, spread, dis, length))
        left = held[len(due) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(_ms(left[0][0]))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"key": [key[0]], "seen": [seen], "last": [last], "reward_ema": [mean], "spread": [spread], "disagreement_ema": [dis], "length": [length]})

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).timestamp() * 1000)


_OUT = "key long, seen long, last long, reward_ema double, spread double, disagreement_ema double, length long"


def averages(stream: DataFrame, late: str, initial: DataFrame | None = None, decay: float = 0.9) -> DataFrame:
    """The keys' averages whenever the watermark lets rows of theirs go; rows that come more than `late` after later ones are dropped."""
    rows = stream.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(Averages(decay), _OUT, "Append", "EventTime", initial.groupBy("key") if initial is not None else None)


def run(stream: DataFrame, sink: str, checkpoint: str, late: str, initial: DataFrame | None = None) -> None:
    """Process what is there and stop; called again with the same checkpoint it goes on with what came since."""
    spark = stream.sparkSession
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # typed state needs it
    try:
        q = averages(stream, late, initial).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def _variable(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def saved(spark: SparkSession, checkpoint: str, decay: float = 0.9) -> DataFrame:
    """STM-12: (key, state) of every key as it stands when all rows that still wait are released too; rows to begin another run with."""
    a, b = F.lit(decay), F.lit(1 - decay)
    state = _variable(spark, checkpoint, "prompt").select(F.col("key.key").alias("key"), F.struct("value.*").alias("s"))
    waiting = _variable(spark, checkpoint, "waiting").select(F.col("key.key").alias("w_key"), F.col("list_element").alias("x")).groupBy("w_key").agg(F.sort_array(F.collect_list(F.struct("x.ts", "x.seq", "x.reward", "x.disagreement", "x.length"))).alias("xs"))  # rows of one watermark delay
    both = state.join(waiting, F.col("key") == F.col("w_key"), "full_outer")
    zero = F.struct(*(F.lit(d).cast(kind).alias(c) for c, (kind, d) in _FIELDS.items()))

    def step(s: Column, x: Column) -> Column:
        mean = a * s["reward_ema"] + b * x["reward"]
        return F.struct(
            s["version"].alias("version"), (s["seen"] + 1).alias("seen"), x["seq"].alias("last"), mean.alias("reward_ema"),
            (a * s["spread"] + b * F.abs(x["reward"] - mean)).alias("spread"), (a * s["disagreement_ema"] + b * x["disagreement"]).alias("disagreement_ema"), x["length"].alias("length"),
        )

    xs = F.coalesce("xs", F.array().cast("array<struct<ts:timestamp,seq:bigint,reward:double,disagreement:double,length:bigint>>"))
    done = both.select(F.coalesce("key", "w_key").alias("key"), F.aggregate(xs, F.coalesce("s", zero), step).alias("s"))
    return done.select("key", "s.*")


def checkpoint_in(folder: str) -> str:
    return f"{folder}/checkpoint-{uuid.uuid4().hex}"
