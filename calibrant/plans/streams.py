"""Windows over events: the batch side of the streaming operators, and their replay through a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calibrant.plans.views import read
from calibrant.session import shared_dir, ship, table
from calibrant.streaming import live, prompts

QUERIES, ORACLE = {}, {}


def events(s, d):
    return read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def shown(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end") if c in df.columns}).withColumns({c: F.round(c, 4) for c in ("total",) if c in df.columns})


QUERIES["ext02_tumbling"] = lambda s, d: shown(live.windowed(events(s, d), "1 hour"))
ORACLE["ext02_tumbling"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES["ext03_sliding"] = lambda s, d: shown(live.windowed(events(s, d), "2 hours", "1 hour"))
ORACLE["ext03_sliding"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) r(k) GROUP BY 1, 2"
QUERIES["ext04_sessions"] = lambda s, d: live.sessions(events(s, d), "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
ORACLE["ext04_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
i AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM i GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""


def _replay(s, d):
    """Hourly windows of the stream, replayed to its end in complete mode."""
    at = f"{shared_dir(s)}/calibrant/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(live.EVENTS).parquet(f"{d}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    live.run_available(live.windowed(stream, "1 hour"), live.once_per_batch(at, "out"), f"{at}/checkpoint", "complete")
    got = s.read.parquet(f"{at}/out")
    last = got.agg(F.max("batch")).first()[0]
    return shown(got.where(F.col("batch") == last).drop("batch"))


QUERIES["ext01_stream_replay"] = _replay
ORACLE["ext01_stream_replay"] = ORACLE["ext02_tumbling"]


def _resumed(s, d):
    """Averages of all events in order of time: quarters of the time come in the order 1, 0 in one run, and 3, 2 in another one that begins with the first one's saved state."""
    ship(s)
    at = f"{shared_dir(s)}/calibrant/prompts-{uuid.uuid4().hex}"
    e = events(s, d)
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("reward"), (k / 100).alias("disagreement"), k.alias("length"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, span = low or 0, (high or 0) - (low or 0) + 4
    quarter = F.floor((F.unix_micros("ts") - low) * 4 / span)
    late, kept = f"{span // 2_000_000 + 1} seconds", None
    for half in (0, 1):
        for q in (2 * half + 1, 2 * half):
            rows.where(quarter == q).coalesce(1).write.mode("append").parquet(f"{at}/in{half}")
        stream = s.readStream.schema(prompts.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in{half}")
        prompts.run(stream, f"{at}/out{half}", f"{at}/checkpoint{half}", late, kept)
        kept = table(prompts.saved(s, f"{at}/checkpoint{half}"), "saved")
    return kept.select(F.col("key").alias("user_id"), "version", "seen", "last", *(F.round(c, 6).alias(c) for c in ("reward_ema", "spread", "disagreement_ema")), "length")


QUERIES["stm12_resumed_state"] = _resumed
ORACLE["stm12_resumed_state"] = """WITH m AS (SELECT user_id, event_id, ts, value, (props->>'$.k')::BIGINT AS k FROM events), o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS r, list(k / 100e0 ORDER BY ts, event_id) AS d, list(event_id ORDER BY ts, event_id)[-1] AS last, list(k ORDER BY ts, event_id)[-1] AS length FROM m GROUP BY user_id),
e AS (SELECT *, list_transform(range(1, len(r) + 1), lambda n: list_sum(list_transform(r[1:n], lambda x, j: 0.1::DOUBLE * x * pow(0.9::DOUBLE, n - j)))) AS e FROM o)
SELECT user_id, 2::INT AS version, len(r)::BIGINT AS seen, last, round(e[-1], 6) AS reward_ema, round(list_sum(list_transform(r, lambda x, j: 0.1::DOUBLE * abs(x - e[j]) * pow(0.9::DOUBLE, len(r) - j))), 6) AS spread,
  round(list_sum(list_transform(d, lambda x, j: 0.1::DOUBLE * x * pow(0.9::DOUBLE, len(d) - j))), 6) AS disagreement_ema, length FROM e"""
