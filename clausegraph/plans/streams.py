"""Queries over the event stream. Each runs a stream over what is there and is held against the same in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.streaming import telemetry as tl

from clausegraph.sources.scratch import scratch

from .registry import query


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.events(spark, f"{sf_dir}/events.parquet")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _window(width: str, every: str) -> str:
    return f"SELECT s AS start, s + INTERVAL {width} AS stop, event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL {every}, ts) - INTERVAL {width} + INTERVAL {every}, time_bucket(INTERVAL {every}, ts), INTERVAL {every})) AS s FROM events) GROUP BY s, event_type"


@query(_window("1 hour", "1 hour"))
def telemetry_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tumbling(batch(spark, sf_dir))


@query(_window("6 hours", "2 hours"))
def telemetry_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.sliding(batch(spark, sf_dir))


@query("""WITH o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 minutes THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL 30 minutes AS stop, user_id, count(*) AS n, sum(value) AS total FROM g GROUP BY user_id, k""")
def telemetry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.sessions(batch(spark, sf_dir))


#: A stream in append mode gives windows that the watermark has passed: all that end two hours before the last event.
@query(f"WITH w AS ({_window('1 hour', '1 hour')}) SELECT * FROM w WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 2 hours")
def telemetry_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.collect(tl.tumbling(stream(spark, sf_dir)), scratch(spark))


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def telemetry_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tail(batch(spark, sf_dir), 100).select("event_id", "ts", "user_id")


@query("SELECT event_id, event_type FROM events")
def telemetry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.collect(tl.distinct_events(stream(spark, sf_dir)), scratch(spark)).select("event_id", "event_type")


@query()
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.limit_rate(batch(spark, sf_dir), 2, 7200)


@query()
def rate_limiter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.collect(tl.limit_rate_stream(stream(spark, sf_dir), 2, 7200), scratch(spark))


@query("""WITH l AS (SELECT user_id, list(least(greatest(value, 0.8), 20.0) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
  SELECT user_id, CAST(len(v) AS INT) AS n, list_reduce(list_transform(v, lambda x, i: {'n': CAST(i AS BIGINT), 'm': CAST(x AS DOUBLE)}), lambda a, b: {'n': b.n, 'm': a.m + CASE WHEN b.n <= 8 THEN 0.25 ELSE 0.12 END * (b.m - a.m)}, {'n': CAST(0 AS BIGINT), 'm': CAST(2.6 AS DOUBLE)}).m AS ema FROM l""")
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.running_mean(batch(spark, sf_dir), 2.6)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(12 + 2.6 * p + CASE WHEN p >= 80 THEN 0.15 * (p - 79) ELSE 0 END, 12), 1200) AS eta FROM (SELECT *, l_quantity * 10 AS p FROM lineitem)")
def eta_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tl.eta(F.col("l_quantity") * 10).alias("eta"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1")
def prepared_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.latest(batch(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id")
