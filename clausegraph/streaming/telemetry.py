"""Telemetry as a stream: windows with late data, sessions, rate limits, running means.

Each function takes a streaming or batch frame of events (event_id, ts, user_id, event_type, value, props). `collect`
runs a stream over what is there now and gives its result as a table, for tests and scheduled jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet event files of a folder, or of one file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = spark.readStream.schema(EVENT.replace("timestamp", "timestamp_ntz"))
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        files, path = files.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return files.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines; lines that don't parse are counted by a null event_id."""
    return spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").json(path)


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _windowed(rows.withWatermark("ts", late), F.window("ts", width))


def sliding(rows: DataFrame, width: str = "6 hours", every: str = "2 hours", late: str = "2 hours") -> DataFrame:
    return _windowed(rows.withWatermark("ts", late), F.window("ts", width, every))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, stop, user_id, n, total of runs of a user's events that are less than the gap apart."""
    got = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n", "total")


def _windowed(rows: DataFrame, window: Column) -> DataFrame:
    got = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total", "most")


def distinct_events(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it was sent within the lateness bound."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n events, n between 1 and 1000."""
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(max(1, min(1000, n)))


def limit_rate(rows: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """event_id, user_id, allowed: at most `most` allowed requests of a user in any `seconds`; refused ones don't count.

    Whether a request is allowed depends on the decisions before it, so a user's requests are folded in order of (ts,
    event_id). State is the allowed times of the window, at most `most` of them; rows are read in batches, never a whole
    user at once."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, log = None, []
        for frame in frames:
            out = []
            for u, t in zip(frame["user_id"], frame["us"]):
                if u != user:
                    user, log = u, []
                log = [x for x in log if t - x < seconds * 1_000_000]
                ok = len(log) < most
                if ok:
                    log.append(t)
                out.append(ok)
            yield pd.DataFrame({"event_id": frame["event_id"], "user_id": frame["user_id"], "allowed": out})

    ordered = rows.select("event_id", "user_id", F.unix_micros("ts").alias("us")).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return ordered.mapInPandas(fold, "event_id long, user_id long, allowed boolean")


def limit_rate_stream(rows: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """The same on a stream, with the log of each user as state. Events of a batch are taken in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for t in frame["us"]:
            log = [x for x in log if t - x < seconds * 1_000_000]
            out.append(len(log) < most)
            if out[-1]:
                log.append(int(t))
        state.update((log,))
        yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "allowed": out})

    got = rows.select("event_id", "user_id", F.unix_micros("ts").alias("us")).groupBy("user_id")
    return got.applyInPandasWithState(fold, "event_id long, user_id long, allowed boolean", "log array<long>", "append", GroupStateTimeout.NoTimeout)


def running_mean(rows: DataFrame, seed: float, fast: float = 0.25, slow: float = 0.12, early: int = 8, low: float = 0.8, high: float = 20.0) -> DataFrame:
    """user_id, n, ema: the values, clamped, folded into an exponential mean that starts from a prior; the first samples weigh more."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.least(F.greatest(x["value"], F.lit(low)), F.lit(high)))
    got = rows.groupBy("user_id").agg(ordered.alias("values"))
    start = F.struct(F.lit(0).alias("n"), F.lit(float(seed)).alias("m"))
    step = lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["m"] + F.when(a["n"] < early, fast).otherwise(slow) * (v - a["m"])).alias("m"))
    return got.select("user_id", F.size("values").alias("n"), F.aggregate("values", start, step, lambda a: a["m"]).alias("ema"))


def eta(pages: Column) -> Column:
    """Seconds a document of so many pages is expected to take before there are samples: within 12 and 1200."""
    return F.least(F.greatest(12 + 2.6 * pages + F.when(pages >= 80, 0.15 * (pages - 79)).otherwise(0.0), F.lit(12.0)), F.lit(1200.0))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what an index holds after upserts."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def collect(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over the input there is now, into Parquet files under `path`, and reads them."""
    out = f"{path}/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")
