"""Streaming jobs: windowed metrics, sustained alerts, change-data apply, freshness, sessions.

Sources are streams with an event time of type timestamp. Each job is a plan on a streaming DataFrame; `drain` runs one to the
end of what is there (availableNow) and returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ragmill.operators.changes import replay


def windowed_metrics(log: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and their number a minute, mean, approximate p95 and p99 of latency, and rates, by window and tenant."""
    g = log.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "tenant")
    s = g.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency"), F.approx_percentile("latency_ms", F.array(F.lit(0.95), F.lit(0.99))).alias("p"), F.avg((F.col("status") != "ok").cast("double")).alias("error_rate"), F.avg((F.col("status") == "timeout").cast("double")).alias("timeout_rate"), F.avg(((F.col("status") == "ok") & (F.col("num_results") == 0)).cast("double")).alias("empty_rate"))
    per_minute = F.col("n") / ((F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60)
    return s.select(F.col("w.start").alias("window_start"), "tenant", "n", per_minute.alias("per_minute"), "mean_latency", F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"), "error_rate", "timeout_rate", "empty_rate")


def sustained_alerts(log: DataFrame, baseline: float, routes: DataFrame, factor: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """Tenants whose error rate stays above factor times the baseline in all three buckets of a sliding quarter of an hour, and who is to do what.

    routes (tenant, owner, runbook) is a small table, joined to the alerts only; the row with a null tenant stands for tenants that have none of their own.
    """
    bucket = log.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes").alias("b"), "tenant").agg(F.avg((F.col("status") != "ok").cast("double")).alias("rate"))
    slide = bucket.groupBy(F.window(F.window_time("b"), "15 minutes", "5 minutes").alias("w"), "tenant").agg(F.min("rate").alias("lowest"), F.count("*").alias("n_buckets"))
    hot = slide.where((F.col("n_buckets") == 3) & (F.col("lowest") > factor * baseline))
    rest = routes.where("tenant is null").select(F.col("owner").alias("other_owner"), F.col("runbook").alias("other_runbook"), F.lit(1).alias("_1"))
    told = hot.join(F.broadcast(routes.where("tenant is not null")), "tenant", "left").withColumn("_1", F.lit(1)).join(F.broadcast(rest), "_1", "left")
    what = F.concat(F.lit(f"error rate above {factor:g} x {baseline:g} for 15 minutes, "), F.round(F.col("lowest") / baseline, 2).cast("string"), F.lit(" x at least"))
    return told.select(F.col("w.start").alias("window_start"), "tenant", "lowest", F.lit("CRITICAL").alias("severity"), what.alias("what"), F.coalesce("owner", "other_owner").alias("owner"), F.coalesce("runbook", "other_runbook").alias("runbook"))


def latest_changes(events: DataFrame) -> DataFrame:
    """A stream of the objects that a batch has changed (object_id, sequence, operation, after_value), from keyed state.

    events: event_id, object_id, sequence, operation, after_value. The state is one native aggregate: of each object the change with the highest sequence (a tombstone, too, so a late
    update can't bring a row back) and the time of the batch that brought it first. A repeat has the sequence of its first delivery and changes nothing, so no ids are kept, and no event is
    too late. A batch reads and writes the state of its own objects only; of these it tells those whose change is of this batch.
    """
    came = events.withColumn("came", F.current_timestamp())  # one time for all of a batch
    best = F.max(F.struct("sequence", (-F.unix_micros("came")).alias("before"), "operation", "after_value")).alias("l")
    last = came.groupBy("object_id").agg(best).where(F.col("l.before") == -F.unix_micros(F.current_timestamp()))
    return last.select("object_id", "l.sequence", "l.operation", "l.after_value")


#: Provider of state stores that keep states of any size on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_changes(events: DataFrame, target: str, late: str = "1 day", repeat_ms: int = 86_400_000) -> DataStreamWriter:
    """A writer of latest_changes to `target`, a folder v=n for each batch with what the batch has changed.

    What is written follows the batch, not the state; a batch that runs again after a failure writes its own folder again.
    late and repeat_ms stand for callers of before: sequences decide, whatever comes late or again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/v={number}")

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # of the queries that start from now on
    return latest_changes(events).writeStream.outputMode("update").foreachBatch(put)


def state(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """Live rows after a batch, by default the last one: of each object the change with the highest sequence, unless that is a delete."""
    written = spark.read.schema("object_id long, sequence long, operation string, after_value double, v int").parquet(target)
    return replay(written if version is None else written.where(F.col("v") <= version))


def freshness(changed: DataFrame, available: DataFrame, within: str = "90 days", late: str = "1 day") -> DataFrame:
    """Lag of each change (change_id, changed_at) until it is first seen in the index (seen_id, available_at); null if not within the time."""
    c, a = changed.withWatermark("changed_at", late), available.withWatermark("available_at", late)
    on = F.expr(f"change_id = seen_id and available_at >= changed_at and available_at <= changed_at + interval {within}")
    return c.join(a, on, "left_outer").select("change_id", "changed_at", "available_at", (F.unix_timestamp("available_at") - F.unix_timestamp("changed_at")).alias("lag_seconds"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by inactivity."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def drain(df: DataFrame, path: str) -> DataFrame:
    """Run a streaming plan to the end of its source, appending to Parquet at path, and read the result."""
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
