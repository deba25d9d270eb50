"""Service monitoring: request metrics, rates by slice, drift of metrics and of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.operators.order_stats import quantiles


def _rates() -> list[Column]:
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return [F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), share(F.col("status") != "ok").alias("error_rate"), share(F.col("status") == "timeout").alias("timeout_rate"), share((F.col("status") == "ok") & (F.col("num_results") == 0)).alias("empty_rate")]


def request_metrics(log: DataFrame, minutes: float) -> DataFrame:
    """Count, latency with p95 and p99, throughput a minute, and rates over all requests; one row."""
    p = quantiles(log, [], "latency_ms", {"p95": 0.95, "p99": 0.99}, interpolate=False)
    return log.agg(*_rates()).join(F.broadcast(p), F.lit(True), "left").withColumn("per_minute", F.round(F.col("n") / minutes, 6))  # one row each


def rates_by(log: DataFrame, *slices: str) -> DataFrame:
    """Rates overall and by each slice column (grouping sets); slice names the column, value its value."""
    sets = [[], *([F.col(s)] for s in slices)]
    g = log.groupingSets(sets, *slices).agg(*_rates(), F.grouping_id().alias("_id"))
    name, value = F.lit("all"), F.lit("all")
    for i, s in enumerate(slices):
        here = F.col("_id") == (2 ** len(slices) - 1) - 2 ** (len(slices) - 1 - i)
        name, value = F.when(here, s).otherwise(name), F.when(here, F.col(s).cast("string")).otherwise(value)
    return g.select(name.alias("slice"), value.alias("value"), "n", "mean_latency", "error_rate", "timeout_rate", "empty_rate")


def drift(current: DataFrame, baseline: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(metric, value) of now against before: drifting where it exceeds the baseline by more than the tolerance."""
    j = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "metric")
    return j.withColumn("drifting", F.col("current") > F.col("baseline") * (1 + tolerance))


def unpivot(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.select(F.expr(f"stack({len(metrics)}, " + ", ".join(f"'{m}', cast({m} as double)" for m in metrics) + ") as (metric, value)"))


def stage_latency(spans: DataFrame, request: str, stage: str, ms: str) -> DataFrame:
    """Share of all latency by stage, and how many requests each stage is the slowest of (ties by name)."""
    share = spans.groupBy(stage).agg(F.sum(ms).alias("total"), F.count("*").alias("n"))
    slow = spans.groupBy(request).agg(F.max_by(stage, F.struct(ms, stage)).alias(stage)).groupBy(stage).agg(F.count("*").alias("slowest_in"))
    total = share.agg(F.sum("total").alias("all"))
    return share.join(slow, stage, "left").crossJoin(F.broadcast(total)).select(stage, "n", F.round(F.col("total").cast("double") / F.col("all").cast("double"), 6).alias("share"), F.coalesce("slowest_in", F.lit(0)).alias("slowest_in"))  # one row of totals


def distribution_drift(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """Shares of each value in two snapshots, with its part of total variation and of the population stability index."""
    share = lambda df, n: df.groupBy(value).agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("t")))).select(value, (F.col("n") / F.col("t")).alias(n))
    j = share(before, "a").join(share(after, "b"), value, "full_outer").select(value, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    psi = F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a")))
    return j.select(value, F.round("a", 6).alias("before"), F.round("b", 6).alias("after"), F.round(F.abs(F.col("a") - F.col("b")) / 2, 6).alias("variation"), F.round(psi, 6).alias("psi"))
