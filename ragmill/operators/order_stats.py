"""Exact order statistics and running moments without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.sources.tables import kept, small_side

#: Buckets of an interval in a round.
BUCKETS = 1024


def _ranks(df: DataFrame, by: list[str], value: str, positions: DataFrame) -> DataFrame:
    """positions (by, rank from 0) with the value that stands there in its group's order.

    Each round cuts the interval in which a wanted value lies into BUCKETS of equal width, counts the rows in each, and goes on in the bucket that holds
    the rank, from the smallest to the largest value seen in it. Counts are summed in the tasks that read the rows, so a group of all rows is no single task; what is shuffled
    are at most BUCKETS counts an interval and task. All groups and ranks go through the rounds together.
    """
    x = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = x.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = kept(positions.join(ends, by).select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below")), "ranks")
    while not (open_ := state.where("lo < hi")).isEmpty():
        spans = small_side(open_.select(*by, "lo", "hi").distinct(), "spans")
        at = F.floor((F.col("v") * 0.5 - F.col("lo") * 0.5) / (F.col("hi") * 0.5 - F.col("lo") * 0.5) * BUCKETS)  # halves: no overflow
        inside = x.join(spans, by).where("v between lo and hi").withColumn("bucket", F.least(at, F.lit(BUCKETS - 1)))
        counts = inside.groupBy(*by, "lo", "hi", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("bucket")))  # BUCKETS rows at most
        met = open_.join(upto, [*by, "lo", "hi"]).where((F.col("below") + F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("upto")))
        closer = met.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"))
        state = kept(state.where("lo = hi").unionByName(closer), "ranks")
    return state.select(*by, "rank", F.col("lo").alias("value"))


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], interpolate: bool = True) -> DataFrame:
    """by and a column for each point (name: share): exact quantiles of the values that aren't null or NaN, as doubles.

    With interpolate a quantile lies between its two neighbours by position (n - 1) * share; else it is the value at place min(n - 1, floor(n * share)) from 0. Groups
    without values have no row; without `by`, all rows are one group.
    """
    whole = not by
    if whole:
        df, by = df.withColumn("_g", F.lit(0)), ["_g"]
    n = kept(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n")), "counts")
    place = (lambda p: (F.col("n") - 1) * F.lit(p)) if interpolate else (lambda p: F.least(F.col("n") - 1, F.floor(F.round(F.col("n") * F.lit(p), 9))).cast("double"))
    asked = n.select(*by, F.inline(F.array(*(F.struct(F.lit(name).alias("name"), place(p).alias("place")) for name, p in points.items()))))
    asked = asked.select(*by, "name", "place", F.floor("place").cast("long").alias("first"), F.ceil("place").cast("long").alias("second"))
    ranks = asked.select(*by, F.explode(F.array_distinct(F.array("first", "second"))).alias("rank")).distinct()
    found = _ranks(df, by, value, ranks)
    side = lambda rank, name: found.select(*by, F.col("rank").alias(rank), F.col("value").alias(name))
    both = asked.join(side("first", "a"), [*by, "first"]).join(side("second", "b"), [*by, "second"])
    q = F.when(F.col("first") == F.col("second"), F.col("a")).otherwise((F.col("second") - F.col("place")) * F.col("a") + (F.col("place") - F.col("first")) * F.col("b"))
    out = both.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, q)).alias(name) for name in points))
    return out.drop("_g") if whole else out


def running_moments(df: DataFrame, by: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with run_n, run_mean and run_m2 (sum of squared distances from the mean) of the values up to each row of its series, in order.

    Rows are cut into ranges of (by, order), so a long series lies in many tasks. Each range runs on its own; the moments of the ranges before it in the same series, one row for
    each, are added up and merged in. order must be total within a series, as ties run in any order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(by, "_part").agg(F.count(value).alias("_tn"), F.sum(F.col(value).cast("double")).alias("_ts"), F.avg(value).alias("_tmean"), (F.var_pop(value) * F.count(value)).alias("_tm2"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges that the series is in
    whole = Window.partitionBy(by)
    shift = F.sum("_ts").over(whole) / F.sum("_tn").over(whole)  # distances from the mean of the series keep the sums small
    t = totals.where("_tn > 0").withColumn("_shift", shift).withColumn("_d", F.col("_tmean") - F.col("_shift"))
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    t = t.select(by, "_part", "_shift", summed(F.col("_tn").cast("double")).alias("_n0"), summed(F.col("_ts")).alias("_sum0"), summed(F.col("_tn") * F.col("_d")).alias("_d0"), summed(F.col("_tm2") + F.col("_tn") * F.col("_d") * F.col("_d")).alias("_s0"))
    mean0 = F.when(F.col("_n0") > 0, F.col("_d0") / F.col("_n0") + F.col("_shift")).otherwise(F.lit(0.0))
    m20 = F.when(F.col("_n0") > 0, F.col("_s0") - F.col("_d0") * F.col("_d0") / F.col("_n0")).otherwise(F.lit(0.0))
    ahead = small_side(t.select(by, "_part", "_n0", "_sum0", mean0.alias("_mean0"), m20.alias("_m20")), "ahead")
    run = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = lambda c: F.coalesce(c.over(run), F.lit(0.0))
    rows = ranged.withColumns({"_n": F.count(value).over(run).cast("double"), "_sum": told(F.sum(F.col(value).cast("double"))), "_mean": told(F.avg(value)), "_var": told(F.var_pop(value))})
    j = rows.join(ahead, [by, "_part"], "left").fillna(0.0, ["_n0", "_sum0", "_mean0", "_m20"])
    n, gap = F.col("_n0") + F.col("_n"), F.col("_mean") - F.col("_mean0")
    m2 = F.col("_m20") + F.col("_n") * F.col("_var") + F.when((F.col("_n0") > 0) & (F.col("_n") > 0), gap * gap * F.col("_n0") * F.col("_n") / n).otherwise(0.0)
    return j.select(*df.columns, n.cast("long").alias("run_n"), F.when(n > 0, (F.col("_sum0") + F.col("_sum")) / n).alias("run_mean"), F.when(n > 0, m2).alias("run_m2"))


def half_band(n: Column, m2: Column) -> Column:
    """Half the width of the 95 % band of a mean; 0 for a single value."""
    return F.when(n > 1, 1.96 * F.sqrt(F.greatest(m2, F.lit(0.0)) / n) / F.sqrt(n)).otherwise(0.0)
