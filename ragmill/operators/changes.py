"""Change data: replay, refresh of a derived index, histories, consistency, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.operators.order_stats import quantiles
from ragmill.sources.tables import kept, scratch


def day_before(c: Column) -> Column:
    return F.date_sub(c, 1)


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Intervals are closed on both ends; an open end is null."""
    return (day >= start) & (end.isNull() | (day <= end))


def replay(events: DataFrame, upto: Column | None = None, base: DataFrame | None = None) -> DataFrame:
    """State of each object after the delivered events: the after-image with the highest sequence, unless that is a delete.

    Images are full and older sequences are discarded, so the highest sequence decides whatever the order and number of
    deliveries: one partial aggregate. base holds (object_id, after_value) from before all events.
    """
    seen = events if upto is None else events.where(upto)
    rows = seen.select("object_id", "sequence", "operation", "after_value")
    if base is not None:
        rows = rows.unionByName(base.select("object_id", F.lit(-1).cast("long").alias("sequence"), F.lit("upsert").alias("operation"), "after_value"))
    last = rows.groupBy("object_id").agg(F.max_by(F.struct("operation", "after_value"), "sequence").alias("l"), F.max("sequence").alias("sequence"))
    return last.where("l.operation <> 'delete'").select("object_id", "sequence", F.col("l.after_value").alias("value"))


def anomalies(events: DataFrame) -> DataFrame:
    """Counts of repeated deliveries, of stale events, and of applied upserts and deletes, in delivery order."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("delivery_pos")) == 1
    once = events.withColumn("first", first)
    before = Window.partitionBy("object_id").orderBy("delivery_pos").rowsBetween(Window.unboundedPreceding, -1)
    known = F.max(F.when(F.col("first"), F.col("sequence"))).over(before)
    e = once.withColumn("stale", F.col("first") & F.coalesce(F.col("sequence") < known, F.lit(False)))
    applied = F.col("first") & ~F.col("stale")
    one = e.agg(F.count_if(~F.col("first")).alias("duplicate"), F.count_if("stale").alias("stale"), F.count_if(applied & (F.col("operation") == "upsert")).alias("upsert"), F.count_if(applied & (F.col("operation") == "delete")).alias("delete"))
    return one.select(F.expr("stack(4, 'duplicate', duplicate, 'stale', stale, 'upsert', upsert, 'delete', delete) as (kind, n)"))


def refresh_actions(source: DataFrame, index: DataFrame) -> DataFrame:
    """What each source id needs: DELETE, INSERT, UPDATE, META or NOOP, in this precedence; orphans are deleted.

    Only keys and versions are joined; vectors and texts are attached to the few rows that need them.
    """
    s = source.select("source_id", F.col("content_version").alias("sv"), F.col("access_group").alias("sa"), "deleted", F.lit(True).alias("in_s"))
    i = index.select("source_id", F.col("content_version").alias("iv"), F.col("access_group").alias("ia"), "status", F.lit(True).alias("in_i"))
    j = s.join(i, "source_id", "full_outer")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    action = (
        F.when(F.col("in_s").isNull(), F.when(active, "DELETE_ORPHAN"))
        .when(F.col("deleted"), F.when(active, "DELETE"))
        .when(F.col("in_i").isNull(), "INSERT")
        .when(F.col("sv") != F.col("iv"), "UPDATE")
        .when(F.col("sa") != F.col("ia"), "META")
        .otherwise("NOOP")
    )
    return j.select("source_id", action.alias("action"), "sv", "sa", "iv", "ia", "status").where("action is not null")


def refreshed(actions: DataFrame, index: DataFrame) -> DataFrame:
    """The index after the actions. A tombstone stays one, even if its source is live again."""
    j = index.join(actions.select("source_id", "action", "sv", "sa"), "source_id", "full_outer")
    gone = F.col("action").isin("DELETE", "DELETE_ORPHAN")
    return j.select(
        "source_id", F.when(F.col("action").isin("INSERT", "UPDATE"), F.col("sv")).otherwise(F.col("content_version")).alias("content_version"),
        F.when(F.col("action").isin("INSERT", "UPDATE", "META"), F.col("sa")).otherwise(F.col("access_group")).alias("access_group"),
        F.when(gone, "deleted").when(F.col("action") == "INSERT", "active").otherwise(F.col("status")).alias("status"), F.coalesce("model", F.lit("m1")).alias("model"),
    )


def rebuild_decision(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Whether a full rebuild is due: any condition holds for the table."""
    one = df.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()))
    reasons = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in conditions)))
    return one.select((F.size(reasons) > 0).alias("rebuild"), F.array_join(reasons, ",").alias("reasons"))


def consistency(source: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """(check, source_id) of each violation between a source and its index."""
    live, active = source.where("not deleted"), index.where("status = 'active'")
    check = lambda name, df: df.select(F.lit(name).alias("check"), "source_id")
    both = active.alias("i").join(live.alias("s"), "source_id")
    parts = [
        check("missing_vectors", live.join(active, "source_id", "left_anti")),
        check("orphaned_vectors", active.join(source, "source_id", "left_anti")),
        check("metadata_mismatch", both.where("i.access_group <> s.access_group or i.content_version <> s.content_version")),
        check("model_mismatch", active.where(F.col("model") != model)),
        check("undeleted", active.join(source.where("deleted"), "source_id", "left_semi")),
        check("duplicate_vectors", active.groupBy("source_id").count().where("count > 1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def counts(violations: DataFrame, checks: list[str]) -> DataFrame:
    """(metric, value) of each check, 0 where nothing is violated."""
    return violations.groupBy().agg(*(F.count_if(F.col("check") == c).alias(c) for c in checks)).select(F.expr(f"stack({len(checks)}, " + ", ".join(f"'{c}', {c}" for c in checks) + ") as (metric, value)"))


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics above their threshold (metric, most, severity, owner), with PAGE before WARN; names that start with _ are ignored."""
    j = metrics.join(F.broadcast(thresholds), "metric").where((F.col("value") > F.col("most")) & ~F.col("metric").startswith("_"))
    return j.select("metric", "value", "most", "severity", "owner", F.when(F.col("severity") == "PAGE", 0).otherwise(1).alias("urgency"))


def operational(index: DataFrame, source: DataFrame) -> DataFrame:
    """Vectors that aren't deleted and have their source's current version; unknown sources go."""
    return index.where("status <> 'deleted'").join(source.select("source_id", F.col("content_version").alias("current")), "source_id").where("content_version = current").drop("current")


def resolve(index: DataFrame, source: DataFrame) -> DataFrame:
    """Vectors with their source's version; known = false for those without a source."""
    return index.join(source.select("source_id", F.col("content_version").alias("current"), F.lit(True).alias("k")), "source_id", "left").withColumn("known", F.col("k").isNotNull()).drop("k")


def compacted(index: DataFrame) -> DataFrame:
    return index.where("status <> 'deleted'")


def point(spark: SparkSession, path: str, version: int) -> None:
    """Let the pointer name another live version; the history of pointers stays."""
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def pointed(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max_by("version", "at")).first()[0]


def live(spark: SparkSession, root: str) -> DataFrame:
    """The version of an index that its pointer names."""
    return spark.read.parquet(f"{root}/v={pointed(spark, f'{root}/pointer')}")


def incident(detected: DataFrame, after: DataFrame, restored: DataFrame, version: int) -> DataFrame:
    """One row on record: violations found (JSON by check), the version gone back to, its active rows, tombstones dropped, violations left."""
    found = detected.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("detected"))  # a row for each check
    state = restored.agg(F.count_if(F.col("status") == "active").alias("restored_active"), F.count_if(F.col("status") == "deleted").alias("tombstones_compacted"))
    rest = after.agg(F.sum("value").alias("violations_left"))
    return found.crossJoin(state).crossJoin(rest).withColumn("rolled_back_to", F.lit(version))  # one row each


def snapshot_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only in a, only in b, or with other content (compared by hash)."""
    digest = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*(c for c in df.columns if c != key))), 256).alias(n))
    j = digest(a, "ha").join(digest(b, "hb"), key, "full_outer")
    return j.select(key, F.when(F.col("hb").isNull(), "only_a").when(F.col("ha").isNull(), "only_b").when(F.col("ha") != F.col("hb"), "changed").alias("diff")).where("diff is not null")


def edges(tables: dict[str, DataFrame], catalog: list[tuple[str, str, str, str]]) -> DataFrame:
    """Edges (relation, from_id, to_id) that foreign keys imply; the catalogue has (relation, table, key, foreign key), an array giving one edge for each item."""
    out = None
    for relation, name, key, foreign in catalog:
        df = tables[name]
        target = F.explode(foreign) if dict(df.dtypes)[foreign].startswith("array") else F.col(foreign)
        rows = df.select(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("from_id"), target.cast("string").alias("to_id")).where("to_id is not null")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def history(log: DataFrame, key: str, at: str, sequence: str, value: str) -> DataFrame:
    """Validity intervals from a change log: the last change of a day counts, equal neighbours merge, an interval ends the day before the next."""
    daily = log.withColumn("day", F.to_date(at)).groupBy(key, "day").agg(F.max_by(value, sequence).alias("value"))
    w = Window.partitionBy(key).orderBy("day")
    first = daily.withColumn("before", F.lag("value").over(w)).withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before")))
    return first.select(key, "value", F.col("day").alias("valid_from"), day_before(F.lead("day").over(w)).alias("valid_to"))


def as_of(spans: DataFrame, probes: DataFrame, key: str, day: str) -> DataFrame:
    """The row of spans that is valid on each probe's day."""
    return probes.join(spans, key).where(valid_on(F.col(day), F.col("valid_from"), F.col("valid_to")))


def version_before(versions: DataFrame, probes: DataFrame, key: str, sequence: str, upto: str) -> DataFrame:
    """The last version of each probe's key with a sequence up to the probe's."""
    j = probes.join(versions, key).where(F.col(sequence) <= F.col(upto))
    return j.groupBy(*probes.columns).agg(F.max_by(F.struct(*(c for c in versions.columns if c != key)), sequence).alias("v")).select(*probes.columns, "v.*")


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent, child[foreign] == parent[key], "left_anti")


def overlapping(spans: DataFrame, key: str) -> DataFrame:
    """Keys of which two intervals overlap or which have not exactly one open interval."""
    w = Window.partitionBy(key).orderBy("valid_from")
    s = spans.withColumn("next", F.lead("valid_from").over(w))
    g = s.groupBy(key).agg(F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.count_if(F.col("next") <= F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).alias("n_overlaps"))
    return g.where("n_open <> 1 or n_overlaps > 0")


def chain_tops(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """The top of each node's chain of parents by pointer doubling, which takes log2(depth) joins; null for nodes on or above a cycle.

    Rounds end when no pointer moves. Pointers on a cycle may move for ever, but as many rounds as the count of nodes has binary digits
    reach the root of any chain. Each round is written, so plans don't grow.
    """
    spark = nodes.sparkSession
    up = nodes.select(F.col(key).alias("node"), F.coalesce(parent, key).alias("top"))
    for _ in range(nodes.count().bit_length()):
        path = scratch(spark, "chain")
        step = up.join(up.select(F.col("node").alias("top"), F.col("top").alias("next")), "top", "left")
        step.select("node", F.coalesce("next", "top").alias("top"), F.coalesce(F.col("next") != F.col("top"), F.lit(False)).alias("moved")).write.parquet(path)
        step = spark.read.parquet(path)
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    roots = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("top"), F.lit(True).alias("is_root"))
    return up.join(roots, "top", "left").select("node", F.when(F.col("is_root"), F.col("top")).alias("top"))


def erase(df: DataFrame, subjects: DataFrame, key: str, blank: list[str]) -> DataFrame:
    """df with the listed fields of erased subjects blanked; ids stay."""
    j = df.join(subjects.select(F.col(key), F.lit(True).alias("_gone")).distinct(), key, "left")
    return j.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in blank else F.col(c) for c in df.columns))


def residue(df: DataFrame, subjects: DataFrame, key: str, blank: list[str]) -> DataFrame:
    """How many values of erased subjects are left in each field."""
    j = df.join(subjects.select(key).distinct(), key, "left_semi")
    return j.agg(*(F.count(c).alias(c) for c in blank)).select(F.expr(f"stack({len(blank)}, " + ", ".join(f"'{c}', {c}" for c in blank) + ") as (field, n_left)"))


def freshness(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """By change class: changes, those available, median and p95 lag in hours, share within its target, share available."""
    lag = changes.withColumn("lag", F.timestamp_diff("SECOND", F.col("changed_at"), F.col("available_at")) / 3600.0)
    lag = kept(lag.join(F.broadcast(targets), "change_class").select("change_class", "lag", "target_hours"), "lags")
    s = lag.groupBy("change_class").agg(F.count("*").alias("n"), F.count("lag").alias("n_available"), F.avg((F.col("lag") <= F.col("target_hours")).cast("double")).alias("within"))
    s = s.join(quantiles(lag, ["change_class"], "lag", {"p50": 0.5, "p95": 0.95}), "change_class", "left")
    return s.select("change_class", "n", "n_available", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("within", 6).alias("share_within"), F.round(F.col("n_available") / F.col("n"), 6).alias("share_available"))


def field_diffs(df: DataFrame, key: str, version: list[str], fields: list[str]) -> DataFrame:
    """For each version after the first: fields that differ from the one before, with old and new value; "no change" if none."""
    w = Window.partitionBy(key).orderBy(*version)
    j = df.withColumn("_old", F.lag(F.struct(*fields)).over(w)).where("_old is not null")
    item = lambda f: F.when(~F.col(f).eqNullSafe(F.col(f"_old.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_old.{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new")))
    none = F.array(F.struct(F.lit("no change").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    found = F.array_compact(F.array(*(item(f) for f in fields)))
    return j.select(key, *version, F.inline(F.when(F.size(found) > 0, found).otherwise(none)))
