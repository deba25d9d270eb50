"""Retrieval quality: reciprocal rank, nDCG, coverage, by slice and against gates; errors of numeric guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.operators.order_stats import half_band, running_moments

#: Lower ends of green and of amber (fixed values).
BANDS = {"mrr": (0.9, 0.75), "ndcg": (0.9, 0.75), "coverage": (90.0, 75.0), "answers": (4.5, 4.0)}


def keyword_hits(keywords: DataFrame, results: DataFrame) -> DataFrame:
    """(question_id, keyword) with each result's rank and whether its text holds the keyword, in any case."""
    return keywords.join(results, "question_id").select("question_id", "keyword", "rank", F.lower("text").contains(F.lower("keyword")).cast("int").alias("hit"))


def keyword_scores(keywords: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Per (question, keyword): reciprocal rank over all results, and binary nDCG at k whose ideal has the retrieved hits first."""
    g = keyword_hits(keywords, results).groupBy("question_id", "keyword")
    top = (F.col("hit") == 1) & (F.col("rank") <= k)
    s = g.agg(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(F.when(top, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(top).alias("h"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("h").cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    every = keywords.select("question_id", "keyword").join(s, ["question_id", "keyword"], "left")
    return every.select("question_id", "keyword", F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce(F.when(F.col("h") > 0, F.col("dcg") / ideal), F.lit(0.0)).alias("ndcg"))


def question_scores(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """Per question the mean of both, keywords found and coverage in percent; 0 without keywords."""
    g = scores.groupBy("question_id").agg(F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count_if(F.col("rr") > 0).alias("found"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return questions.join(g, "question_id", "left").select(*questions.columns, F.round(zero(F.col("mrr")), 6).alias("mrr"), F.round(zero(F.col("ndcg")), 6).alias("ndcg"), F.coalesce("found", F.lit(0).cast("long")).alias("found"), F.round(zero(F.col("found") / F.col("n") * 100), 6).alias("coverage"))


def summary(scored: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Means overall and by category."""
    g = scored.groupingSets([[], [F.col(category)]], category)
    return g.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics), F.grouping(category).cast("int").alias("overall"))


def band(value: Column, metric: str) -> Column:
    green, amber = BANDS[metric]
    return F.when(value >= green, "green").when(value >= amber, "amber").otherwise("red")


def golden_metrics(queries: DataFrame, relevant: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """Per query recall and precision at k (precision over k), reciprocal rank over the whole list and whether it is covered; null where unlabelled."""
    hits = results.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "doc_id"])
    h = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("h"), F.min("rank").alias("first"))
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    j = queries.select("query_id").join(n, "query_id", "left").join(h, "query_id", "left")
    known = F.col("n_relevant").isNotNull()
    got = F.coalesce("h", F.lit(0))
    return j.select("query_id", F.when(known, F.round(got / F.col("n_relevant"), 6)).alias("recall"), F.when(known, F.round(got / F.lit(k), 6)).alias("precision"), F.when(known, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)).alias("rr"), F.when(known, got > 0).alias("covered"))


def weakest(slices: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """The slice with the lowest value of each metric, the first in name order on ties."""
    picks = F.array(*(F.struct(F.lit(m).alias("metric"), F.min_by(kind, F.struct(F.col(m), F.col(kind))).alias("slice"), F.min(m).alias("value")) for m in metrics))
    return slices.agg(picks.alias("p")).select(F.inline("p"))


def compare(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, value) of two runs with the relative change."""
    j = baseline.withColumnRenamed("value", "baseline").join(new.withColumnRenamed("value", "new"), "metric", "full_outer")
    return j.select("metric", "baseline", "new", F.round(F.when(F.col("baseline") != 0, F.col("new") / F.col("baseline") - 1), 6).alias("change"))


def price_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """df with the absolute error and its colour."""
    e = F.abs(F.col(guess) - F.col(truth))
    share = F.when(F.col(truth) != 0, e / F.abs(truth)).otherwise(F.when(e == 0, 0.0).otherwise(float("inf")))
    return df.withColumn("error", e).withColumn("colour", F.when((e < 40) | (share < 0.2), "green").when((e < 80) | (share < 0.4), "orange").otherwise("red"))


def error_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean error, mean squared error, r squared (in percent of 1) and share of green, in one pass."""
    y, d = F.col(truth), F.col(truth) - F.col(guess)
    s = price_errors(df, truth, guess).agg(F.count("*").alias("n"), F.avg("error").alias("mae"), F.avg(d * d).alias("mse"), F.var_pop(y).alias("v"), F.avg((F.col("colour") == "green").cast("double")).alias("hit"))
    return s.select("n", F.round("mae", 4).alias("mean_error"), F.round("mse", 3).alias("mse"), F.round(1 - F.col("mse") / F.col("v"), 6).alias("r2"), F.round("hit", 6).alias("share_green"))


def running_error(df: DataFrame, by: str, order: list[str], error: str) -> DataFrame:
    """Running mean and 95 % band of an error in row order within each series; the band is 0 at the first row. A long series is spread over many tasks."""
    r = running_moments(df, by, order, error)
    return r.select(*df.columns, F.col("run_mean").alias("mean_error"), half_band(F.col("run_n"), F.col("run_m2")).alias("band"))
