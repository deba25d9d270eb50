"""Feature building and simple regressors for prices and qualities."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, HashingTF, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.operators.evaluate import error_report
from ragmill.sources.tables import kept

#: Rows times words in a task that grows trees: MLlib keeps every row at the vocabulary's full width and reads some 12 bytes a cell, so this is about 50 MB.
TREE_CELLS = 4_000_000


def tabular(df: DataFrame, weight: str, text: str) -> DataFrame:
    """weight, weight_unknown (it is 0) and text_length of each row."""
    return df.withColumn("weight", F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).withColumn("weight_unknown", (F.col("weight") == 0).cast("int")).withColumn("text_length", F.length(F.coalesce(text, F.lit(""))))


def mean_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """The training mean as guess for every row."""
    return test.crossJoin(F.broadcast(train.agg(F.avg(target).alias("guess"))))  # one row


def linear(train: DataFrame, features: list[str], target: str):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol=target, predictionCol="guess")]).fit(train)


def word_vectors(text: str, size: int = 2000) -> list:
    """Stages that count the most frequent words without stop words."""
    return [RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[^\p{L}\d]+"), StopWordsRemover(inputCol="tokens", outputCol="kept"), CountVectorizer(inputCol="kept", outputCol="features", vocabSize=size)]


def bag_of_words(train: DataFrame, text: str, target: str, size: int = 2000):
    return Pipeline(stages=[*word_vectors(text, size), LinearRegression(labelCol=target, predictionCol="raw", regParam=0.1)]).fit(train)


def hashed(df: DataFrame, text: str, target: str, width: int = 5000) -> DataFrame:
    """Binary hashed words, and the target as standardised log1p with the mean and deviation that undo it."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"[^\p{L}\d]+").transform(df)
    v = HashingTF(inputCol="_t", outputCol="features", numFeatures=width, binary=True).transform(tokens).drop("_t")
    s = df.agg(F.avg(F.log1p(target)).alias("log_mean"), F.stddev_pop(F.log1p(target)).alias("log_sd"))
    return v.crossJoin(F.broadcast(s)).withColumn("scaled", F.when(F.col("log_sd") > 0, (F.log1p(target) - F.col("log_mean")) / F.col("log_sd")).otherwise(0.0))  # one row of statistics


def unscaled(guess, mean="log_mean", sd="log_sd"):
    """A guess back from the scaled logarithm, 0 at least."""
    return F.greatest(F.expm1(guess * F.col(sd) + F.col(mean)), F.lit(0.0))


def trees(train: DataFrame, text: str, target: str, size: int = 2000) -> dict:
    """A boosted and a forest regressor over word counts.

    Words are counted once for both. The counts are dealt evenly to as many tasks as their rows need, since how many partitions the texts come in says nothing of what a task has to hold.
    """
    words = Pipeline(stages=word_vectors(text, size)).fit(train)
    vectors = kept(words.transform(train).select("features", target), "vectors")
    tasks = -(-vectors.count() * len(words.stages[-1].vocabulary) // TREE_CELLS)
    dealt = vectors.repartition(max(tasks, train.sparkSession.sparkContext.defaultParallelism))
    grown = {
        "boosted": GBTRegressor(labelCol=target, predictionCol="guess", maxIter=10, maxDepth=3, seed=1).fit(dealt),
        "forest": RandomForestRegressor(labelCol=target, predictionCol="guess", numTrees=10, maxDepth=4, seed=1).fit(dealt),
    }
    return {name: PipelineModel(stages=[*words.stages, model]) for name, model in grown.items()}


def report(predicted: DataFrame, target: str, name: str, guess: str = "guess") -> DataFrame:
    return error_report(predicted, target, guess).withColumn("model", F.lit(name))
