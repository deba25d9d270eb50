"""Curation of training rows: funnels, duplicates, sampling, splits, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.operators.order_stats import quantiles


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left, and their share, after each step and all before it; one pass."""
    held, aggs = F.lit(True), [F.count("*").alias("all")]
    for name, condition in steps.items():
        held = held & F.coalesce(condition, F.lit(False))
        aggs.append(F.count_if(held).alias(name))
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"`{n}`").alias("n_rows")) for i, n in enumerate(["all", *steps])))
    return one.select("all", F.inline(rows)).select("step_no", "step", "n_rows", F.round(F.when(F.col("all") > 0, F.col("n_rows") / F.col("all")), 6).alias("share"))


def keep_first(df: DataFrame, key: Column, order: Column, *ties: str) -> DataFrame:
    """The row of each key that comes first. Keys are hashed, so long texts aren't shuffled as keys; the aggregate is partial."""
    row = F.struct(*(F.col(c) for c in df.columns))
    first = df.groupBy(F.sha2(key.cast("string"), 256).alias("_key")).agg(F.min_by(row, F.struct(order.alias("_o"), *ties)).alias("_row"))
    return first.select("_row.*")


def seeded(key: str, seed: str) -> Column:
    """An order that any engine gives alike: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def uniform(key: str, seed: str) -> Column:
    """A number in (0, 1) from seed and key."""
    return (F.conv(F.substring(seeded(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def duplicate_sizes(df: DataFrame, key: Column) -> DataFrame:
    """How many keys come how often, with the extra copies."""
    n = df.groupBy(F.sha2(key, 256).alias("k")).agg(F.count("*").alias("group_size"))
    return n.groupBy("group_size").agg(F.count("*").alias("n_groups")).withColumn("extra_copies", F.col("n_groups") * (F.col("group_size") - 1))


def duplicate_spread(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Of groups of equal keys: equal values, a spread within 20 %, or above; "no value" if all values are null."""
    g = df.groupBy(F.sha2(key, 256).alias("k")).agg(F.count("*").alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo")).where("n > 1")
    ratio = F.col("hi") / F.col("lo")
    kind = F.when(F.col("hi").isNull(), "no value").when(F.col("hi") == F.col("lo"), "equal").when((F.col("lo") > 0) & (ratio <= 1.2), "within_20").otherwise("above_20")
    return g.groupBy(kind.alias("spread")).agg(F.count("*").alias("n_groups"))


def conflict_aware(df: DataFrame, key: Column, value: Column, id_col: str, most: float = 1.2) -> DataFrame:
    """One row for each key with the mean value; keys whose values differ by more than the factor go, those without a value stay."""
    g = df.groupBy(F.sha2(key, 256).alias("k")).agg(F.min(id_col).alias(id_col), F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean_value"), F.count("*").alias("n"))
    return g.where(F.coalesce(F.col("hi") <= F.col("lo") * most, F.lit(True))).select(id_col, F.round("mean_value", 4).alias("mean_value"), F.col("n").alias("n_rows"))


def weighted_sample(df: DataFrame, weight: Column, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement with chances in proportion to weight (exponential race); weight 0 is never drawn."""
    race = -F.log(uniform(key, seed)) / weight
    return df.where(weight > 0).withColumn("race", race).orderBy("race", key).limit(n)


def price_weight(df: DataFrame, price: str, category: str, halved: str, rare: str) -> DataFrame:
    """((price - min) / (max - min + 1e-9)) squared, times 0.5 or 0.05 for two categories."""
    ends = df.agg(F.min(price).alias("_lo"), F.max(price).alias("_hi"))
    scaled = F.pow((F.col(price) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9), 2)
    factor = F.when(F.col(category) == halved, 0.5).when(F.col(category) == rare, 0.05).otherwise(1.0)
    return df.crossJoin(F.broadcast(ends)).withColumn("weight", scaled * factor).drop("_lo", "_hi")  # one row


def seeded_rank(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with `rank` from 1 in a seeded order, and the count of all rows as `_all`.

    The order is a hash, so its first four digits deal the rows evenly into 65,536 buckets; their counts give the offsets
    and a row's rank is that in its bucket plus the offset. No row order goes through one task.
    """
    dealt = df.withColumn("_o", seeded(key, seed)).withColumn("_b", F.substring("_o", 1, 4))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))  # a row for each bucket
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_b").withColumn("rank", rank.cast("long")).drop("_o", "_b", "_n", "_before")


def split_by_rank(df: DataFrame, key: str, seed: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Exact splits by rank in a seeded order. The last share takes the rest."""
    ranked = seeded_rank(df, key, seed)
    upto, split = 0.0, None
    for name, share in shares[:-1]:
        upto += share
        test = F.col("rank") <= F.floor(F.col("_all") * upto)
        split = F.when(test, name) if split is None else split.when(test, name)
    return ranked.withColumn("split", split.otherwise(shares[-1][0])).drop("_all")


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.where(value.isNotNull()).groupBy(F.floor(value / width).cast("long").alias("bin")).agg(F.count("*").alias("n_rows"))


def profile(df: DataFrame, value: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Count, mean, standard deviation, ends and percentiles (linear interpolation)."""
    one = df.agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    names = {f"p{int(x * 100)}": x for x in points}
    return one.join(F.broadcast(quantiles(df, [], value, names)), F.lit(True), "left").select("n", "mean", "std", "lowest", "highest", *(F.round(n, 4).alias(n) for n in names))  # one row each


def category_counts(df: DataFrame, *by: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("n_rows"))
    return n.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))  # a row for each category


def token_caps(df: DataFrame, tokens: Column, caps: list[int]) -> DataFrame:
    """For each cap: share of texts trimmed, share of tokens kept, tokens left."""
    total = F.sum("t")
    aggs = [F.struct(F.lit(c).alias("cap"), F.round(F.avg((F.col("t") > c).cast("double")), 6).alias("share_trimmed"), F.round(F.sum(F.least("t", F.lit(c))) / total, 6).alias("share_kept"), F.sum(F.least("t", F.lit(c))).alias("tokens")) for c in caps]
    return df.select(tokens.cast("long").alias("t")).agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def normalize_values(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with `normalized`: the canonical value of the column's spelling, or the value itself."""
    known = aliases.select(F.col("alias"), F.col("canonical"))
    return df.withColumn("alias", F.lower(F.btrim(column))).join(F.broadcast(known), "alias", "left").withColumn("normalized", F.coalesce("canonical", column)).drop("alias", "canonical")


def unmapped_values(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    v = df.withColumn("alias", F.lower(F.btrim(column)))
    return v.join(F.broadcast(aliases.select("alias")), "alias", "left_anti").groupBy(column).agg(F.count("*").alias("n_rows"))


def prompts(question: str, text: Column, price: Column) -> tuple[Column, Column]:
    """A training prompt that ends with the price (halves go to even), and the same without it."""
    full = F.concat(F.lit(question + "\n\n"), text, F.lit("\n\nPrice is $"), F.bround(price).cast("long").cast("string"), F.lit(".00"))
    return full, F.concat(F.substring_index(full, "Price is $", 1), F.lit("Price is $"))
