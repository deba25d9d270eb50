"""Connected components by contraction along shuffled labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm._spark import written

#: Rounds that take ids in their own order.
PLAIN = 2
_HALF = (1 << 32) - 1


def _shuffled(df: DataFrame, columns: list[str], salt: int) -> DataFrame:
    """df with the longs of columns replaced one to one by others in an order that the salt decides (two steps of a Feistel network)."""

    def half(c: Column, s: int) -> Column:
        return F.xxhash64(c, F.lit(s)).bitwiseAND(F.lit(_HALF))

    high = {c: F.shiftrightunsigned(c, 32).bitwiseXOR(half(F.col(c).bitwiseAND(F.lit(_HALF)), 2 * salt)) for c in columns}
    df = df.select(*df.columns, *(x.alias(f"{c}_high") for c, x in high.items()))
    low = {c: F.col(c).bitwiseAND(F.lit(_HALF)).bitwiseXOR(half(F.col(f"{c}_high"), 2 * salt + 1)) for c in columns}
    joined = {c: F.shiftleft(f"{c}_high", 32).bitwiseOR(low[c]) for c in columns}
    return df.select(*(joined.get(c, F.col(c)).alias(c) for c in df.columns if c.removesuffix("_high") not in columns or c in columns))


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contracted(edges: DataFrame) -> list[DataFrame]:
    """The rounds of contraction, each a table (id, to): a vertex's label before and after the round.

    Every round points each vertex at the smallest of itself and its neighbours (a partial minimum, so a hub is no hot spot). The
    first rounds take the ids as they are, which is all that stars around their smallest id need. From then on every round gives the
    labels a new random order, which takes about half of the vertices out, whatever the graph looks like: rounds follow the
    logarithm of the number of vertices, on long chains too. A label that has no edge left is its component's.
    """
    e, rounds = written(_edges(edges), "edges"), []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both.withColumn("id", F.col("a"))
        if len(rounds) >= PLAIN:
            seen = _shuffled(seen, ["a", "b"], len(rounds))
        to = written(seen.groupBy("id").agg(F.least(F.min("a"), F.min("b")).alias("to")), "contract")
        rounds.append(to)
        left = to.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = e.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        e = written(_edges(moved), "edges")
    return rounds


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the edges (a, b) that joins two ids: root is the smallest id reachable.

    Nothing is collected; each round of contraction is written to the shared folder. No edges: no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    rounds = contracted(e)
    if not rounds:
        return e.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    label = rounds[-1].select("id", F.col("to").alias("label"), F.lit(len(rounds)).alias("round"))
    for k in range(len(rounds) - 2, -1, -1):
        up = label.select(F.col("id").alias("to"), "label", "round")
        label = rounds[k].join(up, "to", "left").select("id", F.coalesce("label", "to").alias("label"), F.coalesce("round", F.lit(k + 1)).alias("round"))
    label = written(label, "labels")
    smallest = label.groupBy("label", "round").agg(F.min("id").alias("root"))
    return label.join(smallest, ["label", "round"]).select("id", "root")
