"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Method: vectors are dealt by a hash of their id to shards of bounded size; each shard builds its ball tree once, and blocks
of queries stream past it. A block opens nodes from the root on, that with the greatest upper bound
query * centre + |query| * radius of any of its queries first (a child's bound never exceeds its parent's). Queries whose bound is
below their current kth score leave a node there and then, and a node that none is left for is closed with all below it. The kth score is
shared: each block first searches one shard, and what it finds there is the starting kth score in all shards. Scores are
integers and exact; only bounds are floating point, and they are widened.

A query set against all rows goes in blocks: rows stay in their shard, blocks of bounded size visit all shards.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, and null ids take no part. Vectors
of different lengths aren't compared. Repeated rows (same id and vector) count once; of several vectors with a query's id the
smallest is the query. A query's own id is never its candidate. Fewer than k candidates: all of them. Huge components are taken at the
bounds of a long, and so are scores.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm._spark import sorted_groups, written

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 1024, 128


def quantised(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v (array<long>, floor(scale * x)) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))


class BallTree:
    """Nodes as arrays; the rows of a node are a slice."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        f = x[order].astype(np.float64)
        perm = np.arange(len(x))
        self.rows: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        work = [(0, len(x), -1)]
        while work:
            lo, hi, parent = work.pop()
            part = f[perm[lo:hi]]
            far = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
            other = part[np.argmax(((part - far) ** 2).sum(1))]
            self.rows.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(len(self.rows) - 1)
            if hi - lo > leaf and (far != other).any():
                half = np.argsort(part @ (other - far), kind="stable")
                perm[lo:hi] = perm[lo:hi][half]
                work += [(lo, (lo + hi) // 2, len(self.rows) - 1), ((lo + hi) // 2, hi, len(self.rows) - 1)]
        self.x, self.ids = x[order][perm], ids[order][perm]
        f = f[perm]
        self.centre = np.array([f[lo:hi].mean(0) for lo, hi in self.rows])
        self.radius = np.array([np.sqrt(((f[lo:hi] - c) ** 2).sum(1).max()) for (lo, hi), c in zip(self.rows, self.centre, strict=True)])
        self.reach = np.sqrt((self.centre**2).sum(1)) + self.radius
        self.opened = 0

    def search(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its best k rows that reach its starting kth score; opened counts the nodes that were looked into."""
        f = q.astype(np.float64)
        norm = np.sqrt((f**2).sum(1))
        size = float(np.abs(f).max(initial=0)) * float(np.abs(self.x.astype(np.float64)).max(initial=0)) * q.shape[1]
        kind = np.float64 if size < 2**53 else np.int64 if size < 2**62 else object
        rows, qs = self.x.astype(kind), q.astype(kind)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
        kth = kth.astype(np.float64)

        def bound(node: int, live: np.ndarray, most: np.ndarray) -> np.ndarray:
            b = f[live] @ self.centre[node] + norm[live] * self.radius[node]
            return np.minimum(b + 1.0 + 1e-9 * norm[live] * self.reach[node], most)  # the terms of b may be far larger than b

        every = np.arange(len(q))
        first = bound(0, every, np.full(len(q), np.inf))
        heap = [(-first.max(initial=-np.inf), 0, every, first)]
        while heap:
            _, node, live, most = heapq.heappop(heap)
            open_ = most >= kth[live]
            live, most = live[open_], most[open_]
            if not len(live):
                continue  # closed with all nodes below it
            self.opened += 1
            for child in self.children[node]:
                b = bound(child, live, most)
                heapq.heappush(heap, (-b.max(), child, live, b))
            if self.children[node]:
                continue
            lo, hi = self.rows[node]
            scores = np.clip(qs[live] @ rows[lo:hi].T, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else (qs[live] @ rows[lo:hi].T).astype(np.int64)
            for i, s in zip(live, scores, strict=True):
                ok = (s >= kth[i]) & (self.ids[lo:hi] != own[i])
                if ok.any():
                    ids, sc = np.concatenate([best[i][0], self.ids[lo:hi][ok]]), np.concatenate([best[i][1], s[ok]])
                    top = np.lexsort((ids, -sc.astype(kind) if kind is object else -sc))[:k]
                    best[i] = ids[top], sc[top]
                    if len(top) == k:
                        kth[i] = max(kth[i], float(sc[top[-1]]))
        return best


_FOUND = "query_id long, vec_id long, score long"


_UNIT = ["shard", "is_query", "block"]


def _search(k: int):
    """Of each shard the rows come first, then the blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trees = -1, {}
        for t in sorted_groups(batches, _UNIT):
            shard, is_query = t.column("shard")[0].as_py(), t.column("is_query")[0].as_py()
            ids, kth, v = t.column("vec_id").to_numpy(), t.column("kth").to_numpy(), t.column("v").combine_chunks()
            width = np.diff(v.offsets.to_numpy())
            if shard != at:
                at, trees = shard, {}
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for dim in np.unique(width):
                mine = np.flatnonzero(width == dim)
                x = v.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim)
                if not is_query:
                    trees[dim] = BallTree(x, ids[mine])
                elif dim in trees:
                    found = trees[dim].search(x, ids[mine], kth[mine], k)
                    out += [(np.full(len(a), i), a, s) for i, (a, s) in zip(ids[mine], found, strict=True)]
            if is_query:
                cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all other rows for each row that is_query (a condition on vec_id) holds for."""
    rows = written(quantised(vectors, scale).distinct(), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_queries))
    lowest = F.lit(-(1 << 63)).cast("long")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)).cast("int")

    def units(rows: DataFrame, queries: DataFrame) -> DataFrame:
        here = rows.select("shard", F.lit(0).alias("is_query"), F.lit(0).alias("block"), "vec_id", lowest.alias("kth"), "v")
        asked = queries.select("shard", F.lit(1).alias("is_query"), "block", "vec_id", "kth", "v")
        return here.unionByName(asked).repartition("shard").sortWithinPartitions(*_UNIT).mapInArrow(_search(k), _FOUND)

    dealt = rows.withColumn("shard", shard)
    pilot = dealt.where(F.col("shard") < blocks)  # block b starts in shard b, or b modulo their number
    first = _best(units(pilot, queries.withColumn("shard", F.pmod("block", F.lit(shards)).cast("int")).withColumn("kth", lowest)), k)
    known = written(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")), "kth")
    shared = queries.join(known, "vec_id", "left").withColumn("kth", F.coalesce("kth", lowest))
    found = units(dealt, shared.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query's rows in DuckDB.
ORACLE = """
with v as (
    select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), asked as (
    select vec_id, min(q) as q from v where vec_id % 100 = 0 group by vec_id
), scored as (
    select a.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * v.q[i])) as bigint) as score
    from asked a join v on v.vec_id <> a.vec_id and len(v.q) = len(a.q)
), placed as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scored
)
select * from placed where rank <= 10
"""
