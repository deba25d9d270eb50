"""Retrieval: exact and clustered vector top-k, fusion of rankings, context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import l2_normalize
from ragmill.sources.tables import give_back, kept, small_batches, small_side

#: Most vectors that a task holds at a time.
SHARD_ROWS = 16384
#: Scores of queries and rows that a task holds at a time.
SCORES = 1 << 20


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Rank from 1 within each group; Spark cuts groups to k before their rows are shuffled."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))  # then no word is empty, and no filter needs to look at each
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = True, classes: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score (cosine, rounded to 6) over all vectors; ties by id. vectors and queries are (id, vector).

    Vectors are dealt once to shards of bounded size; queries visit every shard, batch by batch, and only k rows for each query and shard are shuffled on.
    With classes, vectors have a class and queries the classes that they may see, and that is tested before a shard's rows are cut to k.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = _in_shards(rows, asked, k, skip_self, classes)
    return ranked(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def _in_shards(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool, classes: bool = False) -> DataFrame:
    """(query_id, shard, doc_id, score): the k best vectors of each shard that a query visits. vectors and queries are (shard, id, vector), with classes as in exact_topk."""
    kinds = {df.schema["vector"].dataType.simpleString() for df in (vectors, queries)}
    value = F.col("vector") if len(kinds) == 1 else F.col("vector").cast("array<double>")
    seen = lambda c: c.cast("array<long>") if classes else F.lit(None).cast("array<long>")
    rows = vectors.select("shard", F.lit(False).alias("asked"), "id", value.alias("vector"), seen(F.array("class") if classes else None).alias("classes"))
    asked = queries.select("shard", F.lit(True).alias("asked"), "id", value.alias("vector"), seen(F.col("classes") if classes else None).alias("classes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready = -1, [], None
        for batch in batches:
            shard, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((shard[1:] != shard[:-1]) | (is_query[1:] != is_query[:-1])) + 1, [len(shard)]]) if len(shard) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if shard[lo] != at:
                    at, parts, ready = shard[lo], [], None
                if not is_query[lo]:  # a shard's rows come before its queries
                    parts.append(part)
                    continue
                if ready is None and parts:
                    ready, parts = _Shard(pa.Table.from_batches(parts), classes), []
                if ready is not None:
                    yield ready.best(part, k, skip_self)
        parts, ready = [], None
        give_back()

    units = small_batches(rows.unionByName(asked)).repartition("shard").sortWithinPartitions("shard", "asked")
    return units.mapInArrow(search, "query_id long, shard int, doc_id long, score double")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return _unit(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1))


class _Shard:
    """Rows of a shard, ready for queries."""

    def __init__(self, rows: pa.Table, classes: bool):
        self.own, self.x = rows.column("id").to_numpy(), _matrix(rows.column("vector"))
        self.kinds, self.kind = np.unique(rows.column("classes").combine_chunks().flatten().to_numpy(), return_inverse=True) if classes else (None, None)

    def best(self, asked: pa.RecordBatch, k: int, skip_self: bool) -> pa.RecordBatch:
        """The k best rows for each query, so many queries at a time that their scores take some MB."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        ids, q, seen = asked.column(2).to_numpy(), _matrix(asked.column(3)), asked.column(4)
        step = max(1, SCORES // len(self.own))
        for at in range(0, len(ids), step):
            score = q[at : at + step] @ self.x.T
            np.round(score, 6, out=score)
            score += 0.0
            if skip_self:
                score[ids[at : at + step, None] == self.own[None, :]] = -np.inf
            if self.kinds is not None:
                may = np.stack([np.isin(self.kinds, c.values.to_numpy() if c.is_valid else []) for c in seen.slice(at, step)])
                score[~may[:, self.kind]] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k] if k < len(self.own) else np.full(len(score), -np.inf)
            i, j = np.nonzero((score >= kth[:, None]) & np.isfinite(score))  # with all that tie at the kth place
            order = np.lexsort((self.own[j], -score[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            for col, v in zip(out, (ids[at + i[keep]], self.own[j[keep]], score[i[keep], j[keep]]), strict=True):
                col.append(v)
        found = [pa.array(np.concatenate(c)) for c in out]
        return pa.RecordBatch.from_arrays([found[0], pa.array(np.full(len(found[0]), asked.column(0)[0].as_py(), np.int32)), *found[1:]], ["query_id", "shard", "doc_id", "score"])


def ivf_build(vectors: DataFrame, lists: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Vectors with their list, and the centroids (list_id, centroid): k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    v = vectors.withColumn("vector", l2_normalize(F.col("vector"))).withColumn("features", array_to_vector("vector"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(v)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")
    return kept(model.transform(v).select("id", "vector", F.col("prediction").alias("list_id")), "lists"), centres


def _near(centres: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, q (unit), list_id and the place of the list by closeness of its centroid, from 1."""
    from ragmill.functions.text import dot

    q = queries.select(F.col("id").alias("query_id"), l2_normalize(F.col("vector")).alias("q"))
    near = q.crossJoin(F.broadcast(centres)).withColumn("s", F.round(dot(F.col("q"), F.col("centroid")), 9))  # centroids: as many as lists
    return ranked(near, ["query_id"], [F.desc("s"), F.col("list_id")]).select("query_id", "q", "list_id", "rank")


def ivf_probes(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int, least: float = 0.9, trials: int = 1000) -> int:
    """The fewest probes whose recall@k for these queries is expected to be at least `least`.

    Recall is measured on trials: indexed vectors that aren't queries, by exact search over all vectors. A true neighbour is found with p probes
    if its list is among the p nearest ones, so one search gives the recall for every p. Two standard errors of a mean over as many
    queries are taken off. With all lists recall is 1, so there always is an answer.
    """
    vectors = index.select("id", "vector")
    tried = vectors.join(queries.select("id"), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(trials)
    true = exact_topk(vectors, tried, k).select("query_id", F.col("doc_id").alias("id"))
    at = true.join(index.select("id", "list_id"), "id").join(_near(centres, tried).select("query_id", "list_id", "rank"), ["query_id", "list_id"])
    hits = at.groupBy("query_id", "rank").agg(F.count("*").alias("n")).toPandas()  # at most k rows for each trial
    lists, n_queries = centres.count(), queries.count()
    if hits.empty or not n_queries:
        return lists
    found = np.zeros((hits["query_id"].nunique(), lists))
    found[hits["query_id"].factorize()[0], hits["rank"] - 1] = hits["n"]
    recall = found.cumsum(1) / found.sum(1, keepdims=True)
    sure = recall.mean(0) - 2 * recall.std(0) / np.sqrt(min(n_queries, len(found)))
    return int(np.argmax(sure >= least)) + 1 if sure[-1] >= least else lists


def ivf_candidates(index: DataFrame, centres: DataFrame, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """(query_id, probe, doc_id, score): the best k of each shard of the lists whose centroids are nearest to the query; probe is the place of the list by closeness, from 1.

    A list is dealt to shards of bounded size, which its queries visit, so pairs are scored as products of matrices.
    """
    sizes = index.groupBy("list_id").agg(F.count("*").alias("n")).collect()  # a row for each list
    shards, first = [], 0
    for r in sorted(sizes):
        shards.append((r.list_id, first, -(-r.n // SHARD_ROWS)))
        first += shards[-1][2]
    if not shards:
        return index.sparkSession.createDataFrame([], "query_id long, probe int, doc_id long, score double")
    of = F.broadcast(index.sparkSession.createDataFrame(shards, "list_id int, first int, parts int"))
    rows = index.join(of, "list_id").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))).cast("int"))
    probed = _near(centres, queries).where(F.col("rank") <= probes).join(of, "list_id")
    asked = probed.select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard"), F.col("query_id").alias("id"), F.col("q").alias("vector"))
    places = probed.select("query_id", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard"), F.col("rank").alias("probe"))
    return _in_shards(rows, asked, k, True).join(places, ["query_id", "shard"]).select("query_id", "probe", "doc_id", "score")


def best_of_probes(candidates: DataFrame, probes: int, k: int) -> DataFrame:
    """query_id, rank, doc_id, score of the candidates in the nearest lists."""
    return ranked(candidates.where(F.col("probe") <= probes), ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def ivf_topk(index: DataFrame, centres: DataFrame, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """query_id, rank, doc_id, score over the lists whose centroids are nearest to the query."""
    return best_of_probes(ivf_candidates(index, centres, queries, probes, k), probes, k)


def recall_report(exact: DataFrame, approximate: dict[int, DataFrame], lists: int, k: int, least: float = 0.9, most_scan: float = 0.25) -> DataFrame:
    """Mean recall, share of lists scanned and verdict for each number of probes."""
    out = None
    want = exact.groupBy("query_id").agg(F.collect_set("doc_id").alias("want"))  # k ids for each query
    for probes, found in approximate.items():
        got = found.groupBy("query_id").agg(F.collect_set("doc_id").alias("got"))
        r = want.join(got, "query_id", "left").select((F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>")))) / k).alias("r"))
        row = r.agg(F.round(F.avg("r"), 6).alias("recall")).withColumn("probes", F.lit(probes)).withColumn("scan", F.lit(probes / lists))
        out = row if out is None else out.unionByName(row)
    return out.select("probes", "recall", "scan", ((F.col("recall") >= least) & (F.col("scan") <= most_scan)).alias("accepted"))


def rrf_fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion; rank counts from 0 in the formula. Rankings are (query_id, rank from 1, doc_id)."""
    rows = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "doc_id", "rank"))
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank") - 1)), 9).alias("score"))
    return ranked(fused, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def merge_rankings(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first list, then what the second adds; each content once. Lists are (query_id, rank, doc_id)."""
    rows = first.select("query_id", "rank", "doc_id", F.lit(1).alias("list")).unionByName(second.select("query_id", "rank", "doc_id", F.lit(2).alias("list")))
    once = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    return ranked(once, ["query_id"], [F.col("at.list"), F.col("at.rank")]).select("query_id", "rank", "doc_id")


def apply_rerank(ranking: DataFrame, orders: DataFrame, k: int) -> DataFrame:
    """A ranking in the order that a reranker gave (query_id, order: places from 1): unknown places go, repeated ones count once."""
    places = orders.select("query_id", F.posexplode(F.array_distinct("order")).alias("at", "place"))
    placed = ranking.select("query_id", F.col("rank").alias("place"), "doc_id").join(places, ["query_id", "place"])
    return ranked(placed, ["query_id"], [F.col("at")], k).select("query_id", "rank", "doc_id")


def assemble_context(ranking: DataFrame, texts: DataFrame, k: int, header: bool = True) -> DataFrame:
    """The texts of the best k, in order, parted by blank lines."""
    text = F.concat(F.lit("Extract from "), F.col("source"), F.lit(":\n"), F.col("text")) if header else F.col("text")
    best = small_side(ranking.where(F.col("rank") <= k).select("query_id", "rank", "doc_id"), "best")  # texts stay where they are
    rows = best.join(texts.select("doc_id", text.alias("text")), "doc_id")
    items = F.sort_array(F.collect_list(F.struct("rank", "text")))  # at most k
    return rows.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n\n").alias("context"))


def messages(system: Column, history: Column, user: Column) -> Column:
    """Messages as array<struct<role,content>>: system, history, user."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(F.array(m("system", system)), history, F.array(m("user", user)))


def combine_history(turns: DataFrame) -> DataFrame:
    """For each user turn all earlier user turns joined by line breaks, a line break, and the turn itself."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(before)
    return turns.withColumn("question", F.concat(F.array_join(earlier, "\n"), F.lit("\n"), F.col("text"))).where("role = 'user'").select("conv_id", "turn", "question")


def lookup_context(questions: DataFrame, dictionary: DataFrame, default: str) -> DataFrame:
    """Context of a question: the entries whose key is one of its words (letters only, lower case), by key; else a default."""
    w = questions.select("query_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +"))).alias("key"))
    hit = w.join(dictionary, "key").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "entry"))), lambda x: x["entry"]), "\n").alias("found"))
    return questions.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("found", F.lit(default)).alias("context"))


def rank_probe(ranking: DataFrame, texts: DataFrame, phrases: DataFrame, depths: list[int]) -> DataFrame:
    """For each query and depth the rank of the first result whose text holds the query's phrase, or null."""
    asked = small_side(ranking.join(phrases, "query_id").select("query_id", "rank", "doc_id", "phrase"), "asked")  # texts stay where they are
    hit = asked.join(texts.select("doc_id", "text"), "doc_id").select("query_id", "rank", F.col("text").contains(F.col("phrase")).alias("hit"))
    return hit.crossJoin(F.broadcast(hit.sparkSession.createDataFrame([(d,) for d in depths], "depth int"))).groupBy("query_id", "depth").agg(F.min(F.when(F.col("hit") & (F.col("rank") <= F.col("depth")), F.col("rank"))).alias("first_rank"))


def snippet(text: Column, keyword: str, before: int = 500, after: int = 1000) -> Column:
    """The text around the first place of a keyword; null without it."""
    at = F.locate(keyword, text)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at - begin + after))
