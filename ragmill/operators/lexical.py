"""BM25 over a stored index: blocks of documents with their terms and postings, each block scored where it is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators.retrieve import ranked, tokens
from ragmill.sources.tables import give_back, kept, scratch, small_batches, small_side, spread, written

#: Documents of a block, and blocks of a file. Queries and distinct terms that are scored at a time.
BLOCK_DOCS, FILE_BLOCKS = 1024, 8
QUERIES, TERMS = 1024, 16384
_BLOCKS = "block int, doc_ids array<long>, lengths array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>"


@dataclass
class LexicalIndex:
    """blocks: block, doc_ids, lengths (words of each), terms, df (documents of the block that hold each), docs and tf (places of these documents and the term's occurrences, term after term). terms: term, df, idf, avgdl, k1, b.

    All lie under one folder: anybody who may read it can search it again with open_index.
    """

    path: str
    blocks: DataFrame
    terms: DataFrame


def _lists(ids: list, text: list) -> list[pa.Array]:
    """The columns of a block after its number. Rows of one id and length count as one document."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([(x or "").lower() for x in text], pa.string())))
    size = pc.list_value_length(split).to_numpy()
    words = split.flatten()
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # a text without words is one empty word
    row, words = np.repeat(np.arange(len(size)), size)[some], words.filter(pa.array(some)).dictionary_encode()
    size = np.bincount(row, minlength=len(size))
    told: dict[tuple, int] = {}
    doc = np.array([told.setdefault(x, len(told)) for x in zip(ids, size.tolist(), strict=True)])
    key, tf = np.unique(words.indices.to_numpy() * np.int64(len(told)) + doc[row], return_counts=True)
    term, doc = np.divmod(key, len(told))
    return [pa.array([i for i, _ in told], pa.int64()), pa.array([n for _, n in told], pa.int32()), words.dictionary, pa.array(np.bincount(term, minlength=len(words.dictionary)).astype(np.int32)), pa.array(doc.astype(np.int32)), pa.array(tf.astype(np.int32))]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_block(batches):
        cols = _lists(t.column("doc_id").to_pylist(), t.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([t.column(0).slice(0, 1).combine_chunks(), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols)], ["block", "doc_ids", "lengths", "terms", "df", "docs", "tf"])
    give_back()


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    """Index the texts of docs and store the index at path. A negative idf becomes epsilon times the mean idf.

    Documents are dealt whole to blocks, drawn by a hash, and a block's words are counted in one place: texts are all that is shuffled, and a frequent term is no hot key.
    Texts are lower-cased by Python, which agrees with Spark's lower but for letters newer than its Unicode tables.
    """
    spark = docs.sparkSession
    t = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, texts = t.agg(F.count("*"), F.count("text")).first()
    dealt = spread(t).select(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // BLOCK_DOCS)))).cast("int").alias("block"), "doc_id", "text")
    lists = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_index, _BLOCKS)
    written(lists.write.option("maxRecordsPerFile", FILE_BLOCKS), spark, f"{path}/blocks")  # so few rows are read at a time
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    words = blocks.select(F.explode("tf").alias("n")).agg(F.sum("n")).first()[0]
    avgdl = (words or 0) / texts if texts else None
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    raw = kept(df.withColumn("idf", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))), "idf")
    least = (raw.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    constants = [F.lit(x).cast("double").alias(name) for name, x in (("avgdl", avgdl), ("k1", k1), ("b", b))]
    raw.select("term", "df", F.when(F.col("idf") < 0, least).otherwise(F.col("idf")).alias("idf"), *constants).write.parquet(f"{path}/terms")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(path, spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))


class _Queries:
    """A block of queries: its terms and, for each, the weight in every query."""

    def __init__(self, rows: list):
        self.ids = np.array(sorted({r.query_id for r in rows}), np.int64)
        self.terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        self.at = np.array([self.terms[r.term] for r in rows]), np.searchsorted(self.ids, [r.query_id for r in rows])
        self.weight = np.array([r.weight for r in rows])

    def scores(self, term: np.ndarray, row: np.ndarray, part: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weight times part, and whether a row shares a term with a query: both (rows, queries)."""
        out = self._sums(term, row, part, rows, self.weight)
        return out, out > 0 if (self.weight > 0).all() else self._sums(term, row, np.ones(len(term)), rows, np.ones(len(self.weight))) > 0

    def _sums(self, term: np.ndarray, row: np.ndarray, part: np.ndarray, rows: int, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, len(self.ids)))
        for lo in range(0, len(self.terms), 2048):  # so many terms that both matrices stay small
            hi, here, mine = lo + 2048, (self.at[0] >= lo) & (self.at[0] < lo + 2048), (term >= lo) & (term < lo + 2048)
            weights, parts = np.zeros((min(hi, len(self.terms)) - lo, len(self.ids))), np.zeros((rows, min(hi, len(self.terms)) - lo))
            weights[self.at[0][here] - lo, self.at[1][here]] = weight[here]
            np.add.at(parts, (row[mine], term[mine] - lo), part[mine])
            out += parts @ weights
        return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block (column 0), which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != block[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _scored(index: LexicalIndex, queries: _Queries, avgdl: float, k1: float, b: float, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k of each query in each task's blocks, of documents that share a term with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(list(queries.terms), pa.string())
        query, doc, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(queries.ids), -np.inf)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, dl, terms, df, docs, tf = (batch.column(i)[at].values for i in range(1, 7))
                number = pc.index_in(terms, asked)
                known, df = pc.is_valid(number).to_numpy(zero_copy_only=False), df.to_numpy()
                if not known.any():
                    continue
                mine = np.repeat(known, df)
                place, tf = docs.to_numpy()[mine], tf.to_numpy()[mine]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl.to_numpy()[place] / avgdl))
                own, row = np.unique(ids.to_numpy(), return_inverse=True)
                found, met = queries.scores(np.repeat(number.drop_null().to_numpy(), df[known]), row[place], part, len(own))
                np.round(found, 9, out=found)
                found += 0.0
                found[~met | (found < least)] = -np.inf
                kth = np.partition(found, -k, axis=0)[-k] if k < len(own) else np.full(found.shape[1], -np.inf)
                i, j = np.nonzero((found >= kth) & np.isfinite(found))  # with all that tie at the kth place
                query, doc, score = np.concatenate([query, j]), np.concatenate([doc, own[i]]), np.concatenate([score, found[i, j]])
                order = np.lexsort((doc, -score, query))
                query, doc, score = query[order], doc[order], score[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, doc, score = query[keep], doc[keep], score[keep]
                full = np.flatnonzero(np.bincount(query, minlength=len(least)) == k)
                least[full] = score[np.searchsorted(query, full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[query]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])
        give_back()

    return small_batches(index.blocks).mapInArrow(run, "query_id long, doc_id long, score double")


def search(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score of the documents that share a term with the query; repeated query terms count again.

    Queries go in blocks of bounded size. Each passes once over the index, where every task keeps the best k of the blocks that it has read.
    """
    asked = kept(queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")
    used = small_side(asked.select("term").distinct(), "terms")
    weighted = kept(asked.join(index.terms.join(used, "term"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl", "k1", "b"), "weights")
    n, rows = weighted.agg(F.count_distinct("query_id"), F.count("*")).first()
    parts = max(1, -(-n // QUERIES), -(-rows // TERMS))
    found = None
    for at in range(parts):
        mine = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == at).collect()  # a block of queries
        if not mine:
            continue
        here = _scored(index, _Queries(mine), mine[0].avgdl, mine[0].k1, mine[0].b, k)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return ranked(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """search over an index of docs that is written for the call."""
    return search(write_index(docs, scratch(docs.sparkSession, "bm25")), queries, k)
