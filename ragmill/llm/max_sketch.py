"""Ranked lexical search over hashed max-sketches.

Method: a document's impacts fold into a sketch, an array in two halves of a power of two of coordinates: a term is hashed to one coordinate of each half, and
a coordinate keeps the largest impact of its terms. For one document the impact of a term grows with its frequency alone, so the sketch keeps the largest
frequency (a byte; 255 stands for any larger one) and scores in full once the corpus counts are known. A query term's impact is at most what the smaller of its
two coordinates gives, so a block of items gets its upper bounds for a batch of documents by one lookup of all its terms and one matrix product. The best bounds are scored
exactly from the texts first, which sets a threshold for each item (its kth score so far); then what reaches the threshold is scored in slabs of
descending bound, each of which raises it, until no bound reaches it.

Sketches have at least twice as many coordinates in a half as their document has distinct terms, up to WIDEST. The index is those sketches, the
document frequencies of all terms, and three totals; a text is read once to build it, and again only where it is a candidate.

Skew: documents of equal term counts are one class; the smallest doc_id is searched for it and the others join its results at the end, so that no number of
copies makes ties to be scored. Document frequencies are summed in each task first. Items go in blocks of a bounded number of items and terms, against all documents.

Defined cases: a null text has no terms, and nor has one of separators only; such a document is in no result and not in N. An item without terms has no results. Repeated
rows of an id: one document or item (the text that sorts last). Null ids: left out. Other columns are ignored. Empty tables: empty result. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._spark import give_back, slim_side, unique_texts, written

#: Coordinates of half a sketch.
NARROWEST, WIDEST = 64, 8192
#: Items and distinct terms in a block of items, and terms that are looked up at a time.
BLOCK_ITEMS, BLOCK_TERMS, CHUNK = 256, 16384, 2048
#: The most that a term's frequency gives.
MOST = 1_000_000
_ROWS = "doc_id long, n long, h1 long, h2 long, width int, sketch binary, term long, df long"


@dataclass
class Index:
    """sketches: doc_id (one of each class of equal term counts), n, width, sketch. terms: term (hash), df. copies: doc_id, rep. Totals: N, L."""

    sketches: DataFrame
    terms: DataFrame
    copies: DataFrame
    n_docs: int
    n_terms: int


def term_counts(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row in order, their frequencies, and the offsets of rows."""
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))), np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))])


def coordinates(terms: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of terms in both halves of a sketch."""
    mask = np.asarray(width, K.U) - K.U(1)
    return (terms & mask).astype(np.int64), ((terms >> K.U(32)) & mask).astype(np.int64) + width


def sketched(terms: np.ndarray, tf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-widths and sketches (one after the other) of rows of terms."""
    d = np.diff(at)
    width = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * d, 1))).astype(np.int64), NARROWEST, WIDEST)
    start = np.concatenate([[0], np.cumsum(2 * width)])
    out, of = np.zeros(start[-1], np.uint8), np.repeat(np.arange(len(d)), d)
    value = np.minimum(tf, 255).astype(np.uint8)
    for c in coordinates(terms, width[of]):
        np.maximum.at(out, start[of] + c, value)
    return width, out


def _analysed(docs: DataFrame) -> DataFrame:
    """A row with its sketch for each document, and rows (term, df) of each batch."""
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, K.U)]
            for lo, hi, h, row in K.words(batch.column(1), K.NOT_WORD):
                rows = hi - lo
                terms, tf, at = term_counts(h, row, rows)
                width, sketch = sketched(terms, tf, at)
                ends = np.concatenate([[0], np.cumsum(2 * width)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(sketch)])
                both = terms * K.U(0x2545F4914F6CDD1D) + tf.astype(K.U)
                sums = [np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(x), dtype=K.U)]) for x in (both ^ K.U(0x5851F42D4C957F2D), both + K.U(0x14057B7EF767814F))]
                digests = [pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)) for c in sums]
                count = np.bincount(row, minlength=rows)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(count), *digests, pa.array(width.astype(np.int32)), blobs, none, none], names)
                found.append(terms)
            terms, df = np.unique(np.concatenate(found), return_counts=True)
            none = pa.nulls(len(terms), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(terms), pa.int32()), pa.nulls(len(terms), pa.binary()), pa.array(terms.view(np.int64)), pa.array(df)], names)
        give_back()

    return docs.mapInArrow(run, _ROWS)


def build(docs: DataFrame) -> Index:
    """The index of all documents (doc_id, text), in the shared folder."""
    rows = written(_analysed(unique_texts(docs)), "sketches")
    terms = written(rows.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    full = rows.where("n > 0")
    n_docs, n_terms = full.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = written(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"), "classes")
    copies = written(full.select("doc_id", "h1", "h2").join(slim_side(classes), ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    alone = full.select("doc_id", "n", "width", "sketch").join(slim_side(copies.select("doc_id")), "doc_id", "left_anti")
    return Index(alone, terms, copies, n_docs, n_terms)


class Block:
    """Some items: their terms with weights, and for each item its terms and how often it repeats them."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids = np.array(sorted({r.item_id for r in rows}), np.int64)
        term = np.array([r.term for r in rows], np.int64).view(K.U)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) * r.times for r in rows], np.int64)
        self.terms, of = np.unique(term, return_inverse=True)
        item = np.searchsorted(self.ids, np.array([r.item_id for r in rows], np.int64))
        order = np.lexsort((of, item))
        self.of, self.item, self.weight = of[order], item[order], weight[order]
        self.at = np.searchsorted(self.item, np.arange(len(self.ids) + 1))

    def m(self, n: np.ndarray) -> np.ndarray:
        return 75 + 25 * n * self.n_docs // self.n_terms

    def bounds(self, n: np.ndarray, width: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
        """An upper bound for the score of each document (row) and item (column)."""
        out = np.zeros((len(n), len(self.ids)))
        length = 12.0 * self.m(n)
        for lo in range(0, len(self.terms), CHUNK):
            hi = min(lo + CHUNK, len(self.terms))
            here = np.flatnonzero((self.of >= lo) & (self.of < hi))
            weights = np.zeros((hi - lo, len(self.ids)))
            np.add.at(weights, (self.of[here] - lo, self.item[here]), self.weight[here])
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                one, other = coordinates(self.terms[lo:hi], int(w))
                for k in range(0, len(mine), CHUNK // 8):
                    rows = mine[k : k + CHUNK // 8]
                    x = np.stack([sketches[i] for i in rows])
                    tf = np.minimum(x[:, one], x[:, other])
                    impact = tf * (1000.0 * MOST) / (1000.0 * tf + length[rows, None])
                    impact[tf == 255] = MOST
                    out[rows] += impact @ weights
        return np.where(out > 0, np.floor(out * (1 + 1e-9)) + 1, 0).astype(np.int64)

    def scores(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The exact score of each document (row) and item (column), from the terms of the documents."""
        place = np.searchsorted(self.terms, h)
        place[place == len(self.terms)] = 0
        hit = self.terms[place] == h
        slot, tf = np.unique(row[hit] * len(self.terms) + place[hit], return_counts=True)
        doc, term = np.divmod(slot, len(self.terms))
        at = np.searchsorted(doc, np.arange(rows + 1))
        m = self.m(np.bincount(row, minlength=rows))
        out = np.zeros((rows, len(self.ids)), np.int64)
        for i in range(rows):
            u = np.zeros(len(self.terms), np.int64)
            f = tf[at[i] : at[i + 1]].astype(np.int64)
            u[term[at[i] : at[i + 1]]] = (1000 * MOST * f) // (1000 * f + 12 * m[i])
            if len(f):
                out[i] = np.add.reduceat(u[self.of] * self.weight, self.at[:-1])
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (hash) and how often the item has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, h, row in K.words(batch.column(1), K.NOT_WORD):
                terms, times, at = term_counts(h, row, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], np.diff(at))), pa.array(terms.view(np.int64)), pa.array(times)], ["item_id", "term", "times"])

    return items.mapInArrow(run, "item_id long, term long, times long")


_PAIRS = "item_id long, doc_id long, bound long"


def bounded(sketches: DataFrame, block: Block, floor: dict[int, int] | None = None, depth: int = 0) -> DataFrame:
    """item_id, doc_id, bound: what reaches the item's floor, or in each task the best `depth` of an item."""
    sent = sketches.sparkSession.sparkContext.broadcast((block, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floor = sent.value
        least = np.array([max(1, (floor or {}).get(int(i), 1)) for i in block.ids], np.int64)
        best, docs = np.zeros((len(block.ids), 0), np.int64), np.zeros((len(block.ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, width = (batch.column(i).to_numpy() for i in (0, 1, 2))
            raw, offs = K.text_buffers(batch.column(3))
            bounds = block.bounds(n, width, [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)])
            if depth:
                best = np.concatenate([best, bounds.T], axis=1)
                docs = np.concatenate([docs, np.broadcast_to(ids, (len(block.ids), len(ids)))], axis=1)
                if best.shape[1] > depth:
                    top = np.argpartition(-best, depth - 1, axis=1)[:, :depth]
                    best, docs = np.take_along_axis(best, top, 1), np.take_along_axis(docs, top, 1)
            else:
                doc, item = np.nonzero(bounds >= least)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[item]), pa.array(ids[doc]), pa.array(bounds[doc, item])], ["item_id", "doc_id", "bound"])
        if depth and best.shape[1]:
            item, at = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[item]), pa.array(docs[item, at]), pa.array(best[item, at])], ["item_id", "doc_id", "bound"])
        give_back()

    return sketches.select("doc_id", "n", "width", "sketch").mapInArrow(run, _PAIRS)


def rescored(docs: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """item_id, doc_id, score of pairs: the exact scores above 0. A document lists each item once, so at most those of a block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    joined = docs.join(slim_side(written(wanted, "wanted")), "doc_id").select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            ids, items = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, h, row in K.words(batch.column(1), K.NOT_WORD):
                scores, part = block.scores(h, row, hi - lo), items.slice(lo, hi - lo)
                at = np.searchsorted(block.ids, part.flatten().to_numpy())
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                got = scores[doc, at]
                keep = got > 0
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[at[keep]]), pa.array(ids[lo + doc[keep]]), pa.array(got[keep])], ["item_id", "doc_id", "score"])
        give_back()

    return joined.mapInArrow(run, "item_id long, doc_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(index: Index, docs: DataFrame, block: Block, k: int, depth: int) -> DataFrame:
    """item_id, doc_id, score: the best k classes of each item of a block."""
    w = Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id")
    first = bounded(index.sketches, block, depth=depth).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).drop("rank")
    done = written(first, "pilot")
    best = written(_best(rescored(docs, done, block), k), "best")

    def kth() -> DataFrame:
        return best.where(F.col("rank") == k).select("item_id", F.col("score").alias("kth"), F.col("doc_id").alias("last"))

    floor = {r.item_id: r.kth for r in kth().collect()}  # a number for each item of the block
    open_ = written(bounded(index.sketches, block, floor).join(F.broadcast(done.select("item_id", "doc_id")), ["item_id", "doc_id"], "left_anti"), "open")
    slab = 8 * depth
    while True:
        reach = (F.col("kth").isNull()) | (F.col("bound") > F.col("kth")) | ((F.col("bound") == F.col("kth")) & (F.col("doc_id") < F.col("last")))
        left = open_.join(F.broadcast(kth()), "item_id", "left").where(reach).select("item_id", "doc_id", "bound")
        more = written(left.withColumn("place", F.row_number().over(w)).where(F.col("place") <= slab).drop("place") if slab else left, "slab")
        if more.isEmpty():
            return best.drop("rank")
        best = written(_best(best.drop("rank").unionByName(rescored(docs, more, block)), k), "best")
        if not slab:
            return best.drop("rank")
        cut = more.groupBy("item_id").agg(F.min(F.struct((-F.col("bound")).alias("b"), "doc_id")).alias("x"), F.max(F.struct((-F.col("bound")).alias("b"), "doc_id")).alias("cut")).select("item_id", "cut")
        open_ = left.join(F.broadcast(cut), "item_id").where(F.struct((-F.col("bound")).alias("b"), "doc_id") > F.col("cut")).drop("cut")
        slab = 0  # the threshold is as good as a slab makes it: all that still reaches it is scored


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = 20, depth: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text), equal scores by doc_id. docs are those of the index."""
    depth, docs = depth or 2 * k, unique_texts(docs)
    asked = unique_texts(items.select(F.col("item_id").alias("doc_id"), "text"))
    terms = written(item_terms(asked), "item-terms")
    n, rows = terms.agg(F.count_distinct("item_id"), F.count("*")).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-rows // BLOCK_TERMS))
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    known = written(index.terms.join(slim_side(written(terms.select("term").distinct(), "asked")), "term"), "known")
    found = None
    for b in range(blocks):
        mine = dealt.where(F.col("block") == b).join(known, "term").collect()  # one block: a bounded number of items and terms
        if mine:
            best = _search_block(index, docs, Block(mine, index.n_docs, index.n_terms), k, depth)
            found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # copies of a class that is found share its score; of each class the k smallest can be in the result
    twins = index.copies.join(slim_side(written(found.select(F.col("doc_id").alias("rep")).distinct(), "found")), "rep")
    twins = twins.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("doc_id"))).where(F.col("nth") < k).select("rep", "doc_id")
    shared = found.withColumnRenamed("doc_id", "rep").join(twins, "rep").select("item_id", "doc_id", "score")
    return _best(found.unionByName(shared), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The query's rows in DuckDB.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
with words as (
    select doc_id, {_TERMS} as term from documents
), lengths as (
    select doc_id, count(*) as n from words group by doc_id
), totals as (
    select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths
), postings as (
    select doc_id, term, count(*) as tf from words group by doc_id, term
), asked as (
    select item_id, term, count(*) as times from (select item_id, {_TERMS} as term from benchmark) group by item_id, term
), weights as (
    select p.term, cast(floor(1000 * ln((2 * any_value(t.n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
    from postings p cross join totals t where p.term in (select term from asked) group by p.term
), scored as (
    select a.item_id, p.doc_id, cast(sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * l.n * t.n_docs) // t.n_terms))))) as bigint) as score
    from asked a join weights w using (term) join postings p using (term) join lengths l using (doc_id) cross join totals t group by a.item_id, p.doc_id
), placed as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from placed where rank <= 20
"""
