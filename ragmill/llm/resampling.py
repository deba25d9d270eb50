"""Quality classifier by importance resampling with hashed n-gram models.

Method: two generative models over hashed features (which words, word pairs and levels of self-repetition a document
holds): target text, from documents labelled good and not toxic, and raw text, from all documents. Each model gives every feature
the share of its documents that hold it. A document's log importance weight is the sum of the log ratios target / raw of its features, normalised by the
number of features that tell (over its square root from `few` on), so that weights of documents of all lengths are of the order of the noise. The
sample is the top k of log weight + Gumbel noise over all documents, which draws k without replacement in proportion to their weights. k is a
parameter; by default it is the number that rejection sampling would accept, the sum of min(1, weight).

`prior` documents are added to either count. A feature tells if its count in target text lies `sure` standard deviations or more from what raw text lets
expect; others have a ratio of 1. A ratio above 1 counts with the share `credit` of its log, so that hundreds of ordinary words do not drown a few bad ones.
These are constants: nothing depends on how large the tables are, and any number of features may tell.
Every feature is hashed twice and the ratio nearer to 1 stands, so that a word that shares one bucket with a telling one
isn't taken for it.

Counts are summed in each task into arrays of fixed size (`2 * 2**bits` numbers for each model), sent in slices and summed; the driver
sees the telling features of each slice only, besides the ids of at most `most_labelled` labelled documents (those with the smallest hashes).
Raw counts cover all documents. Scoring is a scan without a shuffle.

Defined cases: null or empty text has no features and weight 1. Labels of one document must agree for it to be target text;
null labels are no labels. Without target text all weights are 1. Repeated rows are judged alike; a row with a null doc_id is raw text and has its noise
from its text. Columns log_weight and sample_key of the input are replaced. Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._spark import folded, give_back, in_small_batches, written

U = K.U
BITS = 21
_SLICES = 64


def features(col: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: first and end row, and each distinct (row, hash of a feature)."""
    for lo, hi, h, row in K.words(col):
        same = row[1:] == row[:-1]
        pair = K.mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[same]
        again = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=hi - lo)
        rep = np.flatnonzero(again)
        level = K.mix(np.frexp(again[rep])[1].astype(U) + U(12345))
        owner, value = np.concatenate([row, row[1:][same], rep]), np.concatenate([h, pair, level])
        order = np.argsort(value)
        order = order[np.argsort(owner[order], kind="stable")]
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi, owner[new], value[new]


def buckets(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each feature: one in each half of the model."""
    return (value >> U(64 - bits)).astype(np.int64), (K.mix(value + U(7919)) >> U(64 - bits)).astype(np.int64) + (1 << bits)


def _target_ids(labels: DataFrame, most: int) -> np.ndarray:
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q >= 1 and t <= 0")
    rows = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


_TELLING = np.dtype([("bucket", "i4"), ("ratio", "f4")])


def telling(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int, prior: float, sure: float, credit: float) -> np.ndarray:
    """The buckets that tell, whose count in target text is far from what raw text lets expect, and the log ratio of each."""
    share = n_target / max(n_raw, 1)
    expected = raw * share
    away = np.abs(target - expected) / np.sqrt(expected * (1 - share) + 1)
    at = np.flatnonzero(away >= sure)
    ratio = np.log((target[at] + prior) / (expected[at] + prior))
    out = np.zeros(len(at), _TELLING)
    out["bucket"], out["ratio"] = at, np.where(ratio > 0, credit * ratio, ratio)
    return out


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, prior: float = 0.1, sure: float = 3.0, credit: float = 0.5, most_labelled: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The telling buckets and the log ratio of target to raw of each."""
    spark, width = docs.sparkSession, 2 << bits
    target = spark.sparkContext.broadcast(_target_ids(labels, most_labelled))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, docs_seen = target.value, np.zeros((2, width), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            doc, known = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            hit = np.searchsorted(ids, doc)
            hit = known & (ids[np.minimum(hit, len(ids) - 1)] == doc) if len(ids) else np.zeros(len(doc), bool)
            docs_seen += (len(doc), int(hit.sum()))
            for lo, _, row, value in features(batch.column(1), bits):
                mine = hit[lo + row]
                for feature in buckets(value, bits):
                    np.add.at(total[0], feature, 1)
                    np.add.at(total[1], feature[mine], 1)
        give_back()
        step = width // _SLICES
        for i in range(_SLICES if docs_seen[0] else 0):
            part = np.concatenate([docs_seen.astype(np.int32), total[:, i * step : (i + 1) * step].ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    parts = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "slice long, counts binary")

    def finish(_: int, got: np.ndarray) -> bytes:
        raw, tgt = got[2:].reshape(2, -1).astype(np.float64)
        return telling(raw, tgt, int(got[0]), int(got[1]), prior, sure, credit).tobytes() if got[1] else b""

    found = [np.zeros(0, _TELLING)]
    for i, v in folded(parts, "counts", np.int32, np.add, finish).collect():
        found.append(np.frombuffer(v, _TELLING).copy())
        found[-1]["bucket"] += i * (width // _SLICES)
    best = np.concatenate(found)
    return best["bucket"].copy(), best["ratio"].copy()


def weighted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, few: int = 16) -> DataFrame:
    """Rows of docs with their log_weight."""
    docs = docs.drop("log_weight", "sample_key")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.zeros(2 << bits, np.float32)
        ratio[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, row, value in features(batch.column(at), bits):
                a, b = (ratio[x].astype(np.float64) for x in buckets(value, bits))
                x = np.where(np.abs(a) <= np.abs(b), a, b)
                tell = np.bincount(row, x != 0, minlength=hi - lo)
                out[lo:hi] = np.bincount(row, x, minlength=hi - lo) / np.maximum(1, np.sqrt(tell / few))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*(f"c{i}" for i in range(batch.num_columns)), "log_weight"])
        give_back()

    kinds = docs.schema
    plain = in_small_batches(docs).select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)), "log_weight double"])
    return plain.mapInArrow(score, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), "log_weight")


def gumbel(seed: int, columns: list[str]) -> Column:
    """Gumbel noise that a row has from its doc_id and the seed alone; from its text where it has no doc_id."""
    drawn = F.xxhash64(F.col("doc_id"), F.lit(seed))
    if "text" in columns:
        drawn = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"), F.lit(seed))).otherwise(drawn)
    u = (F.pmod(drawn, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """A key that k rows reach (more only if rows tie with it), by refining a histogram; the driver sees the bins only."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        step = (high - low) / bins
        if low + step <= low or high - step >= high:
            break
        inside = df.where(F.col(key).between(low, high)).select(F.least(F.floor((F.col(key) - low) / step), F.lit(bins - 1)).alias("bin"), key)
        counts = sorted(inside.groupBy("bin").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), reverse=True)
        for _, n, lo, hi in counts:
            if above + n >= k:
                break
            above += n
        if above + n == k:
            return lo
        if (lo, hi) == (low, high):
            break
        low, high = lo, hi
    return low


def draw(weights: DataFrame, k: int, seed: int = 7) -> tuple[Column, float]:
    """The Gumbel key of a row with a doc_id and a log_weight, and the key from which on k rows of weights are drawn (ties at it all are)."""
    key = F.col("log_weight") + gumbel(seed, weights.columns)
    slim = written(weights.select(key.alias("sample_key")), "keys")
    return key, kth_largest(slim, "sample_key", k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, bits: int = BITS) -> DataFrame:
    """The rows of docs that are drawn, with log_weight and sample_key: k, or as many as rejection sampling would accept."""
    scored = weighted(docs, fit(docs, labels, bits), bits)
    key = F.col("log_weight") + gumbel(seed, docs.columns)
    slim = written(scored.select("log_weight", key.alias("sample_key")), "weights")
    if k is None:
        k = round(slim.agg(F.sum(F.least(F.lit(1.0), F.exp("log_weight")))).first()[0] or 0)
    cut = kth_largest(slim, "sample_key", k) if k else float("inf")
    return scored.withColumn("sample_key", key).where(F.col("sample_key") >= cut)
