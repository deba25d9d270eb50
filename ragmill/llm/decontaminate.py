"""Benchmark decontamination with spaced-seed hashing.

Method: a seed is a fixed mask over eight words; its hash ignores the words at the masked-out positions, so a
substituted word there changes nothing. All positions of items and documents are hashed under every mask. Equal hashes
fix an alignment of an item with a place in a document; there the aligned words are compared one by one, and the item is
found if `num / den` of the words of some window of `span` words of it (of the whole item, if shorter) are equal. By enumeration the
masks hit over 0.99 of such patterns of substitutions of 3 words in 15 and 4 in 20, 0.93 of those of 2 in 10, and any
single substitution from 8 words on. Items of under eight words have a seed of their own, their whole sequence, and are found where they
occur word for word.

Words are runs of ASCII letters and digits and of all non-ASCII characters, lower-cased. The benchmark's hashes set two
bits each in a table of fixed size, which goes to all tasks: document positions that miss it never leave their task. The others are
joined with the benchmark by hash. A larger benchmark only lets more positions through; the result is the same.

Defined cases: null or empty texts and items have no overlap. A text may be shorter than an item: only its words count.
Repeated rows of a doc_id or item_id count as further texts of it; each (doc_id, item_id) comes once, with its
best overlap. Null ids take no part in overlaps; drop_contaminated judges rows without a doc_id by their text. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._spark import fold_slices, give_back, in_small_batches, slim_side, written

U = K.U
#: Masks over eight words: 1 is looked at, 0 is ignored.
MASKS = ("11111000", "11110100", "11011010", "10110110", "11101001", "01100111")
WIDE = 8
#: Words from the first to the last seed of a stretch; one that runs on is the next stretch, and both keep the words of a whole window around each of their seeds.
LONGEST = 512
_BITS = 24
_SLICES = 16


def _words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from K.words(pc.utf8_lower(pc.fill_null(col, "")), K.NOT_WORD)


def _seeds(h: np.ndarray, row: np.ndarray, short: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask, and each length of short items: its width, positions where it fits in one text, and its hashes there."""
    for m, mask in enumerate((*MASKS, *("1" * n for n in short))):
        n, salt = len(h) - len(mask) + 1, m if m < len(MASKS) else 100 + len(mask)
        at = np.flatnonzero(row[: max(n, 0)] == row[len(mask) - 1 :]) if n > 0 else np.zeros(0, np.int64)
        whole = len(at) == n
        v = np.full(len(at), (salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), U)
        for k, bit in enumerate(mask):
            if bit == "1":
                v *= U(0xD6E8FEB86659FD93)
                v += h[k : k + n] if whole else h[at + k]
        yield len(mask), at, K.mix(v)


def short_lengths(benchmark: DataFrame) -> tuple[int, ...]:
    """Lengths under WIDE that items have: WIDE - 1 numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {int(n) for lo, hi, _, row in _words(batch.column(1)) for n in np.unique(np.bincount(row, minlength=hi - lo)) if 0 < n < WIDE}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["n"])

    return tuple(sorted(r.n for r in _rows(benchmark, "item_id").mapInArrow(run, "n int").distinct().collect()))


def _probes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v >> U(64 - _BITS)).astype(np.int64), (v & U((1 << _BITS) - 1)).astype(np.int64)


def benchmark_seeds(benchmark: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """hash, item_id and pos of each seed of each item; short items have that of their own length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, h, row in _words(batch.column(1)):
                start, count = np.searchsorted(row, np.arange(hi - lo)), np.bincount(row, minlength=hi - lo)
                for wide, at, v in _seeds(h, row, short):
                    mine = (wide == WIDE) | (count[row[at]] == wide)
                    at, v = at[mine], v[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[lo + row[at]]), pa.array(at - start[row[at]])], ["hash", "item_id", "pos"])

    return _rows(benchmark, "item_id").mapInArrow(run, "hash long, item_id long, pos long")


def _rows(df: DataFrame, key: str) -> DataFrame:
    return in_small_batches(df).select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull())


def _table(seeds: DataFrame) -> np.ndarray:
    """Which probes the seeds set; the driver sees this table of fixed size only."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << _BITS, bool)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy(zero_copy_only=False).view(U)):
                seen[p] = True
        for i, part in enumerate(np.split(np.packbits(seen), _SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["slice", "bits"])

    size = (1 << _BITS) // 8 // _SLICES
    out = np.zeros((_SLICES, size), np.uint8)
    for i, bits in fold_slices(seeds.select("hash").mapInArrow(mark, "slice long, bits binary"), "bits", np.uint8, np.bitwise_or).items():
        out[i] = bits
    return np.unpackbits(out.ravel()).astype(bool)


def _stretches(docs: DataFrame, seeds: DataFrame, span: int, short: tuple[int, ...]) -> DataFrame:
    """Stretches of documents around seeds that may be the benchmark's, with their word hashes."""
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(_table(seeds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(5)]
            for lo, hi, h, row in _words(batch.column(1)):
                found = []
                for _, at, v in _seeds(h, row, short):
                    a, b = _probes(v)
                    ok = np.flatnonzero(seen[a])
                    ok = ok[seen[b[ok]]]
                    found.append((at[ok], v[ok]))
                at, v = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, v = at[order], v[order]
                begin, end = np.searchsorted(row, np.arange(hi - lo)), np.searchsorted(row, np.arange(hi - lo), "right")
                new = np.concatenate([[True], (row[at[1:]] != row[at[:-1]]) | (np.diff(at) > WIDE)])
                run = at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                new[1:] |= run[1:] // LONGEST != run[:-1] // LONGEST
                for i, j in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(at)], strict=True):
                    r = row[at[i]]
                    first, last = max(begin[r], at[i] - span), min(end[r], at[j - 1] + WIDE + span)
                    for col, x in zip(out, (ids[lo + r], first - begin[r], h[first:last].tobytes(), v[i:j].view(np.int64), at[i:j] - first), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "start", "words", "hashes", "places"])
        give_back()

    return _rows(docs, "doc_id").mapInArrow(run, "doc_id long, start long, words binary, hashes array<long>, places array<long>")


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = 20, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, n_equal, n_words: the best aligned window of each item found in each document."""
    short = short_lengths(benchmark)
    seeds = written(benchmark_seeds(benchmark, short), "seeds")
    near = written(_stretches(docs, seeds, span, short).withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    hits = near.select("stretch", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("stretch", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    lines = hits.join(slim_side(seeds), "hash").select("stretch", "item_id", (F.col("place") - F.col("pos")).alias("shift")).distinct()

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, row in _words(batch.column(1)):
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                blobs = pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blobs, pa.array(np.diff(cut))], ["item_id", "item", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, item, shift, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, want = np.frombuffer(a, U), np.frombuffer(b, U)
                at = np.arange(len(want)) + shift
                inside = (at >= 0) & (at < len(text))
                same = np.zeros(len(want), np.int64)
                same[inside] = text[at[inside]] == want[inside]
                size = min(span, len(want))
                total = np.concatenate([[0], np.cumsum(same)])
                best = int((total[size:] - total[:-size]).max())
                if best * den >= num * size:
                    for col, x in zip(out, (doc, item, best, size), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "n_equal", "n_words"])

    words = written(_rows(benchmark, "item_id").mapInArrow(items, "item_id long, item binary, n long"), "items")
    # of a stretch only the words that the item would lie on go on, so a line costs an item's length however long the text is
    first = F.greatest(F.col("shift"), F.lit(0))
    window = F.substring(F.col("words"), (8 * first + 1).cast("int"), (8 * (F.col("shift") + F.col("n") - first)).cast("int"))
    placed = written(lines.join(words.select("item_id", "n"), "item_id"), "lines").join(near.select("stretch", "doc_id", "words"), "stretch")
    placed = placed.select("doc_id", "item_id", F.least(F.col("shift"), F.lit(0)).alias("shift"), window.alias("words"))
    pairs = placed.join(words.select("item_id", "item"), "item_id").select("doc_id", "item_id", "shift", "words", "item")
    found = pairs.mapInArrow(verify, "doc_id long, item_id long, n_equal long, n_words long")
    best = F.max_by(F.struct("n_equal", "n_words"), F.struct(F.col("n_equal") / F.col("n_words"), "n_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_equal", "b.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 20, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs in which no benchmark item is found."""

    def found(rows: DataFrame) -> DataFrame:
        return slim_side(written(overlaps(rows, benchmark, span, num, den).select("doc_id").distinct(), "contaminated"))

    kept = docs.join(found(docs), "doc_id", "left_anti")
    if docs.where("doc_id is null").isEmpty():
        return kept.select(*docs.columns)
    text = F.xxhash64("text")  # stands for the id of rows that have none
    nameless = docs.where("doc_id is null")
    bad = found(nameless.select(text.alias("doc_id"), "text")).withColumnRenamed("doc_id", "text_hash")
    clean = nameless.join(bad, text == F.col("text_hash"), "left_anti")
    return kept.where("doc_id is not null").select(*docs.columns).unionByName(clean.select(*docs.columns))
