"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or
earlier in the same document). Matches never cross documents; all strings are judged on the input.

Method: the anchor of a window of `length` bytes is its 32-byte string with the smallest hash (the first of equals), so
equal windows have equal anchors and each window belongs to one anchored run. Work is dealt by anchor. In each key range a
first family finds, batch by batch, the runs whose whole context (anchor and all bytes of the run) came earlier: they are repeats as they stand. What
shares an anchor, but not the whole context, goes to the second family as bytes: every arriving batch gets a suffix array (its
suffixes, as far as `length` bytes, in byte order), which is merge-scanned against the arrays of the existing levels for matches of `length` bytes, and
becomes a level itself; levels of like size merge geometrically, so an entry is merged a logarithmic number of times.

The first family orders by 64-bit hashes of anchor and context (128 bits tell strings apart), the second by bytes alone.

Repeats within a batch of a map task are found before the shuffle, so a passage that a third of all
documents hold sends one row for each batch to its key range.

Defined cases: null text is empty; texts under `length` bytes lose nothing. Repeated rows of a doc_id are one
document (the text that sorts last stands). Null doc_id: left out, but kept as they are by drop_repeats. Other columns are ignored.
Empty input: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._spark import give_back, unique_texts, written

ANCHOR = 32
#: Runs that a key range of the second family gets on average: its levels hold some 30 suffixes for each.
RANGE_RUNS = 4096
_SCAN = 1 << 18
U = K.U


class Family:
    """Sorted arrays of (key, value) with payload columns, in levels of geometrically growing size."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    @staticmethod
    def _find(level: list[np.ndarray], key: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(level[1], value), len(level[1]) - 1)
        return (level[1][at] == value) & (level[0][at] == key)

    def add(self, key: np.ndarray, value: np.ndarray, *payload: np.ndarray) -> np.ndarray:
        """Index a batch, in order of position; true for each entry that was known or came earlier in it."""
        known = np.ones(len(key), bool)
        order = np.argsort(value, kind="stable")
        k, v = key[order], value[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (k[1:] != k[:-1])
        order, k, v = order[first], k[first], v[first]
        fresh = np.ones(len(k), bool)
        for level in self.levels:
            fresh &= ~self._find(level, k, v)
        known[order[fresh]] = False
        if fresh.any():
            new = [k[fresh], v[fresh], *(p[order[fresh]] for p in payload)]
            while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
                both = [np.concatenate(x) for x in zip(self.levels.pop(), new, strict=True)]
                merged = np.argsort(both[1], kind="stable")
                new = [x[merged] for x in both]
            self.levels.append(new)
        return known

    def entries(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.levels, strict=True)] if self.levels else []


class SuffixArrays:
    """Levels of suffixes of `length` bytes in byte order, of geometrically growing size."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def add(self, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Index the suffixes of b at some starts, in order of position; true for each of which `length` bytes were known or came earlier in b."""
        suffix = np.lib.stride_tricks.sliding_window_view(b, self.length)[start].view(f"S{self.length}").ravel()
        known = np.ones(len(suffix), bool)
        order = np.argsort(suffix, kind="stable")
        array = suffix[order]
        first = np.ones(len(array), bool)
        first[1:] = array[1:] != array[:-1]
        order, array = order[first], array[first]
        fresh = np.ones(len(array), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, array), len(level) - 1)
            fresh &= level[at] != array
        known[order[fresh]] = False
        if fresh.any():
            new = array[fresh]
            while self.levels and len(self.levels[-1]) <= 2 * len(new):
                new = np.sort(np.concatenate([self.levels.pop(), new]), kind="stable")
            self.levels.append(new)
        return known


def runs(b: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchored runs of a piece that holds whole documents: document, first and last window start (in the piece), key, context."""
    n = len(b)
    windows = np.diff(bounds) - length + 1
    if n < length or windows.max(initial=0) <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    w = length - ANCHOR + 1
    c, inv = K.prefix_sums(b), K.powers(n + 1)[1]
    key = c[ANCHOR:] - c[:-ANCHOR]
    key *= inv[: len(key)]
    h = K.mix(key)
    mask = U((1 << 26) - 1)
    h &= ~mask
    h |= np.arange(len(h), dtype=U)
    h = np.concatenate([h, np.full(-len(h) % w, 2**64 - 1, U)]).reshape(-1, w)
    ahead = np.minimum.accumulate(h, axis=1).ravel()
    behind = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    at &= mask
    new = np.zeros(count + 1, bool)
    new[1:count] = at[1:] != at[:-1]
    live = np.flatnonzero(windows > 0)
    begin, end = bounds[live], bounds[live] + windows[live]
    new[begin] = True
    new[end[end <= count]] = True
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], count) - 1
    doc = np.searchsorted(bounds, cut, "right") - 1
    inside = cut + length <= bounds[doc + 1]
    lo, hi, doc = cut[inside], last[inside], doc[inside]
    a = at[lo].astype(np.int64)
    ctx = K.mix((c[hi + length] - c[lo]) * inv[lo] + K.mix((a - lo).astype(U) * U(1000003) + (hi - lo).astype(U)))
    return doc, lo, hi, key[a], ctx


def _pieces(offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges with the bounds of their texts; a very long text comes in parts that overlap by length - 1."""
    for lo, hi in K.row_groups(offs, _SCAN):
        if offs[hi] - offs[lo] <= 16 * _SCAN:
            yield lo, hi, offs[lo : hi + 1]
        else:
            for at in range(int(offs[lo]), max(int(offs[hi]) - length + 1, int(offs[lo]) + 1), 16 * _SCAN):
                yield lo, hi, np.array([at, min(at + 16 * _SCAN + length - 1, offs[hi])])


#: A run's first window, whether it is known by now, and how many windows follow, in one number: 40, 1 and 23 bits.
_RUN = "key long, ctx long, doc_id long, span long"
_KNOWN, _MORE = 1 << 23, (1 << 23) - 1
_OUT = "doc_id long, lo long, hi long, key long, open boolean"


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offs = K.text_buffers(batch.column(1))
            found: list[tuple[np.ndarray, ...]] = []
            for r, _, bounds in _pieces(offs, length):
                doc, lo, hi, key, ctx = runs(raw[bounds[0] : bounds[-1]], bounds - bounds[0], length)
                shift = bounds[0] - offs[r + doc]
                found.append((ids[r + doc], lo + shift, hi + shift, key, ctx))
                if sum(len(x[0]) for x in found) > 400_000:
                    yield from _local(found)
                    found = []
            yield from _local(found)
        give_back()

    return run


def _local(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch; what repeats within it is known now and needs no key range."""
    if not found:
        return
    doc, lo, hi, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lo, doc))
    doc, lo, hi, key, ctx = (x[order] for x in (doc, lo, hi, key, ctx))
    known = Family().add(key, ctx)
    span = lo << 24 | known.astype(np.int64) << 23 | (hi - lo)
    for i in range(0, len(doc), 50_000):
        s = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64)[s], ctx.view(np.int64)[s], doc[s], span[s])], [x.split()[0] for x in _RUN.split(", ")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one key range, sorted by position: runs that came earlier; at the end those that share an anchor only."""
    family = Family()
    names = [x.split()[0] for x in _OUT.split(", ")]
    for batch in batches:
        key, ctx, doc, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        lo, known = span >> 24, (span & _KNOWN) != 0
        hi = lo + (span & _MORE)
        at = np.flatnonzero(~known)
        known[at] = family.add(key[at].view(U), ctx[at].view(U), doc[at], lo[at], hi[at])
        if known.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[known]) for x in (doc, lo, hi, key)), pa.array(np.zeros(known.sum(), bool))], names)
    if family.levels:
        key, _, doc, lo, hi = family.entries()
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.zeros(len(key), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        for i in range(0, int(shared.sum()), 50_000):
            at = np.flatnonzero(shared)[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (doc, lo, hi, key.view(np.int64))), pa.array(np.ones(len(at), bool))], names)
    give_back()


def _contexts(length: int):
    """Bytes of the open runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(1))
            out: list[list] = [[], [], [], []]
            for i, (doc, items) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                lo, hi, key = (items.values.field(f).to_numpy() for f in ("lo", "hi", "key"))
                out[0] += [doc] * len(lo)
                out[1] += lo.tolist()
                out[2] += key.tolist()
                out[3] += [text[x : y + length] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "lo", "key", "bytes"])
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "lo", "key", "bytes"])
        give_back()

    return run


def _windows(length: int):
    """Of open runs, sorted by position: ranges of windows that came earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixArrays(length)
        for batch in batches:
            doc, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            raw, offs = K.text_buffers(batch.column(3))
            for i, j in K.row_groups(offs, _SCAN):
                b, size = raw[offs[i] : offs[j]], np.diff(offs[i : j + 1]) - length + 1
                owner = np.repeat(np.arange(j - i), size)
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                known = family.add(b, (offs[i:j] - offs[i])[owner] + step)
                if not known.any():
                    continue
                first = known.copy()
                first[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
                last = known.copy()
                last[:-1] &= ~known[1:] | (owner[1:] != owner[:-1])
                f, e = np.flatnonzero(first), np.flatnonzero(last)
                base = lo[i:j][owner[f]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[i:j][owner[f]]), pa.array(base + step[f]), pa.array(base + step[e])], ["doc_id", "lo", "hi"])
        give_back()

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi): ranges of starts of windows that occur earlier; ranges may repeat."""
    texts = docs.select("doc_id", "text")
    route = F.when(F.col("span").bitwiseAND(F.lit(_KNOWN)) != 0, F.xxhash64("doc_id")).otherwise(F.col("key"))  # what is known already goes anywhere
    rows = texts.mapInArrow(_scan(length), _RUN).repartition(route).sortWithinPartitions("doc_id", "span")
    found = written(rows.mapInArrow(_index, _OUT), "runs")
    opened = found.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "key")).alias("items"))
    contexts = texts.join(opened, "doc_id").mapInArrow(_contexts(length), "doc_id long, lo long, key long, bytes binary")
    conf = docs.sparkSession.conf
    ranges = max(int(conf.get("spark.sql.shuffle.partitions")), -(-found.where("open").count() // RANGE_RUNS))
    parts = contexts.repartition(ranges, "key").sortWithinPartitions("doc_id", "lo").mapInArrow(_windows(length), "doc_id long, lo long, hi long")
    return found.where("not open").select("doc_id", "lo", "hi").unionByName(parts)


def _spans(items: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed byte ranges of one document from its window ranges."""
    if not len(items):
        return np.zeros((0, 2), np.int64)
    items = items[np.argsort(items[:, 0], kind="stable")]
    end = np.maximum.accumulate(items[:, 1] + length)
    new = np.ones(len(items), bool)
    new[1:] = items[1:, 0] > end[:-1]
    return np.stack([items[new, 0], np.append(end[:-1][new[1:]], end[-1])], axis=1)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay, in order) and kept_sha256 of each document."""
    return _cut(docs, length, False)


def _cut(docs: DataFrame, length: int, as_text: bool) -> DataFrame:
    """without_repeats; with as_text, doc_id and the text that stays."""
    docs = unique_texts(docs)
    items = repeated_windows(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("items"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(1))
            out: list[list] = [[] for _ in range(5)]
            for i, items in enumerate(batch.column(2)):
                text = raw[offs[i] : offs[i + 1]]
                pairs = np.stack([items.values.field(f).to_numpy() for f in ("lo", "hi")], axis=1) if items.is_valid else np.zeros((0, 2), np.int64)
                spans = _spans(pairs, length)
                keep = np.concatenate([[0], spans.ravel(), [len(text)]]).reshape(-1, 2)
                kept = b"".join(text[x:y].tobytes() for x, y in keep)
                for col, v in zip(out, (len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            if as_text:
                texts = pa.array([x.decode("utf-8", "ignore") for x in out[3]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        give_back()

    return docs.select("doc_id", "text").join(items, "doc_id", "left").mapInArrow(run, "doc_id long, text string" if as_text else schema)


def drop_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Rows of docs, one for each doc_id, with repeated strings cut out of text (and n_chars, if there, to match).

    Characters of which a part was cut go whole.
    """
    new = _cut(docs, length, True)
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        rest = named.drop("text")
    else:  # the row whose text stands
        rest = named.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in docs.columns if c not in ("text", "doc_id"))), "text").alias("row")).select("doc_id", "row.*")
    out = rest.join(new, "doc_id")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))
