"""Exact n-gram Jaccard self-join of documents, as classes and connected components.

Method: equal sets are one class, for which its smallest doc_id stands. Documents fall into size bands that grow by a constant factor; a pair whose similarity
reaches the threshold lies in one band or two neighbouring ones. In a band, the hash range is
cut into more parts than two linked sets can differ in, so linked sets agree in some
parts (pigeonhole): equal parts give candidate groups and no link is missed. Very frequent shingles (by a sketch of fixed size over
all documents) are left out of parts, which makes two sets differ in no more of them, so that common lines make no candidates.
There are spare parts, so those with too few shingles need not count; a document with more of these sends the parts of all its
shingles besides. Linked sets so agree in a known number of parts. A document that shares fewer with any others has no link,
and each may leave out, of the parts that it shares, just under half that number: those that it shares with the documents with which it shares
least. Passages that many documents hold then chain few candidates, and no link is lost. In each candidate
group and band (a tile), bitmaps of hashed shingles bound the overlap from above by bit counts, and
only pairs that pass get the exact intersection of their sorted arrays. A tile gives a spanning
forest, never all its pairs. Tiles over a size limit are cut into blocks which all hold the tile's
pivot; documents that the pivot doesn't link are compared with every block.

Defined cases: null or empty text, or text of separators only: empty set, linked with nothing.
Repeated rows of a doc_id: the same document (the text that sorts last stands). Null doc_id: left out.
Other columns are ignored. Empty input: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._graph import components
from ragmill.llm._spark import fold_slices, give_back, slim_side, unique_texts, written
from ragmill.llm._tiles import Linker, tile_edges

#: Documents and shingles of one block of a tile.
BLOCK_DOCS, BLOCK_SHINGLES = 16384, 1 << 23
#: The sketch of shingle frequencies, and from which share of documents on a shingle is frequent.
SKETCH_BITS, SLICES, FREQUENT = 19, 64, 0.002
#: A vertex is a set in a band: the high bits of its digest, the band, and the level of the parts that it must share. The last level marks a hub, the documents of a part.
BAND_BITS, LEVEL_BITS = 10, 6
LEVELS = np.unique((1.2 ** np.arange(96)).astype(np.int64))[: (1 << LEVEL_BITS) - 1]
HUB = (1 << LEVEL_BITS) - 1
#: Rows of (hub, vertex) that a task folds at once.
FOLD_ROWS = 1 << 19


class Bands:
    """Size bands and the parts of each, for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        starts, grow = [1], (den / num) ** 2
        while starts[-1] < 2**40:
            starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * grow)))
        self.starts = np.array(starts, np.int64)
        differ = [(a - 1 + (a - 1) * den // num) * (den - num) // (den + num) for a in starts[1:]]
        # a part counts from two shingles on where the threshold leaves enough of them for each part, else from one
        self.least, spare = (2, 0.15) if 100 * num >= 84 * den else (1, 0.25)
        self.slack = np.array([0 if d == 0 else max(1, math.ceil(spare * d)) for d in differ], np.int64)
        self.parts = np.array(differ, np.int64) + 1 + self.slack

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def lower(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set of n may link with a smaller one of the band below."""
        return (band > 0) & (n * self.num <= (self.starts[band] - 1) * self.den)


def word_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, h, row in K.words(batch.column(batch.schema.get_field_index("text"))):
        yield lo, hi, *K.shingle_sets(h, row, hi - lo, n)


def _sums(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, K.U), np.cumsum(v, dtype=K.U)])
    return c[at[1:]] - c[at[:-1]]


def digest_columns(s: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """A 128-bit digest of each set, as two longs."""
    return [pa.array(_sums(K.mix(x), at).view(np.int64)) for x in (s ^ K.U(0x5851F42D4C957F2D), s + K.U(0x14057B7EF767814F))]


def _buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s >> K.U(64 - SKETCH_BITS)).astype(np.int64), (K.mix(s + K.U(7919)) >> K.U(64 - SKETCH_BITS)).astype(np.int64) + (1 << SKETCH_BITS)


_DIGESTS = "doc_id long, n_shingles long, h1 long, h2 long, slice int, counts binary"


def set_digests(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of each set; besides, rows (slice, counts) of each task's sketch of shingle frequencies."""
    names = [x.split()[0] for x in _DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sketch = 0, np.zeros(2 << SKETCH_BITS, np.int32)
        for batch in batches:
            seen += batch.num_rows
            for lo, hi, s, at in word_sets(batch, n):
                for b in _buckets(s):
                    np.add.at(sketch, b, 1)
                rows = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(np.diff(at)), *digest_columns(s, at), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if seen:
            parts = [np.concatenate([np.array([seen if i == 0 else 0], np.int32), x]).tobytes() for i, x in enumerate(np.split(sketch, SLICES))]
            blank = [pa.nulls(SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*blank, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names)
        give_back()

    return docs.mapInArrow(run, _DIGESTS)


def frequent_shingles(digests: DataFrame) -> np.ndarray:
    """Which buckets of the sketch hold shingles of more than FREQUENT of all documents; all that the driver sees is the sketch."""

    got = fold_slices(digests.where("slice is not null"), "counts", np.int32, np.add)
    if not got:
        return np.zeros(2 << SKETCH_BITS, bool)
    return np.concatenate([got[i][1:] for i in range(SLICES)]) > max(32, FREQUENT * int(got[0][0]))


def _parts(s: np.ndarray, at: np.ndarray, rows: np.ndarray, band: np.ndarray, bands: Bands, salt: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of rows in bands with the row and band of each and how many parts that row shares at least with any that it links with, and the (rows, bands) that have so many thin parts that they may agree in no other.

    With last, these send all their parts; else they send none here.
    """
    left = np.diff(at)
    none = np.zeros(0, np.int64)
    keys, owners, schemes, needs, odd_rows, odd_bands = [np.zeros(0, K.U)], [none], [none], [none], [none], [none]
    value = K.mix(s * K.U(0x2545F4914F6CDD1D) + K.U(1))
    for scheme in np.unique(band):
        mine = np.sort(rows[band == scheme])
        m, slack = int(bands.parts[scheme]), int(bands.slack[scheme])
        n = left[mine]
        take = np.repeat(at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(mine)), n)
        part = ((s[take] >> K.U(32)) * K.U(m) >> K.U(32)).astype(np.int64)
        slot = owner * m + part
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        total = np.add.reduceat(value[take], first) if len(slot) else np.zeros(0, K.U)
        part, owner = part[first], owner[first]
        count = np.diff(np.append(first, len(slot)))
        thin = m - np.bincount(owner[count >= bands.least], minlength=len(mine))
        odd = np.flatnonzero(thin > slack)
        keep = (count >= bands.least) | np.isin(owner, odd) if last else count >= bands.least
        part, owner, total = part[keep], owner[keep], total[keep]
        if last:
            for i in odd:
                empty = np.setdiff1d(np.arange(m), part[owner == i])
                part, owner, total = np.concatenate([part, empty]), np.concatenate([owner, np.full(len(empty), i)]), np.concatenate([total, np.zeros(len(empty), K.U)])
        keys.append(K.mix(total + K.mix(part.astype(K.U) + K.U((int(scheme) * 2 + salt) << 40))) & ~K.U(255) | K.U(int(scheme)))
        owners.append(mine[owner])
        schemes.append(np.full(len(owner), scheme))
        # of the parts in which linked rows agree, slack + 1 or more, at most those that are thin here aren't sent
        needs.append(np.ones(len(owner), np.int64) if last else np.maximum(1, 1 + slack - thin)[owner])
        odd_rows.append(mine[odd])
        odd_bands.append(np.full(len(odd), scheme))
    return tuple(map(np.concatenate, (keys, owners, schemes, needs, odd_rows, odd_bands)))


def _keys(s: np.ndarray, at: np.ndarray, rare: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts and the row of each."""
    return _sent(s, at, rare, bands)[:2]


def _sent(s: np.ndarray, at: np.ndarray, rare: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts, the row and band of each, and in how many keys of this band the row agrees at least with any that it links with. rare marks the shingles that aren't frequent.

    Parts are of rare shingles; a row that has too few of them for that sends, besides, the parts of all its shingles. So
    two linked rows agree in a part of rare shingles, or both are of the latter kind and agree in one of all shingles. Of the latter kind no more is known.
    """
    size = np.diff(at)
    rows = np.flatnonzero(size)
    band = bands.band(size[rows])
    low = bands.lower(size[rows], band)
    rows, band = np.concatenate([rows, rows[low]]), np.concatenate([band, band[low] - 1])
    *sent, odd_rows, odd_bands = _parts(s[rare], np.concatenate([[0], np.cumsum(rare)])[at], rows, band, bands, 0, False)
    if len(odd_rows):
        *more, _, _ = _parts(s, at, odd_rows, odd_bands, bands, 1, True)
        sent = [np.concatenate(x) for x in zip(sent, more, strict=True)]
    return tuple(sent)


def _vertices(digest: np.ndarray, scheme: np.ndarray, need: np.ndarray) -> np.ndarray:
    low = (scheme.astype(K.U) << K.U(LEVEL_BITS)) | (np.searchsorted(LEVELS, need, "right") - 1).astype(K.U)
    return (digest & ~K.U((1 << BAND_BITS + LEVEL_BITS) - 1) | low).view(np.int64)


def _counted(hub: np.ndarray, vertex: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((hub, vertex))
    hub, vertex = hub[order], vertex[order]
    first = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (vertex[1:] != vertex[:-1])]))
    return pa.RecordBatch.from_arrays([pa.array(hub[first]), pa.array(vertex[first]), pa.array(np.diff(np.append(first, len(hub))))], ["hub", "vertex", "n"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, vertex, n) of rows (key, vertex) sorted by both: of the keys that several vertices hold, vertex holds n whose smallest vertex is hub."""
    key_before, vertex_before, root, place_before = None, None, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, vertex = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new_key = np.concatenate([[key[0] != key_before], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[vertex[0] != vertex_before], vertex[1:] != vertex[:-1]])
        key, vertex, new_key = key[new], vertex[new], new_key[new]
        if not len(key):
            continue
        row = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new_key, row, -1))
        hub = np.where(first >= 0, vertex[first], root)
        place = np.where(first >= 0, row - first, place_before + 1 + row)
        key_before, vertex_before, root, place_before = key[-1], vertex[-1], hub[-1], place[-1]
        second, later = hub[place == 1], place > 0
        held.append((np.concatenate([hub[later], second]), np.concatenate([vertex[later], second])))
        if sum(len(h) for h, _ in held) >= FOLD_ROWS:
            yield _counted(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if sum(len(h) for h, _ in held):
        yield _counted(*map(np.concatenate, zip(*held, strict=True)))


def candidate_edges(docs: DataFrame, n: int, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """(a, b): hubs, and the vertices that agree in a part with others there. Equal sets are one vertex."""

    table = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(table.value).astype(bool)
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, s, at in word_sets(batch, n):
                digests = [x.to_numpy() for x in digest_columns(s, at)]
                fresh = np.zeros(len(at) - 1, bool)  # of equal sets a task sends one, as long as it remembers them
                for i, x in enumerate(zip(*(d.tolist() for d in digests), strict=True)):
                    fresh[i] = x not in sent
                    sent.add(x)
                a, b = _buckets(s)
                keys, owner, scheme, need = (x for x in _sent(s, at, ~(common[a] & common[b]), bands))
                keep = fresh[owner]
                vertex = _vertices(digests[0].view(K.U)[owner[keep]], scheme[keep], need[keep])
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(vertex)], ["key", "vertex"])
            if len(sent) > FOLD_ROWS:
                sent.clear()
        give_back()

    rows = docs.mapInArrow(emit, "key long, vertex long").repartition("key").sortWithinPartitions("key", "vertex")
    held = rows.mapInArrow(shared_keys, "hub long, vertex long, n long").repartition("vertex").groupBy("vertex", "hub").agg(F.sum("n").alias("n"))
    least = F.element_at(F.array(*(F.lit(int(x)) for x in LEVELS)), F.col("vertex").bitwiseAND(HUB).cast("int") + 1)
    by = Window.partitionBy("vertex")
    held = held.withColumn("least", least).withColumn("all", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("n", "hub").rowsBetween(Window.unboundedPreceding, 0)))
    # linked vertices agree in max(least, least) keys or more: if each leaves out fewer than half of its own least, one is left
    held = held.where((F.col("all") >= F.col("least")) & (F.col("upto") > F.expr("(least - 1) div 2")))
    return written(held.select(F.col("hub").bitwiseOR(F.lit(HUB)).alias("a"), F.col("vertex").alias("b")), "candidates")


def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 64), K.U)
    for i, s in enumerate(sets):
        bit = s & K.U(width - 1)
        np.bitwise_or.at(out[i], (bit >> K.U(6)).astype(np.int64), K.U(1) << (bit & K.U(63)))
    return out


def link_block(sets: list[np.ndarray], num: int, den: int, guests: int = 0) -> np.ndarray:
    """A label for each set: equal labels are linked, directly or by others of the block.

    With guests, the last so many sets are compared with the ones before them only.
    """
    m = len(sets)
    label = np.arange(m)
    size = np.array([len(s) for s in sets], np.int64)
    width = int(min(8192, max(64, 1 << int(2 * size.max() - 1).bit_length())))
    bits = _bitmaps(sets, width)
    hosts = m - guests
    for i in range(hosts, m) if guests else range(m - 1):
        span = slice(0, hosts) if guests else slice(i + 1, m)
        need = -(-num * (size[i] + size[span]) // (num + den))
        maybe = (label[span] != label[i]) & (np.minimum(size[i], size[span]) >= need)
        at = np.flatnonzero(maybe) + span.start
        if not len(at):
            continue
        need = need[at - span.start]
        more = np.bitwise_count(bits[i] & ~bits[at]).sum(1, dtype=np.int64)
        fewer = np.bitwise_count(bits[at] & ~bits[i]).sum(1, dtype=np.int64)
        for j, least in zip(at[(size[i] - more >= need) & (size[at] - fewer >= need)], need[(size[i] - more >= need) & (size[at] - fewer >= need)], strict=True):
            if label[i] == label[j]:
                continue
            small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            pos = np.searchsorted(large, small)
            pos[pos == len(large)] = 0
            if int((large[pos] == small).sum()) >= least:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def with_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members (doc_id and others) with the sorted sets of their documents as a column shingles. A document's rows, as many as it meets blocks, go to its text as one."""
    others = [c for c in members.columns if c != "doc_id"]
    joined = docs.join(slim_side(members.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("of"))), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("of"))
            for lo, hi, s, at in word_sets(batch, n):
                mine = of.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy())
                told = mine.flatten()
                for k in range(0, len(row), 2000):
                    part = row[k : k + 2000]
                    blobs = pa.array([s[at[i] : at[i + 1]].tobytes() for i in part], pa.binary())
                    cols = [told.field(told.type.get_field_index(c)).slice(k, len(part)) for c in others]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + part)), *cols, blobs], ["doc_id", *others, "shingles"])
        give_back()

    kinds = dict(members.dtypes)
    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *others)) + ", shingles binary")


def exact_linker(num: int, den: int) -> Linker:
    """Labels of a block by the exact overlap of its sets."""

    def link(t: pa.Table, guests: int) -> np.ndarray:
        raw, at = K.text_buffers(t.column("shingles"))
        return link_block(np.split(raw[at[0] : at[-1]].view(K.U), (at[1:-1] - at[0]) // 8), num, den, guests)

    return link


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links num * union <= den * intersection."""
    spark, bands = docs.sparkSession, Bands(num, den)
    docs = unique_texts(docs)
    digests = written(set_digests(docs, n), "sets")
    seen = digests.where("slice is null").drop("slice", "counts")
    classes = written(seen.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    copies = written(seen.where("n_shingles > 0").join(slim_side(classes), ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    # a document takes part in its size band and, where it may, in the one below, each time as a vertex of its own, so candidates don't chain from band to band
    pairs = candidate_edges(docs, n, bands, frequent_shingles(digests))
    of_level = lambda x: F.col(x).bitwiseAND(HUB)
    near = components(pairs).where(of_level("id") != HUB).select((F.col("id") - of_level("id")).alias("vertex"), F.col("root").alias("comp"))
    known = [int(x) for x in bands.starts if x < 2**31]
    band = F.expr(f"size(filter(array({','.join(map(str, known))}), x -> x <= n_shingles)) - 1")
    starts = F.element_at(F.array(*map(F.lit, known)), F.col("band") + 1)
    both = (F.col("band") > 0) & (F.col("n_shingles") * num <= (starts - 1) * den)
    # only the smallest doc_id of equal sets is compared with others
    alone = seen.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    slim = alone.select("doc_id", F.col("n_shingles").alias("weight"), "n_shingles", "h1").withColumn("band", band)
    slim = slim.withColumn("scheme", F.explode(F.when(both, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))))
    low = (1 << BAND_BITS + LEVEL_BITS) - 1
    slim = slim.withColumn("vertex", (F.col("h1") - F.col("h1").bitwiseAND(low)).bitwiseOR(F.shiftleft(F.col("scheme").cast("long"), LEVEL_BITS)))
    members = written(slim.join(slim_side(near), "vertex").select("doc_id", "weight", "comp"), "banded")
    edges = tile_edges(members, ["comp"], lambda m: with_sets(docs, m, n), exact_linker(num, den), BLOCK_DOCS, BLOCK_SHINGLES)
    edges = edges.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    roots = components(edges).withColumnRenamed("id", "doc_id")
    return seen.select("doc_id", "n_shingles").join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs without the near copies: of each component the smallest doc_id stays."""
    groups = jaccard_components(docs.select("doc_id", "text"), n, num, den)
    copies = written(groups.where("component_id <> doc_id").select("doc_id"), "copies")
    return docs.join(slim_side(copies), "doc_id", "left_anti")
