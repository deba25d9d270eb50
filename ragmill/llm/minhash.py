"""Near-copy detection by b-bit MinHash: bands for candidates, bit counts for an estimate, whole sets for the decision.

Method: `minima` hash functions give a document's set of word shingles as many minima. Rows of them form bands, whose hashes deal documents to
buckets. Of each minimum only the low bits are kept and packed, in planes, as a signature of a few words. Within a bucket two signatures are compared by bit counts:
the share of minima whose low bits agree is corrected for those that agree by chance, (share - 2**-bits) / (1 - 2**-bits), and a pair goes on
if that estimate isn't below what a pair at the threshold falls under once in 10**9. What goes on chains documents into candidate groups, and
within these the whole sets decide each link exactly. Equal sets are one class, for which its smallest doc_id stands.

With 160 minima in 32 bands of five, two sets at a similarity of 0.85 share no band with a probability of (1 - 0.85**5)**32 = 7e-9; more alike ones, less still.

Skew: a bucket or a candidate group of any size is cut into blocks that share its smallest document, so that copies cost one comparison each and
never all pairs; buckets are counted by partial sums before their members are joined to them, and tables are dealt by document and block, not by key alone.

Defined cases: a null text, or one of separators only, has an empty set and is linked with nothing; fewer words than a shingle has are one shingle.
Repeated rows of a doc_id: one document (the text that sorts last). Rows with a null doc_id: left out. Other columns are ignored. Empty input: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm import _kernels as K
from ragmill.llm._graph import components
from ragmill.llm._spark import give_back, slim_side, unique_texts, written
from ragmill.llm._tiles import Linker, tile_edges
from ragmill.llm.jaccard_join import BLOCK_SHINGLES, digest_columns, exact_linker, with_sets, word_sets

#: Hash functions, those in a band, bits kept of each minimum, and how often a pair at the threshold may be estimated too low.
MINIMA, ROWS, BITS, MISS = 160, 5, 2, 1e-9
#: Documents of one block of a bucket or candidate group.
BLOCK_DOCS = 1024
_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, signature binary, buckets array<long>"


class Family:
    """Hash functions x -> (a * x + b) modulo 2**64, of which the upper half counts, and their signatures and bands."""

    def __init__(self, minima: int = MINIMA, rows: int = ROWS, bits: int = BITS, seed: int = 20240607):
        if minima % rows or not 0 < bits < 32 or minima % 32:
            raise ValueError("minima must be a multiple of rows and of 32, bits from 1 to 31")
        r = np.random.default_rng(seed)
        self.minima, self.rows, self.bits = minima, rows, bits
        self.a = r.integers(0, 2**63, minima, dtype=np.uint64) * K.U(2) + K.U(1)
        self.b = r.integers(0, 2**64, minima, dtype=np.uint64)

    def least(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Minima of the sets between the offsets at, none of them empty: (sets, minima), 32 bits each."""
        out = np.empty((len(at) - 1, self.minima), np.uint32)
        for i in range(self.minima):
            out[:, i] = np.minimum.reduceat((s * self.a[i] + self.b[i]) >> K.U(32), at[:-1])
        return out

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the minima: a plane of 32-bit words for each bit."""
        planes = [np.packbits((minima >> np.uint32(i)).astype(np.uint8) & 1, axis=1) for i in range(self.bits)]
        return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.uint32)

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band."""
        bands = minima.reshape(len(minima), -1, self.rows).astype(K.U)
        key = np.broadcast_to(K.mix(np.arange(bands.shape[1]).astype(K.U) + K.U(1)), bands.shape[:2])
        for i in range(self.rows):
            key = K.mix(key * K.U(0x9E3779B97F4A7C15) + bands[:, :, i] + K.U(1))
        return key

    def agreeing(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many minima of one agree in their low bits with those of each other signature, by bit counts."""
        differ = (one ^ others).reshape(len(others), self.bits, -1)
        return self.minima - np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(1, dtype=np.int64)

    def estimate(self, agreeing: np.ndarray) -> np.ndarray:
        """Similarity with the chance agreements taken out."""
        chance = 0.5**self.bits
        return (agreeing / self.minima - chance) / (1 - chance)

    def enough(self, threshold: float, miss: float = MISS) -> int:
        """The largest count that a pair at the threshold falls short of with a probability of at most miss."""
        p, k, total = threshold + (1 - threshold) * 0.5**self.bits, self.minima, 0.0
        for x in range(k + 1):
            log = math.lgamma(k + 1) - math.lgamma(x + 1) - math.lgamma(k - x + 1) + (x * math.log(p) + (k - x) * math.log1p(-p) if p < 1 else (0.0 if x == k else -math.inf))
            total += math.exp(log)
            if total > miss:
                return x
        return k


def signed(docs: DataFrame, n: int, family: Family) -> DataFrame:
    """doc_id, n_shingles, a digest of the set, its signature and the keys of its bands; the latter two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, s, at in word_sets(batch, n):
                size = np.diff(at)
                full = np.flatnonzero(size)
                minima = family.least(s, np.append(at[full], len(s))) if len(full) else np.zeros((0, family.minima), np.uint32)
                words, keys = family.packed(minima), family.buckets(minima)
                blobs, lists = [None] * (hi - lo), [None] * (hi - lo)
                for i, x in enumerate(full):
                    blobs[x], lists[x] = words[i].tobytes(), keys[i].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), *digest_columns(s, at), pa.array(blobs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "h1", "h2", "signature", "buckets"],
                )
        give_back()

    return docs.mapInArrow(run, _SIGNED)


def signature_linker(family: Family, num: int, den: int, miss: float = MISS) -> Linker:
    """Labels of a block by estimates: equal where the estimate and the sizes allow a similarity of num / den, directly or by others."""
    enough = family.enough(num / den, miss)

    def link(t: pa.Table, guests: int) -> np.ndarray:
        m, size = t.num_rows, t.column("n_shingles").to_numpy()
        raw, at = K.text_buffers(t.column("signature"))
        x = raw[at[0] : at[-1]].view(np.uint32).reshape(m, -1)
        label, hosts = np.arange(m), m - guests
        for i in range(hosts, m) if guests else range(m - 1):
            lo, hi = (0, hosts) if guests else (i + 1, m)
            small, large = np.minimum(size[i], size[lo:hi]), np.maximum(size[i], size[lo:hi])
            near = np.flatnonzero((label[lo:hi] != label[i]) & (small * den >= large * num)) + lo
            if len(near):
                near = near[family.agreeing(x[i], x[near]) >= enough]
            if len(near):
                merged = np.append(label[near], label[i])
                label[np.isin(label, merged)] = merged.min()
        return label

    return link


def near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, family: Family | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of the links num * union <= den * intersection; the smallest doc_id of each is kept."""
    family = family or Family()
    docs = unique_texts(docs)
    seen = written(signed(docs, n, family), "signatures")
    full = seen.where("n_shingles > 0")
    classes = written(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    copies = written(full.join(slim_side(classes), ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    alone = full.join(slim_side(copies.select("doc_id")), "doc_id", "left_anti")

    dealt = alone.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = written(dealt.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "buckets")
    members = written(dealt.join(slim_side(shared), "bucket").withColumn("weight", F.lit(1)), "members")
    signatures = seen.select("doc_id", "n_shingles", "signature")
    likely = tile_edges(members, ["bucket"], lambda m: m.join(signatures, "doc_id"), signature_linker(family, num, den), BLOCK_DOCS, BLOCK_DOCS)
    groups = components(likely).select(F.col("id").alias("doc_id"), F.col("root").alias("comp"))

    sized = written(groups.join(seen.select("doc_id", F.col("n_shingles").alias("weight")), "doc_id"), "groups")
    links = tile_edges(sized, ["comp"], lambda m: with_sets(docs, m, n), exact_linker(num, den), BLOCK_DOCS, BLOCK_SHINGLES)
    roots = components(links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))).withColumnRenamed("id", "doc_id")
    out = seen.select("doc_id", "n_shingles").join(roots, "doc_id", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def components_oracle(n: int, percent: int) -> str:
    """DuckDB SQL for doc_id, n_shingles and component_id of n-word shingles and links of a similarity of percent / 100 or more."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split
), sizes as (
    select d.doc_id, count(s.s) as n from documents d left join shingles s on d.doc_id = s.doc_id group by d.doc_id
), sets as (
    select doc_id, md5(string_agg(s, chr(10) order by s)) as digest from shingles group by doc_id
), classes as (
    select doc_id, min(doc_id) over (partition by digest) as rep from sets
), alone as (
    select s.doc_id, s.s from shingles s join classes c on s.doc_id = c.rep and c.doc_id = c.rep
), links as (
    select a.doc_id as a, b.doc_id as b from alone a join alone b on a.s = b.s and a.doc_id < b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    where 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= {percent} * (x.n + y.n - count(*))
), both_ways as (
    select a, b from links union all select b, a from links
), reach as (
    select rep as id, rep as root from classes where doc_id = rep union select e.b, r.root from reach r join both_ways e on e.a = r.id where r.root < e.b
), roots as (
    select id, min(root) as root from reach group by id
)
select z.doc_id, z.n as n_shingles, coalesce(r.root, z.doc_id) as component_id from sizes z left join classes c on c.doc_id = z.doc_id left join roots r on r.id = c.rep
"""


ORACLE = f"select *, doc_id = component_id as kept from ({components_oracle(3, 85)})"
