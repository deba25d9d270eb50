"""Links within groups of documents of any size, in blocks of bounded size, as spanning forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm._spark import give_back, slim_side, sorted_groups, written

#: Gives a label to each row of a block (equal labels are linked); with a count of guests, the last so many rows meet the ones before them only.
Linker = Callable[[pa.Table, int], np.ndarray]


def _block_edges(tiles: DataFrame, tile: list[str], link: Linker, guests: bool) -> DataFrame:
    keys = [*tile, "block", *(["fblock"] if guests else [])]
    kinds = dict(tiles.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            ids, pivot, blocks = (t.column(c).to_numpy() for c in ("doc_id", "pivot", "blocks"))
            guest = t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((ids, guest))
            order = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if not guests else order
            ids = ids[order]
            if len(ids) < 2 or guests and not guest.any():
                continue
            label = link(t.take(pa.array(order)), int(guest.sum()) if guests else 0)
            home = label[np.flatnonzero(ids == pivot[0])[0]] if not guests and blocks[0] > 1 else -1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[label]), pa.array(ids), pa.array((label != home) & (blocks[0] > 1) & (not guests)), *(pa.repeat(t.column(c)[0], len(ids)) for c in tile)],
                ["a", "b", "loose", *tile],
            )
        give_back()

    schema = ", ".join(["a long, b long, loose boolean", *(f"{c} {kinds[c]}" for c in tile)])
    # work in a block grows faster than its bytes: a stated number of partitions is not coalesced by size
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tile_edges(members: DataFrame, tile: list[str], attach: Callable[[DataFrame], DataFrame], link: Linker, block_docs: int, block_weight: int) -> DataFrame:
    """(a, b) that span what `link` links within each tile. members: the columns `tile` (its key), doc_id and weight.

    attach adds to members what link reads. A tile over block_docs documents or block_weight in sum is cut into blocks by a hash of
    doc_id, which all hold the tile's pivot (its smallest doc_id); documents that aren't linked with the pivot in their block meet every block, so no
    link is lost, and a tile of copies costs one comparison a document. Only distances of a tile's own rows decide; the rest of the table doesn't matter.
    """
    stats = members.groupBy(*tile).agg(F.count("*").alias("m"), F.sum("weight").alias("s"), F.min("doc_id").alias("pivot")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / block_docs), F.ceil(F.col("s") / block_weight)).cast("int")
    stats = slim_side(written(stats.select(*tile, "pivot", blocks.alias("blocks")), "stats"))
    slim = written(members.join(stats, tile).select("doc_id", "weight", *tile, "pivot", "blocks"), "tiles")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")
    every = F.explode(F.when(F.col("doc_id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    found = written(_block_edges(attach(slim.withColumn("block", every).withColumn("guest", F.lit(False))), tile, link, False), "links")
    edges = found.select("a", "b")
    loose = found.where("loose").select(F.col("b").alias("doc_id"), *tile).distinct()
    if not loose.isEmpty():
        odd = written(loose.join(slim, ["doc_id", *tile]), "loose")
        fblocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("weight") / block_weight), F.lit(1)).cast("int")
        count = slim_side(written(odd.groupBy(*tile).agg(fblocks.alias("fblocks")), "loose-blocks"))
        hosts = slim.join(count, tile).withColumn("block", own).withColumn("fblock", F.explode(F.sequence(F.lit(0), F.col("fblocks") - 1))).withColumn("guest", F.lit(False))
        guests = odd.join(count, tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("fblock", F.pmod(F.xxhash64("doc_id"), F.col("fblocks").cast("long")).cast("int")).withColumn("guest", F.lit(True))
        edges = edges.unionByName(_block_edges(attach(hosts.unionByName(guests)), tile, link, True).select("a", "b"))
    return edges
