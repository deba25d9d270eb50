"""Session helpers shared by the operators: table access, shared folder, written intermediates."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master, which has no other machine, gets one of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors. What was shuffled for it goes from the disks at once."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FREE)
    conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a side that is broadcast; its rows hold a few numbers each, so this is some 20 MB.
BROADCAST_ROWS = 200_000


def slim_side(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as the smaller side of a join: broadcast up to BROADCAST_ROWS rows, so that the
    texts on the other side stay where they are, and a shuffle join beyond; the rows are the same."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


#: Rows and bytes of text in a batch between the JVM and Python: whole texts may be long, so fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands texts to Python in batches of BATCH_ROWS rows and about BATCH_BYTES bytes at most."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def unique_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without null doc_id; of repeated rows of a doc_id the text that sorts last stands."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.groupBy("doc_id").agg(F.max("text").alias("text")) if twice else docs


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of batches that is sorted by keys into one table for each key.

    Only the open group is held: callers bound the size of a group before they shuffle.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        at = 0
        for c in cuts:
            held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
        last = tuple(batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def folded(parts: DataFrame, value: str, kind: type, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[int, np.ndarray], bytes] | None = None) -> DataFrame:
    """Fold the arrays (binary column `value`, items of `kind`) of each slice of a table of fixed size into one: (slice, value).

    Each task holds one running array, however many come. finish makes the bytes of a folded slice; by default they are its items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_py(), kind)
                totals[i] = fold(totals[i], part) if i in totals else part.astype(np.int64) if fold is np.add else part
        for i, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([finish(i, total) if finish else total.tobytes()], pa.binary())], ["slice", "value"])

    return parts.select(F.col("slice").cast("long").alias("slice"), F.col(value).alias("value")).repartition("slice").mapInArrow(run, "slice long, value binary")


def fold_slices(parts: DataFrame, value: str, kind: type, fold: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The slices folded; only this table of fixed size reaches the driver."""
    return {i: np.frombuffer(v, np.int64 if fold is np.add else kind) for i, v in folded(parts, value, kind, fold).collect()}
