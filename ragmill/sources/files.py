"""Reading corpora, entities and products; writing indexes, splits, requests; manifests."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.sources.tables import kept, small_batches, small_side


def read_markdown_tree(spark: SparkSession, root: str, pattern: str = "*.md", folders: list[str] | None = None) -> DataFrame:
    """source (path), doc_type (first folder under the root) and text of every matching file, one row for each. The driver lists the files: folders below the root, if stated, are all that is read, so a large tree can be read in turns."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).format("binaryFile").load(root if folders is None else [f"{root}/{x}" for x in folders])
    path = F.col("_metadata.file_path")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    kind = F.regexp_extract(path, f"/{base}/([^/]+)/", 1)
    return df.select(path.alias("source"), kind.alias("doc_type"), F.col("content").cast("string").alias("text"))


#: What stands for null in a folder's name.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_tree(df: DataFrame, root: str) -> None:
    """A text file for each row of df (source, folder, value), value and a line break, below source=.../folder=...

    In a local folder, tasks make the files themselves: Hadoop's local file system starts a process for each file to set its mode. df gives its rows in the same order when a task runs again, so its files
    are written over. Elsewhere it is Spark's writer, whose files are moved by tasks, not by the driver.
    """
    local = re.fullmatch(r"(file:(?://)?)?(/.*)", root)
    if local is None or not (local[1] or df.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:")):
        df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("source", "folder").text(root)
        return
    top = local[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for source, folder, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                path = f"{top}/source={source if source.is_valid else NO_VALUE}/folder={folder}"
                if path not in made:
                    os.makedirs(path, exist_ok=True)
                    made.add(path)
                with open(f"{path}/part-{task:05d}-{n:09d}.txt", "wb") as f:
                    f.write(value.as_buffer())
                    f.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    small_batches(df.select("source", "folder", "value")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


@contextmanager
def small_files(spark: SparkSession, cost: int = 1 << 16) -> Iterator[None]:
    """Within it, scans deal a file out as its bytes and `cost` more, by default 64 KB and not 4 MB: else a task reads a few small files, and there are as many tasks as a fraction of the files."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(cost))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def front_matter(text: Column, schema: T.StructType) -> Column:
    """Fields of the `key: json` lines between the --- lines, as a struct; null if there is no such block."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.concat(F.lit('"'), F.regexp_extract(x, r"^([^:]+):\s*(.*)$", 1), F.lit('": '), F.regexp_extract(x, r"^([^:]+):\s*(.*)$", 2)))
    return F.when(block != "", F.from_json(F.concat(F.lit("{"), F.array_join(lines, ", "), F.lit("}")), schema))


def parse_front_matter(df: DataFrame, text: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows (fields and body, whose sha256 is the stated content_sha256), and rejected ones with a reason."""
    body = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    p = df.withColumn("meta", front_matter(F.col(text), schema)).withColumn("body", body)
    empty = F.array_compact(F.array(*(F.when(F.col(f"meta.{f.name}").isNull(), F.lit(f.name)) for f in schema if not f.nullable)))
    reason = F.when(F.col("meta").isNull(), "no front matter").when(F.size(empty) > 0, F.concat(F.lit("missing "), F.array_join(empty, ","))).when(F.sha2("body", 256) != F.col("meta.content_sha256"), "hash differs")
    p = p.withColumn("reason", reason)
    rest = [c for c in df.columns if c != text]
    return p.where("reason is null").select(*rest, "meta.*", "body"), p.where("reason is not null").select(*rest, "reason", F.col(text).alias("payload"))


def read_entities(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; lines that don't fit keep their text in _corrupt_record."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def read_products(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Raw products of several categories, one path each, as one table with its category."""
    out = None
    for category, path in paths.items():
        df = spark.read.schema(schema).json(path).withColumn("category", F.lit(category))
        out = df if out is None else out.unionByName(df)
    return out


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrite a table by partition: an index by tenant or list, data sets by split. Rows of a value may lie in several files, so a hot one is no single task."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def _joined(name: str, digest: str) -> Column:
    """sha256 of the sorted lines name, tab, digest of a group."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", name, digest))), "\n"), 256)


def hash_tree(files: DataFrame) -> list[DataFrame]:
    """A hash tree of (area, path, content), from its leaves up: (area, path, sha), and two levels of (area, node, n, digest).

    A leaf hangs under the node that the first four hex digits of its path's sha256 name, and that under the one of the first two: a node gathers
    256 digests, or one in 65,536 of an area's lines, so no value grows with an area. How the rows are partitioned makes no difference. Null content is empty.
    """
    leaves = kept(files.select("area", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")), "leaves")
    low = leaves.groupBy("area", F.substring(F.sha2("path", 256), 1, 4).alias("node")).agg(F.count("*").alias("n"), _joined("path", "sha").alias("digest"))
    low = kept(low, "nodes")
    high = low.groupBy("area", F.substring("node", 1, 2).alias("upper")).agg(F.sum("n").alias("n"), _joined("node", "digest").alias("digest")).withColumnRenamed("upper", "node")
    return [leaves, low, kept(high, "nodes")]


def manifest(tree: list[DataFrame]) -> DataFrame:
    """area, n_files and digest of each area of a hash tree, and of "all" areas."""
    areas = tree[-1].groupBy("area").agg(F.sum("n").alias("n_files"), _joined("node", "digest").alias("digest"))
    total = areas.agg(F.sum("n_files").alias("n_files"), _joined("area", "digest").alias("digest")).withColumn("area", F.lit("all"))
    return areas.unionByName(total)


def changed_files(old: list[DataFrame], new: list[DataFrame]) -> DataFrame:
    """(area, path, change): files that two hash trees don't share, found by descent: only below nodes that differ are lower ones compared."""
    below = None
    for a, b in zip(reversed(old[1:]), reversed(new[1:]), strict=True):
        if below is not None:
            a, b = (x.join(below, (x.area == below.in_area) & (F.substring(x.node, 1, 2) == below.under), "left_semi") for x in (a, b))
        j = a.select("area", "node", F.col("digest").alias("da")).join(b.select("area", "node", F.col("digest").alias("db")), ["area", "node"], "full_outer")
        below = small_side(j.where(~F.col("da").eqNullSafe(F.col("db"))).select(F.col("area").alias("in_area"), F.col("node").alias("under")), "differing")
    here = lambda x, name: x.join(below, (x.area == below.in_area) & (F.substring(F.sha2(x.path, 256), 1, 4) == below.under), "left_semi").select("area", "path", F.col("sha").alias(name))
    j = here(old[0], "sa").join(here(new[0], "sb"), ["area", "path"], "full_outer").where(~F.col("sa").eqNullSafe(F.col("sb")))
    return j.select("area", "path", F.when(F.col("sa").isNull(), "added").when(F.col("sb").isNull(), "removed").otherwise("changed").alias("change"))


def batch_requests(items: DataFrame, id_col: str, system: str, user: Column, model: str, size: int = 1000) -> DataFrame:
    """A JSON request for each item, numbered into files of size rows by id."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))
    line = F.struct(F.col(id_col).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return items.select(F.floor(F.col(id_col) / size).cast("long").alias("batch_no"), F.to_json(line).alias("value"))


def apply_responses(items: DataFrame, id_col: str, responses: DataFrame) -> DataFrame:
    """Items with the summary of their last response (value is a JSON line, delivered gives the order); null where none came."""
    r = responses.select(F.get_json_object("value", "$.custom_id").alias("_id"), F.get_json_object("value", "$.response.body.choices[0].message.content").alias("summary"), "delivered")
    last = r.groupBy("_id").agg(F.max_by("summary", "delivered").alias("summary"))
    return items.join(last, items[id_col].cast("string") == F.col("_id"), "left").drop("_id")
