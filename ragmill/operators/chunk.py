"""Chunks of documents: cutting, stable records, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.functions.text import fixed_chunks


def chunked(df: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk: chunk_index from 0, and chunk."""
    return df.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))


def sections(df: DataFrame, body: str) -> DataFrame:
    """Sections of Markdown: heading apart, text before the first heading is "Document", text stripped."""
    cut = F.split(F.col(body), r"(?m)(?=^#{1,6}[ \t])")
    rows = df.select(*(c for c in df.columns if c != body), F.posexplode(cut).alias("section_no", "raw"))
    head = F.regexp_extract("raw", r"^#{1,6}[ \t]+([^\n]*)", 1)
    has = F.col("raw").rlike(r"^#{1,6}[ \t]")
    text = F.regexp_replace(F.when(has, F.regexp_replace("raw", r"^[^\n]*\n?", "")).otherwise(F.col("raw")), r"^\s+|\s+$", "")
    out = rows.select(*(c for c in rows.columns if c != "raw"), F.when(has, F.btrim(head)).otherwise("Document").alias("heading"), text.alias("text"), has.alias("_has"), F.col("raw").contains("\n").alias("_body"))
    # text before the first heading only where there is some; a heading without a following line is no section
    return out.where((F.col("_has") & F.col("_body")) | (~F.col("_has") & (F.col("text") != ""))).drop("_has", "_body")


def section_chunks(df: DataFrame, body: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Sections whole if they are short enough, else in windows."""
    s = sections(df, body)
    return chunked(s, F.when(F.length("text") <= size, F.array("text")).otherwise(fixed_chunks(F.col("text"), size, overlap))).drop("text")


def records(chunks: DataFrame, version_id: str, order: list[str], carried: list[str]) -> DataFrame:
    """Chunk records: id, index and count within the version, hash, and columns carried unchanged.

    One aggregate by version numbers the chunks; a version's chunks come from one document.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, "chunk")))
    g = chunks.groupBy(version_id, *carried).agg(items.alias("items"))
    rows = g.select(version_id, *carried, F.size("items").alias("chunk_count"), F.posexplode("items").alias("chunk_index", "item"))
    return rows.select(F.concat_ws("-", F.col(version_id).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), version_id, "chunk_index", "chunk_count", F.sha2("item.chunk", 256).alias("chunk_hash"), F.length("item.chunk").alias("n_chars"), *carried)


def page_content(headline: Column, summary: Column, original: Column) -> Column:
    return F.concat_ws("\n\n", headline, summary, original)


def chunk_hint(text: Column) -> Column:
    """How many chunks to ask for."""
    return F.floor(F.length(text) / 100) + 1


def profile(chunks: DataFrame, doc: str) -> DataFrame:
    """Documents, chunks, chunks for each document and lengths."""
    per = chunks.groupBy(doc).agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("c"))
    return per.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.round(F.avg("n"), 6).alias("chunks_per_doc"), F.max("n").alias("most_chunks"), F.round(F.sum("c") / F.sum("n"), 6).alias("mean_chars"))


def profile_change(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Documents by how their number of chunks changes between two chunkers."""
    a, b = (x.groupBy(doc).agg(F.count("*").alias(n)) for x, n in ((old, "n_old"), (new, "n_new")))
    d = a.join(b, doc, "full_outer").select((F.coalesce("n_new", F.lit(0)) - F.coalesce("n_old", F.lit(0))).alias("change"))
    return d.groupBy("change").agg(F.count("*").alias("n_docs"))
