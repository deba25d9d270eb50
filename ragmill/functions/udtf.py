"""Chunkers as table functions for SQL: `select ... from docs, lateral recursive_chunks(text, 1000, 200)`."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ragmill.functions.kernels import split_recursive

_HEAD = re.compile(r"^#{1,6}[ \t]+([^\n]*)")
_CUT = re.compile(r"(?m)(?=^#{1,6}[ \t])")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of size characters, each starting overlap characters before the last one's end; the last reaches the end of the text."""
    step, out, at = size - overlap, [], 0
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += step


class RecursiveChunks:
    """Pieces of at most size characters where separators allow; null and empty texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(split_recursive(text or "", size, overlap))


class SectionChunks:
    """Sections of Markdown, whole if they are short enough, else in windows."""

    def eval(self, body: str, size: int, overlap: int) -> Iterator[tuple]:
        parts = _CUT.split(body or "")
        parts = parts[1:] if len(parts) > 1 and not parts[0] else parts
        for no, raw in enumerate(parts):
            head = _HEAD.match(raw)
            if head and "\n" not in raw:
                continue  # a heading without a following line is no section
            text = (raw.partition("\n")[2] if head else raw).strip(" \t\n\x0b\f\r")
            if not head and not text:
                continue
            for i, chunk in enumerate([text] if len(text) <= size else _windows(text, size, overlap)):
                yield no, head[1].strip(" ") if head else "Document", i, chunk


def register(spark: SparkSession) -> None:
    """Make recursive_chunks and section_chunks known to the session's SQL; rows come and go in Arrow batches."""
    spark.udtf.register("recursive_chunks", udtf(RecursiveChunks, returnType="chunk_index int, chunk string", useArrow=True))
    spark.udtf.register("section_chunks", udtf(SectionChunks, returnType="section_no int, heading string, chunk_index int, chunk string", useArrow=True))
