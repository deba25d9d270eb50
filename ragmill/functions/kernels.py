"""Small helpers over Arrow batches, for what Spark has no function for."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_SILENT = {"script", "style"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.pieces: list[str] = []
        self.links: list[str] = []
        self._open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT or tag == "title":
            self._open.append(tag)
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        if self._open and self._open[-1] == tag:
            self._open.pop()

    def handle_data(self, data):
        if self._open and self._open[-1] == "title":
            self.title = (self.title or "") + data
        elif not self._open and data.strip():
            self.pieces.append(data.strip())


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


@pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """Title, a blank line, and the visible text."""

    def one(h):
        p = _parse(h)
        return (p.title.strip() if p.title and p.title.strip() else "No title found") + "\n\n" + "\n".join(p.pieces)

    return html.map(one)


@pandas_udf(T.ArrayType(T.StringType()))
def absolute_links(url: pd.Series, html: pd.Series) -> pd.Series:
    """Links of a page, resolved against its address."""
    return pd.Series([[urljoin(u or "", x) for x in _parse(h).links] for u, h in zip(url, html, strict=True)])


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters where the separators allow: cut at the first separator that occurs, pieces still too
    long cut at the next, short ones merged up to size with the last ones, up to overlap characters, carried over."""
    sep, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        nonlocal run
        held: list[str] = []
        length = 0
        for piece in run:
            if held and length + len(sep) + len(piece) > size:
                out.append(sep.join(held))
                while held and (length > overlap or length + len(sep) + len(piece) > size):
                    length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                    held.pop(0)
            length += len(piece) + (len(sep) if held else 0)
            held.append(piece)
        if held:
            out.append(sep.join(held))
        run = []

    for piece in pieces:
        if len(piece) <= size:
            run.append(piece)
        else:
            flush()
            out.extend(split_recursive(piece, size, overlap, rest) if rest else [piece])
    flush()
    return [s for s in (c.strip() for c in out) if s]


def recursive_chunks(size: int, overlap: int):
    """Chunker of a text column as a vectorised function."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_recursive(t or "", size, overlap))

    return cut
