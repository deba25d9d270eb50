"""Vectorised helpers over Arrow text columns: words and byte strings as 64-bit hashes.

All work goes piece by piece (about a quarter of a megabyte of text at a time), so the memory that a
batch takes does not follow the length of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 18
_rng = np.random.default_rng(20240501)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE, _pow, _inv = 0x9E3779B97F4A7C15, np.ones(1, U), np.ones(1, U)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes for matching prose: ASCII letters and digits and all of non-ASCII; the rest separates.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _pow[:n], _inv[:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """c with hash(b[i:j]) = (c[j] - c[i]) * inverse power of i."""
    c = np.zeros(len(b) + 1, U)
    np.cumsum(_CODE[b] * powers(len(b))[0], out=c[1:])
    return c


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def row_groups(offs: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a longer row stands alone."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _cuts(b: np.ndarray, sep: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of one long text, cut behind separators."""
    lo, n = 0, len(b)
    while n - lo > size:
        at = np.flatnonzero(sep[b[lo : lo + size]])
        cut = lo + int(at[-1]) + 1 if len(at) else lo + size
        while not len(at) and cut < n:
            at = np.flatnonzero(sep[b[cut : cut + size]])
            cut = cut + int(at[0]) + 1 if len(at) else min(n, cut + size)
        yield lo, cut
        lo = cut
    if lo < n:
        yield lo, n


def _hashed(b: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of b; bounds (all within b) also part words."""
    n = len(b)
    gap = sep[b]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = True
    after[inner - 1] = True
    word = ~gap
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    c = prefix_sums(LOWER[b])
    return starts, mix((c[ends] - c[starts]) * powers(n)[1][starts] + (ends - starts).astype(U))


def words(col: pa.Array, sep: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges: first row, end row, hash of each word, and its row counted from the first."""
    raw, offs = text_buffers(col)
    for lo, hi in row_groups(offs):
        b = raw[offs[lo] : offs[hi]]
        if not len(b):
            yield lo, hi, np.zeros(0, U), np.zeros(0, np.int64)
        elif len(b) <= 2 * PIECE:
            starts, h = _hashed(b, offs[lo : hi + 1] - offs[lo], sep)
            yield lo, hi, h, np.searchsorted(offs[lo : hi + 1] - offs[lo], starts, "right") - 1
        else:
            h = np.concatenate([_hashed(b[i:j], np.zeros(0, np.int64), sep)[1] for i, j in _cuts(b, sep, PIECE)])
            yield lo, hi, h, np.zeros(len(h), np.int64)


def shingle_sets(h: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles, sorted within each row, and the offsets of rows.

    A row with words but fewer than n has its whole sequence as its one shingle.
    """
    count = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(count)])
    if len(h) >= n:
        whole = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            whole = whole * U(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
        keep = row[: len(whole)] == row[n - 1 :]
        s, r = mix(whole[keep]), row[: len(whole)][keep]
    else:
        s, r = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), U)
        for i, x in enumerate(short):
            v = U(count[x])
            for w in h[at[x] : at[x + 1]]:
                v = U((int(v ^ w) * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1))
            extra[i] = v
        s, r = np.concatenate([s, mix(extra)]), np.concatenate([r, short])
    order = np.argsort(s)
    order = order[np.argsort(r[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    s, r = s[order], r[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        s, r = s[new], r[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))])
