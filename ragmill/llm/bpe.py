"""Byte-pair encoding of whole texts in time linear in their length, and decoding.

Method: a word is encoded from left to right with the longest vocabulary token at each place, found
by an Aho-Corasick automaton. A token may follow another only if byte-pair merging would really
leave the two side by side (the pair-compatibility check, kept in a table); if not, the next shorter
token is tried, and at a dead end the encoder steps back one token. A bit for each place records
what has been tried, so no place is tried twice. This gives exactly what merging by rank gives. Words repeat,
so two bounded tables keep the ids of recent ones: when the younger is full it replaces the older, and what is asked for again moves
up, so frequent words stay. Decoding copies from one string of all tokens by a table of offsets.

The vocabulary file (tokenizers' JSON, a byte-level BPE with a word-end suffix) is a parameter and is read
by each task. Tasks share nothing; nothing is collected.

Defined cases: null text is empty; empty text has no ids and decodes to an empty text. Special tokens in a text
are their ids. Every row is encoded by itself, so repeated rows and null doc_id stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm._spark import give_back, in_small_batches

#: White space as the tokenizer's own regular expressions have it (U+001C to U+001F are not of it).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{_SPACE}]+")
#: What str.split() takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Entries of the younger table of words, and of the table of pairs.
_MOST_WORDS, _MOST_PAIRS = 50_000, 100_000
#: Stands for the word-end suffix, as one unit.
_END = "\uffff"


def _byte_letters() -> list[str]:
    """The usual printable letter of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return [chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b))) for b in range(256)]


class WordBpe:
    """The encoder of one vocabulary file. What it keeps between texts is bounded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.letters = _byte_letters()
        # A token as units: one for each byte, the last of a word being a unit of its own.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank.setdefault(pair, (r, made))
            self.parts.setdefault(made, (*pair, r))
        self.units = [t.removesuffix(self.suffix) + _END if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t for t in self.names]
        self.width = [len(t) for t in self.units]
        self.by_units = {self.units[i]: i for i in self.vocab.values()}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.by_units.items():
            if len(t) > 1:  # tokens of one unit fit everywhere: no match need be told
                self.matcher.add_word(t, (len(t) - 1, i))
        self.single = {t: i for t, i in self.by_units.items() if len(t) == 1}
        self.matcher.make_automaton()
        self.prefix: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        blob, sizes = [], []
        for t in self.names:
            blob.append((t + " ").encode())
            sizes.append(len(blob[-1]))
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        found = self.prefix.get(token)
        if found is None:
            name = self.units[token]
            found = self.prefix[token] = next((self.by_units[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.by_units), -1)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves token a directly before token b: no merge across the border wins over the merges that made them."""
        pair = a << 32 | b
        found = self.compatible.get(pair)
        if found is None:
            if len(self.compatible) > _MOST_PAIRS:
                self.compatible.clear()
            found = self.compatible[pair] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges step by step, and see whether the pair at the border would have merged before it.
        none = 1 << 62
        limit = none
        while True:
            rank, _ = self.rank.get((a, b), (none, 0))
            if rank < limit:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                limit, a = left[2], left[1]
                # the right side was still whole before this merge, so an equal rank at the border loses to the left one
            else:
                limit, b = right[2] + 1, right[0]
                # of equal ranks the one further left goes first, so the border pair wins

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, given as byte letters."""
        units = word + _END if self.suffix else word
        longest: dict[int, int] = {}
        for end, (back, i) in self.matcher.iter(units):  # ends rise, so the longest stays
            longest[end - back] = i
        n, width, known, single, place, out, before = len(units), self.width, self.compatible, self.single, 0, [], -1
        alone = n - 1 if self.suffix else -1  # no token starts at a word's end
        tried: set[int] = set()
        token = longest[0] if 0 in longest else single[units[0]]
        while True:
            end = place + width[token]
            fit = end not in tried and (before < 0 or ((f := known.get(before << 32 | token)) is None and self.fits(before, token)) or f)
            if fit and end != alone:
                out.append(token)
                if end == n:
                    return out
                place, before, token = end, token, longest[end] if end in longest else single[units[end]]
                continue
            token = self.shorter(token)
            while token < 0:
                tried.add(place)
                token = out.pop()
                place -= width[token]
                before = out[-1] if out else -1
                token = self.shorter(token)

    def merged(self, word: str) -> list[int]:
        """Ids by merging pairs in the order of their rank: what encode_word must give."""
        ids = [self.vocab[c + (self.suffix if k == len(word) - 1 else "")] for k, c in enumerate(word)]
        while len(ids) > 1:
            r, k = min((self.rank.get((ids[k], ids[k + 1]), (1 << 62, 0))[0], k) for k in range(len(ids) - 1))
            if r == 1 << 62:
                break
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def add(self, chunk: str) -> bytes:
        """Ids of a text without white space, kept for the next time."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = b"".join([self.recent.get(word) or self.word(word) for word in _WORD.findall(chunk)])
        return self.keep(chunk, ids)

    def word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            code = self.encode_word("".join([self.letters[b] for b in word.encode()]))
            ids = struct.pack(f"<{len(code)}I", *code)
        return self.keep(word, ids)

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 64:
            if len(self.recent) >= _MOST_WORDS:
                self.older, self.recent = self.recent, {}
            self.recent[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
                pieces = _SPACES.split(plain) if _ODD.search(plain) else plain.split()
                out += [self.recent.get(x) or self.add(x) for x in pieces]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, as the vocabulary names no decoder."""
        ids = ids.astype(np.int64)
        size = self.offset[ids + 1] - self.offset[ids]
        total = int(size.sum())
        if not total:
            return b""
        step = np.ones(total, np.int64)
        begin = np.cumsum(size) - size
        step[0] = self.offset[ids[0]]
        step[begin[1:]] = self.offset[ids[1:]] - (self.offset[ids[:-1]] + size[:-1] - 1)
        return self.blob[np.cumsum(step)[:-1]].tobytes()


@functools.lru_cache(2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (little-endian unsigned 32-bit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], []]
                for text in part.column(1):
                    code = bpe.encode(text.as_py() or "")
                    sha = hashlib.sha256()
                    all_ids = np.frombuffer(code, "<u4")
                    for k in range(0, len(all_ids), 1 << 18):
                        sha.update((b" " if k else b"") + bpe.decode(all_ids[k : k + (1 << 18)]))
                    for col, v in zip(out, (len(code) // 4, hashlib.sha256(code).hexdigest(), sha.hexdigest(), code), strict=True):
                        col.append(v)
                cols = [part.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True))]
                yield pa.RecordBatch.from_arrays(cols[: 5 if ids else 4], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if ids else 4])
        encoder.cache_clear()  # Python workers live on: leave their memory to the next stage
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
