"""Fill-in-middle transformation of documents, cut by repeated-capture matching.

Method: one fullmatch of `(unit)*` by the regex library keeps every repetition of the group, so `match.ends(1)` holds the end of
each unit: its length is n, and the ends at two drawn places are both cut offsets. Nothing iterates over the text. The unit
is a pattern, by default one code point; a text that isn't a sequence of units (or is empty, or holds a sentinel) stays plain.

Which form a document takes, and where it is cut, follow from a hash of the seed and its doc_id, so a rerun, another partitioning
or a lost executor gives the same rows. Documents are transformed where they lie, without a shuffle; a
task holds one batch of bounded size and, for one text at a time, its ends (some 150 bytes a unit).

Defined cases: a null text is empty; empty texts and texts that hold a sentinel are plain, with null prefix_chars and middle_chars. A null doc_id
hashes like an empty one. Repeated rows are transformed alike. Every other column stays; input columns with names of output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm._spark import give_back, in_small_batches

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers: the first groups of eight hex digits of the sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be found again: none occurs in another, and none can overlap itself or another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must not be empty, hold each other or overlap")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ")
    return sentinels


def transformed(
    docs: DataFrame, unit: str = r"(?s:.)", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = 90, spm_below: int = 20, seed: int = 1
) -> DataFrame:
    """docs with n (units; null if the text is no sequence of units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output.

    plain_from and spm_below are percentages: a document is plain if its third number's last two digits reach plain_from, else spm if those of the
    fourth are under spm_below, else psm. psm is prefix, suffix, middle; spm is suffix, prefix, middle, each behind its sentinel.
    """
    first, last, mid = _checked(sentinels)
    pattern, marks = regex.compile(f"({unit})*+"), regex.compile("|".join(map(regex.escape, sentinels)))

    def cut(text: str, h: list[int]) -> tuple:
        m = pattern.fullmatch(text)
        if m is None:
            return None, "plain", None, None, text
        ends = m.ends(1)
        n = len(ends)
        if not n or h[2] % 100 >= plain_from or marks.search(text):
            return n, "plain", None, None, text
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        i, j = (ends[x - 1] if x else 0 for x in (a, b))
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if h[3] % 100 < spm_below:
            return n, "spm", i, j - i, f"{last}{suffix}{first}{prefix}{mid}{middle}"
        return n, "psm", i, j - i, f"{first}{prefix}{last}{suffix}{mid}{middle}"

    made = [x.split()[0] for x in _MADE.split(", ")]
    kept = [c for c in docs.columns if c not in made]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drawn = batch.column(len(kept)), batch.column(len(kept) + 1)
            h = drawn.flatten().to_numpy().reshape(-1, 4)
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < batch.num_rows:  # outputs of about as many bytes as the texts, so a batch never doubles in one piece
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                rows = [cut(t.as_py(), x) for t, x in zip(texts.slice(at, to - at), h[at:to].tolist(), strict=True)]
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[: len(kept)]), *new], [*kept, *made])
                at = to
        give_back()

    spare = "_" * (1 + max(map(len, kept)))  # a name that no column has
    ready = in_small_batches(docs).select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(f"{spare}text"), draws(F.col("doc_id"), seed).alias(f"{spare}draws"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), _MADE])
    return ready.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    first, last, mid = _checked(sentinels)
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in (first, last, mid)))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: The query's rows in DuckDB.
ORACLE = """
with drawn as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256(concat('1:', coalesce(cast(doc_id as varchar), ''))) as h from documents
), numbers as (
    select doc_id, text, n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from drawn
), cuts as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or h3 % 100 >= 90 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from numbers
), parts as (
    select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from cuts
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
