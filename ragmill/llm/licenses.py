"""License notices in documents: MinHash bands over overlapping windows, then exact shingle containment.

Method, all in DataFrame functions: a text's words give shingles (five words; a notice of fewer words is one shingle of
its own length). Notices of like size form a class with windows of twice that size that overlap by half, so a notice lies
whole in some window. Of a window the shingles that its class has in some notice count; others can't add to a match. Each
window and notice has `bands` MinHash values of one row each, and equal values
retrieve the notice. With four fifths of a notice of s shingles in a window of 2w (s <= w < 2s) the Jaccard similarity is at
least 0.19, so `bands` = 64 miss such a window with a probability under 2e-6; a whole notice, similarity 1/4 or more, under 2e-8
(the shingles left out only raise the similarity).
A retrieved notice matches where a window holds `num / den` of its distinct shingles.

Notices are a table (license_id, text) of any size, whole licences among them. Their shingles and bands are tables too, which
join by value: broadcast up to a number of rows, shuffled beyond. A window is gathered from at most its own number of shingles, so
no group grows with a text. A text first has to hold one of a set of words that has a word of every shingle of the notices, where
that set is small enough for a literal; this spares work and changes no row. No text is cut short.

Defined cases: null or empty texts match nothing; notices without words or without an id are never found. Each (doc_id, license_id) comes once, with
its best window, also where rows repeat a doc_id (a window is of one text) or notices repeat an id (the greater share stands, then the greater
number matched). A null doc_id groups like a value. Other columns are ignored. No documents or no notices: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm._spark import slim_side, written

#: Notices looked for by default (fixed values).
NOTICES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
]
#: Whole licences looked for by default, without their copyright lines (fixed values).
LICENSES = [
    (
        "bsd-2-clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
#: Most words of the literal by which texts are chosen; beyond it all texts are looked at.
MOST_WORDS = 2000


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *LICENSES], "license_id string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def once(c: Column) -> Column:
    """A column that is computed once for each row, however often later columns use it."""
    return F.explode(F.array(c))


def shingles(w: Column, n: Column | int) -> Column:
    """Hash of each run of n words, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))


def bands(s: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda b: F.array_min(F.transform(s, lambda x: F.xxhash64(x, b))))


def prepared(templates: DataFrame, bands_: int) -> DataFrame:
    """license_id, notice (a key for each text), n, half (window step), total, s (distinct shingles), telling (the longest word of each) and bands."""
    t = templates.where("license_id is not null").select("license_id", once(words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    t = t.distinct().withColumn("notice", F.xxhash64("license_id", "w")).withColumn("n", F.least(F.size("w"), F.lit(5)))
    t = t.withColumn("s", once(F.array_distinct(shingles(F.col("w"), F.col("n")))))
    half = F.pow(F.lit(2), F.ceil(F.log2(F.size("w") - F.col("n") + F.lit(1)))).cast("int")
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_max(F.transform(F.slice("w", i, F.col("n")), lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"])
    return t.select("license_id", "notice", "n", half.alias("half"), F.size("s").alias("total"), "s", F.array_distinct(spans).alias("telling"), bands(F.col("s"), bands_).alias("bands"))


def scan(docs: DataFrame, templates: DataFrame, bands_: int = 64, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, license_id, matched, total: the best window of each notice found in each document."""
    known = written(prepared(templates, bands_), "notices")
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row"), once(words(F.col("text"))).alias("w"))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # five at most
    if not sizes:
        return texts.select("doc_id", F.lit("").alias("license_id"), F.lit(0).alias("matched"), F.lit(0).alias("total")).limit(0)
    keys = sorted(r.x for r in known.select(F.explode("telling").alias("x")).distinct().limit(MOST_WORDS + 1).collect())
    if len(keys) <= MOST_WORDS:
        texts = texts.where(F.arrays_overlap("w", F.array(*map(F.lit, keys))))

    parts = written(known.select("license_id", "notice", "n", "half", "total", F.explode("s").alias("shingle")), "notice-shingles")
    marks = written(parts.select("n", "half", "shingle").distinct(), "notice-marks")
    values = written(known.select("notice", "n", "half", F.posexplode("bands").alias("band", "value")), "notice-bands")
    placed = texts.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).select("doc_id", "row", "n", F.posexplode(shingles(F.col("w"), F.col("n"))).alias("at", "shingle"))
    k = F.floor(F.col("at") / F.col("half"))
    hits = placed.join(slim_side(marks), ["n", "shingle"]).withColumn("k", F.explode(F.when(k > 0, F.array(k, k - 1)).otherwise(F.array(k))))
    window = ["doc_id", "row", "n", "half", "k"]
    windows = hits.groupBy(*window).agg(F.collect_set("shingle").alias("win"))
    # what follows keeps the partitioning by window
    looked = windows.select(*window, "win", F.posexplode(bands(F.col("win"), bands_)).alias("band", "value"))
    retrieved = looked.join(slim_side(values), ["n", "half", "band", "value"]).select(*window, "win", "notice").distinct()
    held = retrieved.select(*window, "notice", F.explode("win").alias("shingle")).join(slim_side(parts.drop("n", "half")), ["notice", "shingle"])
    counted = held.groupBy(*window, "notice", "license_id", "total").agg(F.count("*").cast("int").alias("matched")).where(F.col("matched") * den >= F.col("total") * num)
    best = F.max(F.struct((F.col("matched") / F.col("total")).alias("share"), "matched", "total"))
    return counted.groupBy("doc_id", "license_id").agg(best.alias("best")).select("doc_id", "license_id", "best.matched", "best.total")


ORACLE = """
with t(license_id, text) as (values """ + ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in [*NOTICES, *LICENSES]) + """),
tw as (select license_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w from t),
tn as (select *, least(len(w), 5) n, len(w) - least(len(w), 5) + 1 c from tw),
tc as (select *, cast(pow(2, ceil(log2(c))) as bigint) half from tn),
ts as (select distinct license_id, n, half, array_to_string(w[i : i + n - 1], ' ') s from (select *, unnest(range(1, c + 1)) i from tc)),
total as (select license_id, n, half, count(*) total from ts group by all),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') w from documents),
sizes as (select distinct n from ts),
dp as (select doc_id, n, w, unnest(range(0, len(w) - n + 1)) i from dw, sizes where len(w) >= n),
ds as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') s from dp),
hit as (select d.doc_id, t.license_id, t.half, d.i // t.half k, d.s from ds d join ts t on d.n = t.n and d.s = t.s),
win as (select doc_id, license_id, k, s from hit union select doc_id, license_id, k - 1, s from hit where k > 0),
best as (select doc_id, license_id, k, count(distinct s) m from win group by all)
select b.doc_id, b.license_id, cast(max(b.m) as integer) matched, cast(any_value(total) as integer) total
from best b join total using (license_id) where b.m * 100 >= total * 80 group by b.doc_id, b.license_id
"""
