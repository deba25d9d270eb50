"""Facts stated in texts: provenance, extraction, unsupported values, sections, rebuilt bodies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.functions.text import normalize_quotes
from ragmill.sources.tables import kept

#: Names of months (fixed values).
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_LONG = rf"(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}"
#: Kinds of values in texts, the first of those that begin at one place being told (fixed patterns). A number ends before a comma that a period or date follows.
VALUE_KINDS = [
    ("id", r"\b[A-Z]{2,5}-\d+\b"),
    ("timestamp", rf"{_LONG} at \d{{2}}:\d{{2}} UTC"),
    ("date", _LONG),
    ("month", rf"(?:{'|'.join(MONTHS)}) \d{{4}}"),
    ("period", r"\b(?:\d{4}-Q[1-4]|FY\d{4})\b"),
    ("iso_date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("code", r"\b[A-Za-z]+\d+\w*\b"),
    ("number", r"(?<![\w.])\d(?:\d|,(?!\d{4}-(?:Q[1-4]|\d{2}-\d{2})\b))*(?:\.\d+)?"),
]
#: Kinds of values in records (fixed patterns).
RECORD_KINDS = [("id", r"\b[A-Z]{2,5}-\d+\b"), ("stamp", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"), ("iso_date", r"\b\d{4}-\d{2}-\d{2}\b"), ("number", r"\d[\d,]*(?:\.\d+)?")]
#: Words that the name of a priced tier holds one of (fixed values).
TIER_WORDS = ["Tier", "Plan", "Fee", "Membership", "Features", "Pricing"]
#: What a price line says of how it is priced, by model (fixed values).
PRICE_MODELS = [("custom pricing", "custom"), ("no cost", "free"), ("starting at", "starting_at")]
#: Instructions planted in texts (fixed pattern).
INJECTION = r"(?i)ignore all previous instructions|disregard your restrictions|administrator mode"


def quote_provenance(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts (fact_id, doc_id, quote, value) with whether the quote is in the document and the value in the quote, spacing and quotes evened."""
    j = facts.join(docs.select("doc_id", "text"), "doc_id", "left")
    q = normalize_quotes(F.col("quote"))
    return j.select("fact_id", F.coalesce(normalize_quotes(F.col("text")).contains(q), F.lit(False)).alias("in_document"), q.contains(normalize_quotes(F.col("value"))).alias("in_quote"))


#: Keywords and their characters in one automaton.
_KEYWORDS, _KEYWORD_CHARS = 50_000, 2_000_000


def keyword_presence(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Documents that hold each keyword (any string: a word, a part of one, a phrase) in any case, 0 where none does.

    One automaton for all keywords of a block passes over each whole text once, so the cost follows the texts and not the number of keywords. Keywords beyond a block's
    bounds go in further passes. Tasks add up their documents before anything is shuffled. Null and empty keywords are left out.
    """
    words = kept(keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct(), "keywords")
    n, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    blocks = max(1, -(-n // _KEYWORDS), -(-chars // _KEYWORD_CHARS))
    texts, found = docs.select(F.lower("text").alias("text")).where("text is not null"), None
    for block in range(blocks):
        mine = words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block)
        sent = docs.sparkSession.sparkContext.broadcast([r.keyword for r in mine.collect()])  # one block of keywords
        if sent.value:
            counts = texts.mapInArrow(_counter(sent), "keyword string, n_docs long")
            found = counts if found is None else found.unionByName(counts)
    if found is None:
        return words.withColumn("n_docs", F.lit(0).cast("long"))
    return words.join(found.groupBy("keyword").agg(F.sum("n_docs").alias("n_docs")), "keyword", "left").select("keyword", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _counter(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, in a task, the texts that hold each of the keywords sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = sent.value
        finder, counts = ahocorasick.Automaton(), np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            finder.add_word(word, i)
        finder.make_automaton()
        for batch in batches:
            for text in batch.column(0):
                held = {i for _, i in finder.iter(text.as_py())}
                counts[list(held)] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in seen], pa.string()), pa.array(counts[seen])], ["keyword", "n_docs"])

    return run


def money(c: Column) -> Column:
    """The first $ amount."""
    found = F.regexp_extract(c, r"\$(\d[\d,]*(?:\.\d+)?)", 1)
    return F.when(found != "", F.translate(found, ",", "").try_cast("double"))


def long_date(c: Column) -> Column:
    """The first date like March 15, 1990."""
    found = F.regexp_extract(c, r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})\b", 1)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("MMMM d, yyyy")).cast("date"))


def score_of_five(c: Column) -> Column:
    """The first score out of five, like 4.5/5."""
    found = F.regexp_extract(c, r"(\d(?:\.\d)?)\s*/\s*5", 1)
    return F.when(found != "", found.try_cast("double"))


def tier(line: Column) -> Column:
    """Struct (name, model, price, unit) of a price line like "- **Basic Plan:** Starting at $10 per month"; null for other lines.

    A line is a list item whose bold part is the name and what follows it the terms.
    """
    marks = F.split(F.ltrim(line), r"\*\*", 3)
    bold, said = F.element_at(marks, 2), F.lower(F.element_at(marks, 3))
    name = F.rtrim(F.regexp_replace(bold, ":$", ""))
    model = F.coalesce(*(F.when(said.contains(phrase), m) for phrase, m in PRICE_MODELS), F.lit("fixed"))
    priced = model.isin("starting_at", "fixed")
    unit = F.when(priced & said.contains("per lead"), "per_lead").otherwise("per_month")
    price = F.when(priced, money(said)).when(model == "free", F.lit(0.0))
    named = F.exists(F.array(*map(F.lit, TIER_WORDS)), lambda w: name.contains(w))
    item = (F.size(marks) == 3) & F.element_at(marks, 1).rlike(r"^-\s*$") & (name != "") & ~bold.contains("*")
    return F.when(item & named, F.struct(name.alias("name"), model.alias("model"), price.alias("price"), unit.alias("unit")))


#: Where a value of any kind begins: elsewhere, which is most of a text, the patterns of the kinds aren't tried.
_BEGINS = r"(?=[A-Z0-9]|\b[a-z])"


def _found(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """The values of a text, each once, as array<string> in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_BEGINS}(?:{'|'.join(f'(?:{p})' for _, p in kinds)})"), F.lit(0)))


#: Kinds that begin with a digit; a period may begin with a letter too.
_OF_DIGITS = {"period", "iso_date", "stamp", "number"}


def _kind(value: Column, kinds: list[tuple[str, str]]) -> Column:
    """The first kind that fits a whole value; only those that begin as it does are tried."""
    first = lambda tried: F.coalesce(*(F.when(value.rlike(f"^(?:{p})$"), k) for k, p in tried))
    digits, letters = [x for x in kinds if x[0] in _OF_DIGITS], [x for x in kinds if x[0] not in _OF_DIGITS or x[0] == "period"]
    return F.when(value < ":", first(digits)).otherwise(first(letters))


def tagged(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """The values of a text, each once, as array<struct<kind,value>> in the order of the text, from one scan with one pattern.

    Of values that overlap the one that begins first stands, and of kinds that begin at one place the first. Kinds begin with a capital, a digit or a word's first letter.
    """
    return F.transform(_found(text, kinds), lambda x: F.struct(_kind(x, kinds).alias("kind"), x.alias("value")))


def values(body: Column) -> Column:
    """Values that a text states, by kind."""
    return tagged(body, VALUE_KINDS)


def _day(value: Column, pattern: str) -> Column:
    """yyyy-MM-dd, null for what is no date."""
    return F.try_to_timestamp(value, F.lit(pattern)).cast("date").cast("string")


def _amount(value: Column) -> Column:
    return F.translate(value, ",", "").try_cast("double").cast("string")


def standard(kind: Column, value: Column) -> Column:
    """A value as records state it: dates as yyyy-MM-dd, timestamps with hours and minutes, months as yyyy-MM, numbers without commas."""
    return (
        F.when(kind == "timestamp", F.concat_ws(" ", _day(F.substring_index(value, " at ", 1), "MMMM d, yyyy"), F.substring(value, -9, 5)))
        .when(kind == "date", _day(value, "MMMM d, yyyy")).when(kind == "month", F.substring(_day(value, "MMMM yyyy"), 1, 7))
        .when(kind == "number", _amount(value)).otherwise(value)
    )


def harvest(record: Column, kind: T.DataType) -> Column:
    """All scalar values of a nested record (structs, arrays, maps) as array<string>, without nulls and booleans."""
    return F.array_compact(_scalars(record, kind))


def _scalars(record: Column, kind: T.DataType) -> Column:
    """What harvest takes, with nulls."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        parts = [_scalars(record[f.name], f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(record, lambda x: _scalars(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return _scalars(F.map_values(record), T.ArrayType(kind.valueType))
    return none if isinstance(kind, T.BooleanType) else F.array(record.cast("string"))


#: A letter and the digit behind it: every code holds one.
_TURN = r"[a-z]\d"


def _stated(texts: DataFrame, key: str) -> DataFrame:
    """(key, value, kind, meet) of values in texts: a record of the key supports one if it tells the same and, for a code, holds it."""
    found = texts.select(key, F.explode_outer(_found(F.col("body"), VALUE_KINDS)).alias("value"))
    kind, value = F.col("kind"), F.col("value")
    v = found.where("value is not null").withColumn("kind", _kind(value, VALUE_KINDS))
    about = F.when(kind.isin("date", "iso_date"), "day").otherwise(kind)
    told = F.when(kind == "code", F.regexp_extract(F.lower(value), _TURN, 0)).otherwise(standard(kind, value))
    return v.select(key, "value", "kind", F.concat(about, F.lit(" "), told).alias("meet"))


def _told(allowed: DataFrame, key: str) -> DataFrame:
    """(key, meet, held) that records tell. A date lets its month be stated, a timestamp its date; the whole value may name a period; held is a word that codes may be part of.

    Everything becomes rows before it is told apart: on rows Spark compiles what it would interpret within an array.
    """
    value = F.col("value")
    sources = [
        ("period", F.when(value.rlike(f"^(?:{dict(VALUE_KINDS)['period']})$"), F.array(value))),
        (None, _found(value, RECORD_KINDS)),
        ("code", F.when(F.lower(value).rlike(_TURN), F.split(F.lower(value), r"\W+"))),
    ]
    lists = allowed.select(key, F.inline_outer(F.array(*(F.struct(F.lit(kind).cast("string").alias("kind"), parts.alias("parts")) for kind, parts in sources))))
    parts = lists.select(key, "kind", F.explode_outer("parts").alias("part")).where("part is not null")
    parts = parts.select(key, "part", F.coalesce("kind", _kind(F.col("part"), RECORD_KINDS)).alias("kind"))
    kind, part, day = F.col("kind"), F.col("part"), F.substring("part", 1, 10)
    of_day = [day, F.substring("part", 1, 7)]
    meets = (
        F.when(kind == "code", F.array_distinct(F.regexp_extract_all(part, F.lit(_TURN), F.lit(0)))).when(kind == "iso_date", F.array(*of_day))
        .when(kind == "stamp", F.array(*of_day, F.concat_ws(" ", day, F.substring(part, 12, 5)))).when(kind == "number", F.array(_amount(part))).otherwise(F.array(part))
    )
    told = parts.select(key, "kind", F.when(kind == "code", part).alias("held"), F.posexplode_outer(meets).alias("at", "meet")).where("meet is not null")
    about = F.when(kind.isin("iso_date", "stamp"), F.element_at(F.array(*map(F.lit, ("day", "month", "timestamp"))), F.col("at") + 1)).otherwise(kind)
    return told.select(key, F.concat(about, F.lit(" "), "meet").alias("meet"), "held")


def unsupported(texts: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """(key, kind, value) of values in texts that none of the key's records (key, value) supports.

    Kinds but codes meet by equality of their standard form. A code is supported by a record of its key that holds it, in any case: the two meet in
    a letter and digit that the code has where its digits begin, so not every record of a key is compared with every code. Texts and records are scanned once, and meet in one join.
    """
    v, r = _stated(texts, key).alias("v"), _told(allowed, key).hint("merge").alias("r")
    held = F.when(F.col("v.kind") == "code", F.col("r.held").contains(F.lower("v.value"))).otherwise(True)
    return v.join(r, [F.col(f"v.{key}") == F.col(f"r.{key}"), F.col("v.meet") == F.col("r.meet"), held], "left_anti").select(key, "kind", "value")


def unstated(facts: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Facts (key, attribute, forms) of which no form is in the key's text, in any case."""
    j = facts.join(texts.select(key, F.lower("body").alias("b")), key)
    return j.where(~F.exists("forms", lambda f: F.col("b").contains(F.lower(f)))).select(key, "attribute")


def injection_flags(docs: DataFrame, annotated: DataFrame) -> DataFrame:
    """(doc_id, difference) between texts that match the pattern and annotated ones."""
    f = docs.where(F.col("text").rlike(INJECTION)).select("doc_id", F.lit(True).alias("f"))
    j = f.join(annotated.select("doc_id", F.lit(True).alias("a")).distinct(), "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("a").isNull(), "found only").when(F.col("f").isNull(), "annotated only").otherwise("both").alias("difference"))


def stated_vs_counted(stated: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Counts that are claimed (key, stated) against rows counted, where they differ."""
    n = rows.groupBy(key).agg(F.count("*").alias("counted"))
    return stated.join(n, key, "left").select(key, "stated", F.coalesce("counted", F.lit(0)).alias("counted")).where("stated <> counted")


def route_lines(docs: DataFrame, body: str, routes: list[tuple], other: str) -> DataFrame:
    """Parts of each body by the heading that its lines stand under: (doc_id, target, body).

    Routes are (pattern of heading, target) or (pattern of heading, pattern of line, target or several): a line goes where the first route says whose heading pattern fits
    and, if there is one, whose line pattern does; else to `other`. Lines before any heading have an empty one. A body is one row, so its lines are walked in place and nothing is shuffled.
    """
    rules = [(r[0], None, (r[1],)) if len(r) == 2 else (r[0], r[1], (r[2],) if isinstance(r[2], str) else tuple(r[2])) for r in routes]
    fits = lambda h, x: F.coalesce(*(F.when(h.rlike(head) & (x.rlike(line) if line else F.lit(True)), F.lit(i)) for i, (head, line, _) in enumerate(rules)), F.lit(len(rules)))
    head = lambda x: x.rlike(r"^#{1,6}[ \t]")
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<rule:int,line:string>>").alias("out"))
    step = lambda a, x: F.struct(F.when(head(x), x).otherwise(a["h"]).alias("h"), F.when(head(x), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(fits(a["h"], x).alias("rule"), x.alias("line"))))).alias("out"))
    rows = docs.select("doc_id", F.aggregate(F.split(F.col(body), "\n"), start, step, lambda a: a["out"]).alias("w"))
    targets = list(dict.fromkeys([*(t for *_, ts in rules for t in ts), other]))

    def lines_of(target: str) -> Column:
        at = [i for i, (*_, ts) in enumerate([*rules, (None, None, (other,))]) if target in ts]
        return F.array_join(F.transform(F.filter("w", lambda x: x["rule"].isin(*at)), lambda x: x["line"]), "\n")

    items = [F.struct(F.lit(t).alias("target"), lines_of(t).alias("body")) for t in targets]
    return rows.select("doc_id", F.inline(F.array(*items))).where("body <> ''")


def rebuild(docs: DataFrame, ranges: DataFrame, text: str = "text") -> DataFrame:
    """Bodies put together from line ranges (doc_id, part, first, last; lines count from 1), in order of part, with their hash."""
    lines = F.split(F.col(text), "\n")
    j = docs.select("doc_id", lines.alias("l")).join(ranges, "doc_id")
    cut = j.select("doc_id", "part", F.array_join(F.slice("l", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n").alias("piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "\n")  # as many as the plan of a document has
    return cut.groupBy("doc_id").agg(whole.alias("body")).withColumn("body_sha256", F.sha2("body", 256))


def edited(docs: DataFrame, edits: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, body, refused: bodies with their edits (doc_id, edit_no, op, old, new) applied in order of edit_no.

    "replace" puts new for old, which must occur exactly once in what the body then is; "append" adds new as a paragraph of its own at the end. An edit whose phrase is empty,
    missing or not single is refused: the body stays, and the edit's number and how often the phrase occurs are listed. A document's edits are one row's array.
    """
    plan = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("edit_no", "op", "old", "new"))).alias("edits"))  # as many as a document has
    kind = "array<struct<edit_no:int,found:int>>"
    start = F.struct(F.coalesce(F.col(text), F.lit("")).alias("body"), F.array().cast(kind).alias("refused"))

    def step(a: Column, e: Column) -> Column:
        old = F.coalesce(e["old"], F.lit(""))
        found = F.when(old == "", 0).otherwise(((F.length(a["body"]) - F.length(F.replace(a["body"], old, F.lit("")))) / F.length(old)).cast("int"))
        more = F.concat(F.regexp_replace(a["body"], r"\n+\z", ""), F.lit("\n\n"), e["new"], F.lit("\n"))
        said = F.concat(a["refused"], F.array(F.struct(e["edit_no"].cast("int").alias("edit_no"), found.alias("found"))).cast(kind))
        ok = (e["op"] == "append") | (found == 1)
        return F.struct(F.when(e["op"] == "append", more).when(found == 1, F.replace(a["body"], old, e["new"])).otherwise(a["body"]).alias("body"), F.when(ok, a["refused"]).otherwise(said).alias("refused"))

    done = docs.join(plan, "doc_id").select("doc_id", F.aggregate("edits", start, step).alias("r"))
    return done.select("doc_id", "r.body", "r.refused")


def uncovered_lines(docs: DataFrame, ranges: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, first, last): gaps of a document's lines that no range covers, the longest ones possible.

    Ranges are merged in order of their first line; there is a row for each range and gap, never one for each line. Ranges may overlap and reach beyond the text.
    """
    n = docs.select("doc_id", F.size(F.split(F.col(text), "\n")).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("first", "last")
    upto = F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sound = ranges.where("first <= last").select("doc_id", F.greatest("first", F.lit(1)).alias("first"), "last")
    before = sound.select("doc_id", (upto + 1).alias("gap"), (F.col("first") - 1).alias("end")).join(n, "doc_id")
    inner = before.select("doc_id", F.col("gap").alias("first"), F.least("end", "n").alias("last"))
    most = sound.groupBy("doc_id").agg(F.max("last").alias("upto"))
    tail = n.join(most, "doc_id", "left").select("doc_id", (F.coalesce("upto", F.lit(0)) + 1).alias("first"), F.col("n").alias("last"))
    return inner.unionByName(tail).where("first <= last")


def signers_without_record(signed: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Names that sign (name, document) but have no record: how many documents each signed, and the first of them."""
    odd = signed.where(F.col(name).isNotNull()).join(records.select(name).distinct(), name, "left_anti")
    return odd.groupBy(name).agg(F.count_distinct("document").alias("n_documents"), F.min("document").alias("first_document"))
