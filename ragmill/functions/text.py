"""Column functions for cleaning, measuring and cutting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of weight and what they are divided by to give pounds (fixed values).
POUND_DIVISORS = {"pounds": 1.0, "ounces": 16.0, "grams": 453.592, "milligrams": 453592.0, "kilograms": 0.453592, "hundredths pounds": 100.0}
#: Details that say nothing about a product (fixed values).
NOISE_KEYS = ["Batteries Included?", "Batteries Required?", "Best Sellers Rank", "Item model number", "Part Number"]
#: Fixed pattern: a token of seven or more capitals and digits with at least one of each ahead on the line.
PART_NUMBER = r"\b(?=[A-Z0-9]{7,}\b)(?=.*[A-Z])(?=.*\d)[A-Z0-9]+\b"


def parse_price(c: Column, low: float = 0.5, high: float = 999.49) -> Column:
    """The number a text states if it lies in the range (ends included), else null."""
    v = c.try_cast("double")
    return F.when(v.between(low, high), v)


def pounds(c: Column) -> Column:
    """Pounds of a text like "12 ounces"; 0 for an unknown unit, null for a bad number."""
    parts = F.split(F.btrim(c), r"\s+", 2)
    amount, unit = parts[0].try_cast("double"), F.lower(F.get(parts, F.lit(1)))
    out = F.when(amount.isNull(), None)
    for name, by in POUND_DIVISORS.items():
        out = out.when(unit == name, amount / by)
    return out.otherwise(F.lit(0.0))


def simplify(c: Column, most: int = 3000) -> Column:
    """Line breaks to spaces, no returns or tabs, one pass of two spaces to one, stripped, cut."""
    return F.substring(F.btrim(F.replace(F.translate(F.replace(c, F.lit("\n"), F.lit(" ")), "\r\t", ""), F.lit("  "), F.lit(" "))), 1, most)


def scrub(c: Column, most: int = 4000) -> Column:
    """Part numbers deleted, stripped, cut."""
    return F.substring(F.btrim(F.regexp_replace(c, PART_NUMBER, ""), F.lit(" \t\n\r\x0b\x0c")), 1, most)


def useful_details(details: Column) -> Column:
    """A map of details without its noise keys."""
    return F.map_filter(details, lambda k, _: ~k.isin(NOISE_KEYS))


def product_text(title: Column, description: Column, features: Column, details: Column, most: int = 4000) -> Column:
    """Title, description, features and useful details (a map, as JSON), a line each where there is any, without part numbers."""
    useful = useful_details(details)
    line = lambda c: F.when(c != "", F.concat(simplify(c), F.lit("\n")))
    whole = [F.concat(F.coalesce(title, F.lit("")), F.lit("\n")), line(description), line(features), F.when(F.size(useful) > 0, F.concat(F.to_json(useful), F.lit("\n")))]
    return scrub(F.concat_ws("", *whole), most)


def full_text(title: Column, *parts: Column) -> Column:
    return F.concat_ws(" ", title, *parts)


def words(c: Column) -> Column:
    """Tokens of the default tokenizer: what white space parts."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def normalize_quotes(c: Column) -> Column:
    """Curly quotes to straight ones, white space to one space, stripped."""
    return F.btrim(F.regexp_replace(F.translate(c, "‘’“”", "''\"\""), r"[ \t\n\x0B\f\r]+", " "))


def parse_guess(c: Column) -> Column:
    """The first number of a text without $ and commas; 0 if there is none. A whole number loses its sign."""
    found = F.regexp_extract(F.translate(c, "$,", ""), r"([-+]?\d*\.\d+|\d+)", 1)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(0.0))


def fixed_chunks(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Windows of a text that overlap; the last reaches its end. Empty text has none."""
    n = F.length(c)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(size - overlap)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * (size - overlap) + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def hash_embedding(c: Column, width: int = 4) -> Column:
    """The first bytes of the text's sha256 over 255, rounded to three digits."""
    h = F.sha2(c, 256)
    return F.array(*(F.round(F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double") / 255, 3) for i in range(width)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
