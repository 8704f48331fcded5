"""Text expressions. Words are maximal runs without white space in Unicode's sense, offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)[^\s\x1c-\x1f]+"

# Patterns of the quality filter.
REFERENCE_HEADER = r"(?im)^\s{0,3}(#+\s*)?(references|bibliography)\s*$"
CAPTION = r"(?i)\b(table|figure|fig\.?)\s+\d+"
CITATION = r"\b(?:[A-Z][A-Za-z'`-]+(?:\s+et\s+al\.)?|\([^)]+)\s*,?\s*(?:19|20)\d{2}[a-z]?\)?"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def density(c: Column, pattern: str) -> Column:
    """Matches of a pattern per word, at least one word."""
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.lit(1), word_count(c))


def is_reference_like(c: Column) -> Column:
    return c.rlike(REFERENCE_HEADER)


def is_caption_like(c: Column) -> Column:
    """The first line of the stripped text mentions a numbered table or figure."""
    return F.element_at(F.split(stripped(c), r"\R"), 1).rlike(CAPTION)


def url_tail(c: Column) -> Column:
    """The last path segment of a URL, final slashes disregarded."""
    return F.element_at(F.split(F.regexp_replace(c, r"/+$", ""), "/"), -1)


def year_number(c: Column) -> Column:
    """The year as a number if it is all digits, else null."""
    return F.when(c.rlike(r"^[0-9]{1,9}$"), c.cast("int"))


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def containment_form(c: Column) -> Column:
    """Lower case, without ASCII punctuation, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(c), PUNCTUATION, ""))


def answer_form(c: Column) -> Column:
    """containment_form without the English articles."""
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), r"\b(a|an|the)\b", " "))


def is_latin(c: Column) -> Column:
    """Every letter is Latin."""
    return ~c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def markdown_spaces(c: Column) -> Column:
    """Runs of blanks between other characters become one; indentation stays."""
    return F.regexp_replace(c, r"(?<=\S)  +(?=\S)", " ")


def author_names(author: Column, author_string: Column) -> Column:
    """Full names of the author structs; without any, the comma-separated string."""
    full = F.filter(F.transform(author, lambda a: a["full"]), lambda n: n.isNotNull() & (n != ""))
    split = F.filter(F.transform(F.split(author_string, ","), lambda x: F.trim(x)), lambda n: n != "")
    return F.when(F.coalesce(F.size(full), F.lit(0)) > 0, full).otherwise(F.coalesce(split, F.array().cast("array<string>")))
