"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import patterns

TOKEN = r"[\p{IsAlphabetic}\p{N}_]+"
#: The same class for constants, which the driver splits.
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}_]+")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def document_key(path: Column) -> Column:
    """Identity of a document: 24 hex digits of its path's digest."""
    return F.substring(F.sha2(path, 256), 1, 24)


def tokens(text: Column, most: int = 16) -> Column:
    """The first distinct lower-case tokens of a query; extraction comes before lower-casing, which may leave the class."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))
    return F.slice(F.array_distinct(found), 1, most)


def token_list(query: str, most: int = 16) -> list[str]:
    """tokens() of a constant."""
    found = [t.lower() for t in _TOKEN.findall(query)]
    return list(dict.fromkeys(found))[:most]


def pattern(source: str, ignore_case: bool = False, literal: bool = False) -> str:
    """A line pattern of the engine's dialect in the JVM's."""
    return patterns.java(patterns.escape(source) if literal else source, ignore_case)


def literal_anchor(line: Column, query: str) -> Column:
    """Whether a one-token query is a word of the line, whatever its case."""
    word = query.strip()
    if not _TOKEN.fullmatch(word):
        return F.lit(False)
    return F.exists(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t) == word.lower())


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Share of the terms that the text contains, anywhere in its lower-case form."""
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) / F.lit(max(1, len(terms)))


def byte_column(line: Column, regex: str) -> Column:
    """1-based byte column of the first match in a line. What comes before it is cut out as text: numbers of characters mean UTF-16 units in patterns."""
    return (F.octet_length(F.regexp_extract(line, rf"(?s)\A(.*?)(?:{regex})", 1)) + 1).cast("long")


def byte_clip(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in so many bytes."""
    raw = F.encode(text, "utf-8")
    # A character has at most four bytes: one of these cuts is at a boundary.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def normalized(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}]", ""))


def generic_title(title: Column) -> Column:
    """Whether a bookmark's title only numbers a page."""
    return normalized(title).rlike(r"^((page|slide|folie|documentpage)?\p{N}+)?$")


def citation(path: Column, first: Column, last: Column, unit: str = "L") -> Column:
    return F.concat(path, F.lit(f":{unit}"), first.cast("string"), F.lit(f"-{unit}"), last.cast("string"))
