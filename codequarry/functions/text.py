"""Text functions as column expressions."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which sizes and budgets are counted."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def token_estimate(length: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(length / 4).cast("long")


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, both included and counted from 1; nothing if start is past the end."""
    lines = lines_of(text)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.when(first > F.size(lines), F.lit("")).otherwise(
        F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    )


def redacted(text: Column, patterns: list[str], mask: str = "[REDACTED]") -> Column:
    """Every match of every pattern, in order, replaced. A pattern that isn't a valid
    expression - for Java's engine, which runs it - is taken literally."""
    for pattern in patterns:
        if is_expression(pattern):
            text = F.regexp_replace(text, pattern, mask)
        else:
            text = F.replace(text, F.lit(pattern), F.lit(mask))
    return text


def is_expression(pattern: str) -> bool:
    """Whether Java's engine takes the pattern."""
    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def content_hash(content: Column) -> Column:
    """SHA-256 in hex of a file's bytes; what tells versions of a file apart."""
    return F.sha2(content, 256)


def short_hash(text: Column) -> Column:
    """SHA-1 in hex, for names."""
    return F.sha1(text)


#: Patterns redacted by default.
REDACTIONS = ["BEGIN PRIVATE KEY", "AWS_SECRET_ACCESS_KEY", "API_KEY=", "SECRET_KEY="]
