"""Column functions on text: counts, names, types, formats. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.functions import fixed


def latin1(content: Column) -> Column:
    """One character per byte, so that character positions are byte positions."""
    return F.decode(content, "ISO-8859-1")


def utf8_ignore(content: Column) -> Column:
    """Bytes as UTF-8 with undecodable sequences left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def token_count(text: Column, token: str) -> Column:
    """Non-overlapping, left-to-right occurrences of a literal."""
    shrunk = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (shrunk / F.lit(len(token))).cast("int")


def token_total(text: Column, tokens: Sequence[str]) -> Column:
    """Sum of the separate counts: a token inside another one counts for both."""
    total = token_count(text, tokens[0])
    for token in tokens[1:]:
        total = total + token_count(text, token)
    return total


def has_any(text: Column, tokens: Sequence[str]) -> Column:
    found = F.contains(text, F.lit(tokens[0]))
    for token in tokens[1:]:
        found = found | F.contains(text, F.lit(token))
    return found


def url_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.URL_PATTERN))


def split_ext(name: Column) -> Column:
    """Lower-cased suffix of the base name; a name that only starts with dots has none."""
    base = F.regexp_extract(name, r"[^/]*$", 0)
    return F.trim(F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)))


def last_dot_ext(name: Column) -> Column:
    """Everything from the last dot on, wherever it stands."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.[^.]*$", 0))


def mime_of(ext: Column) -> Column:
    kind = F.lit(fixed.DEFAULT_MIME)
    for suffix, mime in fixed.MIME_TYPES.items():
        kind = F.when(ext == suffix, F.lit(mime)).otherwise(kind)
    return kind


def mask_secret(value: Column) -> Column:
    """First and last four characters; too short a value shows nothing at all."""
    clean = F.regexp_replace(value, "^[\"'](.+)[\"']$", "$1")
    masked = F.concat(F.substring(clean, 1, 4), F.lit("..."), F.right(clean, F.lit(4)))
    return (
        F.when(value.isNull() | (value == ""), F.lit("MISSING"))
        .when(F.length(clean) < 10, F.lit("****"))
        .otherwise(masked)
    )


def fixed2(x: Column) -> Column:
    """Two decimals, ties to the even digit of the exact binary value, no thousands marks."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def human_size(n: Column, units: Sequence[str] = ("B", "KB", "MB", "GB")) -> Column:
    """Bytes with two decimals in the largest unit that keeps the number at 1 or above."""
    x = n.cast("double")
    shown = F.concat(fixed2(x / F.lit(float(1024 ** (len(units) - 1)))), F.lit(f" {units[-1]}"))
    for power in range(len(units) - 2, -1, -1):
        below = F.concat(fixed2(x / F.lit(float(1024**power))), F.lit(f" {units[power]}"))
        shown = F.when(x < F.lit(float(1024 ** (power + 1))), below).otherwise(shown)
    return shown


def percent(score: Column) -> Column:
    """Score clamped to 0..1, as a whole percentage, halves up."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))
    return F.floor(clamped * 100 + F.lit(0.5)).cast("int")
