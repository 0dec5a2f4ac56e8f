"""Small column helpers used throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; GAP is what lies between words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body refers to it.

    Catalyst may inline a projected column into a lambda, where it would be computed for each element;
    a lambda variable is a value and cannot be inlined.
    """
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def word_count(text: Column) -> Column:
    """Number of words (long)."""
    return F.size(words(text)).cast("long")
