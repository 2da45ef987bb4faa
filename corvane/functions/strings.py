"""String functions with positions from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def middle(s: Column, start: int, length: int) -> Column:
    return F.substring(s, start + 1, length)


def separate(s: Column, delimiter: str) -> Column:
    """Pieces between a literal delimiter."""
    return F.split(s, "\\Q" + delimiter + "\\E")


def number(s: Column) -> Column:
    """The number a text is, or 0."""
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def comments(s: Column) -> Column:
    """Comments of C-like code: from // to the line's end, and between /* and */."""
    return F.regexp_extract_all(s, F.lit(r"(//[^\n]*|/\*[\s\S]*?\*/)"), 1)
