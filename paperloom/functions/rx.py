"""Regular expressions with Unicode classes, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    """A pattern whose classes and word bounds cover all scripts; ``flags`` like "i" or "m"."""
    return f"(?U{flags}){pattern}"


def has(column: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern occurs; false for null."""
    return F.coalesce(column.rlike(rx(pattern, flags)), F.lit(False))


def sub(column: Column, pattern: str, replacement: str = "", flags: str = "") -> Column:
    """All occurrences replaced."""
    return F.regexp_replace(column, rx(pattern, flags), replacement)


def strip(column: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def find_all(column: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(column, F.lit(rx(pattern)), F.lit(group)), F.array().cast("array<string>"))
