"""Pattern helpers shared by the column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(column: Column, pattern: str) -> Column:
    """`rlike` whose `$` means end of text only (Java's `$` also matches before a last newline)."""
    return column.rlike(pattern.replace("$", r"\z"))


def utf16_length(column: Column) -> Column:
    """Length in UTF-16 units, the unit of every published length limit."""
    return (F.octet_length(F.encode(column, "UTF-16BE")) / 2).cast("int")


def compact(*columns: Column) -> Column:
    """Array of the non-null arguments."""
    return F.array_compact(F.array(*columns))


def sorted_set(column: Column) -> Column:
    return F.array_sort(F.array_distinct(column))


def code_when(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))
