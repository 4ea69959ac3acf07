"""Scalar functions that Spark spells differently, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_index(text: Column, separator: str, index: int) -> Column:
    """The index-th (from 0) part of text; null where there are fewer parts."""
    return F.get(F.split(text, "\\Q" + separator + "\\E", -1), F.lit(index))


def regexp_extract_or_null(text: Column, pattern: str, group: int) -> Column:
    """As regexp_extract, but null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def count_char(text: Column, char: str) -> Column:
    """How often char occurs; 0 for null."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(char))), F.lit(0)).cast("bigint")


def positive_mod(value: Column, n: int) -> Column:
    return F.pmod(value, F.lit(n))
