"""Text expressions: plain names and title pairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """ASCII-folded, lower-case name; punctuation becomes one blank.

    Letters that do not decompose (such as o with stroke) vanish.  Folding runs
    in an Arrow UDF, as no built-in decomposes letters; the rest is built in.
    """

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())

    spaced = F.regexp_replace(F.lower(fold(name)), r"[^\w\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def title_pair(title: Column) -> tuple[Column, Column]:
    """The two sides of ``prefix: A vs B``; nulls where the title has no such form."""
    tail = F.trim(F.substring_index(title, ":", -1))
    shown = F.when(tail == "", F.trim(title)).otherwise(tail)
    pattern = r"(?i)^(.+?)\s+vs\s+(.+)$"
    sides = [F.nullif(F.trim(F.regexp_extract(shown, pattern, n)), F.lit("")) for n in (1, 2)]
    return sides[0], sides[1]


def json_array(values: Column) -> Column:
    """JSON text of an array of strings."""
    return F.to_json(values)


def currency(value: Column) -> Column:
    """Dollars with two decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string("$%.2f", value))


def year_of(date: Column) -> Column:
    """First four characters of a date text; a shorter text raises, null stays null."""
    short = F.raise_error(F.concat(F.lit("no date: "), date))
    return F.when(F.length(date) < 4, short).otherwise(F.substring(date, 1, 4))


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)
