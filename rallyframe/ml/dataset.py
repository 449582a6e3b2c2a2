"""Chronological splits of a modelling table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(date: Column, train_end: str, validation_end: str, test_end: str | None = None) -> Column:
    """``train``, ``validation`` or ``test`` of a yyyyMMdd date; null beyond ``test_end``."""
    ends = [train_end, validation_end, *([test_end] if test_end else [])]
    if any(len(e) != 8 or not e.isdigit() for e in ends):
        raise ValueError("boundaries must be YYYYMMDD dates")
    if any(a >= b for a, b in zip(ends, ends[1:])):
        raise ValueError("boundaries must be strictly increasing")
    last = F.when(date <= test_end, "test") if test_end else F.when(date.isNotNull(), "test")
    return F.when(date <= train_end, "train").when(date <= validation_end, "validation").otherwise(last)


def check_splits(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``split`` column, if no split is empty and no row lies outside; else ValueError."""
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if empty := [s for s in ("train", "validation", "test") if not sizes.get(s)]:
        raise ValueError(f"empty split: {', '.join(empty)}")
    if sizes.get(None):
        raise ValueError(f"{sizes[None]} rows lie outside the splits")
    return rows


def check_boundaries(rows: DataFrame, date: str, train_end: str, validation_end: str, test_end: str) -> DataFrame:
    """``rows`` with ``split``, if the splits are in order and full and the last row of each lies on its boundary; else ValueError."""
    placed = check_splits(rows.withColumn("split", split_of(F.col(date), train_end, validation_end, test_end)))
    last = {r.split: r.last for r in placed.groupBy("split").agg(F.max(date).alias("last")).collect()}
    want = {"train": train_end, "validation": validation_end, "test": test_end}
    if off := sorted(s for s, end in want.items() if last[s] != end):
        raise ValueError(f"the last row does not lie on the boundary of: {', '.join(off)}")
    return placed
