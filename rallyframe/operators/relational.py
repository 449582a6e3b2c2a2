"""Deduplication, membership and parity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(rows: DataFrame, keys: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by ``order``.

    A partially aggregated ``max_by``/``min_by``, not a window: a hot key costs
    one row per task in the shuffle.  Rows whose order ties are chosen between
    by their content.  Null keys form a key of their own.  All columns of
    ``rows`` are read, so select those that are wanted first.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    rank = F.struct(*order, whole)
    pick = F.max_by(whole, rank) if last else F.min_by(whole, rank)
    return rows.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def in_listed_order(ids: DataFrame, rows: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows of the listed ids with their list position (``pos``); unknown ids are dropped, or raise if ``strict``."""
    if not strict:
        return ids.join(rows, key, "inner")
    met = ids.join(rows.withColumn("_known", F.lit(True)), key, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # checked row by row while the rows are read: no pass of its own
    return met.where(F.when(F.col("_known").isNull(), unknown).otherwise(F.lit(True))).drop("_known")


def differences_by_position(saved: DataFrame, replayed: DataFrame, pos: str) -> DataFrame:
    """Positions at which two ordered tables differ: ``pos``, ``saved`` and ``replayed`` (structs, null where absent)."""
    columns = [c for c in saved.columns if c != pos]
    side = lambda rows, name: rows.select(pos, F.struct(*columns).alias(name))
    both = side(saved, "saved").join(side(replayed, "replayed"), pos, "full_outer")
    return both.where(~F.col("saved").eqNullSafe(F.col("replayed")))


def non_empty(rows: DataFrame, what: str) -> DataFrame:
    """``rows``; ValueError if there are none."""
    if rows.isEmpty():
        raise ValueError(f"no rows: {what}")
    return rows


def better_side(edge: Column, other_edge: Column, confidence: Column, other_confidence: Column, name: str, other: str) -> Column:
    """The side of larger edge; no edge counts as least.  Ties go by confidence, then to the first side."""
    least = F.lit(float("-inf"))
    a, b = F.coalesce(edge, least), F.coalesce(other_edge, least)
    sure = F.coalesce(confidence, F.lit(0.0)) >= F.coalesce(other_confidence, F.lit(0.0))
    return F.when(a > b, name).when(a < b, other).when(sure, name).otherwise(other)


def map_value(values: Column, key: Column, default: Column) -> Column:
    """Value of a key, or the default."""
    return F.coalesce(F.try_element_at(values, key), default)


def map_updated(values: Column, key: Column, value: Column) -> Column:
    """A copy of a map in which ``key`` has ``value``."""
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def unknown_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return ids.join(rows.select(key), key, "left_anti").distinct()


def repeated_ids(ids: DataFrame, key: str) -> DataFrame:
    return ids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differences(saved: DataFrame, replayed: DataFrame) -> DataFrame:
    """Rows in which two tables differ, with multiplicity: side, and the columns."""
    columns = saved.columns
    other = replayed.select(*columns)
    return (
        saved.exceptAll(other).withColumn("side", F.lit("saved"))
        .unionAll(other.exceptAll(saved).withColumn("side", F.lit("replayed")))
    )


def check_columns(rows: DataFrame, expected: list[str]) -> DataFrame:
    """``rows``, if it has exactly the expected columns in their order; else ValueError."""
    if rows.columns != expected:
        raise ValueError(f"columns differ: missing {sorted(set(expected) - set(rows.columns))}, extra {sorted(set(rows.columns) - set(expected))}")
    return rows


def single_value(rows: DataFrame, column: str):
    """The only value of a column; ValueError if there is none or more than one."""
    found = rows.select(column).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{column} must hold one value")
    return found[0][0]
