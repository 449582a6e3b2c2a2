"""References to keys that their parent table does not hold.

Method: parent keys of the regular form ``prefix + integer`` are sorted and
compressed into runs of contiguous integers; each referenced key is matched
as-of to the run that starts at or before it and is an orphan if it lies beyond
the run's end.  Keys of any other form are kept whole and matched by equality.
Runs are cut at fixed key intervals, so no task sees more than one interval.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.util import salted_join

DECIMAL, HEX16 = "decimal", "hex16"
INTERVAL_BITS = 14


@dataclass(frozen=True)
class Reference:
    """Column ``column`` of ``child`` names keys of ``parent[parent_key]``."""

    source_table: str
    child: DataFrame
    record_id: str
    column: str
    period: Column
    parent: DataFrame
    parent_key: str


def split_key(key: Column) -> tuple[Column, Column]:
    """(prefix, number) of a key; a key of irregular form is its own prefix, with number 0.

    Canonical: ``...:`` and 1-18 decimal digits without leading zero, or
    ``...:`` and 16 lower-case hex digits (read as a signed 64-bit number).
    The split is reversible, so equal pairs mean equal keys, letter by letter.
    """
    decimal = key.rlike(r"\A.*:(0|[1-9][0-9]{0,17})\z")
    hexa = key.rlike(r"\A.*:[0-9a-f]{16}\z")
    tail = F.substring_index(key, ":", -1)
    high = F.conv(F.substring(tail, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(tail, 9, 8), 16, 10).cast("bigint")
    prefix = key.substr(F.lit(1), F.length(key) - F.length(tail))
    form = F.when(hexa, HEX16).when(decimal, DECIMAL)
    number = F.when(hexa, F.shiftleft(high - F.lit(1 << 31), 32) + low).when(decimal, tail.try_cast("bigint"))
    whole = F.concat(F.coalesce(form, F.lit("text")), F.lit("|"), F.when(form.isNotNull(), prefix).otherwise(key))
    return whole, F.coalesce(number, F.lit(0).cast("bigint"))


def _interval(number: Column, prefix: Column) -> Column:
    # hashes are spread over 64 bits, counted ids lie dense: other widths of interval
    return F.when(prefix.startswith(HEX16), F.shiftright(number, 48)).otherwise(F.shiftright(number, INTERVAL_BITS))


def key_runs(keys: DataFrame, label: str | None = None) -> DataFrame:
    """Runs (prefix, interval, first, last) of the distinct keys in column ``key``, per ``label`` if given."""
    own = [label] if label else []
    prefix, number = split_key(F.col("key"))
    numbers = keys.where("key is not null").select(*own, prefix.alias("prefix"), number.alias("n")).distinct()
    numbers = numbers.withColumn("interval", _interval(F.col("n"), F.col("prefix")))
    nth = F.row_number().over(W.partitionBy(*own, "prefix", "interval").orderBy("n"))
    return (
        numbers.withColumn("island", F.col("n") - nth)
        .groupBy(*own, "prefix", "interval", "island")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"))
        .drop("island")
    )


def missing_keys(referenced: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (parent, key) of ``referenced`` that ``parents`` (parent, key) lacks; ``parent`` labels the table meant."""
    prefix, number = split_key(F.col("key"))
    asked = referenced.where("key is not null").select("parent", "key").distinct().select("parent", "key", prefix.alias("prefix"), number.alias("first"))
    asked = asked.withColumn("interval", _interval(F.col("first"), F.col("prefix")))
    runs = key_runs(parents, "parent").select(
        "parent", F.lit(None).cast("string").alias("key"), "prefix", "first", "interval", "last", F.lit(0).alias("tag")
    )
    both = runs.unionByName(asked.withColumn("last", F.lit(None).cast("bigint")).withColumn("tag", F.lit(1)))
    until = W.partitionBy("parent", "prefix", "interval").orderBy("first", "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = both.withColumn("reach", F.last("last", ignorenulls=True).over(until))
    return reach.where("tag = 1 and (reach is null or first > reach)").select("parent", "key")


def orphans(references: list[Reference], salts: int = 8, periods: bool = True) -> DataFrame:
    """Orphan references of each table and column.

    Result: source_table, ref_column, period (unless not ``periods``), record_id,
    missing_id; one row for each distinct record.  Null references, and records
    with a null id, give no row; a null period is reported as ''.  Parent rows
    count however late they came and however often they are repeated; other
    columns of either table are ignored.  An empty parent makes every reference
    an orphan; an empty child gives no rows.

    All columns of one child are unpivoted in one scan, and each parent is
    compressed once, however many columns refer to it.
    """
    if not references:
        raise ValueError("no references given")
    labels: dict[tuple[int, str], int] = {}
    parents, children = None, {}
    for r in references:
        name = (id(r.parent), r.parent_key)
        if name not in labels:
            labels[name] = len(labels)
            keys = r.parent.select(F.lit(labels[name]).alias("parent"), F.col(r.parent_key).cast("string").alias("key"))
            parents = keys if parents is None else parents.unionByName(keys)
        period = [F.coalesce(r.period.cast("string"), F.lit("")).alias("period")] if periods else []
        cell = F.struct(
            F.lit(r.source_table).alias("source_table"), F.lit(r.column).alias("ref_column"), *period,
            F.col(r.record_id).cast("string").alias("record_id"), F.lit(labels[name]).alias("parent"), F.col(r.column).cast("string").alias("key"),
        )
        children.setdefault(id(r.child), (r.child, []))[1].append(cell)
    rows = None
    for child, cells in children.values():
        part = child.select(F.inline(F.array(*cells))).where("key is not null and record_id is not null")
        rows = part if rows is None else rows.unionByName(part)
    gone = missing_keys(rows, parents)
    # one missing id may be named by a third of all rows
    hits = salted_join(rows, gone, ["parent", "key"], [F.col("record_id")], "left_semi", salts)
    kept = ["source_table", "ref_column", *(["period"] if periods else []), "record_id"]
    return hits.select(*kept, F.col("key").alias("missing_id")).distinct()


def orphans_by_period(references: list[Reference], **options) -> DataFrame:
    """Orphan records and distinct missing ids per table, column and period."""
    return orphans(references, **options).groupBy("source_table", "ref_column", "period").agg(
        F.count(F.lit(1)).alias("orphan_records"), F.countDistinct("missing_id").alias("missing_ids")
    )
