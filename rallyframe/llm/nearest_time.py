"""Pairing of records with the nearest record in time of the same entity.

Method: both tables are range-partitioned together by (entity, time), so a hot
entity spreads over as many tasks as it needs.  Every task streams its sorted
rows once and keeps, for each left row, the last right row before and the first
one after it; it holds no more than the last right row and the left rows since.  What lies beyond a partition's edge comes from a parallel prefix
scan over the partitions' edge records, one row per partition and direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.util import materialize, shuffle_partitions

BLOCK = 64
PART_ROWS = 2_000_000
_NAMES = ["kind", "part", "entity", "at", "id", "before_at", "before_id", "after_at", "after_id"]
_SCHEMA = (
    "kind int, part int, entity string, at bigint, id string, "
    "before_at bigint, before_id string, after_at bigint, after_id string"
)
ROW, FIRST_RIGHT, LAST_RIGHT = 0, 1, 2


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def _resolved(rows: pa.Table, asked: int, part: int) -> pa.RecordBatch:
    """The left rows among the first ``asked`` rows with the nearest right rows of their entity before and after."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    entity, ids = rows["entity"].combine_chunks(), rows["id"].combine_chunks()
    at = rows["at"].to_numpy()
    right = rows["side"].to_numpy() == 0
    new = np.ones(n, dtype=bool)
    new[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False)
    same_id = np.zeros(n, dtype=bool)
    same_id[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    repeated = same_id & ~new
    repeated[1:] &= (at[1:] == at[:-1]) & (right[1:] == right[:-1])
    index = np.arange(n)
    begin = np.maximum.accumulate(np.where(new, index, 0))
    ends = np.append(np.flatnonzero(new)[1:], n)
    end = ends[np.cumsum(new) - 1]
    before = np.maximum.accumulate(np.where(right, index, -1))
    after = np.minimum.accumulate(np.where(right, index, n)[::-1])[::-1]
    asks = np.flatnonzero(~right[:asked] & ~repeated[:asked])
    b, a = before[asks], after[asks]
    has_b, has_a = b >= begin[asks], a < end[asks]
    b, a = np.where(has_b, b, 0), np.where(has_a, a, 0)

    def taken(values: pa.Array, where: np.ndarray, has: np.ndarray) -> pa.Array:
        return values.take(pa.array(where, mask=~has))

    stamps = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(asks), ROW, np.int32)), pa.array(np.full(len(asks), part, np.int32)),
            entity.take(pa.array(asks)), stamps.take(pa.array(asks)), ids.take(pa.array(asks)),
            taken(stamps, b, has_b), taken(ids, b, has_b), taken(stamps, a, has_a), taken(ids, a, has_a),
        ],
        names=_NAMES,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []  # the last right row, and the rows since
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rights = np.flatnonzero(batch.column("side").to_numpy() == 0)
        if not len(rights):
            continue
        first = first or batch.slice(rights[0], 1)
        last = batch.slice(rights[-1], 1)
        rows = pa.Table.from_batches(held)
        known = rows.num_rows - batch.num_rows + int(rights[-1])
        yield _resolved(rows, known, part)
        held = [batch.slice(rights[-1])]
    if held and any(b.num_rows for b in held):
        rows = pa.Table.from_batches(held)
        yield _resolved(rows, rows.num_rows, part)
    if first is not None:
        edge = pa.Table.from_batches([first, last]).combine_chunks()
        none = pa.nulls(2, pa.int64()), pa.nulls(2, pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([FIRST_RIGHT, LAST_RIGHT], pa.int32()), pa.array([part, part], pa.int32()),
                *[edge[c].combine_chunks() for c in ("entity", "at", "id")], none[0], none[1], none[0], none[1],
            ],
            names=_NAMES,
        )


def edge_scan(edges: DataFrame, parts: DataFrame, value: str, backward: bool) -> DataFrame:
    """Exclusive scan: for each partition the nearest earlier (or later) edge record.

    Two levels: blocks of partitions scan in parallel, their summaries are
    scanned once, and both are combined.
    """
    sign = -1 if backward else 1
    rows = parts.join(edges, "part", "left").withColumn("block", F.col("part") / BLOCK)
    rows = rows.withColumn("block", F.floor("block")).withColumn("seq", F.col("part") * sign)
    inside = W.partitionBy("block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("near", F.last(value, ignorenulls=True).over(inside))
    reach = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))
    blocks = rows.groupBy("block").agg(reach.alias("reach")).withColumn("bseq", F.col("block") * sign)
    across = W.orderBy("bseq").rowsBetween(W.unboundedPreceding, -1)  # one row per BLOCK partitions
    carried = blocks.select("block", F.last("reach", ignorenulls=True).over(across).alias("carried"))
    return local.join(F.broadcast(carried), "block").select("part", F.coalesce("near", "carried").alias(value))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int | None) -> DataFrame:
    """For each left record the right record of its entity nearest in time.

    Both sides: entity string, at bigint (microseconds), id string; further
    columns are ignored.  Result: entity, left_id, left_at, right_id, right_at,
    for left records with a partner at most ``tolerance_us`` away (no bound if
    None).  Of two equally near partners the earlier one is given; of several
    right records of one instant the one with the greatest id if they lie
    before or at the left record, else the least.  Rows with a null in entity,
    at or id match nothing; equal repeated rows count once; either side may be
    empty.
    """
    spark = left.sparkSession
    sides = [x.select("entity", "at", "id", F.lit(s).alias("side")) for x, s in ((right, 0), (left, 1))]
    rows = sides[0].unionByName(sides[1]).where("entity is not null and at is not null and id is not null")
    key = ["entity", "at", "side", "id"]
    # measured, so that a task's share stays the same whatever the table's size
    parts = max(shuffle_partitions(spark), math.ceil(rows.count() / PART_ROWS))
    placed = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    scanned = materialize(placed.mapInArrow(_scan, _SCHEMA))
    edge = F.struct("entity", "at", "id")
    parts = scanned.select("part").distinct()
    firsts = scanned.where(f"kind = {FIRST_RIGHT}").select("part", edge.alias("later"))
    lasts = scanned.where(f"kind = {LAST_RIGHT}").select("part", edge.alias("earlier"))
    edges = edge_scan(lasts, parts, "earlier", False).join(edge_scan(firsts, parts, "later", True), "part")
    # one row per partition of the scan: bounded by the number of partitions, not by the data
    met = scanned.where(f"kind = {ROW}").join(F.broadcast(edges), "part", "left")

    def side(own: str, edge: str) -> tuple[Column, Column]:
        same = F.col(f"{edge}.entity") == F.col("entity")
        own_at, own_id = F.col(f"{own}_at"), F.col(f"{own}_id")
        return (
            F.coalesce(own_at, F.when(same, F.col(f"{edge}.at"))),
            F.coalesce(own_id, F.when(same, F.col(f"{edge}.id"))),
        )

    (b_at, b_id), (a_at, a_id) = side("before", "earlier"), side("after", "later")
    met = met.select("entity", F.col("id").alias("left_id"), F.col("at").alias("left_at"), b_at.alias("b_at"), b_id.alias("b_id"), a_at.alias("a_at"), a_id.alias("a_id"))
    first = F.col("a_at").isNull() | (F.col("left_at") - F.col("b_at") <= F.col("a_at") - F.col("left_at"))
    first = F.col("b_at").isNotNull() & first
    met = met.select(
        "entity", "left_id", "left_at", F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("right_id"),
        F.when(first, F.col("b_at")).otherwise(F.col("a_at")).alias("right_at"),
    ).where("right_id is not null")
    return met if tolerance_us is None else met.where(F.abs(F.col("left_at") - F.col("right_at")) <= tolerance_us)
