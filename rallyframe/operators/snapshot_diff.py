"""What changed between consecutive full snapshots of a keyed table.

Method: a snapshot's rows, sorted by key, are cut into content-defined chunks: a
key whose hash meets a mask opens a chunk, so equal stretches of two snapshots
are cut alike however many keys lie before them, and a snapshot's chunk digests
depend on that snapshot alone.  Chunks whose digest equals that of the same
chunk in the preceding snapshot are discarded; only rows of unmatched chunks
are joined by key and classified.  Keys and digests move, never whole rows:
values before and after are fetched for the changed keys alone, if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.util import materialize, null_safe_hash, shuffle_partitions

CHUNK_KEYS = 64
AFTER, BEFORE = 1, 2


def row_digest(fields: list[str]) -> Column:
    """128 bits of a row's fields, null-safe."""
    return F.struct(null_safe_hash(fields).alias("a"), null_safe_hash(fields, "second").alias("b"))


def listed_keys(rows: DataFrame, delivery: Column, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """delivery, key, digest: one row per (delivery, key), that of the row that ``order`` puts last.

    A partially aggregated maximum, so a key that is fetched over and over costs
    one row per task in the shuffle.  Rows with null key or delivery are no
    listings and are left out.  Full ties are broken by the row's content.
    """
    slim = rows.select(
        delivery.alias("delivery"), F.col(key).cast("string").alias("key"), F.struct(F.struct(*order), row_digest(fields).alias("digest")).alias("last")
    ).where("delivery is not null and key is not null")
    return slim.groupBy("delivery", "key").agg(F.max("last").alias("last")).select("delivery", "key", F.col("last.digest").alias("digest"))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill in the key that opens each row's chunk; null before a partition's first opening."""
    part = TaskContext.get().partitionId()
    before, open_key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        delivery, keys = batch.column("delivery"), batch.column("key")
        marks = pc.if_else(batch.column("opens"), keys, pa.scalar(None, keys.type))
        fresh = pc.not_equal(delivery[1:], delivery[:-1])
        # a delivery that begins inside the partition opens a chunk: ''
        first = pa.array([before is not None and delivery[0].as_py() != before])
        starts = pa.concat_arrays([first, fresh.combine_chunks() if isinstance(fresh, pa.ChunkedArray) else fresh])
        marks = pc.if_else(pc.and_(starts, pc.is_null(marks)), pa.scalar("", keys.type), marks)
        filled = pc.fill_null_forward(marks)
        if open_key is not None:
            filled = pc.fill_null(filled, open_key)
        before, open_key = delivery[-1].as_py(), filled[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [delivery, keys, batch.column("digest"), filled, pa.array([part] * batch.num_rows, pa.int32())], names=["delivery", "key", "digest", "chunk", "part"]
        )


def with_chunks(listed: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """delivery, key, digest and ``chunk``: the key that opens the row's content-defined chunk ('' at the start of a delivery)."""
    n = shuffle_partitions(listed.sparkSession)
    opens = F.pmod(F.xxhash64("key"), F.lit(chunk_keys)) == 0
    placed = listed.withColumn("opens", opens).repartitionByRange(n, "delivery", "key").sortWithinPartitions("delivery", "key")
    schema = "delivery string, key string, digest struct<a:bigint,b:bigint>, chunk string, part int"
    cut = materialize(placed.mapInArrow(_chunked, schema))
    # what lies before a partition's first opening belongs to the last chunk opened before it: one row per partition
    opened = F.max(F.when(F.col("chunk").isNotNull(), F.struct("delivery", "chunk")))
    heads, carried = [""] * n, None
    for r in cut.groupBy("part").agg(opened.alias("opened"), F.min("delivery").alias("first")).orderBy("part").collect():
        heads[r.part] = carried.chunk if carried and carried.delivery == r.first else ""
        carried = r.opened or carried
    return cut.select("delivery", "key", "digest", F.coalesce("chunk", F.element_at(F.lit(heads), F.col("part") + 1)).alias("chunk"))


def chunk_digests(chunked: DataFrame) -> DataFrame:
    """delivery, chunk, n, a, b: digests that stand for themselves and may be kept for the next delivery."""
    mixed = lambda c: F.bit_xor(F.xxhash64("key", f"digest.{c}")).alias(c)
    return chunked.groupBy("delivery", "chunk").agg(F.count(F.lit(1)).alias("n"), mixed("a"), mixed("b"))


def snapshot_changes(
    rows: DataFrame, delivery: Column, key: str, order: list[str], fields: list[str], chunk_keys: int = CHUNK_KEYS, values: bool = False
) -> DataFrame:
    """Keys ``added``, ``removed`` or ``changed`` against the preceding snapshot.

    ``delivery`` names the snapshot of a row and sorts by time; ``order``
    decides which of several rows of a key in one delivery holds; ``fields``
    are compared null-safely, by 128 bits of hash.  Result: delivery (the later
    of the two), key (as text), change, and with ``values`` also before and after
    (structs of ``fields``, null where absent).  The first delivery gives no
    rows; an empty table gives none; other columns of ``rows`` are ignored; null
    keys are left out; repeated rows count once.
    """
    chunked = with_chunks(listed_keys(rows, delivery.cast("string"), key, order, fields), chunk_keys)
    digests = materialize(chunk_digests(chunked))
    deliveries = [r.delivery for r in digests.select("delivery").distinct().orderBy("delivery").collect()]  # one row per delivery
    count, deliveries = len(deliveries), deliveries or [""]
    number = lambda c: F.array_position(F.lit(deliveries), c).cast("int")
    name = lambda c: F.get(F.lit(deliveries), c - 1)
    # each chunk is the later one of its own step and the earlier one of the next
    roles = F.explode(F.array(F.struct(F.col("step").alias("at"), F.lit(AFTER).alias("role")), F.struct((F.col("step") + 1).alias("at"), F.lit(BEFORE).alias("role"))))
    both = digests.withColumn("step", number(F.col("delivery"))).select("chunk", F.struct("n", "a", "b").alias("d"), roles.alias("r"))
    one = lambda role: F.max(F.when(F.col("r.role") == role, F.col("d")))
    met = both.groupBy("r.at", "chunk").agg(one(AFTER).alias("after"), one(BEFORE).alias("before"))
    unmatched = met.where("not (after <=> before)").select("at", "chunk", "after", "before")
    asked = unmatched.select(
        "chunk",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("after").isNotNull(), F.struct(F.col("at").alias("step"), F.lit(AFTER).alias("role"))),
                    F.when(F.col("before").isNotNull(), F.struct((F.col("at") - 1).alias("step"), F.lit(BEFORE).alias("role"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("r"),
    ).groupBy("chunk", "r.step").agg(F.sum("r.role").alias("roles"))
    asked = asked.withColumn("delivery", name(F.col("step")))
    near = chunked.join(asked, ["delivery", "chunk"])
    wanted = F.filter(
        F.array(
            F.when(F.col("roles").bitwiseAND(F.lit(AFTER)) > 0, F.struct(F.col("step").alias("at"), F.lit(AFTER).alias("role"))),
            F.when(F.col("roles").bitwiseAND(F.lit(BEFORE)) > 0, F.struct((F.col("step") + 1).alias("at"), F.lit(BEFORE).alias("role"))),
        ),
        lambda x: x.isNotNull(),
    )
    near = near.select("key", "digest", F.explode(wanted).alias("r"))
    own = lambda role: F.max(F.when(F.col("r.role") == role, F.col("digest")))
    pairs = near.groupBy("r.at", "key").agg(own(AFTER).alias("after"), own(BEFORE).alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    pairs = pairs.where("not (after <=> before)").select("at", "key", change.alias("change"))
    # the first delivery, and what would follow the last one, are no comparisons
    found = pairs.where((F.col("at") > 1) & (F.col("at") <= count)).withColumn("delivery", name(F.col("at")))
    if values:
        return _with_values(found, number, name, rows, delivery.cast("string"), key, order, fields)
    return found.select("delivery", "key", "change")


def _with_values(found: DataFrame, number, name, rows: DataFrame, delivery: Column, key: str, order: list[str], fields: list[str]) -> DataFrame:
    found = materialize(found)
    earlier = found.select("key", name(F.col("at") - 1).alias("delivery"))
    asked = found.select("delivery", "key").unionByName(earlier).distinct()
    slim = rows.select(
        delivery.alias("delivery"), F.col(key).cast("string").alias("key"), F.struct(F.struct(*order), row_digest(fields).alias("digest")).alias("last"),
        F.struct(*fields).alias("row"),
    ).join(asked, ["delivery", "key"], "left_semi")
    held = slim.groupBy("delivery", "key").agg(F.max_by("row", "last").alias("row")).withColumn("step", number(F.col("delivery")))
    held = materialize(held)
    after = held.select("key", F.col("step").alias("at"), F.col("row").alias("after"))
    before = held.select("key", (F.col("step") + 1).alias("at"), F.col("row").alias("before"))
    return found.join(before, ["key", "at"], "left").join(after, ["key", "at"], "left").select("delivery", "key", "change", "before", "after")
