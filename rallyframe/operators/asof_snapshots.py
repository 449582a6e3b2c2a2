"""Attributes of an entity as known at an event's time.

Method: the change log is folded into periodic as-known snapshots, one row for
each entity and period from its first change on, and both are written.  An
event joins the snapshot at the start of its own period and replays only the
changes between that and the event.  A task therefore holds one (entity,
period), bounded by the days of a period, however many events or changes an
entity has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.util import materialize

YEAR = "try_cast(substring(at, 1, 4) as bigint)"


@dataclass(frozen=True)
class History:
    """Written change log (entity, at, version, period) and snapshots (entity, period, known)."""

    log: DataFrame
    snapshots: DataFrame
    last: int | None
    period: str


def as_known_snapshots(log: DataFrame, last: int) -> DataFrame:
    """State at the start of each period, from the one after an entity's first change to the one after ``last``.

    ``log``: entity, at, version, period.  Result: entity, period, known (struct
    at, version).  Changes are first reduced to the last of each period; a
    window holds one row per period of an entity.
    """
    closing = log.groupBy("entity", "period").agg(F.max(F.struct("at", "version")).alias("known"))
    until = F.coalesce(F.lead("period").over(W.partitionBy("entity").orderBy("period")), F.lit(last + 1))
    return closing.withColumn("until", until).select(
        "entity", F.explode(F.sequence(F.col("period") + 1, F.col("until"))).alias("period"), "known"
    )


def history(changes: DataFrame, entity: str, at: str, version: str, period: str = YEAR) -> History:
    """Fold ``changes`` into a written log and written snapshots; one build serves any number of event tables.

    ``at``: ``yyyyMMdd`` strings; ``period`` maps them to whole numbers without
    gaps (here the year), null for what is no date.  Changes with a null entity,
    version or period are ignored, repeated ones count once, and of several
    versions of one date the greatest id holds.
    """
    log = changes.select(F.col(entity).alias("entity"), F.col(at).alias("at"), F.col(version).alias("version"))
    log = log.where("entity is not null and version is not null").groupBy("entity", "at").agg(F.max("version").alias("version"))
    log = materialize(log.withColumn("period", F.expr(period)).where("period is not null"))
    last = log.agg(F.max("period")).first()[0]
    return History(log, materialize(as_known_snapshots(log, last or 0)), last, period)


def attributes_at(events: DataFrame, entity: str, at: str, known: History) -> DataFrame:
    """Join each event to the version of its entity that held at the event.

    A change of the event's own date counts (``<=``).  Events get columns
    ``version`` and ``version_at``; an event with a null entity, or whose ``at``
    is no date, or before the first change, gets nulls.  Either side may be
    empty; columns of ``events`` named like a result column are replaced.
    """
    asked = events.select(F.col(entity).alias("entity"), F.col(at).alias("at")).where("entity is not null").distinct()
    # beyond the last snapshot nothing changes any more
    asked = asked.withColumn("period", F.expr(known.period)).where("period is not null")
    asked = asked.withColumn("period", F.least("period", F.lit((known.last or 0) + 1)))
    state = F.struct("at", "version")
    # replay: the snapshot first, then the period's changes, each before the events of its date
    replay = (
        known.snapshots.select("entity", "period", F.lit("").alias("at"), F.col("known").alias("state"), F.lit(0).alias("tag"))
        .unionByName(known.log.select("entity", "period", "at", state.alias("state"), F.lit(1).alias("tag")))
        .unionByName(
            asked.select("entity", "period", "at", F.lit(None).cast(known.snapshots.schema["known"].dataType).alias("state"), F.lit(2).alias("tag"))
        )
    )
    until = W.partitionBy("entity", "period").orderBy("at", "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = replay.withColumn("held", F.last("state", ignorenulls=True).over(until)).where("tag = 2 and held is not null")
    held = held.select(
        F.col("entity").alias(entity), F.col("at").alias(at), F.col("held.version").alias("version"), F.col("held.at").alias("version_at")
    )
    kept = [c for c in events.columns if c not in ("version", "version_at")]
    # a key is an entity on one date: so selective that repeating this side for salts would cost more than
    # it saves; a date with very many events is split by adaptive execution
    return events.select(*kept).join(held, [entity, at], "left")
