"""One global ranking from pairwise wins.

Method: offence-defence scaling.  The win matrix A (winner x loser, counts) is
smoothed by ``prior`` pseudo-wins of everyone spread evenly over everyone, so it
is positive however few comparisons an item has.  Sinkhorn iterations rescale
rows and columns in turn,

    offence(i) = sum_j A(i, j) / defence(j)
    defence(j) = sum_i A(i, j) / offence(i)

and strength = offence / defence.  The smoothing term is the same number for
every item, so it is added as a scalar and the matrix stays sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.util import discard, global_rank, materialize, shuffle_partitions

PRIOR = 1.0
TOLERANCE = 1e-6
MAX_ROUNDS = 200


def _round(by_loser: DataFrame, by_winner: DataFrame, old: DataFrame, share: float, total: float) -> DataFrame:
    """One Sinkhorn round: id, offence, defence, moved.  Its only exchanges are the flows summed per item and ``old``."""
    first = by_loser.join(old.select(F.col("id").alias("loser"), "defence"), "loser")
    first = first.groupBy("winner").agg(F.sum(F.col("wins") / F.col("defence")).alias("flow"))
    base = old.select("id", F.col("offence").alias("last"))
    offence = base.join(first.withColumnRenamed("winner", "id"), "id", "left")
    offence = offence.withColumn("offence", F.coalesce("flow", F.lit(0.0)) + F.lit(share * total)).select("id", "last", "offence")
    spread = offence.agg(F.sum(1 / F.col("offence"))).scalar()
    second = by_winner.join(offence.select(F.col("id").alias("winner"), "offence"), "winner")
    second = second.groupBy("loser").agg(F.sum(F.col("wins") / F.col("offence")).alias("back"))
    both = offence.join(second.withColumnRenamed("loser", "id"), "id", "left")
    defence = F.coalesce("back", F.lit(0.0)) + F.lit(share) * spread
    return both.select("id", "offence", defence.alias("defence"), F.abs(F.log(F.col("offence") / F.col("last"))).alias("moved"))


def rank_items(results: DataFrame, prior: float = PRIOR, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rank every item of ``results`` (columns winner, loser; a row per result).

    Result: item, place (1 is best, gapless, ties broken by the item's id),
    strength (geometric mean 1), wins, losses.  Rows with a null winner or
    loser are left out.  A result of an item against itself says nothing about
    strength but keeps the item in the ranking.  Rows are counted as given:
    drop repeated ones before.  Rounds stop when no offence moves by more than
    ``tolerance`` (relative); at ``max_rounds`` the operator raises.  Empty
    input gives an empty ranking.

    Results are first counted per pair, so an item in a third of all results
    has no more rows than it has opponents; the pairs are kept twice, placed by
    loser and by winner, under numbers in place of ids.
    """
    spark = results.sparkSession
    given = results.where("winner is not null and loser is not null")
    pairs = materialize(
        given.groupBy(F.col("winner").cast("string").alias("winner"), F.col("loser").cast("string").alias("loser"))
        .agg(F.count(F.lit(1)).cast("double").alias("wins"))
    )
    counts = (
        pairs.select(F.col("winner").alias("item"), F.col("wins").alias("won"), F.lit(0.0).alias("lost"))
        .unionAll(pairs.select(F.col("loser"), F.lit(0.0), "wins"))
        .groupBy("item").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    )
    counts = materialize(counts.withColumn("id", F.monotonically_increasing_id()))
    n = counts.count()
    schema = "item string, place bigint, strength double, wins bigint, losses bigint"
    if not n:
        return spark.createDataFrame([], schema)
    share, total = prior / n, float(n)
    number = lambda side: counts.select(F.col("item").alias(side), F.col("id").alias(f"{side}_id"))
    met = pairs.where("winner <> loser").join(number("winner"), "winner").join(number("loser"), "loser")
    met = materialize(met.select(F.col("winner_id").alias("winner"), F.col("loser_id").alias("loser"), "wins"))
    parts = shuffle_partitions(spark)
    by_loser, by_winner = (met.repartition(parts, c).sortWithinPartitions(c).persist() for c in ("loser", "winner"))
    vector = counts.select("id", F.lit(1.0).alias("offence"), F.lit(1.0).alias("defence"))
    for _ in range(max_rounds):
        before, vector = vector, materialize(_round(by_loser, by_winner, vector, share, total))  # else plans nest
        seen = vector.agg(F.sum(1 / F.col("defence")).alias("total"), F.max("moved").alias("moved")).first()
        discard(before)
        total, moved = float(seen.total), seen.moved
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds: offences still move by {moved:.3g}")
    by_loser.unpersist()
    by_winner.unpersist()
    strength = materialize(vector.join(counts, "id").withColumn("raw", F.col("offence") / F.col("defence")))
    scale = strength.agg(F.exp(F.avg(F.log("raw")))).first()[0]
    rows = strength.select(
        "item", (F.col("raw") / scale).alias("strength"), F.col("won").cast("bigint").alias("wins"), F.col("lost").cast("bigint").alias("losses")
    )
    return global_rank(rows, [F.desc("strength"), F.asc("item")], "place").select("item", "place", "strength", "wins", "losses")
