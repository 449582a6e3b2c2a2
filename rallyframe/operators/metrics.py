"""Metrics of probability forecasts, and running results."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.util import materialize

BINS = 10
EPS = 2.220446049250313e-16


def calibration_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """All uniform bins of ``p`` with count, mean ``p`` and observed rate of ``y`` (nulls when empty).

    A bin holds its lower edge; the last one also its upper edge.  Edges are
    compared as doubles i/bins, so p = 0.3 falls where the edge 3/10 says.
    """
    place = F.lit(0)
    for i in range(1, bins):
        place = place + (F.col("p") >= F.lit(i / bins)).cast("int")
    seen = rows.withColumn("bin", place.cast("bigint")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed")
    )
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(seen, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed",
    )


def calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error: share-weighted gap of the bins; 0 without rows."""
    b = calibration_bins(rows, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed")))
    return b.agg(F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(0.0)).alias("ece"))


def point_metrics(rows: DataFrame) -> DataFrame:
    """n, accuracy at 0.5, log loss (clipped) and Brier score in one pass; a row with null ``p`` counts in n alone."""
    p = F.when(F.col("p").isNotNull(), F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS)))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(loss).alias("log_loss"),
        F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"),
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by counts per distinct score; null if only one class occurs.

    Scores are first reduced to one row per distinct value; those are placed by
    ranges of the score, with the counts below each range carried in.
    """
    counts = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where("p is not null")
    counts = counts.withColumn("range", F.floor(F.col("p") * 1000))
    totals = counts.groupBy("range").agg(F.sum("neg").alias("_neg"))
    below = totals.select("range", F.coalesce(F.sum("_neg").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = W.partitionBy("range").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.join(below, "range").withColumn("_under", F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("_below"))
    area = F.sum(F.col("pos") * (F.col("_under") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def segments(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Diagnostics per value of several segmentations in one pass (an explode, not one scan each)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("value")) for k, v in by.items()]))
    right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    base = rows.withColumn("right", right).withColumn("favoured", F.greatest(F.col("p"), 1 - F.col("p")))
    return base.select("y", "p", "right", "favoured", pairs.alias("s")).groupBy("s.segment", "s.value").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("win_rate"), F.avg("right").alias("accuracy"),
        F.avg("p").alias("mean_p"), F.avg("favoured").alias("mean_favoured"),
    )


def equity_curve(records: DataFrame) -> DataFrame:
    """Running profit, stake, return, peak and drawdown, ordered by (date, id).

    ``records``: date, id, stake, profit.  Sums of earlier dates are carried as
    one row per date; the window of a task holds one date.
    """
    daily = records.groupBy("date").agg(F.sum("profit").alias("_profit"), F.sum("stake").alias("_stake"))
    before = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)  # one row per date
    carried = daily.select("date", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("_profit", "_stake")])
    inside = W.partitionBy("date").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = records.join(carried, "date")
    run = run.withColumn("cumulative", F.col("_profit") + F.sum("profit").over(inside)).withColumn("staked", F.col("_stake") + F.sum("stake").over(inside))
    tops = run.groupBy("date").agg(F.max("cumulative").alias("_top"))
    peaks = tops.select("date", F.coalesce(F.max("_top").over(before), F.lit(0.0)).alias("_peak"))
    run = run.join(peaks, "date").withColumn("peak", F.greatest(F.lit(0.0), "_peak", F.max("cumulative").over(inside)))
    run = run.withColumn("roi", F.coalesce(F.try_divide("cumulative", "staked"), F.lit(0.0)))
    further = [c for c in records.columns if c not in ("date", "id", "profit", "stake")]
    return run.select("date", "id", "profit", *further, "cumulative", "staked", "roi", "peak", (F.col("peak") - F.col("cumulative")).alias("drawdown"))


def equity_summary(records: DataFrame) -> DataFrame:
    curve = equity_curve(records)
    return curve.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profit") > 0).alias("wins"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("net"),
        F.coalesce(F.max("staked"), F.lit(0.0)).alias("staked"), F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"),
    )


def full_summary(records: DataFrame) -> DataFrame:
    """Summary of results with an ``edge`` column; all rates are 0 without rows or stakes."""
    zero = F.lit(0.0)
    out = equity_curve(records).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profit") > 0).alias("wins"), F.coalesce(F.avg(F.coalesce("edge", zero)), zero).alias("average_edge"),
        F.coalesce(F.sum(F.greatest("profit", zero)), zero).alias("gross"), F.coalesce(F.sum("profit"), zero).alias("net"),
        F.coalesce(F.max("staked"), zero).alias("staked"), F.coalesce(F.max("drawdown"), zero).alias("max_drawdown"),
    )
    rates = {"win_rate": F.coalesce(F.try_divide("wins", "n"), zero), "roi": F.coalesce(F.try_divide("net", "staked"), zero)}
    return out.withColumns(rates)


def bootstrap_mean(rows: DataFrame, column: str, resamples: int = 512, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Bootstrap interval of a mean by Poisson weights: one pass, any number of rows, no collect.

    Each row draws a Poisson(1) weight for each resample; a batch keeps only the
    sums of its resamples.  Draws are seeded by a row's partition and place, so
    equal rows draw on their own; the rows are written first, which fixes both.
    Null values are left out.
    """
    placed = materialize(rows.select(F.col(column).cast("double").alias("x")).where("x is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, weights = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            x = batch.column(0).to_numpy()
            for k in range(0, len(x), 4096):
                w = rng.poisson(1.0, (len(x[k : k + 4096]), resamples))
                sums += x[k : k + 4096] @ w
                weights += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(weights)], names=["r", "s", "w"])

    sums = placed.mapInArrow(run, "r bigint, s double, w double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = sums.select(F.try_divide("s", "w").alias("mean"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"), F.count(F.lit(1)).alias("resamples"))


def bootstrap_exact(values: list[float], resamples: int = 512, seed: int = 42, confidence: float = 0.95) -> tuple[float, float]:
    """Interval of the mean by resampling a short, already summarised list on the driver."""
    rng = random.Random(seed)
    n = len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    series = pd.Series(means)
    tail = (1 - confidence) / 2
    return float(series.quantile(tail)), float(series.quantile(1 - tail))
