"""Streaming forms: latest row per key, deduplicated arrivals, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def latest_per_key(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Running latest row per key (complete or update output): a max_by per micro-batch, merged in state."""
    pick = F.max_by(F.struct(*keep), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("row")).select(key, *[F.col(f"row.{c}") for c in keep])


def once_within(rows: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Arrivals without repeats; repeats later than ``lateness`` after the first may pass."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def counts_by_window(rows: DataFrame, time: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Event-time tumbling counts; rows later than ``lateness`` are dropped by the watermark."""
    return rows.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
