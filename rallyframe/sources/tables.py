"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.operators.relational import check_columns


def table(spark: SparkSession, folder: str, name: str, expected: list[str] | None = None) -> DataFrame:
    """Table ``name`` of ``folder``: one Parquet file or a directory of them; with exactly the ``expected`` columns, if given."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows if expected is None else check_columns(rows, expected)


def table_if_there(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return table(spark, folder, name) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
