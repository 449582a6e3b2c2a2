"""JSON artifacts and table sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.text import plain_name
from rallyframe.operators.relational import check_columns

# Fields of an alias record.
ALIAS_FIELDS = ("raw_market_name", "normalized_market_name", "canonical_player_id", "canonical_player_name", "source_note", "created_at_utc", "updated_at_utc")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias records of a JSON array: all fields required and non-empty, names unique; else ValueError."""
    schema = ", ".join(f"{c} string" for c in ALIAS_FIELDS)
    rows = spark.read.schema(schema).json(path, multiLine=True)
    blank = [F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in ALIAS_FIELDS]
    found = rows.agg(*blank).first().asDict()
    if bad := sorted(c for c, n in found.items() if n):
        raise ValueError(f"empty or missing alias fields: {bad}")
    odd = rows.where(plain_name(F.col("raw_market_name")) != F.col("normalized_market_name")).select("raw_market_name").limit(1).collect()
    if odd:
        raise ValueError(f"not the normal form of its name: {odd[0][0]!r}")
    for c in ("raw_market_name", "normalized_market_name"):
        if rows.groupBy(c).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated {c}")
    return rows


def read_manifest(path: str) -> dict:
    return json.loads(Path(path).read_text())


def replace_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table; an empty frame leaves an empty table with its schema."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_once(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a report table to a new folder; an existing one is an error."""
    rows.write.mode("errorifexists").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# Columns of mapping evidence.
EVIDENCE = (
    "market_ticker", "event_ticker", "collected_at_utc", "raw_title", "raw_yes_sub_title", "raw_no_sub_title", "normalized_yes_player_name", "normalized_no_player_name",
    "alias_hit_player_ids_json", "candidate_canonical_match_ids_json", "mapping_state", "mapping_confidence", "canonical_match_id", "yes_canonical_player_id",
    "no_canonical_player_id", "yes_maps_to_player_a", "no_maps_to_player_b", "rejection_reason_codes_json",
)


def write_evidence(rows: DataFrame, path: str) -> None:
    """Replace the table of mapping evidence; other columns than its own are an error."""
    replace_table(check_columns(rows, list(EVIDENCE)), path)


def write_report(folder: str, tables: dict[str, DataFrame], summary: dict) -> None:
    """A report in a new folder: each table as Parquet and CSV, and ``summary.json``; an existing folder is an error."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path):
        raise FileExistsError(folder)
    for name, rows in tables.items():
        for kind in ("parquet", "csv"):
            write_once(rows, f"{folder}/{name}.{kind}", kind)
    stream = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/summary.json"), False)
    stream.write(bytearray(json.dumps(summary, sort_keys=True, indent=1, default=str).encode()))
    stream.close()
