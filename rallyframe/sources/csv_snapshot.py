"""Delivered CSV snapshots: manifest, scope, all-string scan, row numbers and quarantine."""

from __future__ import annotations

import csv
import re
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Words and names that decide whether a file is in scope, and row exclusions.
OUT_OF_SCOPE = "qual|chall|futures|doubles|itf|wta"
IN_SCOPE = r"^(atp_players|atp_rankings(_(\d{4}|\d{2}s|current))?|atp_matches_\d{4}|atp_matchstats_\d{4})\.csv$"
EXCLUDED_COMMENTS = ("retired", "walkover", "incomplete")
EXCLUDED_ROUNDS = ("Q1", "Q2", "Q3", "QR")
COMMIT = re.compile(r"[0-9a-f]{7,40}")


def file_scope(path: Column) -> Column:
    """Reason why a file is out of scope; null if it is in scope."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.rlike(OUT_OF_SCOPE), "out_of_scope_file_family").when(~name.rlike(IN_SCOPE), "unknown_file_family")


def row_quarantine(comment: Column, score: Column, round_name: Column) -> Column:
    """Reason why a match row is set aside; null if it is kept.  The first that applies holds."""
    said, result = F.lower(F.trim(comment)), F.lower(F.trim(score))
    return (
        F.when(said.isin(*EXCLUDED_COMMENTS), F.concat(F.lit("excluded_"), said))
        .when(result.contains("w/o") | result.contains("walkover"), "excluded_walkover")
        .when(F.upper(F.trim(round_name)).isin(*EXCLUDED_ROUNDS), "excluded_qualifier")
    )


def checked_commit(commit: str) -> str:
    if not COMMIT.fullmatch(commit):
        raise ValueError(f"not a commit id: {commit!r}")
    return commit


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes and sha256 of every CSV file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return files.select(F.col("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, new, or whose checksum differs from the pinned manifest."""
    both = pinned.select("path", F.col("sha256").alias("pinned")).join(found.select("path", F.col("sha256").alias("found")), "path", "full_outer")
    return both.where(~F.col("pinned").eqNullSafe(F.col("found")))


def check_manifest(pinned: DataFrame, found: DataFrame) -> None:
    """ValueError if a file is missing, new, or differs from its pinned checksum; files are told by name."""
    name = lambda rows: rows.select(F.substring_index("path", "/", -1).alias("path"), "sha256")
    if bad := [r.path for r in changed_files(name(pinned), name(found)).select("path").orderBy("path").limit(20).collect()]:
        raise ValueError(f"files differ from the pinned manifest: {', '.join(bad)}")


def copy_snapshot(source: str, target: str, commit: str) -> list[str]:
    """Copy CSV files into ``target/<commit>`` once; an existing folder is an error."""
    folder = Path(target) / checked_commit(commit)
    folder.mkdir(parents=True, exist_ok=False)
    copied = []
    for path in sorted(Path(source).rglob("*.csv")):
        to = folder / path.relative_to(source)
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(path, to)
        copied.append(str(to))
    return copied


def file_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a delivered file: its first line, read through the file system of the session."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff").rstrip("\r")]), []))


CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All-string scan by header name, with ``source_file``, ``source_order`` and ``field_failure``.

    Files of one call may differ in the order and the set of their columns: each
    layout is read under its own header, and the layouts are united by name
    (null where a file has no such column).  ``field_failure`` is ``field_count``
    for rows whose number of fields is not their header's, else null.  Quoted
    line breaks stay in their field; each file is one split because of that.
    """
    paths = [path] if isinstance(path, str) else list(path)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for p in paths:  # one line of each file
        layouts.setdefault(file_header(spark, p), []).append(p)
    options = {
        "header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False, "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False,
    }
    out = None
    for names, files in layouts.items():
        if missing := sorted(set(columns) - set(names)):
            raise ValueError(f"missing required columns: {', '.join(missing)}")
        schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
        rows = spark.read.options(**options).schema(schema).csv(files)
        rows = rows.select(
            *[F.col(f"`{n}`") for n in names], F.when(F.col(CORRUPT).isNotNull(), "field_count").alias("field_failure"),
            F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("source_order"),
        )
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_row_numbers(rows: DataFrame) -> DataFrame:
    """Row number per file, from 2 on, over the rows given (pass accepted rows only, or all)."""
    return rows.withColumn("row_number", F.row_number().over(W.partitionBy("source_file").orderBy("source_order")) + 1)
