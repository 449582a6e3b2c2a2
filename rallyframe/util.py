"""Shared physical-plan helpers: shared-folder tables, salted joins, global ranks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it.

    ``spark.checkpoint.dir`` (or the checkpoint folder already set on the
    context) wins.  Only a local master may fall back to a temporary folder,
    because there driver and executors are one machine.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="rallyframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return (sc.getCheckpointDir() or own).rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def purge(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not a
    recomputation, and every later use sees the same rows and partitions.
    """
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`materialize` returned; other frames are left alone."""
    if written := getattr(df, "_written", None):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[Column],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Equi-join for a left side with hot keys and a right side with few rows a key.

    Left rows of one key are spread over ``salts`` tasks by a hash of the
    ``spread`` columns; the right side is repeated once per salt.  No row is
    dropped.  ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    Where the right side turns out small, adaptive execution may still
    broadcast it: that decision rests on its measured size.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    spread_left = left.withColumn("_salt", salt)
    spread_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread_left.join(spread_right, [*on, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a gapless 1-based rank over the whole frame without a one-task window.

    Rows are range-partitioned by ``order`` and written once; each partition's
    count gives its offset.  The offset table has one row per partition.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_mid", F.monotonically_increasing_id()))
    low = (1 << 33) - 1
    parts = placed.withColumn("_part", F.shiftright("_mid", 33))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = parts.join(F.broadcast(offsets), "_part")  # one row per partition
    rank = F.col("_before") + F.col("_mid").bitwiseAND(F.lit(low)) + 1
    return ranked.select(*df.columns, rank.cast("bigint").alias(name))


def null_safe_hash(columns: list[str], seed: str | None = None) -> Column:
    """64-bit row hash in which a null and a value, or a shifted null, differ; ``seed`` gives another one."""
    parts: list[Column] = [F.lit(seed)] if seed else []
    for c in columns:
        parts += [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return F.xxhash64(*parts)


def widened(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as a shuffle would have.

    For scans whose work per byte is far above the cost of moving the byte: a
    few large files would else keep most of the cluster idle.
    """
    n = shuffle_partitions(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever it was imported from.

    On one machine its folder joins the workers' path; on a cluster the package
    is sent to the executors once per application.
    """
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if str(root) in paths.split(os.pathsep):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), paths]))
    if not sc.master.startswith("local"):
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='rallyframe-code-')}/rallyframe", "zip", root, "rallyframe")
        sc.addPyFile(archive)  # served by the driver to every executor
