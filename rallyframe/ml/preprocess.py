"""Imputation, scaling and encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_groups(rows: DataFrame, left_out: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns of a table but for those left out, in table order.

    Text and flags are categorical, everything else numeric; a column without a
    type of its own (all null) is numeric.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.schema if f.name not in left_out}
    words = [c for c, kind in kinds.items() if kind in ("string", "boolean", "varchar", "char")]
    return [c for c in kinds if c not in words], words


def numeric_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median, mean, population deviation and nulls of each column, in one pass."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
        )
        for c in columns
    ]
    return rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def most_frequent(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value of each column; of equally frequent ones the least."""
    return rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.mode(c, True).cast("string").alias("mode")) for c in columns]).alias("s")).select(F.inline("s"))


@dataclass(frozen=True)
class Preparation:
    """Imputation (and scaling) by the statistics of a training table; plain values, so it can be saved as JSON."""

    numeric: dict[str, dict[str, float | None]]
    categorical: dict[str, str | None]
    scale: bool

    def __call__(self, rows: DataFrame) -> DataFrame:
        out = {}
        for c, s in self.numeric.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(s["median"] if s["median"] is not None else 0.0))
            out[c] = (x - F.lit(s["mean"] or 0.0)) / F.lit(s["sd"] or 1.0) if self.scale else x
        for c, mode in self.categorical.items():
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(mode or ""))
        return rows.withColumns(out)


def imputed(train: DataFrame, numeric: list[str], categorical: list[str], scale: bool = True) -> Preparation:
    """A preparation that imputes (and scales) any table by the statistics of ``train``."""
    stats = {r.feature: {k: r[k] for k in ("median", "mean", "sd")} for r in numeric_statistics(train, numeric).collect()} if numeric else {}
    modes = {r.feature: r["mode"] for r in most_frequent(train, categorical).collect()} if categorical else {}
    return Preparation({c: stats[c] for c in numeric}, {c: modes[c] for c in categorical}, scale)


def encoder(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Stages that index, one-hot encode (unknown values give zeros) and assemble ``features``."""
    stages = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", dropLast=True))
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_hot" for c in categorical]], outputCol="features"))
    return Pipeline(stages=stages)
