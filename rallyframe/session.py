"""Session factory and settings."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    data_dir: Path = Path("data")
    reports_dir: Path = Path("reports")
    feature_version: str = "v1"

    def inside(self, path: str) -> Path:
        """``path`` below the data folder; ValueError if it leads out of it."""
        full = (self.data_dir / path).resolve()
        if not full.is_relative_to(self.data_dir.resolve()):
            raise ValueError(f"{path} leads out of {self.data_dir}")
        return full


def get_session(name: str = "rallyframe", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
