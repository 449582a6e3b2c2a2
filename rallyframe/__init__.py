"""rallyframe: a Spark-first engine for head-to-head results and binary markets."""

__version__ = "0.1.0"
