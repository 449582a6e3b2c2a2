"""Order-book ladders kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levels(text: Column) -> Column:
    """Array of (price, quantity) decimals of a ladder ``[["0.39","475.0"],...]``."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.transform(
        pairs,
        lambda x: F.struct(
            F.get(x, F.lit(0)).cast("decimal(18,4)").alias("price"), F.get(x, F.lit(1)).cast("decimal(18,4)").alias("quantity")
        ),
    )


def top_of_book(text: Column) -> Column:
    """First level of a ladder, as delivered; null for an empty or null one."""
    return F.get(levels(text), F.lit(0))
