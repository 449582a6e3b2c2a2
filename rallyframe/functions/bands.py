"""Reporting bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of ranking bands, and confidence buckets.
RANK_BANDS = ((10, "1-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"))
CONFIDENCE = ((0.6, "[0.50,0.60)"), (0.7, "[0.60,0.70)"), (0.8, "[0.70,0.80)"), (0.9, "[0.80,0.90)"))


def ranking_band(*ranks: Column) -> Column:
    best = F.least(*ranks)
    out = F.when(best.isNull(), "unranked")
    for top, name in RANK_BANDS:
        out = out.when(best <= top, name)
    return out.otherwise("101+")


def confidence_bucket(probability: Column) -> Column:
    favoured = F.greatest(probability, 1 - probability)
    out = F.when(favoured.isNull(), None)
    for top, name in CONFIDENCE:
        out = out.when(favoured < top, name)
    return out.otherwise("[0.90,1.00]")
