"""Predictions for given matches from a saved bundle, and their parity with saved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.ml.models import Calibrator, Fitted, prediction_rows
from rallyframe.operators.relational import differences_by_position, in_listed_order

# What a prediction row carries besides the prediction, and what a replay must repeat.
CARRIED = ("canonical_match_id", "as_of_date", "surface", "tourney_level", "round_name", "best_of", "player_a_rank", "player_b_rank", "rank_diff", "y")
COMPARED = ("canonical_match_id", "y", "raw_probability", "calibrated_probability", "favoured_side")


def predicted(fitted: Fitted, calibrator: Calibrator, rows: DataFrame, listed: DataFrame, name: str = "model") -> DataFrame:
    """Prediction rows of the listed matches (``canonical_match_id``, ``pos``), with their position; an unknown id raises.

    16 columns: model_name, model_family, those of ``CARRIED``, raw and
    calibrated probability, favoured side and its probability; and ``pos``.
    Preparation replaces columns it imputes, so what is carried is taken from
    ``rows`` themselves.
    """
    asked = in_listed_order(listed.select("canonical_match_id", "pos"), rows, "canonical_match_id", strict=True)
    kept = [c for c in CARRIED if c != "canonical_match_id"]
    held = asked.withColumns({f"_kept_{c}": F.col(c) for c in kept})
    out = prediction_rows(calibrator(fitted.score(held)), ["pos", "canonical_match_id", *[F.col(f"_kept_{c}").alias(c) for c in kept]])
    return out.select(F.lit(name).alias("model_name"), F.lit(fitted.family).alias("model_family"), *out.columns)


def replay(fitted: Fitted, calibrator: Calibrator, rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Positions at which the replayed predictions differ from ``saved`` ones (with ``pos``), exactly; none if they agree."""
    again = predicted(fitted, calibrator, rows, saved)
    return differences_by_position(saved.select("pos", *COMPARED), again.select("pos", *COMPARED), "pos")
