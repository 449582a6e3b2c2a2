"""Whole runs: delivered CSV files to canonical tables, canonical tables to features."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import ids
from rallyframe.operators import history as H
from rallyframe.operators import metrics as M
from rallyframe.operators.record_quarantine import FAMILIES, typed_failure
from rallyframe.operators.relational import holds
from rallyframe.sources import csv_snapshot as C
from rallyframe.sources.artifacts import replace_table
from rallyframe.util import global_rank, materialize

# Columns each family must have.
REQUIRED = {
    "atp_players": ["player_id", "name_first", "name_last"],
    "atp_rankings": ["ranking_date", "rank", "player", "points"],
    "atp_matches": ["tourney_id", "surface", "tourney_name", "tourney_date", "tourney_level", "winner_id", "loser_id", "score", "best_of", "round"],
    "atp_matchstats": ["match_id", "1stWon1", "1stWon2", "ace1", "ace2", "svpt1", "svpt2"],
}
FEATURES = [
    "elo", "surface_elo", "form_5_win_rate", "form_10_win_rate", "form_20_win_rate", "rest_days", "rank", "points", "rank_change", "h2h_win_rate",
    "service_rate", "return_allowed_rate", "ace_rate",
]
PASSED_ON = ["surface", "tourney_level", "round_name", "best_of", "lineage_source_repo", "lineage_source_commit_sha", "lineage_source_file_path", "lineage_source_row_number", "lineage_source_snapshot_root"]


def _lineage(repo: str, commit: str, root: str) -> list[Column]:
    return [
        F.lit(repo).alias("lineage_source_repo"), F.lit(commit).alias("lineage_source_commit_sha"), F.col("source_file").alias("lineage_source_file_path"),
        F.col("row_number").cast("int").alias("lineage_source_row_number"), F.lit(root).alias("lineage_source_snapshot_root"),
    ]


def canonical_tables(
    spark: SparkSession, root: str, repo: str, commit: str, row_number_mode: str = "accepted", pinned: DataFrame | None = None, strict: bool = False
) -> dict[str, DataFrame]:
    """Canonical tables of a snapshot folder, ``quarantined_rows`` and ``failed_rows``.

    Every row is validated under its family's whole-number and date columns and
    its file's header; rows that fail are set aside in ``failed_rows``
    (source_file, source_order, column, reason), or raise if ``strict``.
    ``pinned``: a manifest that the delivered files must agree with.  Row numbers
    count the loaded and accepted rows of a file from 2 on; with
    ``row_number_mode='physical'`` they count all its rows.  A family that
    delivered no file gives no table.
    """
    C.checked_commit(commit)
    lineage = _lineage(repo, commit, root)
    text = lambda c: F.trim(F.col(c))
    whole = lambda c: F.trim(F.col(c)).try_cast("int")
    out: dict[str, DataFrame] = {}
    found = C.manifest(spark, root)
    if pinned is not None:
        C.check_manifest(pinned, found)
    files = [r.path for r in found.where(C.file_scope(F.col("path")).isNull()).select("path").collect()]  # file names only
    failures: list[DataFrame] = []

    def family(prefix: str) -> DataFrame | None:
        own = [f for f in files if f.rsplit("/", 1)[-1].lower().startswith(prefix + ("." if prefix == "atp_players" else "_")) or f.endswith(f"{prefix}.csv")]
        if not own:
            return None
        rows = C.read_csv(spark, own, REQUIRED[prefix])
        known = next(f for f in FAMILIES if f.prefix.rstrip("_") == prefix)
        typed = typed_failure(known, [c for c in (*known.integers, *known.optional_integers, *known.dates) if c in rows.columns])
        count = F.when(F.col("field_failure").isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col("field_failure").alias("reason")))
        rows = rows.withColumn("failure", F.coalesce(count, typed))
        if row_number_mode == "physical":
            rows = C.with_row_numbers(rows)
        failed = rows.where("failure is not null").select("source_file", "source_order", "failure.column", "failure.reason")
        if strict and (bad := failed.limit(1).collect()):
            raise ValueError(f"{bad[0].source_file}: {bad[0].reason} {bad[0].column or ''}".strip())
        failures.append(failed)
        loaded = rows.where("failure is null").drop("failure", "field_failure")
        return loaded if row_number_mode == "physical" or prefix == "atp_matches" else C.with_row_numbers(loaded)

    if (rows := family("atp_players")) is not None:
        players = rows.select(
            ids.player_id(whole("player_id")).alias("canonical_player_id"), whole("player_id").alias("source_player_id"), text("name_first").alias("first_name"),
            text("name_last").alias("last_name"), F.trim(F.concat_ws(" ", text("name_first"), text("name_last"))).alias("full_name"), *lineage,
        )
        out["canonical_players"] = holds(players, ["canonical_player_id"], [F.col("lineage_source_file_path"), F.col("lineage_source_row_number")], last=False)
    if (rows := family("atp_rankings")) is not None:
        player = ids.player_id(whole("player"))
        out["canonical_rankings"] = rows.select(
            ids.ranking_id(player, F.col("ranking_date")).alias("canonical_ranking_id"), player.alias("canonical_player_id"), text("ranking_date").alias("ranking_date"),
            whole("rank").alias("rank"), whole("points").alias("points"), *lineage,
        )
    if (rows := family("atp_matches")) is not None:
        comment = F.col("comment") if "comment" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("reason", C.row_quarantine(comment, F.col("score"), F.col("round")))
        out["quarantined_rows"] = rows.where("reason is not null").select("source_file", "source_order", "reason")
        kept = rows.where("reason is null")
        kept = kept if row_number_mode == "physical" else C.with_row_numbers(kept)
        edition = ids.tournament_id(F.col("tourney_id"), F.col("tourney_name"), F.col("tourney_date"))
        winner, loser = ids.player_id(whole("winner_id")), ids.player_id(whole("loser_id"))
        match = ids.match_id(F.col("source_file"), F.col("row_number"), F.col("tourney_id"), winner, loser, F.col("round"))
        shared = [text("tourney_id").alias("source_tourney_id"), text("tourney_name").alias("tourney_name"), text("surface").alias("surface"), text("tourney_level").alias("tourney_level"), text("tourney_date").alias("tourney_date")]
        tournaments = kept.select(edition.alias("canonical_tournament_id"), *shared, *lineage)
        out["canonical_tournaments"] = holds(tournaments, ["canonical_tournament_id"], [F.col("lineage_source_file_path"), F.col("lineage_source_row_number")], last=False)
        out["canonical_matches"] = kept.select(
            match.alias("canonical_match_id"), edition.alias("canonical_tournament_id"), winner.alias("winner_canonical_player_id"), loser.alias("loser_canonical_player_id"),
            *shared, text("round").alias("round_name"), whole("best_of").alias("best_of"), text("score").alias("score"), *lineage,
        )
    if (rows := family("atp_matchstats")) is not None:
        out["canonical_match_stats"] = rows.select(
            F.concat(F.lit("match-stat:sackmann:"), whole("match_id").cast("string")).alias("canonical_match_stat_id"), whole("match_id").alias("source_match_id"),
            whole("1stWon1").alias("first_won_player1"), whole("1stWon2").alias("first_won_player2"), whole("ace1").alias("ace_player1"), whole("ace2").alias("ace_player2"),
            whole("svpt1").alias("serve_points_player1"), whole("svpt2").alias("serve_points_player2"), *lineage,
        )
    if failures:
        out["failed_rows"] = functools.reduce(DataFrame.unionByName, failures)
    return out


def feature_tables(matches: DataFrame, rankings: DataFrame, stats: DataFrame | None = None) -> dict[str, DataFrame]:
    """``snapshots`` (match x player), ``differentials`` (match) and ``audit`` of one feature build.

    A differential has the differences of ``FEATURES``, the match's date, its
    columns of ``PASSED_ON`` as far as ``matches`` has them, and the pair's
    earlier meetings.  Without ``stats`` the rates of serve, return and aces
    are missing for everyone.
    """
    passed = [c for c in PASSED_ON if c in matches.columns]
    once = H.one_row_per_match(matches, tuple(c for c in passed if c not in H.MATCH_COLUMNS))
    once = materialize(once)
    rows = materialize(H.player_rows(once))
    key = ["canonical_match_id", "player", "won"]
    # each history is taken from the written rows and joined by key: chained, every step would repeat all before it
    parts = [
        H.elo_before(rows, once), H.elo_before(rows, once, "surface", "surface_elo"), H.recent_form(rows), H.last_date_before(rows),
        H.pair_rate(H.head_to_head(rows)), H.ranking_as_of(rows, rankings),
    ]
    with_stats = None if stats is None else materialize(H.with_match_stats(rows, stats))
    if with_stats is not None:
        parts.append(H.stats_before(with_stats))
    sides = rows
    for part in parts:
        sides = sides.join(part.drop(*[c for c in sides.columns if c not in key]), key)
    if stats is None:
        unknown = {c: F.lit(None).cast("double") for c in ("service_rate", "return_allowed_rate", "ace_rate")}
        sides = sides.withColumns(unknown | {"stats_missing": F.lit(True), "stats_low_sample": F.lit(False)})
    sides = materialize(sides)
    met = sides.where("won = 1").select("canonical_match_id", F.col("h2h_count").cast("bigint").alias("h2h_match_count"))
    known = once.select("canonical_match_id", F.col("tourney_date").alias("as_of_date"), *passed)
    differentials = H.differential(sides, FEATURES).join(met, "canonical_match_id").join(known, "canonical_match_id")
    own = [c for c in sides.columns if c not in (*H.SEQ, "cohort", "surface", "year", "won", "opponent")]
    return {
        "snapshots": sides, "differentials": differentials, "audit": H.state_audit(rows, once, with_stats),
        "side_rows": H.side_rows(sides, ["canonical_match_id", "tourney_date", "surface"], own),
    }


SPLIT = ("20141231", "20181231")


def train_bundle(spark: SparkSession, folder: str, out: str, family: str = "logistic_regression", calibrator: str = "sigmoid") -> dict[str, float]:
    """Fit on the training split, calibrate on validation, and save the bundle with its validation metrics."""
    from rallyframe.ml.registry import write_bundle
    from rallyframe.plans.reference import _fitted, _modeling

    rows, numeric, categorical = _modeling(spark, folder)
    fitted, calibrate = _fitted(rows, numeric, categorical, family, calibrator)
    metrics = _metrics(calibrate(fitted.score(rows.where("split = 'validation'"))).select("y", "p"))
    write_bundle(out, fitted, calibrate, "v1", "-".join(SPLIT), metrics)
    return metrics


def evaluate_bundle(spark: SparkSession, folder: str, bundle: str) -> tuple[DataFrame, dict[str, float]]:
    """Predictions of a saved bundle for the test split, in the order of their ids, and their metrics."""
    from rallyframe.ml.registry import load_bundle
    from rallyframe.ml.replay import predicted
    from rallyframe.plans.reference import _modeling

    fitted, calibrate, _ = load_bundle(bundle, "v1", "-".join(SPLIT))
    test = _modeling(spark, folder)[0].where("split = 'test'")
    listed = global_rank(test.select("canonical_match_id"), [F.asc("canonical_match_id")], "pos")
    rows = materialize(predicted(fitted, calibrate, test, listed, fitted.family))
    return rows, _metrics(rows.select("y", F.col("calibrated_probability").alias("p")))


def replay_bundle(spark: SparkSession, folder: str, bundle: str, saved: DataFrame) -> DataFrame:
    """Positions at which a bundle, run again, differs from saved predictions."""
    from rallyframe.ml.registry import load_bundle
    from rallyframe.ml.replay import replay
    from rallyframe.plans.reference import _modeling

    fitted, calibrate, _ = load_bundle(bundle, "v1", "-".join(SPLIT))
    return replay(fitted, calibrate, _modeling(spark, folder)[0].where("split = 'test'"), saved)


def _metrics(rows: DataFrame) -> dict[str, float]:
    return M.point_metrics(rows).first().asDict() | M.calibration_error(rows).first().asDict() | M.roc_auc(rows).first().asDict()


def persist(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None, empty: bool = True) -> None:
    """Replace the tables of a folder; with ``empty=False`` an empty one is an error and nothing is written."""
    if not empty and (none := sorted(n for n, rows in tables.items() if rows.isEmpty())):
        raise ValueError(f"empty: {', '.join(none)}")
    for name, rows in tables.items():
        replace_table(rows, f"{folder}/{name}.parquet", (partition_by or {}).get(name))
