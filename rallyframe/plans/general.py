"""Queries of the general data problems 1, 2, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators.asof_snapshots import attributes_at, history
from rallyframe.operators.orphans import Reference, orphans, orphans_by_period
from rallyframe.operators.record_quarantine import failed_records, load_records, loaded_records
from rallyframe.operators.snapshot_diff import snapshot_changes
from rallyframe.plans.sql_records import RECORDS_SQL
from rallyframe.sources.tables import table

SNAPSHOT_FIELDS = ["status", "title", "yes_sub_title", "no_sub_title", "close_time", "yes_bid_dollars", "yes_ask_dollars"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    failed = failed_records(table(spark, folder, "raw_csv_lines"), table(spark, folder, "file_quarantine_records"))
    return failed.select("line_id").where("line_id is not null").distinct()


def p1_failed_records(spark: SparkSession, folder: str) -> DataFrame:
    return failed_records(table(spark, folder, "raw_csv_lines"), table(spark, folder, "file_quarantine_records"))


def p1_failed_columns(spark: SparkSession, folder: str) -> DataFrame:
    return p1_failed_records(spark, folder).drop("offset")


def p1_loaded_records(spark: SparkSession, folder: str) -> DataFrame:
    loaded = loaded_records(table(spark, folder, "raw_csv_lines"), table(spark, folder, "file_quarantine_records"))
    return loaded.withColumn("values", F.to_json("values"))


def p1_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    records = load_records(table(spark, folder, "raw_csv_lines"), table(spark, folder, "file_quarantine_records"))
    return records.groupBy(F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("records"))


def _market_changes(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.date_format("collected_at_utc", "yyyyMMddHH")
    return snapshot_changes(
        table(spark, folder, "kalshi_market_snapshots"), hour, "ticker", ["collected_at_utc", "response_index"], SNAPSHOT_FIELDS
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _market_changes(spark, folder).select(
        F.col("key").alias("ticker"), F.col("delivery").alias("delivery_hour"), "change"
    )


def p2_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p2_found(spark, folder).groupBy("delivery_hour", "change").agg(F.count(F.lit(1)).alias("tickers"))


def _references(spark: SparkSession, folder: str) -> list[Reference]:
    matches, rankings = table(spark, folder, "canonical_matches"), table(spark, folder, "canonical_rankings")
    players, editions = table(spark, folder, "canonical_players"), table(spark, folder, "canonical_tournaments")
    year, ranked = F.substring("tourney_date", 1, 4), F.substring("ranking_date", 1, 4)
    of_match = ("canonical_matches", matches, "canonical_match_id")
    return [
        Reference(*of_match, "winner_canonical_player_id", year, players, "canonical_player_id"),
        Reference(*of_match, "loser_canonical_player_id", year, players, "canonical_player_id"),
        Reference(*of_match, "canonical_tournament_id", year, editions, "canonical_tournament_id"),
        Reference("canonical_rankings", rankings, "canonical_ranking_id", "canonical_player_id", ranked, players, "canonical_player_id"),
    ]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(_references(spark, folder), periods=False)


def p4_by_period(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_period(_references(spark, folder))


def _ranks_at_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "modeling_rows").select("canonical_match_id", "player_a_id", "player_b_id", "as_of_date")
    sides = rows.select(
        "canonical_match_id", "as_of_date", F.explode(F.array("player_a_id", "player_b_id")).alias("canonical_player_id")
    )
    rankings = table(spark, folder, "canonical_rankings").where("rank is not null")
    known = history(rankings, "canonical_player_id", "ranking_date", "canonical_ranking_id")
    return attributes_at(sides, "canonical_player_id", "as_of_date", known)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _ranks_at_match(spark, folder).where("version is not null and canonical_match_id is not null")
    return found.select("canonical_match_id", "canonical_player_id", F.col("version").alias("canonical_ranking_id")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_failed_records, p1_failed_columns, p1_loaded_records, p1_reason_counts,
        p2_found, p2_change_counts, p4_found, p4_by_period, p5_found,
    )
}

_LISTED = f"""
WITH one AS (
  SELECT strftime(collected_at_utc, '%Y%m%d%H') AS h, *,
         row_number() OVER (PARTITION BY strftime(collected_at_utc, '%Y%m%d%H'), ticker
                            ORDER BY collected_at_utc DESC, response_index DESC) AS nth
  FROM kalshi_market_snapshots WHERE ticker IS NOT NULL AND collected_at_utc IS NOT NULL),
listed AS (SELECT h, ticker, {", ".join(SNAPSHOT_FIELDS)} FROM one WHERE nth = 1),
steps AS (SELECT h, lag(h) OVER (ORDER BY h) AS b FROM (SELECT DISTINCT h FROM listed)),
new AS (SELECT l.* FROM listed l JOIN steps s ON l.h = s.h WHERE s.b IS NOT NULL),
old AS (SELECT s.h AS h, l.* EXCLUDE (h) FROM listed l JOIN steps s ON l.h = s.b),
found AS (
  SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.h, o.h) AS delivery_hour,
         CASE WHEN o.ticker IS NULL THEN 'added' WHEN n.ticker IS NULL THEN 'removed'
              WHEN {" OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in SNAPSHOT_FIELDS)} THEN 'changed' END AS change
  FROM new n FULL JOIN old o ON n.h = o.h AND n.ticker = o.ticker)
"""


def _orphan_sql(source: str, column: str, record: str, date: str, parent: str, key: str) -> str:
    return f"""SELECT DISTINCT '{source}' AS source_table, '{column}' AS ref_column, coalesce({date}[1:4], '') AS period,
      {record} AS record_id, {column} AS missing_id FROM {source} c
      WHERE {column} IS NOT NULL AND {record} IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"""


_ORPHANS = " UNION ALL ".join(
    [
        _orphan_sql("canonical_matches", "winner_canonical_player_id", "canonical_match_id", "tourney_date", "canonical_players", "canonical_player_id"),
        _orphan_sql("canonical_matches", "loser_canonical_player_id", "canonical_match_id", "tourney_date", "canonical_players", "canonical_player_id"),
        _orphan_sql("canonical_matches", "canonical_tournament_id", "canonical_match_id", "tourney_date", "canonical_tournaments", "canonical_tournament_id"),
        _orphan_sql("canonical_rankings", "canonical_player_id", "canonical_ranking_id", "ranking_date", "canonical_players", "canonical_player_id"),
    ]
)

ORACLES = {
    "p1_found": f"WITH {RECORDS_SQL} SELECT DISTINCT line_id FROM records WHERE reason IS NOT NULL AND line_id IS NOT NULL",
    "p1_failed_columns": f"WITH {RECORDS_SQL} SELECT line_id, relative_path, line_number, reason, col AS \"column\" FROM records WHERE reason IS NOT NULL",
    "p1_reason_counts": f"WITH {RECORDS_SQL} SELECT coalesce(reason, 'loaded') AS reason, count(*) AS records FROM records GROUP BY ALL",
    "p2_found": f"{_LISTED} SELECT ticker, delivery_hour, change FROM found WHERE change IS NOT NULL",
    "p2_change_counts": f"{_LISTED} SELECT delivery_hour, change, count(*) AS tickers FROM found WHERE change IS NOT NULL GROUP BY ALL",
    "p4_found": f"SELECT DISTINCT source_table, ref_column, record_id, missing_id FROM ({_ORPHANS})",
    "p4_by_period": f"""SELECT source_table, ref_column, period, count(*) AS orphan_records,
        count(DISTINCT missing_id) AS missing_ids FROM ({_ORPHANS}) GROUP BY ALL""",
    "p5_found": """
WITH sides AS (
  SELECT canonical_match_id, as_of_date, player_a_id AS canonical_player_id FROM modeling_rows
  UNION SELECT canonical_match_id, as_of_date, player_b_id FROM modeling_rows)
SELECT DISTINCT s.canonical_match_id, s.canonical_player_id,
       arg_max(r.canonical_ranking_id, r.ranking_date || r.canonical_ranking_id) AS canonical_ranking_id
FROM sides s JOIN canonical_rankings r
  ON r.canonical_player_id = s.canonical_player_id AND r.ranking_date <= s.as_of_date AND r.rank IS NOT NULL
WHERE s.canonical_match_id IS NOT NULL
GROUP BY s.canonical_match_id, s.canonical_player_id, s.as_of_date""",
}
