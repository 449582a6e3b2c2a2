"""Named queries of the smaller rows of the inventory, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.functions import ids, text
from rallyframe.ml.preprocess import feature_groups, most_frequent, numeric_statistics
from rallyframe.operators import metrics as M
from rallyframe.operators import relational as R
from rallyframe.operators.record_quarantine import load_records
from rallyframe.plans.reference import NO_FEATURES, _FORECASTS, _LATEST, _MATCHES, _forecasts, _latest, _matches, _results, _round, query
from rallyframe.plans.sql_records import RECORDS_SQL
from rallyframe.sources.csv_snapshot import row_quarantine
from rallyframe.sources.tables import table
from rallyframe.util import global_rank

# ---- records -----------------------------------------------------------------


def _records(spark, folder):
    return load_records(table(spark, folder, "raw_csv_lines"), table(spark, folder, "file_quarantine_records"))


def _field(name: str) -> str:
    return f"fields[list_position(header, '{name}')]"


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT {_field("comment")} AS comment, {_field("score")} AS score, {_field("round")} AS round FROM records WHERE reason IS NULL AND starts_with(base, 'atp_matches_')),
 q AS (SELECT CASE WHEN lower(trim(comment)) IN ('retired', 'walkover', 'incomplete') THEN 'excluded_' || lower(trim(comment)) WHEN contains(lower(trim(score)), 'w/o') OR contains(lower(trim(score)), 'walkover') THEN 'excluded_walkover'
   WHEN upper(trim(round)) IN ('Q1', 'Q2', 'Q3', 'QR') THEN 'excluded_qualifier' ELSE 'accepted' END AS reason FROM k) SELECT reason, count(*) AS n FROM q GROUP BY reason""")
def pf02_delivered_rows(spark, folder):
    rows = _records(spark, folder).where("reason is null and element_at(split(relative_path, '/'), -1) like 'atp\\\\_matches\\\\_%'")
    reason = row_quarantine(*[F.col("values")[c] for c in ("comment", "score", "round")])
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS_SQL} SELECT regexp_extract(base, '^[a-z]+_[a-z]+') AS family, coalesce(col, '') AS "column", coalesce(reason, 'loaded') AS reason, count(*) AS n FROM records GROUP BY ALL""")
def pf05_validation_report(spark, folder):
    """Failures of all families by column and reason, beside what loads."""
    family = F.regexp_extract(F.element_at(F.split("relative_path", "/"), -1), "^[a-z]+_[a-z]+", 0)
    return _records(spark, folder).groupBy(
        family.alias("family"), F.coalesce("column", F.lit("")).alias("column"), F.coalesce("reason", F.lit("loaded")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS_SQL} SELECT line_id, relative_path, 'accepted' AS state, NULL AS reason FROM records WHERE reason IS NULL
  UNION ALL SELECT line_id, relative_path, 'rejected', reason FROM records WHERE reason IS NOT NULL""")
def so02_accepted_and_rejected(spark, folder):
    """Accepted rows, which have no reason column, above rejected ones."""
    rows = _records(spark, folder)
    accepted = rows.where("reason is null").select("line_id", "relative_path", F.lit("accepted").alias("state"))
    rejected = rows.where("reason is not null").select("line_id", "relative_path", F.lit("rejected").alias("state"), "reason")
    return accepted.unionByName(rejected, allowMissingColumns=True)


# ---- joins and membership ----------------------------------------------------


@query(f"""WITH {_MATCHES}, e AS (SELECT DISTINCT market_ticker, least(yes_canonical_player_id, no_canonical_player_id) AS a,
    greatest(yes_canonical_player_id, no_canonical_player_id) AS b, strftime(collected_at_utc, '%Y%m%d') AS day FROM market_mapping_evidence
    WHERE yes_canonical_player_id IS NOT NULL AND no_canonical_player_id IS NOT NULL),
 f AS (SELECT e.market_ticker, e.day, list(m.canonical_match_id ORDER BY m.canonical_match_id) FILTER (m.canonical_match_id IS NOT NULL) AS ids FROM e LEFT JOIN m
   ON least(m.winner_canonical_player_id, m.loser_canonical_player_id) = e.a AND greatest(m.winner_canonical_player_id, m.loser_canonical_player_id) = e.b AND m.tourney_date = e.day
   GROUP BY e.market_ticker, e.day, e.a, e.b)
 SELECT market_ticker, day, coalesce(len(ids), 0)::BIGINT AS candidates, coalesce(array_to_string(ids, ','), '') AS match_ids, CASE coalesce(len(ids), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS found FROM f""")
def jn08_same_day_pair(spark, folder):
    """Matches of the same two players on the same day, whichever side they stand on."""
    rows = table(spark, folder, "market_mapping_evidence").where("yes_canonical_player_id is not null and no_canonical_player_id is not null")
    pair = lambda a, b: ids.pair_key(F.col(a), F.col(b)).alias("pair")
    rows = rows.select("market_ticker", pair("yes_canonical_player_id", "no_canonical_player_id"), F.date_format("collected_at_utc", "yyyyMMdd").alias("day")).distinct()
    met = _matches(spark, folder).select("canonical_match_id", pair("winner_canonical_player_id", "loser_canonical_player_id"), F.col("tourney_date").alias("day"))
    met = met.groupBy("pair", "day").agg(F.array_sort(F.collect_list("canonical_match_id")).alias("ids"))  # a pair's matches of one day
    n = F.coalesce(F.size("ids"), F.lit(0))
    return rows.join(met, ["pair", "day"], "left").withColumn("n", F.when(F.col("ids").isNull(), 0).otherwise(n)).select(
        "market_ticker", "day", F.col("n").cast("bigint").alias("candidates"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("match_ids"),
        F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("found"),
    )


@query("""SELECT DISTINCT canonical_match_id FROM market_mapping_evidence e WHERE canonical_match_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM modeling_rows m WHERE m.canonical_match_id = e.canonical_match_id)""")
def jn14_ids_without_features(spark, folder):
    asked = table(spark, folder, "market_mapping_evidence").select("canonical_match_id").where("canonical_match_id is not null")
    return R.unknown_ids(asked, table(spark, folder, "modeling_rows"), "canonical_match_id")


@query("SELECT canonical_player_id, count(*) AS n FROM canonical_players GROUP BY 1 HAVING count(*) > 1")
def ag18_repeated_keys(spark, folder):
    return R.repeated_ids(table(spark, folder, "canonical_players"), "canonical_player_id")


_REPLAY = "canonical_match_id, player_a_id, player_b_id, as_of_date, round_name"


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY canonical_match_id, {_REPLAY}, elo_diff) AS pos FROM (SELECT DISTINCT {_REPLAY}, elo_diff FROM modeling_rows WHERE feature_version = 'v1' AND canonical_match_id IS NOT NULL)),
 b AS (SELECT *, row_number() OVER (ORDER BY canonical_match_id, {_REPLAY}, elo_diff) AS pos FROM (SELECT DISTINCT {_REPLAY}, elo_diff FROM modeling_rows WHERE feature_version = 'v2' AND canonical_match_id IS NOT NULL))
 SELECT coalesce(a.pos, b.pos) AS pos, a.canonical_match_id AS saved_id, b.canonical_match_id AS replayed_id FROM a FULL JOIN b ON a.pos = b.pos
 WHERE (a.canonical_match_id, a.player_a_id, a.player_b_id, a.as_of_date, a.round_name, a.elo_diff) IS DISTINCT FROM (b.canonical_match_id, b.player_a_id, b.player_b_id, b.as_of_date, b.round_name, b.elo_diff)""")
def jn15_parity_by_position(spark, folder):
    columns = [*_REPLAY.split(", "), "elo_diff"]
    rows = table(spark, folder, "modeling_rows").where("canonical_match_id is not null")
    order = [F.asc_nulls_last(c) for c in columns]
    saved, replayed = (global_rank(rows.where(F.col("feature_version") == v).select(*columns).distinct(), order, "pos") for v in ("v1", "v2"))
    return R.differences_by_position(saved, replayed, "pos").select("pos", F.col("saved.canonical_match_id").alias("saved_id"), F.col("replayed.canonical_match_id").alias("replayed_id"))


@query("""WITH l AS (SELECT feature_version, coalesce(as_of_date, '') AS d, sha256(string_agg(canonical_match_id, chr(10) ORDER BY canonical_match_id) || chr(10)) AS h
  FROM (SELECT DISTINCT feature_version, as_of_date, canonical_match_id FROM modeling_rows WHERE canonical_match_id IS NOT NULL) GROUP BY 1, 2)
 SELECT feature_version, sha256(string_agg(h, chr(10) ORDER BY d) || chr(10)) AS membership_hash FROM l GROUP BY 1""")
def ag16_version_hash(spark, folder):
    """One hash per version: over the hashes of its dates in order, so no task lists all ids."""
    rows = table(spark, folder, "modeling_rows").where("canonical_match_id is not null")
    rows = rows.select("feature_version", F.coalesce("as_of_date", F.lit("")).alias("d"), "canonical_match_id").distinct()
    daily = rows.groupBy("feature_version", "d").agg(F.array_sort(F.collect_list("canonical_match_id")).alias("ids"))
    daily = daily.select("feature_version", F.struct("d", ids.ordered_list_hash(F.col("ids")).alias("h")).alias("x"))
    listed = daily.groupBy("feature_version").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]).alias("hs"))  # one per date
    return listed.select("feature_version", ids.ordered_list_hash(F.col("hs")).alias("membership_hash"))


# ---- sorts, choices, sets, maps ----------------------------------------------

_RANKS = ("yes_bid_dollars", "yes_ask_dollars", "volume_fp", "open_interest_fp")


@query(f"""WITH l AS (SELECT * FROM kalshi_market_snapshots WHERE ticker IS NOT NULL QUALIFY {_LATEST})
 SELECT ticker, row_number() OVER (ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in _RANKS)}, collected_at_utc ASC NULLS LAST, ticker) AS place FROM l""")
def st04_five_keys(spark, folder):
    """Four keys downwards, one upwards, missing values last, ties by name."""
    columns = ["ticker", "collected_at_utc", "response_index", "request_id", *_RANKS]
    rows = _latest(table(spark, folder, "kalshi_market_snapshots").select(*columns))
    order = [*[F.desc_nulls_last(c) for c in _RANKS], F.asc_nulls_last("collected_at_utc"), F.asc("ticker")]
    return global_rank(rows.select("ticker", "collected_at_utc", *_RANKS), order, "place").select("ticker", "place")


@query(f"""WITH l AS (SELECT ticker, (0.5 - yes_ask_dollars)::DOUBLE AS ye, (0.5 - no_ask_dollars)::DOUBLE AS ne, coalesce(yes_ask_size_fp, 0)::DOUBLE AS yc, coalesce(no_ask_size_fp, 0)::DOUBLE AS nc
   FROM (SELECT *, yes_bid_size_fp AS no_ask_size_fp FROM kalshi_market_snapshots) WHERE ticker IS NOT NULL QUALIFY {_LATEST})
 SELECT ticker, CASE WHEN coalesce(ye, -1e300) > coalesce(ne, -1e300) THEN 'yes' WHEN coalesce(ye, -1e300) < coalesce(ne, -1e300) THEN 'no' WHEN yc >= nc THEN 'yes' ELSE 'no' END AS side FROM l""")
def st07_larger_edge(spark, folder):
    """The side of larger edge (none counts as least), ties by confidence, then the positive side."""
    columns = ["ticker", "collected_at_utc", "response_index", "request_id", "yes_ask_dollars", "no_ask_dollars", "yes_ask_size_fp", "yes_bid_size_fp"]
    rows = _latest(table(spark, folder, "kalshi_market_snapshots").select(*columns))
    edge = lambda c: F.lit(0.5) - F.col(c).cast("double")
    side = R.better_side(edge("yes_ask_dollars"), edge("no_ask_dollars"), F.col("yes_ask_size_fp").cast("double"), F.col("yes_bid_size_fp").cast("double"), "yes", "no")
    return rows.select("ticker", side.alias("side"))


_CODES = "from_json({}, '[\"VARCHAR\"]')"


@query(f"""SELECT DISTINCT market_ticker, array_to_string(list_sort(list_distinct(coalesce({_CODES.format("rejection_reason_codes_json")}, []))), ',') AS codes,
  array_to_string(list_sort(list_distinct(coalesce({_CODES.format("alias_hit_player_ids_json")}, []))), ',') AS players FROM market_mapping_evidence""")
def so06_distinct_codes(spark, folder):
    values = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")))), ",")
    rows = table(spark, folder, "market_mapping_evidence")
    return rows.select("market_ticker", values("rejection_reason_codes_json").alias("codes"), values("alias_hit_player_ids_json").alias("players")).distinct()


@query("""WITH c AS (SELECT winner_canonical_player_id AS player, surface, count(*) AS n FROM canonical_matches WHERE winner_canonical_player_id IS NOT NULL AND surface IS NOT NULL GROUP BY 1, 2)
 SELECT player, coalesce(max(n) FILTER (surface = 'Clay'), 0)::BIGINT AS clay, coalesce(max(n) FILTER (surface = 'Moon'), 1500)::BIGINT AS moon, 7::BIGINT AS grass_after, count(*) FILTER (surface <> 'Grass') + 1 AS entries_after FROM c GROUP BY 1""")
def sf20_map_lookup(spark, folder):
    """A map per player: lookup with a default, and an updated copy."""
    rows = table(spark, folder, "canonical_matches").where("winner_canonical_player_id is not null and surface is not null")
    counts = rows.groupBy(F.col("winner_canonical_player_id").alias("player"), "surface").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("player").agg(F.map_from_entries(F.collect_list(F.struct("surface", "n"))).alias("m"))  # one entry per surface
    after = R.map_updated(F.col("m"), F.lit("Grass"), F.lit(7).cast("bigint"))
    return maps.select(
        "player", R.map_value(F.col("m"), F.lit("Clay"), F.lit(0)).cast("bigint").alias("clay"), R.map_value(F.col("m"), F.lit("Moon"), F.lit(1500)).cast("bigint").alias("moon"),
        after["Grass"].alias("grass_after"), F.size(after).cast("bigint").alias("entries_after"),
    )


@query("""SELECT DISTINCT ticker, yes_ask_dollars::DOUBLE AS ask, CASE WHEN yes_ask_dollars IS NOT NULL THEN '$' || printf('%.2f', yes_ask_dollars::DOUBLE) END AS shown, strftime(collected_at_utc, '%Y') AS year FROM kalshi_market_snapshots WHERE ticker IS NOT NULL""")
def sf21_currency(spark, folder):
    rows = table(spark, folder, "kalshi_market_snapshots").where("ticker is not null")
    ask = F.col("yes_ask_dollars").cast("double")
    return rows.select("ticker", ask.alias("ask"), text.currency(ask).alias("shown"), text.year_of(F.date_format("collected_at_utc", "yyyyMMdd")).alias("year")).distinct()


# ---- metrics and features ----------------------------------------------------


@query(f"""WITH {_FORECASTS}, e AS (SELECT as_of_date AS date, canonical_match_id AS id, 0.5 AS stake, (CASE WHEN y = 1 THEN 0.5 ELSE -0.5 END)::DOUBLE AS profit, p - 0.5 AS edge FROM f WHERE as_of_date IS NOT NULL),
 c AS (SELECT *, sum(profit) OVER o AS cumulative FROM e WINDOW o AS (ORDER BY date, id ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, greatest(0, max(cumulative) OVER (ORDER BY date, id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
 SELECT count(*) AS n, round(count(*) FILTER (profit > 0) / count(*), 6) AS win_rate, round(avg(edge), 6) AS average_edge, round(sum(greatest(profit, 0)), 6) AS gross, round(sum(profit), 6) AS net,
  round(sum(stake)::DOUBLE, 6) AS staked, round(sum(profit) / sum(stake)::DOUBLE, 6) AS roi, round(max(peak - cumulative), 6) AS max_drawdown FROM k""")
def ag12_full_summary(spark, folder):
    rows = _results(spark, folder, (F.col("p") - 0.5).alias("edge"))
    names = ("win_rate", "average_edge", "gross", "net", "staked", "roi", "max_drawdown")
    return M.full_summary(rows).select("n", *[_round(c) for c in names])


_NUMBERS = (
    "best_of", "h2h_match_count", "player_a_elo_overall", "player_b_elo_overall", "player_a_form_last_5_win_rate", "player_b_form_last_5_win_rate", "elo_diff", "surface_elo_diff",
    "service_first_won_rate_diff", "return_first_won_allowed_rate_diff", "ace_rate_diff", "h2h_win_rate_diff",
)
_WORDS = ("surface", "tourney_level", "round_name", "player_a_stats_missing", "player_b_stats_missing")


def _groups(spark, folder):
    rows = table(spark, folder, "modeling_rows")
    return rows, *feature_groups(rows, [*NO_FEATURES, *[c for c in rows.columns if c.startswith("lineage_")]])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, '{kind}' AS kind" for kind, names in (("numeric", _NUMBERS), ("categorical", _WORDS)) for c in names))
def ag15_feature_types(spark, folder):
    """Kind of every feature column of the table by its type; text and flags are categorical."""
    rows, numeric, categorical = _groups(spark, folder)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind")) for kind, names in (("numeric", numeric), ("categorical", categorical)) for c in names]
    return rows.limit(1).select(F.inline(F.array(*cells)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, count(*) - count({c}) AS nulls FROM modeling_rows" for c in _NUMBERS))
def ml01_all_statistics(spark, folder):
    rows, numeric, _ = _groups(spark, folder)
    return numeric_statistics(rows, numeric).select("feature", _round("median"), _round("mean"), _round("sd"), "nulls")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM modeling_rows WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode" for c in _WORDS))
def ag20_all_modes(spark, folder):
    rows, _, categorical = _groups(spark, folder)
    return most_frequent(rows, categorical)
