"""Named queries of the relational operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallyframe.functions import bands, ids, ladders, text
from rallyframe.operators import history as H
from rallyframe.operators import metrics as M
from rallyframe.operators import relational as R
from rallyframe.sources.csv_snapshot import file_scope, row_quarantine
from rallyframe.sources.tables import table
from rallyframe.util import global_rank, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


# ---- common parts of the SQL -------------------------------------------------

_ORDER = "CASE trim(round_name) " + " ".join(f"WHEN '{r}' THEN {n}" for n, r in enumerate(H.ROUNDS)) + " END"
_FIRST = "lineage_source_snapshot_root, lineage_source_file_path, lineage_source_row_number"
_SEQ = "tourney_date, round_order, lineage_source_file_path, lineage_source_row_number, canonical_match_id"
_MATCHES = f"""
m AS (SELECT *, {_ORDER} AS round_order, tourney_date || ':' || ({_ORDER}) AS cohort FROM canonical_matches
      WHERE canonical_match_id IS NOT NULL AND winner_canonical_player_id IS NOT NULL AND loser_canonical_player_id IS NOT NULL
        AND tourney_date IS NOT NULL AND round_name IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY canonical_match_id ORDER BY {_FIRST}) = 1)"""
_PLAYERS = f"""{_MATCHES},
r AS (SELECT {_SEQ}, cohort, surface, winner_canonical_player_id AS player, loser_canonical_player_id AS opponent, 1 AS won FROM m
      UNION ALL SELECT {_SEQ}, cohort, surface, loser_canonical_player_id, winner_canonical_player_id, 0 FROM m)"""
_FORECASTS = """
f AS (SELECT d.canonical_match_id, d.as_of_date, d.surface, d.tourney_level, d.player_a_rank, d.player_b_rank,
             CASE WHEN d.player_a_id = w.winner_canonical_player_id THEN 1 ELSE 0 END AS y,
             1 / (1 + pow(10, -d.elo_diff / 400)) AS p
      FROM (SELECT DISTINCT canonical_match_id, player_a_id, as_of_date, surface, tourney_level, player_a_rank, player_b_rank, elo_diff
            FROM modeling_rows WHERE feature_version = 'v1' AND elo_diff IS NOT NULL) d
      JOIN (SELECT DISTINCT canonical_match_id, winner_canonical_player_id FROM canonical_matches
            WHERE winner_canonical_player_id IS NOT NULL) w USING (canonical_match_id))"""


def _matches(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return H.one_row_per_match(table(spark, folder, "canonical_matches"), extra)


def _players(spark: SparkSession, folder: str) -> DataFrame:
    return H.player_rows(_matches(spark, folder))


def _dataset(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    rows = table(spark, folder, "modeling_rows").where("feature_version = 'v1' and elo_diff is not null")
    rows = rows.select("canonical_match_id", "player_a_id", *columns, "elo_diff").distinct()
    winners = table(spark, folder, "canonical_matches").where("winner_canonical_player_id is not null")
    winners = winners.select("canonical_match_id", "winner_canonical_player_id").distinct()
    y = F.when(F.col("player_a_id") == F.col("winner_canonical_player_id"), 1).otherwise(0)
    return rows.join(winners, "canonical_match_id").withColumn("y", y)


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["as_of_date", "surface", "tourney_level", "player_a_rank", "player_b_rank"]
    p = 1 / (1 + F.pow(F.lit(10.0), -F.col("elo_diff") / 400))
    return _dataset(spark, folder, columns).select("canonical_match_id", *columns, "y", p.alias("p"))


# ---- scans, ids, quarantine --------------------------------------------------


@query(f"WITH {_MATCHES} SELECT canonical_match_id, tourney_date, round_name, surface, winner_canonical_player_id, loser_canonical_player_id FROM m")
def src07_match_scan(spark, folder):
    columns = ["canonical_match_id", "tourney_date", "round_name", "surface", "winner_canonical_player_id", "loser_canonical_player_id"]
    return _matches(spark, folder).select(*columns)


@query("""SELECT DISTINCT source_tourney_id, tourney_name, tourney_date,
  'tournament:synthetic:' || sha256('tournament|' || trim(source_tourney_id) || '|' || lower(trim(tourney_name)) || '|' || trim(tourney_date))[1:16] AS id
  FROM canonical_tournaments WHERE source_tourney_id IS NOT NULL AND tourney_name IS NOT NULL AND tourney_date IS NOT NULL""")
def sf05_tournament_ids(spark, folder):
    rows = table(spark, folder, "canonical_tournaments").select("source_tourney_id", "tourney_name", "tourney_date").dropna().distinct()
    return rows.withColumn("id", ids.tournament_id(F.col("source_tourney_id"), F.col("tourney_name"), F.col("tourney_date")))


@query("""SELECT DISTINCT canonical_ranking_id, 'ranking:synthetic:' || sha256('ranking|' || canonical_player_id || '|' || trim(ranking_date))[1:16] AS id
  FROM canonical_rankings WHERE canonical_player_id IS NOT NULL AND ranking_date IS NOT NULL AND canonical_ranking_id IS NOT NULL""")
def sf05_ranking_ids(spark, folder):
    rows = table(spark, folder, "canonical_rankings").where("canonical_player_id is not null and ranking_date is not null and canonical_ranking_id is not null")
    return rows.select("canonical_ranking_id", ids.ranking_id(F.col("canonical_player_id"), F.col("ranking_date")).alias("id")).distinct()


@query(f"""WITH {_MATCHES} SELECT canonical_match_id, 'match:synthetic:' || sha256('match|' || lineage_source_file_path || '|' || lineage_source_row_number
  || '|' || trim(source_tourney_id) || '|' || winner_canonical_player_id || '|' || loser_canonical_player_id || '|' || upper(trim(round_name)))[1:16] AS id
  FROM m WHERE source_tourney_id IS NOT NULL""")
def sf05_match_ids(spark, folder):
    made = ids.match_id(*[F.col(c) for c in ("lineage_source_file_path", "lineage_source_row_number", "source_tourney_id", "winner_canonical_player_id", "loser_canonical_player_id", "round_name")])
    return _matches(spark, folder, "source_tourney_id").where("source_tourney_id is not null").select("canonical_match_id", made.alias("id"))


@query("""SELECT relative_path, CASE WHEN regexp_matches(n, 'qual|chall|futures|doubles|itf|wta') THEN 'out_of_scope_file_family'
   WHEN regexp_matches(n, '^(atp_players|atp_rankings(_([0-9]{4}|[0-9]{2}s|current))?|atp_matches_[0-9]{4}|atp_matchstats_[0-9]{4})\\.csv$') THEN 'accepted'
   ELSE 'unknown_file_family' END AS scope
  FROM (SELECT DISTINCT relative_path, lower(regexp_replace(relative_path, '^.*/', '')) AS n FROM raw_csv_lines)""")
def pf01_file_scope(spark, folder):
    paths = table(spark, folder, "raw_csv_lines").select("relative_path").distinct()
    return paths.select("relative_path", F.coalesce(file_scope(F.col("relative_path")), F.lit("accepted")).alias("scope"))


@query("""SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN contains(lower(coalesce(score, '')), 'w/o') OR contains(lower(coalesce(score, '')), 'walkover') THEN 'excluded_walkover'
              WHEN upper(trim(coalesce(round_name, ''))) IN ('Q1', 'Q2', 'Q3', 'QR') THEN 'excluded_qualifier' ELSE 'accepted' END AS reason
  FROM canonical_matches) GROUP BY reason""")
def pf02_row_quarantine(spark, folder):
    rows = table(spark, folder, "canonical_matches")
    reason = row_quarantine(F.lit(None).cast("string"), F.col("score"), F.col("round_name"))
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'canonical_rankings' AS source, count(*) AS n, count(*) FILTER (ranking_date IS NULL OR try_strptime(ranking_date, '%Y%m%d') IS NULL) AS bad_dates,
  count(*) FILTER (rank IS NULL) AS null_ranks FROM canonical_rankings""")
def pf05_validation_counts(spark, folder):
    rows = table(spark, folder, "canonical_rankings")
    good = F.col("ranking_date").rlike(r"\A[0-9]{8}\z") & F.try_to_timestamp("ranking_date", F.lit("yyyyMMdd")).isNotNull()
    return rows.agg(
        F.first(F.lit("canonical_rankings")).alias("source"), F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_dates"), F.count_if(F.col("rank").isNull()).alias("null_ranks"),
    )


@query("""SELECT DISTINCT canonical_player_id, lineage_source_file_path AS source_file_path, lineage_source_row_number AS source_row_number FROM canonical_players""")
def pf07_flatten_lineage(spark, folder):
    rows = table(spark, folder, "canonical_players")
    names = [c for c in rows.columns if c.startswith("lineage_")]
    nested = rows.select("canonical_player_id", F.struct(*[F.col(c).alias(c.removeprefix("lineage_")) for c in names]).alias("lineage"))
    return nested.select("canonical_player_id", "lineage.source_file_path", "lineage.source_row_number").distinct()


@query(f"""SELECT canonical_player_id, first_name, last_name, full_name FROM canonical_players
  QUALIFY row_number() OVER (PARTITION BY canonical_player_id ORDER BY {_FIRST}, coalesce(first_name, '~')) = 1""")
def ag17_first_wins(spark, folder):
    order = [F.col(c.strip()) for c in _FIRST.split(",")] + [F.coalesce("first_name", F.lit("~"))]
    names = ["canonical_player_id", "first_name", "last_name", "full_name"]
    rows = table(spark, folder, "canonical_players").select(*names, *[c.strip() for c in _FIRST.split(",")])
    return R.holds(rows, ["canonical_player_id"], order, last=False).select(*names)


@query(f"""SELECT canonical_ranking_id, rank::DOUBLE AS rank FROM canonical_rankings WHERE canonical_ranking_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY canonical_ranking_id ORDER BY {_FIRST.replace(",", " DESC,")} DESC, coalesce(rank, -1) DESC) = 1""")
def ag21_last_wins(spark, folder):
    order = [F.col(c.strip()) for c in _FIRST.split(",")] + [F.coalesce("rank", F.lit(-1))]
    rows = table(spark, folder, "canonical_rankings").where("canonical_ranking_id is not null")
    rows = rows.select("canonical_ranking_id", "rank", *[c.strip() for c in _FIRST.split(",")])
    return R.holds(rows, ["canonical_ranking_id"], order).select("canonical_ranking_id", F.col("rank").cast("double").alias("rank"))


# ---- latest rows, ladders ----------------------------------------------------

_LATEST = "row_number() OVER (PARTITION BY ticker ORDER BY collected_at_utc DESC, response_index DESC, request_id DESC) = 1"


def _latest(rows: DataFrame) -> DataFrame:
    return R.holds(rows.where("ticker is not null"), ["ticker"], [F.col("collected_at_utc"), F.col("response_index"), F.col("request_id")])


@query(f"""SELECT ticker, request_id, status, CAST(yes_ask_dollars AS DOUBLE) AS yes_ask FROM (
  SELECT * FROM kalshi_market_snapshots WHERE ticker IS NOT NULL QUALIFY {_LATEST})""")
def wn01_latest_market(spark, folder):
    columns = ["ticker", "request_id", "collected_at_utc", "response_index", "status", "yes_ask_dollars"]
    rows = _latest(table(spark, folder, "kalshi_market_snapshots").select(*columns))
    return rows.select("ticker", "request_id", "status", F.col("yes_ask_dollars").cast("double").alias("yes_ask"))


@query(f"""SELECT ticker, request_id, CAST(yes_best_price_dollars AS DOUBLE) AS yes_best FROM (
  SELECT * FROM kalshi_orderbook_snapshots WHERE ticker IN (SELECT ticker FROM kalshi_market_snapshots WHERE status = 'open') QUALIFY {_LATEST})""")
def wn02_latest_orderbook(spark, folder):
    columns = ["ticker", "request_id", "collected_at_utc", "response_index", "yes_best_price_dollars"]
    books = table(spark, folder, "kalshi_orderbook_snapshots").select(*columns)
    asked = table(spark, folder, "kalshi_market_snapshots").where("status = 'open'").select("ticker")
    return _latest(books.join(asked, "ticker", "left_semi")).select("ticker", "request_id", F.col("yes_best_price_dollars").cast("double").alias("yes_best"))


@query("""SELECT DISTINCT request_id, CAST(json_extract_string(yes_levels_json, '$[0][0]') AS DOUBLE) AS price,
  CAST(json_extract_string(yes_levels_json, '$[0][1]') AS DOUBLE) AS quantity, json_array_length(yes_levels_json)::BIGINT AS depth
  FROM kalshi_orderbook_snapshots WHERE yes_levels_json IS NOT NULL""")
def sf17_top_of_book(spark, folder):
    rows = table(spark, folder, "kalshi_orderbook_snapshots").where("yes_levels_json is not null")
    top = ladders.top_of_book(F.col("yes_levels_json"))
    return rows.select(
        "request_id", top["price"].cast("double").alias("price"), top["quantity"].cast("double").alias("quantity"),
        F.size(ladders.levels(F.col("yes_levels_json"))).cast("bigint").alias("depth"),
    ).distinct()


@query("""SELECT ticker, count(*) AS books, round(avg(date_diff('microsecond', before, collected_at_utc) / 1e6), 3) AS mean_gap_s FROM (
  SELECT ticker, collected_at_utc, lag(collected_at_utc) OVER (PARTITION BY ticker ORDER BY collected_at_utc, request_id) AS before
  FROM (SELECT DISTINCT ticker, request_id, collected_at_utc FROM kalshi_orderbook_snapshots WHERE ticker IS NOT NULL)) GROUP BY ticker""")
def sf10_book_ages(spark, folder):
    rows = table(spark, folder, "kalshi_orderbook_snapshots").where("ticker is not null").select("ticker", "request_id", "collected_at_utc").distinct()
    # the mean gap needs only the ends: no window over a hot ticker
    ends = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("books"), F.min("collected_at_utc").alias("a"), F.max("collected_at_utc").alias("b"))
    gap = F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 1e6
    return ends.select("ticker", "books", F.round(F.try_divide(gap, F.col("books") - 1), 3).alias("mean_gap_s"))


# ---- cohorts and histories ---------------------------------------------------


@query(f"WITH {_MATCHES} SELECT tourney_date, round_order::BIGINT AS round_order, count(*) AS matches, row_number() OVER (ORDER BY tourney_date, round_order) AS cohort_index FROM m GROUP BY tourney_date, round_order")
def wn03_cohorts(spark, folder):
    return H.cohorts(_matches(spark, folder)).withColumn("round_order", F.col("round_order").cast("bigint"))


@query(f"""WITH {_PLAYERS}, c AS (SELECT DISTINCT player, cohort, tourney_date, round_order FROM r),
 b AS (SELECT player, cohort, max(tourney_date) OVER (PARTITION BY player ORDER BY tourney_date, round_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_date FROM c)
 SELECT canonical_match_id, player, last_date, date_diff('day', strptime(last_date, '%Y%m%d')::DATE, strptime(tourney_date, '%Y%m%d')::DATE)::DOUBLE AS rest_days
 FROM r JOIN b USING (player, cohort)""")
def wn06_rest(spark, folder):
    rows = H.last_date_before(_players(spark, folder))
    return rows.select("canonical_match_id", "player", "last_date", F.col("rest_days").cast("double").alias("rest_days"))


def _form_sql(k: int) -> str:
    inside = f"OVER (PARTITION BY player ORDER BY {_SEQ} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"sum(won) {inside} AS s{k}, count(won) {inside} AS n{k}"


@query(f"""WITH {_PLAYERS}, w AS (SELECT *, {_form_sql(5)}, {_form_sql(10)}, {_form_sql(20)} FROM r),
 o AS (SELECT *, {", ".join(f"first_value(s{k}) OVER c AS fs{k}, first_value(n{k}) OVER c AS fn{k}" for k in (5, 10, 20))} FROM w
       WINDOW c AS (PARTITION BY player, cohort ORDER BY {_SEQ}))
 SELECT canonical_match_id, player, {", ".join(f"fn{k} AS form_{k}_count, round(fs{k}::DOUBLE / nullif(fn{k}, 0), 6) AS form_{k}_win_rate" for k in (5, 10, 20))} FROM o""")
def wn07_form(spark, folder):
    rows = H.recent_form(_players(spark, folder))
    parts = [c for k in (5, 10, 20) for c in (F.col(f"form_{k}_count"), _round(f"form_{k}_win_rate"))]
    return rows.select("canonical_match_id", "player", *parts)


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, strftime(l_shipdate, '%Y%m%d') AS day, strftime(l_shipdate, '%Y') AS year,
   l_quantity::DECIMAL(18,2) AS quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem),
 w AS (SELECT *, sum(quantity) OVER b AS q, sum(returned) OVER b AS n FROM s
       WINDOW b AS (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, first_value(q) OVER c AS fq, first_value(n) OVER c AS fn FROM w WINDOW c AS (PARTITION BY l_suppkey, day ORDER BY l_orderkey, l_linenumber))
 SELECT l_orderkey, l_linenumber, coalesce(fq, 0)::DOUBLE AS quantity_before, coalesce(fn, 0)::BIGINT AS returned_before FROM o""")
def wn08_sums_before(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd").alias("day"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )
    out = H.sums_before(rows, ["l_suppkey"], "year", "day", ["day", "l_orderkey", "l_linenumber"], ["quantity", "returned"])
    return out.select("l_orderkey", "l_linenumber", F.col("quantity_before").cast("double").alias("quantity_before"), F.col("returned_before").cast("bigint").alias("returned_before"))


@query(f"""WITH {_PLAYERS}, k AS (SELECT *, least(player, opponent) || '::' || greatest(player, opponent) AS pair FROM r),
 o AS (SELECT *, count(*) OVER b AS n, sum(won) OVER b AS s FROM k WINDOW b AS (PARTITION BY pair, player ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT canonical_match_id, player, first_value(n) OVER c AS h2h_count, coalesce(first_value(s) OVER c, 0)::BIGINT AS h2h_wins FROM o
 WINDOW c AS (PARTITION BY pair, player, cohort ORDER BY {_SEQ})""")
def wn09_head_to_head(spark, folder):
    rows = H.head_to_head(_players(spark, folder).where("player <> opponent"))
    return rows.select("canonical_match_id", "player", F.col("h2h_count").cast("bigint").alias("h2h_count"), F.col("h2h_wins").cast("bigint").alias("h2h_wins"))


_RANKED = """
l AS (SELECT canonical_player_id AS player, ranking_date, rank, points FROM canonical_rankings
      WHERE canonical_player_id IS NOT NULL AND ranking_date IS NOT NULL AND rank IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY canonical_player_id, ranking_date
        ORDER BY lineage_source_snapshot_root DESC, lineage_source_file_path DESC, lineage_source_row_number DESC) = 1),
k AS (SELECT *, lag(rank) OVER (PARTITION BY player ORDER BY ranking_date) AS previous_rank FROM l)"""


_RANK_COLUMNS = [("rank", "rank"), ("previous_rank", "previous_rank"), ("rank_change", "rank_change"), ("ranking_age_days", "age_days")]


@query(f"""WITH {_PLAYERS}, {_RANKED}
 SELECT r.canonical_match_id, r.player, k.ranking_date, k.rank::DOUBLE AS rank, k.previous_rank::DOUBLE AS previous_rank, (k.rank - k.previous_rank)::DOUBLE AS rank_change,
  date_diff('day', strptime(k.ranking_date, '%Y%m%d')::DATE, strptime(r.tourney_date, '%Y%m%d')::DATE)::DOUBLE AS age_days
 FROM r ASOF LEFT JOIN k ON r.player = k.player AND r.tourney_date >= k.ranking_date""")
def jn02_asof_ranking(spark, folder):
    rows = H.ranking_as_of(_players(spark, folder), table(spark, folder, "canonical_rankings"))
    return rows.select("canonical_match_id", "player", "ranking_date", *[F.col(c).cast("double").alias(n) for c, n in _RANK_COLUMNS])


@query(f"""WITH {_PLAYERS}, w AS (SELECT *, {_form_sql(5)} FROM r),
 o AS (SELECT *, first_value(s5) OVER c / nullif(first_value(n5) OVER c, 0)::DOUBLE AS rate FROM w WINDOW c AS (PARTITION BY player, cohort ORDER BY {_SEQ}))
 SELECT a.canonical_match_id, a.player AS player_a, b.player AS player_b, round(a.rate - b.rate, 6) AS form_diff
 FROM o a JOIN o b ON a.canonical_match_id = b.canonical_match_id AND a.won = 1 AND b.won = 0""")
def pf11_differential(spark, folder):
    sides = H.recent_form(_players(spark, folder), (5,))
    out = H.differential(sides, ["form_5_win_rate"])
    return out.select("canonical_match_id", "player_a", "player_b", F.round("form_5_win_rate_diff", 6).alias("form_diff"))


@query(f"WITH {_PLAYERS} SELECT won::BIGINT AS won, count(*) AS n, count(DISTINCT player) AS players FROM r GROUP BY won")
def so01_union_sides(spark, folder):
    return _players(spark, folder).groupBy(F.col("won").cast("bigint").alias("won")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("player").alias("players"))


@query(f"""WITH {_PLAYERS}, o AS (SELECT canonical_match_id, player, won, row_number() OVER w - 1 AS n, coalesce(sum(won) OVER (PARTITION BY player ORDER BY {_SEQ}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM r WINDOW w AS (PARTITION BY player ORDER BY {_SEQ}))
 SELECT canonical_match_id, player, 'matches' AS metric, n AS pre, n + 1 AS post FROM o UNION ALL SELECT canonical_match_id, player, 'wins', s, s + won FROM o""")
def jn05_audit(spark, folder):
    return H.audit_counts(_players(spark, folder))


def _delivered_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Serve statistics of delivered files, by file name and line."""
    from rallyframe.operators.record_quarantine import loaded_records

    lines = table(spark, folder, "raw_csv_lines").where("relative_path like '%/atp_matchstats_%'")
    loaded = loaded_records(lines, table(spark, folder, "file_quarantine_records"))
    whole = lambda c, name: F.trim(F.col("values")[c]).try_cast("int").alias(name)
    return loaded.select(
        F.element_at(F.split("relative_path", "/"), -1).alias("lineage_source_file_path"), F.col("line_number").alias("lineage_source_row_number"),
        *[whole(f"{c}{n}", f"{name}_player{n}") for c, name in (("1stWon", "first_won"), ("svpt", "serve_points"), ("ace", "ace")) for n in (1, 2)],
    )


@query()
def dc06_feature_build(spark, folder):
    from rallyframe.plans.pipelines import feature_tables

    built = feature_tables(table(spark, folder, "canonical_matches"), table(spark, folder, "canonical_rankings"), _delivered_stats(spark, folder))
    return built["differentials"]


# ---- dataset, splits, membership ---------------------------------------------


@query(f"WITH {_FORECASTS} SELECT canonical_match_id, y::BIGINT AS y, round(p, 6) AS p FROM f")
def jn01_dataset(spark, folder):
    return _forecasts(spark, folder).select("canonical_match_id", F.col("y").cast("bigint").alias("y"), _round("p"))


_SPLIT = "CASE WHEN as_of_date <= '20141231' THEN 'train' WHEN as_of_date <= '20181231' THEN 'validation' ELSE 'test' END"


@query(f"WITH {_FORECASTS} SELECT {_SPLIT} AS split, count(*) AS n, min(as_of_date) AS first_date, max(as_of_date) AS last_date FROM f WHERE as_of_date IS NOT NULL GROUP BY 1")
def pf12_splits(spark, folder):
    from rallyframe.ml.dataset import split_of

    rows = _forecasts(spark, folder).where("as_of_date is not null").withColumn("split", split_of(F.col("as_of_date"), "20141231", "20181231"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("as_of_date").alias("first_date"), F.max("as_of_date").alias("last_date"))


@query(f"""WITH {_FORECASTS}, d AS (SELECT DISTINCT canonical_match_id, as_of_date FROM f WHERE as_of_date IS NOT NULL),
 o AS (SELECT *, row_number() OVER (ORDER BY as_of_date, canonical_match_id) AS k, count(*) OVER () AS n FROM d)
 SELECT canonical_match_id FROM o WHERE k > n - ceil(0.15 * n)""")
def wn12_tail(spark, folder):
    return _tail(_forecasts(spark, folder))


def _tail(rows: DataFrame) -> DataFrame:
    """The latest 15% of the matches."""
    rows = rows.where("as_of_date is not null").select("canonical_match_id", "as_of_date").distinct()
    # the tail by counts per date, then a window within the one date it begins in
    daily = rows.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))
    later = W.orderBy(F.desc("as_of_date")).rowsBetween(W.unboundedPreceding, -1)  # one row per date
    daily = daily.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    daily = daily.withColumn("want", F.ceil(F.lit(0.15) * F.sum("n").over(W.partitionBy())))
    rank = F.row_number().over(W.partitionBy("as_of_date").orderBy(F.desc("canonical_match_id")))
    placed = rows.join(daily, "as_of_date").where("after < want").withColumn("k", rank + F.col("after"))
    return placed.where("k <= want").select("canonical_match_id")


@query("""WITH l AS (SELECT canonical_match_id, row_number() OVER (ORDER BY canonical_match_id DESC) - 1 AS pos
   FROM (SELECT DISTINCT canonical_match_id FROM modeling_rows WHERE feature_version = 'v2'))
 SELECT l.pos, r.canonical_match_id, r.as_of_date FROM l JOIN (SELECT DISTINCT canonical_match_id, as_of_date FROM modeling_rows WHERE feature_version = 'v1') r USING (canonical_match_id)""")
def jn13_membership_order(spark, folder):
    rows = table(spark, folder, "modeling_rows")
    listed = global_rank(rows.where("feature_version = 'v2' and canonical_match_id is not null").select("canonical_match_id").distinct(), [F.desc("canonical_match_id")], "pos")
    listed = listed.withColumn("pos", F.col("pos") - 1)
    known = rows.where("feature_version = 'v1'").select("canonical_match_id", "as_of_date").distinct()
    return R.in_listed_order(listed, known, "canonical_match_id").select("pos", "canonical_match_id", "as_of_date")


@query("SELECT DISTINCT canonical_match_id FROM modeling_rows r WHERE canonical_match_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_matches m WHERE m.canonical_match_id = r.canonical_match_id)")
def jn14_unknown_ids(spark, folder):
    rows = table(spark, folder, "modeling_rows").select("canonical_match_id").where("canonical_match_id is not null")
    return R.unknown_ids(rows, table(spark, folder, "canonical_matches"), "canonical_match_id")


@query("SELECT canonical_match_id, count(*) AS n FROM modeling_rows WHERE feature_version = 'v1' GROUP BY 1 HAVING count(*) > 1")
def so03_repeated_members(spark, folder):
    return R.repeated_ids(table(spark, folder, "modeling_rows").where("feature_version = 'v1'"), "canonical_match_id")


_PARITY = "SELECT canonical_match_id, player_a_id, round(elo_diff, 3) AS elo_diff FROM modeling_rows WHERE feature_version"


@query(f"""SELECT 'saved' AS side, * FROM ({_PARITY} = 'v2' EXCEPT ALL {_PARITY} = 'v1')""")
def jn15_parity(spark, folder):
    rows = table(spark, folder, "modeling_rows").select("feature_version", "canonical_match_id", "player_a_id", F.round("elo_diff", 3).alias("elo_diff"))
    one = [rows.where(F.col("feature_version") == v).drop("feature_version") for v in ("v2", "v1")]
    return R.differences(*one).where("side = 'saved'").select("side", "canonical_match_id", "player_a_id", "elo_diff")


_VALUES = (
    "canonical_match_id", "player_a_id", "player_b_id", "as_of_date", "player_a_side", "player_b_side", "surface", "tourney_level", "round_name", "best_of",
    "player_a_rank", "player_b_rank", "player_a_elo_overall", "player_b_elo_overall", "player_a_form_last_5_win_rate", "player_b_form_last_5_win_rate",
    "player_a_stats_missing", "player_b_stats_missing", "rank_diff", "elo_diff", "surface_elo_diff", "service_first_won_rate_diff",
    "return_first_won_allowed_rate_diff", "ace_rate_diff", "h2h_win_rate_diff", "h2h_match_count",
)
_VALUES_OF = f"SELECT {', '.join(_VALUES)} FROM modeling_rows WHERE feature_version"


_WHOLE = ("best_of", "player_a_rank", "player_b_rank", "rank_diff", "h2h_match_count")


@query(f"""SELECT * REPLACE ({", ".join(f"{c}::DOUBLE AS {c}" for c in _WHOLE)}) FROM (SELECT 'saved' AS side, * FROM ({_VALUES_OF} = 'v2' EXCEPT ALL {_VALUES_OF} = 'v1')
  UNION ALL SELECT 'replayed', * FROM ({_VALUES_OF} = 'v1' EXCEPT ALL {_VALUES_OF} = 'v2'))""")
def jn15_parity_both(spark, folder):
    """Both sides over all value columns, exactly; ``jn15_parity`` shows one side and three columns, as its SQL says."""
    rows = table(spark, folder, "modeling_rows")
    one = [rows.where(F.col("feature_version") == v).select(*_VALUES) for v in ("v2", "v1")]
    return R.differences(*one).select("side", *[F.col(c).cast("double").alias(c) if c in _WHOLE else c for c in _VALUES])


@query("""SELECT feature_version, as_of_date, sha256(string_agg(canonical_match_id, chr(10) ORDER BY canonical_match_id) || chr(10)) AS membership_hash
  FROM (SELECT DISTINCT feature_version, coalesce(as_of_date, '') AS as_of_date, canonical_match_id FROM modeling_rows WHERE canonical_match_id IS NOT NULL) GROUP BY feature_version, as_of_date""")
def ag16_membership_hash(spark, folder):
    """One hash per version and date, so no task lists more than a day's ids."""
    rows = table(spark, folder, "modeling_rows").where("canonical_match_id is not null")
    rows = rows.select("feature_version", F.coalesce("as_of_date", F.lit("")).alias("as_of_date"), "canonical_match_id").distinct()
    listed = rows.groupBy("feature_version", "as_of_date").agg(F.array_sort(F.collect_list("canonical_match_id")).alias("ids"))
    return listed.select("feature_version", "as_of_date", ids.ordered_list_hash(F.col("ids")).alias("membership_hash"))


# ---- name resolution ---------------------------------------------------------

_PLAIN = "trim(regexp_replace(regexp_replace(lower(regexp_replace(nfc_normalize(strip_accents({0})), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT full_name, {_PLAIN.format('full_name')} AS plain FROM canonical_players WHERE full_name IS NOT NULL")
def sf01_plain_name(spark, folder):
    return table(spark, folder, "canonical_players").where("full_name is not null").select("full_name").distinct().withColumn("plain", text.plain_name(F.col("full_name")))


@query("""SELECT DISTINCT raw_title, nullif(trim(regexp_extract(t, '(?i)^(.+?)\\s+vs\\s+(.+)$', 1)), '') AS side_a, nullif(trim(regexp_extract(t, '(?i)^(.+?)\\s+vs\\s+(.+)$', 2)), '') AS side_b
 FROM (SELECT raw_title, trim(regexp_replace(raw_title, '^.*:', '')) AS t FROM market_mapping_evidence WHERE raw_title IS NOT NULL)""")
def sf02_title_pair(spark, folder):
    a, b = text.title_pair(F.col("raw_title"))
    return table(spark, folder, "market_mapping_evidence").where("raw_title is not null").select("raw_title", a.alias("side_a"), b.alias("side_b")).distinct()


@query(f"""WITH p AS (SELECT {_PLAIN.format('full_name')} AS plain, count(DISTINCT canonical_player_id) AS n, min(canonical_player_id) AS id
    FROM canonical_players WHERE full_name IS NOT NULL GROUP BY 1)
 SELECT DISTINCT e.market_ticker, CASE WHEN p.n = 1 THEN p.id END AS player, coalesce(p.n, 0) AS candidates
 FROM market_mapping_evidence e LEFT JOIN p ON p.plain = e.normalized_yes_player_name""")
def jn06_resolve_names(spark, folder):
    players = table(spark, folder, "canonical_players").where("full_name is not null").select("canonical_player_id", "full_name").distinct()
    known = players.groupBy(text.plain_name(F.col("full_name")).alias("plain")).agg(
        F.countDistinct("canonical_player_id").alias("n"), F.min("canonical_player_id").alias("id")
    )
    rows = table(spark, folder, "market_mapping_evidence").select("market_ticker", F.col("normalized_yes_player_name").alias("plain"))
    out = rows.join(known, "plain", "left")
    return out.select("market_ticker", F.when(F.col("n") == 1, F.col("id")).alias("player"), F.coalesce("n", F.lit(0)).alias("candidates")).distinct()


@query("""WITH a AS (SELECT raw_market_name, normalized_market_name, canonical_player_id FROM player_alias_overrides WHERE canonical_player_id <> ''),
  n AS (SELECT normalized_market_name, min(canonical_player_id) AS id FROM a GROUP BY 1 HAVING count(DISTINCT canonical_player_id) = 1)
 SELECT DISTINCT e.market_ticker, coalesce(r.canonical_player_id, n.id) AS player, CASE WHEN r.canonical_player_id IS NOT NULL THEN 'raw' WHEN n.id IS NOT NULL THEN 'normalized' ELSE 'none' END AS hit
 FROM market_mapping_evidence e LEFT JOIN a r ON r.raw_market_name = e.raw_yes_sub_title LEFT JOIN n ON n.normalized_market_name = e.normalized_yes_player_name""")
def jn07_alias_lookup(spark, folder):
    aliases = table(spark, folder, "player_alias_overrides").where("canonical_player_id <> ''")
    raw = aliases.select(F.col("raw_market_name").alias("raw_yes_sub_title"), F.col("canonical_player_id").alias("by_raw"))
    plain = aliases.groupBy(F.col("normalized_market_name").alias("normalized_yes_player_name")).agg(
        F.min("canonical_player_id").alias("by_plain"), F.countDistinct("canonical_player_id").alias("n")
    ).where("n = 1").drop("n")
    rows = table(spark, folder, "market_mapping_evidence").select("market_ticker", "raw_yes_sub_title", "normalized_yes_player_name")
    out = rows.join(raw, "raw_yes_sub_title", "left").join(plain, "normalized_yes_player_name", "left")
    hit = F.when(F.col("by_raw").isNotNull(), "raw").when(F.col("by_plain").isNotNull(), "normalized").otherwise("none")
    return out.select("market_ticker", F.coalesce("by_raw", "by_plain").alias("player"), hit.alias("hit")).distinct()


@query("SELECT normalized_market_name, count(*) AS n FROM player_alias_overrides GROUP BY 1 HAVING count(*) > 1")
def ag18_repeated_aliases(spark, folder):
    return R.repeated_ids(table(spark, folder, "player_alias_overrides"), "normalized_market_name")


@query(f"""WITH {_MATCHES}, e AS (SELECT DISTINCT market_ticker, least(yes_canonical_player_id, no_canonical_player_id) AS a,
    greatest(yes_canonical_player_id, no_canonical_player_id) AS b, strftime(collected_at_utc, '%Y') AS y FROM market_mapping_evidence
    WHERE yes_canonical_player_id IS NOT NULL AND no_canonical_player_id IS NOT NULL)
 SELECT e.market_ticker, count(m.canonical_match_id) AS candidates, min(m.canonical_match_id) AS first_match FROM e LEFT JOIN m
   ON least(m.winner_canonical_player_id, m.loser_canonical_player_id) = e.a AND greatest(m.winner_canonical_player_id, m.loser_canonical_player_id) = e.b
  AND m.tourney_date[1:4] = e.y GROUP BY e.market_ticker""")
def jn08_unordered_pair(spark, folder):
    rows = table(spark, folder, "market_mapping_evidence").where("yes_canonical_player_id is not null and no_canonical_player_id is not null")
    rows = rows.select("market_ticker", ids.pair_key(F.col("yes_canonical_player_id"), F.col("no_canonical_player_id")).alias("pair"), F.date_format("collected_at_utc", "yyyy").alias("year")).distinct()
    met = _matches(spark, folder).select(
        "canonical_match_id", ids.pair_key(F.col("winner_canonical_player_id"), F.col("loser_canonical_player_id")).alias("pair"), F.substring("tourney_date", 1, 4).alias("year")
    )
    found = met.groupBy("pair", "year").agg(F.count(F.lit(1)).alias("n"), F.min("canonical_match_id").alias("first_match"))
    out = rows.join(found, ["pair", "year"], "left")
    return out.groupBy("market_ticker").agg(F.sum(F.coalesce("n", F.lit(0))).alias("candidates"), F.min("first_match").alias("first_match"))


@query("SELECT mapping_state, mapping_confidence, count(*) AS n FROM market_mapping_evidence GROUP BY ALL")
def ag01_state_counts(spark, folder):
    return table(spark, folder, "market_mapping_evidence").groupBy("mapping_state", "mapping_confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(from_json(rejection_reason_codes_json, '["VARCHAR"]')) AS code FROM market_mapping_evidence) GROUP BY code""")
def ag02_reason_counts(spark, folder):
    codes = table(spark, folder, "market_mapping_evidence").select(F.explode(F.from_json("rejection_reason_codes_json", "array<string>")).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- metrics -----------------------------------------------------------------

_BIN = " + ".join(f"(p >= {i / 10!r})::INT" for i in range(1, 10))


@query(f"""WITH {_FORECASTS}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM f GROUP BY 1)
 SELECT i AS bin, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed
 FROM range(10) t(i) LEFT JOIN b ON b.bin = t.i""")
def ag03_bins(spark, folder):
    return M.calibration_bins(_forecasts(spark, folder)).select("bin", "lower", "upper", "n", _round("mean_p"), _round("observed"))


@query(f"""WITH {_FORECASTS}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM f GROUP BY 1)
 SELECT round(sum(n * abs(mean_p - observed)) / sum(n), 6) AS ece FROM b""")
def ag04_ece(spark, folder):
    return M.calibration_error(_forecasts(spark, folder)).select(_round("ece"))


@query(f"""WITH {_FORECASTS} SELECT round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM f GROUP BY {_BIN}""")
def ag05_curve(spark, folder):
    return M.calibration_bins(_forecasts(spark, folder)).where("n > 0").select(_round("mean_p"), _round("observed"))


@query(f"""WITH {_FORECASTS} SELECT count(*) AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy,
 round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier FROM f""")
def ag06_point_metrics(spark, folder):
    return M.point_metrics(_forecasts(spark, folder)).select("n", _round("accuracy"), _round("log_loss"), _round("brier"))


@query(f"""WITH {_FORECASTS}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM f)
 SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)::DOUBLE
   / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k""")
def ag07_roc_auc(spark, folder):
    return M.roc_auc(_forecasts(spark, folder)).select(_round("auc"))


_BAND = "CASE WHEN k IS NULL THEN 'unranked' WHEN k <= 10 THEN '1-10' WHEN k <= 25 THEN '11-25' WHEN k <= 50 THEN '26-50' WHEN k <= 100 THEN '51-100' ELSE '101+' END"
_BUCKET = "CASE WHEN v < 0.6 THEN '[0.50,0.60)' WHEN v < 0.7 THEN '[0.60,0.70)' WHEN v < 0.8 THEN '[0.70,0.80)' WHEN v < 0.9 THEN '[0.80,0.90)' ELSE '[0.90,1.00]' END"


@query(f"""WITH {_FORECASTS}, s AS (SELECT *, least(player_a_rank, player_b_rank) AS k, greatest(p, 1 - p) AS v FROM f),
 u AS (SELECT 'surface' AS segment, coalesce(surface, 'unknown') AS value, y, p, v FROM s UNION ALL SELECT 'level', coalesce(tourney_level, 'unknown'), y, p, v FROM s
   UNION ALL SELECT 'year', coalesce(as_of_date[1:4], 'unknown'), y, p, v FROM s UNION ALL SELECT 'band', {_BAND}, y, p, v FROM s UNION ALL SELECT 'bucket', {_BUCKET}, y, p, v FROM s)
 SELECT segment, value, count(*) AS n, round(avg(y), 6) AS win_rate, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(p), 6) AS mean_p,
  round(avg(v), 6) AS mean_favoured FROM u GROUP BY segment, value""")
def ag10_segments(spark, folder):
    by = {
        "surface": F.col("surface"), "level": F.col("tourney_level"), "year": F.substring("as_of_date", 1, 4),
        "band": bands.ranking_band(F.col("player_a_rank"), F.col("player_b_rank")), "bucket": bands.confidence_bucket(F.col("p")),
    }
    return M.segments(_forecasts(spark, folder), by).select("segment", "value", "n", *[_round(c) for c in ("win_rate", "accuracy", "mean_p", "mean_favoured")])


_RESULTS = f"""{_FORECASTS}, e AS (SELECT as_of_date AS date, canonical_match_id AS id, 0.5 AS stake, (CASE WHEN y = 1 THEN 0.5 ELSE -0.5 END)::DOUBLE AS profit
   FROM f WHERE as_of_date IS NOT NULL),
 c AS (SELECT date, id, profit, sum(profit) OVER o AS cumulative, sum(stake) OVER o AS staked FROM e WINDOW o AS (ORDER BY date, id ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, greatest(0, max(cumulative) OVER (ORDER BY date, id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)"""


def _results(spark: SparkSession, folder: str, *further: Column) -> DataFrame:
    profit = F.when(F.col("y") == 1, 0.5).otherwise(-0.5)
    return _forecasts(spark, folder).where("as_of_date is not null").select(
        F.col("as_of_date").alias("date"), F.col("canonical_match_id").alias("id"), F.lit(0.5).alias("stake"), profit.alias("profit"), *further
    )


@query(f"WITH {_RESULTS} SELECT id, profit, round(cumulative, 6) AS cumulative, round(peak, 6) AS peak, round(peak - cumulative, 6) AS drawdown FROM k")
def wn10_equity(spark, folder):
    return M.equity_curve(_results(spark, folder)).select("id", "profit", _round("cumulative"), _round("peak"), _round("drawdown"))


@query(f"WITH {_RESULTS} SELECT count(*) AS n, count(*) FILTER (profit > 0) AS wins, round(sum(profit), 6) AS net, round(max(staked)::DOUBLE, 6) AS staked, round(max(peak - cumulative), 6) AS max_drawdown FROM k")
def ag12_summary(spark, folder):
    return M.equity_summary(_results(spark, folder)).select("n", "wins", _round("net"), _round("staked"), _round("max_drawdown"))


@query()
def ag13_bootstrap(spark, folder):
    return M.bootstrap_mean(_results(spark, folder), "profit")


@query(f"WITH {_FORECASTS} SELECT surface, round(quantile_cont(p, 0.05), 6) AS low, round(quantile_cont(p, 0.5), 6) AS middle, round(quantile_cont(p, 0.95), 6) AS high FROM f GROUP BY surface")
def ag14_quantiles(spark, folder):
    p = lambda q, n: F.round(F.percentile("p", q), 6).alias(n)
    return _forecasts(spark, folder).groupBy("surface").agg(p(0.05, "low"), p(0.5, "middle"), p(0.95, "high"))


_NUMERIC = ("elo_diff", "ace_rate_diff", "h2h_win_rate_diff")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, count(*) - count({c}) AS nulls FROM modeling_rows" for c in _NUMERIC))
def ml01_preprocess_stats(spark, folder):
    from rallyframe.ml.preprocess import numeric_statistics

    return numeric_statistics(table(spark, folder, "modeling_rows"), list(_NUMERIC)).select("feature", _round("median"), _round("mean"), _round("sd"), "nulls")


@query("""SELECT 'surface' AS feature, arg_max(surface, n * 1000 - ascii(surface)) AS mode FROM (SELECT surface, count(*) AS n FROM modeling_rows WHERE surface IS NOT NULL GROUP BY 1)""")
def ag20_most_frequent(spark, folder):
    from rallyframe.ml.preprocess import most_frequent

    return most_frequent(table(spark, folder, "modeling_rows"), ["surface"])


@query(f"""WITH {_FORECASTS} SELECT canonical_match_id, rank() OVER (ORDER BY p DESC, canonical_match_id) AS place FROM f""")
def st04_ranked(spark, folder):
    rows = _forecasts(spark, folder).select("canonical_match_id", "p")
    return global_rank(rows, [F.desc("p"), F.asc("canonical_match_id")], "place").drop("p")


# ---- models (no SQL equivalent) ----------------------------------------------

# Columns of modeling_rows that are keys, lineage or not to be trusted, so no features.
NO_FEATURES = (
    "feature_version", "canonical_match_id", "player_a_id", "player_b_id", "as_of_date", "player_a_side", "player_b_side", "player_a_rank", "player_b_rank", "rank_diff",
)


def _modeling(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], list[str]]:
    """Dataset with its splits, and its numeric and categorical features: every column that is no key."""
    from rallyframe.ml.dataset import split_of
    from rallyframe.ml.preprocess import feature_groups

    given = table(spark, folder, "modeling_rows")
    numeric, categorical = feature_groups(given, [*NO_FEATURES, *[c for c in given.columns if c.startswith("lineage_")]])
    columns = ["as_of_date", "player_a_rank", "player_b_rank", "rank_diff", *[c for c in (*numeric, *categorical) if c != "elo_diff"]]
    rows = _dataset(spark, folder, columns).where("as_of_date is not null")
    # of repeated rows that differ one stands for its match
    rows = R.holds(rows, ["canonical_match_id"], [F.col("player_a_id")])
    return materialize(rows.withColumn("split", split_of(F.col("as_of_date"), "20141231", "20181231"))), numeric, categorical


def _fitted(rows: DataFrame, numeric: list[str], categorical: list[str], family: str, calibrator: str, trees: int = 400):
    from rallyframe.ml import models

    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    if family == "gradient_boosted_trees":
        train = train.join(_tail(train).withColumn("is_tail", F.lit(True)), "canonical_match_id", "left").fillna({"is_tail": False})
    fitted = models.fit(train, numeric, categorical, family, trees=trees)
    return fitted, (models.platt if calibrator == "sigmoid" else models.isotonic)(fitted.score(validation))


def _predictions(spark: SparkSession, folder: str, family: str, calibrator: str = "sigmoid") -> DataFrame:
    from rallyframe.ml.replay import predicted

    rows, numeric, categorical = _modeling(spark, folder)
    test = rows.where("split = 'test'")
    listed = global_rank(test.select("canonical_match_id"), [F.asc("canonical_match_id")], "pos")
    return predicted(*_fitted(rows, numeric, categorical, family, calibrator), test, listed, family)


@query()
def ml02_logistic_regression(spark, folder):
    return _predictions(spark, folder, "logistic_regression")


@query()
def ml03_random_forest(spark, folder):
    return _predictions(spark, folder, "random_forest")


@query()
def ml04_boosted_trees(spark, folder):
    return _predictions(spark, folder, "gradient_boosted_trees")


@query()
def ml07_isotonic(spark, folder):
    return _predictions(spark, folder, "logistic_regression", "isotonic")


@query("SELECT 0::BIGINT AS differing, true AS complete")
def ml10_replay(spark, folder):
    """A saved bundle, loaded and replayed over the listed test matches, repeats the saved predictions exactly."""
    from uuid import uuid4

    from rallyframe.ml.registry import load_bundle, write_bundle
    from rallyframe.ml.replay import predicted, replay
    from rallyframe.util import shared_dir

    rows, numeric, categorical = _modeling(spark, folder)
    test = rows.where("split = 'test'")
    listed = global_rank(test.select("canonical_match_id"), [F.desc("canonical_match_id")], "pos")
    fitted, calibrator = _fitted(rows, numeric, categorical, "logistic_regression", "isotonic")
    saved = materialize(predicted(fitted, calibrator, test, listed))
    bundle = write_bundle(f"{shared_dir(spark)}/bundles/{uuid4().hex}", fitted, calibrator, "v1", "s1", {})
    again = replay(*load_bundle(bundle, "v1", "s1")[:2], test, saved)
    return again.agg(F.count(F.lit(1)).alias("differing")).withColumn("complete", F.lit(saved.count() == test.count()))


@query()
def ml11_metric_bundle(spark, folder):
    rows = materialize(_predictions(spark, folder, "logistic_regression").select("y", F.col("calibrated_probability").alias("p")))
    point = M.point_metrics(rows)
    # forecasts that all are null (no validation rows) have no calibration error, not one of 0
    known = point.select(((F.col("n") == 0) | F.col("brier").isNotNull()).alias("_known"))
    error = M.calibration_error(rows).crossJoin(F.broadcast(known)).select(F.when(F.col("_known"), F.col("ece")).alias("ece"))
    parts = [point, error, M.roc_auc(rows)]
    long = [part.select(F.expr(f"stack({len(part.columns)}, {', '.join(f"'{c}', double({c})" for c in part.columns)}) as (metric, value)")) for part in parts]
    return long[0].unionAll(long[1]).unionAll(long[2])


# ---- lookups between evidence, books and forecasts ---------------------------


@query(f"""WITH {_FORECASTS}, e AS (SELECT canonical_match_id, market_ticker FROM market_mapping_evidence WHERE canonical_match_id IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY canonical_match_id ORDER BY collected_at_utc DESC, market_ticker DESC) = 1)
 SELECT DISTINCT f.canonical_match_id, e.market_ticker, round(f.p, 6) AS p FROM f JOIN e USING (canonical_match_id)""")
def jn09_last_market(spark, folder):
    evidence = table(spark, folder, "market_mapping_evidence").where("canonical_match_id is not null").select("canonical_match_id", "market_ticker", "collected_at_utc")
    last = R.holds(evidence, ["canonical_match_id"], [F.col("collected_at_utc"), F.col("market_ticker")]).drop("collected_at_utc")
    return _forecasts(spark, folder).select("canonical_match_id", _round("p")).join(last, "canonical_match_id").distinct()


@query(f"""SELECT e.market_ticker, b.request_id, CASE WHEN b.request_id IS NULL THEN 'missing_orderbook_snapshot' ELSE 'found' END AS status
 FROM (SELECT DISTINCT market_ticker FROM market_mapping_evidence) e LEFT JOIN (SELECT ticker, request_id FROM kalshi_orderbook_snapshots
   WHERE ticker IS NOT NULL QUALIFY {_LATEST}) b ON b.ticker = e.market_ticker""")
def jn10_missing_books(spark, folder):
    asked = table(spark, folder, "market_mapping_evidence").select(F.col("market_ticker").alias("ticker")).distinct()
    books = _latest(table(spark, folder, "kalshi_orderbook_snapshots").select("ticker", "request_id", "collected_at_utc", "response_index"))
    out = asked.join(books.select("ticker", "request_id"), "ticker", "left")
    status = F.when(F.col("request_id").isNull(), "missing_orderbook_snapshot").otherwise("found")
    return out.select(F.col("ticker").alias("market_ticker"), "request_id", status.alias("status"))


@query(f"""WITH {_FORECASTS} SELECT CASE WHEN f.canonical_match_id IS NULL THEN 'missing_prediction' ELSE 'found' END AS status, count(*) AS n
 FROM (SELECT DISTINCT market_ticker, canonical_match_id FROM market_mapping_evidence WHERE canonical_match_id IS NOT NULL) e
 LEFT JOIN (SELECT DISTINCT canonical_match_id FROM f) f USING (canonical_match_id) GROUP BY 1""")
def jn11_missing_predictions(spark, folder):
    asked = table(spark, folder, "market_mapping_evidence").where("canonical_match_id is not null").select("market_ticker", "canonical_match_id").distinct()
    known = _forecasts(spark, folder).select("canonical_match_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), "missing_prediction").otherwise("found")
    return asked.join(known, "canonical_match_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MATCHES} SELECT DISTINCT e.market_ticker, list_sort([e.yes_canonical_player_id, e.no_canonical_player_id]) = list_sort([m.winner_canonical_player_id, m.loser_canonical_player_id]) AS agrees
 FROM market_mapping_evidence e JOIN m USING (canonical_match_id) WHERE e.yes_canonical_player_id IS NOT NULL AND e.no_canonical_player_id IS NOT NULL""")
def jn16_pair_agreement(spark, folder):
    evidence = table(spark, folder, "market_mapping_evidence").where("yes_canonical_player_id is not null and no_canonical_player_id is not null")
    evidence = evidence.select("market_ticker", "canonical_match_id", F.array_sort(F.array("yes_canonical_player_id", "no_canonical_player_id")).alias("sides"))
    met = _matches(spark, folder).select("canonical_match_id", F.array_sort(F.array("winner_canonical_player_id", "loser_canonical_player_id")).alias("players"))
    return evidence.join(met, "canonical_match_id").select("market_ticker", (F.col("sides") == F.col("players")).alias("agrees")).distinct()


@query("""SELECT count(*) AS n, count(*) FILTER (mapping_state = 'matched') AS matched, count(*) FILTER (yes_canonical_player_id IS NULL) AS open_names,
 count(*) FILTER (collected_at_utc < TIMESTAMP '2024-01-01 00:00:00') AS older FROM market_mapping_evidence""")
def ag19_conditional_counts(spark, folder):
    old = F.col("collected_at_utc") < F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return table(spark, folder, "market_mapping_evidence").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapping_state") == "matched").alias("matched"),
        F.count_if(F.col("yes_canonical_player_id").isNull()).alias("open_names"), F.count_if(old).alias("older"),
    )


_SIDE = "CASE WHEN coalesce(yes_best_price_dollars, -1) > coalesce(no_best_price_dollars, -1) THEN 'yes' WHEN coalesce(yes_best_price_dollars, -1) < coalesce(no_best_price_dollars, -1) THEN 'no' WHEN coalesce(yes_best_quantity_fp, 0) >= coalesce(no_best_quantity_fp, 0) THEN 'yes' ELSE 'no' END"


@query(f"SELECT DISTINCT request_id, {_SIDE} AS side, (1 - no_best_price_dollars)::DOUBLE AS complement FROM kalshi_orderbook_snapshots")
def st07_best_side(spark, folder):
    price = lambda s: F.coalesce(F.col(f"{s}_best_price_dollars"), F.lit(-1).cast("decimal(18,4)"))
    size = lambda s: F.coalesce(F.col(f"{s}_best_quantity_fp"), F.lit(0).cast("decimal(18,4)"))
    side = F.when(price("yes") > price("no"), "yes").when(price("yes") < price("no"), "no").when(size("yes") >= size("no"), "yes").otherwise("no")
    rows = table(spark, folder, "kalshi_orderbook_snapshots")
    return rows.select("request_id", side.alias("side"), (F.lit(1).cast("decimal(18,4)") - F.col("no_best_price_dollars")).cast("double").alias("complement")).distinct()


@query(f"WITH {_FORECASTS} SELECT canonical_match_id, printf('%.1f%%', 100 * round(p, 3)) AS shown, as_of_date[1:4] AS year FROM f")
def sf21_formats(spark, folder):
    rows = _forecasts(spark, folder)
    return rows.select("canonical_match_id", text.percent(F.round("p", 3)).alias("shown"), F.substring("as_of_date", 1, 4).alias("year"))


@query("""SELECT feature_version, count(DISTINCT lineage_source_repo) AS repos, count(DISTINCT lineage_source_commit_sha) AS commits FROM modeling_rows GROUP BY 1""")
def pf13_source_values(spark, folder):
    return table(spark, folder, "modeling_rows").groupBy("feature_version").agg(
        F.countDistinct("lineage_source_repo").alias("repos"), F.countDistinct("lineage_source_commit_sha").alias("commits")
    )
