"""Named queries of ratings, audits and the whole feature build, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import history as H
from rallyframe.plans.reference import (
    _MATCHES, _PLAYERS, _RANKED, _SEQ, QUERIES, _delivered_stats, _form_sql, _matches, _players, _round, query,
)
from rallyframe.plans.sql_records import STATS_SQL
from rallyframe.sources.tables import table
from rallyframe.util import materialize

# ---- ratings: a recursion over numbered matches that carries one list of ratings ----


def _elo_sql(group: str, result: str) -> str:
    own = f"coalesce(surface, '') || '|' || " if group else ""
    gain = "32 * (1 - 1 / (1 + pow(10, (s.r[e.l] - s.r[e.w]) / 400)))"
    loss = "32 / (1 + pow(10, (s.r[e.w] - s.r[e.l]) / 400))"
    return f"""WITH RECURSIVE {_MATCHES},
 q AS (SELECT *, {own}winner_canonical_player_id AS a, {own}loser_canonical_player_id AS b, row_number() OVER (ORDER BY {_SEQ}) AS k FROM m),
 p AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM q UNION SELECT b FROM q)),
 e AS (SELECT q.k, x.i AS w, y.i AS l FROM q JOIN p x ON x.id = q.a JOIN p y ON y.id = q.b),
 s AS (SELECT 0::BIGINT AS k, list_transform(range((SELECT count(*) FROM p)), lambda x: 1500.0::DOUBLE) AS r,
         NULL::DOUBLE AS wa, NULL::DOUBLE AS wb, NULL::DOUBLE AS la, NULL::DOUBLE AS lb
       UNION ALL
       SELECT e.k, list_transform(s.r, lambda x, i: CASE WHEN i = e.l THEN x - {loss} WHEN i = e.w THEN x + {gain} ELSE x END),
         s.r[e.w], s.r[e.w] + {gain}, s.r[e.l], s.r[e.l] - {loss}
       FROM s JOIN e ON e.k = s.k + 1),
 t AS (SELECT q.*, s.wa, s.wb, s.la, s.lb FROM q JOIN s USING (k)),
 u AS (SELECT {_SEQ}, cohort, surface, winner_canonical_player_id AS player, wa AS pre, wb AS post FROM t
       UNION ALL SELECT {_SEQ}, cohort, surface, loser_canonical_player_id, la, lb FROM t)
 {result}"""


_BEFORE_COHORT = "first_value(pre) OVER (PARTITION BY player, cohort{} ORDER BY " + _SEQ + ")"


@query(_elo_sql("", f"SELECT canonical_match_id, player, round({_BEFORE_COHORT.format('')}, 6) AS elo FROM u"))
def wn04_elo(spark, folder):
    matches = _matches(spark, folder)
    return H.elo_before(H.player_rows(matches), matches).select("canonical_match_id", "player", _round("elo"))


@query(_elo_sql("surface", f"SELECT canonical_match_id, player, coalesce(surface, '') AS surface, round({_BEFORE_COHORT.format(', surface')}, 6) AS elo FROM u"))
def wn05_surface_elo(spark, folder):
    matches = _matches(spark, folder).withColumn("surface", F.coalesce("surface", F.lit("")))
    return H.elo_before(H.player_rows(matches), matches, "surface").select("canonical_match_id", "player", "surface", _round("elo"))


@query(_elo_sql("", "SELECT canonical_match_id, round(wa, 6) AS winner_pre, round(wb, 6) AS winner_post, round(la, 6) AS loser_pre, round(lb, 6) AS loser_post FROM t"))
def wn13_elo_audit(spark, folder):
    fold = H.elo_fold(_matches(spark, folder))
    return fold.select("canonical_match_id", *[_round(c) for c in ("winner_pre", "winner_post", "loser_pre", "loser_post")])


# ---- audits in match order ----

def _values(rows):
    counts = [F.col(c).cast("double").alias(c) for c in ("pre_count", "post_count")]
    return rows.select("canonical_match_id", "player", "metric", _round("pre_value"), _round("post_value"), *counts)


def _form_audit_sql(k: int) -> str:
    w = "OVER (PARTITION BY player ORDER BY {} ROWS BETWEEN {} PRECEDING AND {})"
    pre, post = w.format(_SEQ, k, "1 PRECEDING"), w.format(_SEQ, k - 1, "CURRENT ROW")
    return f"""SELECT canonical_match_id, player, 'form_last_{k}_win_rate' AS metric, round(avg(won) {pre}, 6) AS pre_value,
      round(avg(won) {post}, 6) AS post_value, (count(won) {pre})::DOUBLE AS pre_count, (count(won) {post})::DOUBLE AS post_count FROM r"""


@query(f"WITH {_PLAYERS} {' UNION ALL '.join(_form_audit_sql(k) for k in H.FORM_WINDOWS)}")
def wn13_form_audit(spark, folder):
    return _values(H.form_audit(_players(spark, folder)))


@query(f"""WITH {_PLAYERS}, k AS (SELECT *, least(player, opponent) || '::' || greatest(player, opponent) AS pair FROM r WHERE player <> opponent),
 o AS (SELECT *, count(*) OVER b - 1 AS n, sum(won) OVER b - won AS s FROM k WINDOW b AS (PARTITION BY pair, player ORDER BY {_SEQ} ROWS UNBOUNDED PRECEDING))
 SELECT canonical_match_id, player, 'head_to_head_win_rate' AS metric, CASE WHEN n >= {H.PAIR_SAMPLE} THEN round(s / n, 6) END AS pre_value,
   CASE WHEN n + 1 >= {H.PAIR_SAMPLE} THEN round((s + won) / (n + 1), 6) END AS post_value, n::DOUBLE AS pre_count, (n + 1)::DOUBLE AS post_count FROM o
 UNION ALL SELECT canonical_match_id, player, 'head_to_head_match_count', n, n + 1, NULL, NULL FROM o""")
def wn13_pair_audit(spark, folder):
    return _values(H.pair_audit(_players(spark, folder)))


_WITH_STATS = f"""{_PLAYERS}, {STATS_SQL},
 v AS (SELECT r.*, CASE WHEN won = 1 THEN f1 ELSE f2 END AS f, CASE WHEN won = 1 THEN s1 ELSE s2 END AS s, CASE WHEN won = 1 THEN f2 ELSE f1 END AS fa,
         CASE WHEN won = 1 THEN s2 ELSE s1 END AS sa, CASE WHEN won = 1 THEN a1 ELSE a2 END AS a, s1 IS NOT NULL AND s2 IS NOT NULL AS usable
       FROM r LEFT JOIN stats ON stats.path = replace(r.lineage_source_file_path, 'atp_matches_', 'atp_matchstats_') AND stats.line = r.lineage_source_row_number),
 c AS (SELECT {_SEQ}, player, opponent, cohort, won, usable, usable::INT AS m, CASE WHEN usable THEN coalesce(f, 0) ELSE 0 END AS f, CASE WHEN usable THEN s ELSE 0 END AS s,
         CASE WHEN usable THEN coalesce(fa, 0) ELSE 0 END AS fa, CASE WHEN usable THEN sa ELSE 0 END AS sa, CASE WHEN usable THEN coalesce(a, 0) ELSE 0 END AS a,
         (usable AND a IS NULL)::INT AS x FROM v),
 o AS (SELECT *, {", ".join(f"sum({c}) OVER b - {c} AS {c}0, sum({c}) OVER b AS {c}1" for c in ("m", "f", "s", "fa", "sa", "a", "x"))} FROM c
       WINDOW b AS (PARTITION BY player ORDER BY {_SEQ} ROWS UNBOUNDED PRECEDING))"""


def _rate_audit(name: str, top: str, below: str, complete: bool = False) -> str:
    rate = lambda n: f"CASE WHEN {f'x{n} = 0 AND ' if complete else ''}{below}{n} <> 0 THEN round({top}{n} / {below}{n}, 6) END"
    return f"SELECT canonical_match_id, player, '{name}' AS metric, {rate(0)} AS pre_value, {rate(1)} AS post_value, {below}0::DOUBLE AS pre_count, {below}1::DOUBLE AS post_count FROM o WHERE usable"


@query(f"""WITH {_WITH_STATS} {_rate_audit("service_first_won_rate", "f", "s")} UNION ALL {_rate_audit("return_first_won_allowed_rate", "fa", "sa")}
 UNION ALL {_rate_audit("ace_rate", "a", "s", True)} UNION ALL SELECT canonical_match_id, player, 'stats_match_count', m0, m1, NULL, NULL FROM o WHERE usable""")
def wn13_stats_audit(spark, folder):
    rows = materialize(H.with_match_stats(_players(spark, folder), _delivered_stats(spark, folder)))
    return _values(H.stats_audit(rows))


@query(f"""WITH {_WITH_STATS}, d AS (SELECT *, {", ".join(f"first_value({c}0) OVER k AS {c}b" for c in ("m", "f", "s", "fa", "sa", "a", "x"))} FROM o
       WINDOW k AS (PARTITION BY player, cohort ORDER BY {_SEQ}))
 SELECT canonical_match_id, player, CASE WHEN usable THEN f END::DOUBLE AS first_won, CASE WHEN usable THEN s END::DOUBLE AS served, mb = 0 AS stats_missing, mb > 0 AND sb < {H.STAT_SAMPLE} AS stats_low_sample,
   CASE WHEN sb >= {H.STAT_SAMPLE} THEN round(fb / sb, 6) END AS service_rate, CASE WHEN sb >= {H.STAT_SAMPLE} AND sab <> 0 THEN round(fab / sab, 6) END AS return_allowed_rate,
   CASE WHEN sb >= {H.STAT_SAMPLE} AND xb = 0 THEN round(ab / sb, 6) END AS ace_rate FROM d""")
def jn03_match_stats(spark, folder):
    """Serve statistics of delivered files, looked up by file name and line of each match."""
    rows = H.stats_before(materialize(H.with_match_stats(_players(spark, folder), _delivered_stats(spark, folder))))
    first_won = F.when(F.col("stat_matches") == 1, F.coalesce("first_won", F.lit(0)).cast("double")).alias("first_won")
    rates = [_round(c) for c in ("service_rate", "return_allowed_rate", "ace_rate")]
    return rows.select("canonical_match_id", "player", first_won, F.col("served").cast("double").alias("served"), "stats_missing", "stats_low_sample", *rates)


# ---- the whole build ----

_FORM = (5, 10, 20)
_BUILD = f"""WITH {_WITH_STATS}, {_RANKED},
 d AS (SELECT *, {", ".join(f"first_value({c}0) OVER k AS {c}b" for c in ("m", "f", "s", "fa", "sa", "a", "x"))} FROM o WINDOW k AS (PARTITION BY player, cohort ORDER BY {_SEQ})),
 st AS (SELECT canonical_match_id, player, won, CASE WHEN sb >= {H.STAT_SAMPLE} THEN fb / sb END AS service_rate, CASE WHEN sb >= {H.STAT_SAMPLE} AND sab <> 0 THEN fab / sab END AS return_allowed_rate,
         CASE WHEN sb >= {H.STAT_SAMPLE} AND xb = 0 THEN ab / sb END AS ace_rate FROM d),
 fw AS (SELECT *, {", ".join(_form_sql(k) for k in _FORM)} FROM r),
 fo AS (SELECT canonical_match_id, player, won, {", ".join(f"first_value(s{k}) OVER c / nullif(first_value(n{k}) OVER c, 0)::DOUBLE AS form_{k}_win_rate" for k in _FORM)} FROM fw
        WINDOW c AS (PARTITION BY player, cohort ORDER BY {_SEQ})),
 dt AS (SELECT DISTINCT player, cohort, tourney_date, round_order FROM r),
 lb AS (SELECT player, cohort, max(tourney_date) OVER (PARTITION BY player ORDER BY tourney_date, round_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_date FROM dt),
 rk AS (SELECT r.canonical_match_id, r.player, r.won, r.cohort, r.tourney_date, k.rank, k.points, k.rank - k.previous_rank AS rank_change
        FROM r ASOF LEFT JOIN (SELECT l.points, z.* FROM k z JOIN l USING (player, ranking_date)) k ON r.player = k.player AND r.tourney_date >= k.ranking_date),
 hh AS (SELECT *, least(player, opponent) || '::' || greatest(player, opponent) AS pair FROM r WHERE player <> opponent),
 hw AS (SELECT *, count(*) OVER b AS n, sum(won) OVER b AS w FROM hh WINDOW b AS (PARTITION BY pair, player ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ho AS (SELECT canonical_match_id, player, won, first_value(n) OVER c AS met, coalesce(first_value(w) OVER c, 0) AS wins FROM hw WINDOW c AS (PARTITION BY pair, player, cohort ORDER BY {_SEQ})),
 z AS (SELECT rk.canonical_match_id, rk.player, rk.won, rk.rank, rk.points, rk.rank_change, form_5_win_rate, form_10_win_rate, form_20_win_rate, service_rate, return_allowed_rate, ace_rate,
         date_diff('day', strptime(last_date, '%Y%m%d')::DATE, strptime(rk.tourney_date, '%Y%m%d')::DATE) AS rest_days, met, CASE WHEN met >= {H.PAIR_SAMPLE} THEN wins / met END AS h2h_win_rate
       FROM rk JOIN fo USING (canonical_match_id, player, won) JOIN st USING (canonical_match_id, player, won) JOIN ho USING (canonical_match_id, player, won) JOIN lb ON lb.player = rk.player AND lb.cohort = rk.cohort)"""
_BUILT = (
    "form_5_win_rate", "form_10_win_rate", "form_20_win_rate", "rest_days", "rank", "points", "rank_change", "h2h_win_rate", "service_rate", "return_allowed_rate", "ace_rate",
)


@query(f"""{_BUILD} SELECT a.canonical_match_id, a.player AS player_a, b.player AS player_b, m.tourney_date AS as_of_date, m.surface, m.tourney_level, m.round_name, m.best_of::DOUBLE AS best_of,
  {", ".join(f"round((a.{c} - b.{c})::DOUBLE, 6) AS {c}_diff" for c in _BUILT)}, a.met AS h2h_match_count
  FROM z a JOIN z b ON a.canonical_match_id = b.canonical_match_id AND a.won = 1 AND b.won = 0 JOIN m ON m.canonical_match_id = a.canonical_match_id""")
def pf11_all_differences(spark, folder):
    """The build of ``dc06_feature_build`` without its two rating differences, which ``wn04_elo`` and ``wn05_surface_elo`` state."""
    built = QUERIES["dc06_feature_build"](spark, folder)
    passed = ["as_of_date", "surface", "tourney_level", "round_name", F.col("best_of").cast("double").alias("best_of")]
    return built.select("canonical_match_id", "player_a", "player_b", *passed, *[_round(f"{c}_diff") for c in _BUILT], "h2h_match_count")


_SIDES = ("form_5_win_rate", "rank", "rest_days", "h2h_win_rate", "service_rate", "ace_rate")


@query(f"""{_BUILD} SELECT a.canonical_match_id, m.tourney_date, m.surface, a.player AS player_a_player, b.player AS player_b_player,
  {", ".join(f"round({s}.{c}::DOUBLE, 6) AS player_{s}_{c}" for s in "ab" for c in _SIDES)}
  FROM z a JOIN z b ON a.canonical_match_id = b.canonical_match_id AND a.won = 1 AND b.won = 0 JOIN m ON m.canonical_match_id = a.canonical_match_id""")
def pf08_side_rows(spark, folder):
    from rallyframe.plans.pipelines import feature_tables

    rows = feature_tables(table(spark, folder, "canonical_matches"), table(spark, folder, "canonical_rankings"), _delivered_stats(spark, folder))["side_rows"]
    return rows.select("canonical_match_id", "tourney_date", "surface", "player_a_player", "player_b_player", *[_round(f"player_{s}_{c}") for s in "ab" for c in _SIDES])


@query(f"""WITH {_PLAYERS}, k AS (SELECT *, least(player, opponent) || '::' || greatest(player, opponent) AS pair FROM r WHERE player <> opponent),
 o AS (SELECT *, count(*) OVER b AS n, sum(won) OVER b AS s FROM k WINDOW b AS (PARTITION BY pair, player ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT canonical_match_id, player, first_value(n) OVER w AS n, first_value(s) OVER w AS s FROM o WINDOW w AS (PARTITION BY pair, player, cohort ORDER BY {_SEQ}))
 SELECT canonical_match_id, player, n = 0 AS h2h_missing, n > 0 AND n < {H.PAIR_SAMPLE} AS h2h_low_sample, CASE WHEN n >= {H.PAIR_SAMPLE} THEN round(s / n, 6) END AS h2h_win_rate FROM c""")
def pf26_pair_gates(spark, folder):
    rows = H.pair_rate(H.head_to_head(_players(spark, folder).where("player <> opponent")))
    return rows.select("canonical_match_id", "player", "h2h_missing", "h2h_low_sample", _round("h2h_win_rate"))
