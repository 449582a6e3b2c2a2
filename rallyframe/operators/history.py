"""Chronological state of entities before each match: cohorts, form, rest, sums, ratings.

A cohort is all matches of one date and round.  What a match may know is the
state before its cohort; within a cohort the order (date, round, file, row)
only matters for audits.  Windows run per (entity, year) with the earlier years
folded into one carried row, so a busy entity is spread over its years.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Rounds in the order they are played.
ROUNDS = ("RR", "BR", "R128", "R64", "R32", "R16", "QF", "SF", "F", "ER")
ELO_START, ELO_STEP, ELO_SCALE = 1500.0, 32.0, 400.0
FORM_WINDOWS = (5, 10, 20)
SEQ = ("tourney_date", "round_order", "lineage_source_file_path", "lineage_source_row_number", "canonical_match_id")


def round_order(name: Column, strict: bool = True) -> Column:
    """Place of a round in play order; an unknown one raises (or is null if not ``strict``)."""
    out = None
    for n, r in enumerate(ROUNDS):
        out = F.when(F.trim(name) == r, n) if out is None else out.when(F.trim(name) == r, n)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown round: "), F.coalesce(name, F.lit("null"))))) if strict else out


MATCH_COLUMNS = (
    "canonical_match_id", "winner_canonical_player_id", "loser_canonical_player_id", "surface", "tourney_date", "round_name",
    "lineage_source_snapshot_root", "lineage_source_file_path", "lineage_source_row_number",
)


def one_row_per_match(matches: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Complete matches, each once (its first delivery), with ``round_order`` and ``cohort``.

    Only the columns that histories need, and ``extra`` ones, are read.
    """
    from rallyframe.operators.relational import holds

    matches = matches.select(*MATCH_COLUMNS, *extra)
    known = matches.where(
        "canonical_match_id is not null and winner_canonical_player_id is not null "
        "and loser_canonical_player_id is not null and tourney_date is not null and round_name is not null"
    )
    first = ["lineage_source_snapshot_root", "lineage_source_file_path", "lineage_source_row_number"]
    once = holds(known, ["canonical_match_id"], [F.col(c) for c in first], last=False)
    once = once.withColumn("round_order", round_order(F.col("round_name")))
    return once.withColumn("cohort", F.concat_ws(":", "tourney_date", F.col("round_order").cast("string")))


def player_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match: player, opponent, won, and the order columns."""
    keep = [*SEQ, "cohort", "surface"]
    side = F.explode(
        F.array(
            F.struct(F.col("winner_canonical_player_id").alias("player"), F.col("loser_canonical_player_id").alias("opponent"), F.lit(1).alias("won")),
            F.struct(F.col("loser_canonical_player_id").alias("player"), F.col("winner_canonical_player_id").alias("opponent"), F.lit(0).alias("won")),
        )
    )
    return matches.select(*keep, side.alias("s")).select(*keep, "s.*").withColumn("year", F.substring("tourney_date", 1, 4).cast("int"))


def cohorts(matches: DataFrame) -> DataFrame:
    """Numbered cohorts: tourney_date, round_order, cohort_index, matches."""
    sizes = matches.groupBy("tourney_date", "round_order").agg(F.count(F.lit(1)).alias("matches"))
    # one row per (date, round): bounded by the calendar, not by the matches
    return sizes.withColumn("cohort_index", F.row_number().over(W.orderBy("tourney_date", "round_order")).cast("bigint"))


def sums_before(rows: DataFrame, key: list[str], period: str, cohort: str, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over the key's rows before the row's cohort (``<name>_before``).

    Nulls count as 0.  Sums of earlier periods are carried as one row per
    (key, period); a task's window holds one key's rows of one period.
    """
    total = rows.groupBy(*key, period).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_{c}") for c in sums])
    earlier = W.partitionBy(*key).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    carried = total.select(*key, period, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = W.partitionBy(*key, period).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    opening = W.partitionBy(*key, period, cohort).orderBy(*order)
    out = rows
    for c in sums:
        out = out.withColumn(f"_run_{c}", F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0)))
    for c in sums:
        out = out.withColumn(f"_run_{c}", F.first(f"_run_{c}").over(opening))
    out = out.join(carried, [*key, period])
    return out.select(*rows.columns, *[(F.col(f"_run_{c}") + F.col(f"_{c}")).alias(f"{c}_before") for c in sums])


def last_date_before(rows: DataFrame) -> DataFrame:
    """Player rows with ``last_date``, the player's latest date in an earlier cohort, and ``rest_days``."""
    dates = rows.select("player", "cohort", "tourney_date", "round_order").distinct()
    before = W.partitionBy("player").orderBy("tourney_date", "round_order").rowsBetween(W.unboundedPreceding, -1)
    known = dates.withColumn("last_date", F.max("tourney_date").over(before)).select("player", "cohort", "last_date")
    day = lambda c: F.to_date(c, "yyyyMMdd")
    return rows.join(known, ["player", "cohort"]).withColumn("rest_days", F.datediff(day("tourney_date"), day("last_date")))


def recent_form(rows: DataFrame, windows: tuple[int, ...] = FORM_WINDOWS, cohort: str = "cohort", after: bool = False) -> DataFrame:
    """Player rows with win rate and count of the last k results before the cohort (null rate where none).

    With ``after`` also those that include the row's own result.
    """
    longest = max(windows)
    inside = W.partitionBy("player", "year").orderBy(*SEQ).rowsBetween(-longest, -1)
    opening = W.partitionBy("player", "year", cohort).orderBy(*SEQ)
    tails = rows.groupBy("player", "year").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(*SEQ, "won")))), 1, longest).alias("tail")
    )
    tails = tails.withColumn("tail", F.reverse(F.transform("tail", lambda x: x["won"])))
    earlier = W.partitionBy("player").orderBy("year").rowsBetween(-longest, -1)  # every year has a result
    carried = tails.select("player", "year", F.flatten(F.collect_list("tail").over(earlier)).alias("_carried"))
    out = rows.withColumn("_own", F.collect_list("won").over(inside)).withColumn("_own", F.first("_own").over(opening))
    out = out.join(carried, ["player", "year"]).withColumn("_seen", F.concat("_carried", "_own"))
    seen = {"": F.col("_seen")} | ({"_after": F.concat("_seen", F.array("won"))} if after else {})
    for k in windows:
        for end, results in seen.items():
            part = F.slice(F.reverse(results), 1, k)
            won = F.aggregate(part, F.lit(0), lambda a, x: a + x)
            out = out.withColumn(f"form_{k}_count{end}", F.size(part).cast("bigint")).withColumn(
                f"form_{k}_win_rate{end}", F.try_divide(won.cast("double"), F.size(part))
            )
    return out.drop("_own", "_carried", "_seen")


def head_to_head(rows: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Player rows with earlier meetings of the pair and the player's wins among them."""
    both = rows.withColumn("pair", F.concat_ws("::", F.least("player", "opponent"), F.greatest("player", "opponent")))
    both = both.withColumn("first_won", (F.col("won") == (F.col("player") < F.col("opponent")).cast("int")).cast("int"))
    one = both.where("player < opponent").withColumn("met", F.lit(1))
    known = sums_before(one, ["pair"], "year", cohort, list(SEQ), ["met", "first_won"])
    known = known.select("canonical_match_id", "pair", "met_before", "first_won_before")
    out = both.join(known, ["canonical_match_id", "pair"])
    wins = F.when(F.col("player") < F.col("opponent"), F.col("first_won_before")).otherwise(F.col("met_before") - F.col("first_won_before"))
    return out.withColumn("h2h_count", F.col("met_before")).withColumn("h2h_wins", wins).drop("pair", "first_won", "met_before", "first_won_before")


def ranking_as_of(rows: DataFrame, rankings: DataFrame) -> DataFrame:
    """Player rows with the latest ranking on or before their date, and the one before that.

    Result columns: rank, points, previous_rank, ranking_date, rank_change,
    ranking_age_days, rank_missing.  Rankings of one date are reduced to the
    last delivered; null players, dates and ranks say nothing.
    """
    from rallyframe.operators.relational import holds

    valid = rankings.where("canonical_player_id is not null and ranking_date is not null and rank is not null")
    order = ["lineage_source_snapshot_root", "lineage_source_file_path", "lineage_source_row_number"]
    valid = valid.select("canonical_player_id", "ranking_date", "rank", "points", *order)
    log = holds(valid, ["canonical_player_id", "ranking_date"], [F.col(c) for c in order])
    by_date = W.partitionBy("player").orderBy("at")  # one row per player and ranking date
    log = log.select(F.col("canonical_player_id").alias("player"), F.col("ranking_date").alias("at"), "rank", "points")
    log = log.withColumn("previous_rank", F.lag("rank").over(by_date))
    state = F.struct("at", "rank", "points", "previous_rank")
    asked = rows.select("player", F.col("tourney_date").alias("at")).distinct()
    both = log.select("player", "at", state.alias("s"), F.lit(0).alias("tag")).unionByName(
        asked.withColumn("tag", F.lit(1)), allowMissingColumns=True
    )
    until = W.partitionBy("player").orderBy("at", "tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = both.withColumn("k", F.last("s", ignorenulls=True).over(until)).where("tag = 1")
    known = known.select("player", F.col("at").alias("tourney_date"), F.col("k.at").alias("ranking_date"), "k.rank", "k.points", "k.previous_rank")
    # a key is a player on one date: no salts, adaptive execution splits the odd hot one
    out = rows.join(known, ["player", "tourney_date"], "left")
    day = lambda c: F.to_date(c, "yyyyMMdd")
    return (
        out.withColumn("rank_change", F.col("rank") - F.col("previous_rank"))
        .withColumn("ranking_age_days", F.datediff(day("tourney_date"), day("ranking_date")))
        .withColumn("rank_missing", F.col("rank").isNull())
    )


def elo_fold(matches: DataFrame, group: str | None = None) -> DataFrame:
    """Ratings before and after each match, in match order: winner_pre, winner_post, loser_pre, loser_post.

    The recurrence runs through all players of a group (a surface, a tour), so
    it is sequential within one; groups run in parallel.  Rows stream through in
    sorted Arrow batches: memory holds one rating per player of the group at hand,
    never the matches.
    """
    name = F.coalesce(F.col(group), F.lit("")) if group else F.lit("all")
    slim = matches.select(name.alias("grp"), *SEQ, F.col("winner_canonical_player_id").alias("winner"), F.col("loser_canonical_player_id").alias("loser"))
    placed = slim.repartition("grp") if group else slim.repartition(1)
    ordered = placed.sortWithinPartitions("grp", *SEQ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict[str, float] = {}
        at = None
        for batch in batches:
            grp, ids = batch.column(0).to_pylist(), batch.column(batch.num_columns - 3)
            out: list[list[float]] = [[], [], [], []]
            for g, w, l in zip(grp, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if g != at:
                    ratings.clear()
                    at = g
                a, b = ratings.get(w, ELO_START), ratings.get(l, ELO_START)
                new_a = a + ELO_STEP * (1 - 1 / (1 + 10 ** ((b - a) / ELO_SCALE)))
                new_b = b - ELO_STEP / (1 + 10 ** ((a - b) / ELO_SCALE))
                ratings[w], ratings[l] = new_a, new_b
                for column, value in zip(out, (a, new_a, b, new_b)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], names=["canonical_match_id", "winner_pre", "winner_post", "loser_pre", "loser_post"])

    schema = "canonical_match_id string, winner_pre double, winner_post double, loser_pre double, loser_post double"
    return ordered.mapInArrow(run, schema)


def elo_before(rows: DataFrame, matches: DataFrame, group: str | None = None, name: str = "elo") -> DataFrame:
    """Player rows with the rating held before the cohort."""
    fold = elo_fold(matches, group)
    pre = rows.join(fold, "canonical_match_id").withColumn("_pre", F.when(F.col("won") == 1, F.col("winner_pre")).otherwise(F.col("loser_pre")))
    keys = ["player", "cohort", *([group] if group else [])]
    opening = W.partitionBy(*keys).orderBy(*SEQ)
    return pre.withColumn(name, F.first("_pre").over(opening)).select(*rows.columns, name)


def differential(sides: DataFrame, columns: list[str]) -> DataFrame:
    """One row per match: winner side minus loser side of ``columns``; a null on either side gives null."""
    a = sides.where("won = 1").select("canonical_match_id", F.col("player").alias("player_a"), F.col("opponent").alias("player_b"), *columns)
    b = sides.where("won = 0").select("canonical_match_id", *[F.col(c).alias(f"_{c}") for c in columns])
    return a.join(b, "canonical_match_id").select(
        "canonical_match_id", "player_a", "player_b", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_diff") for c in columns]
    )


STAT_SAMPLE, PAIR_SAMPLE = 50, 2
_STAT_SUMS = ["first_won", "served", "first_won_against", "served_against", "aces", "stat_matches", "aces_unknown"]


def with_match_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Player rows with the serve statistics of their match (left lookup by file and row).

    ``stats``: lineage_source_file_path (of the statistics file), lineage_source_row_number,
    first_won_player1/2, serve_points_player1/2, ace_player1/2; player 1 is the
    winner.  Of repeated keys the greatest row holds.  A row without serve
    points on either side counts for neither player.
    """
    from rallyframe.operators.relational import holds

    key = ["lineage_source_file_path", "lineage_source_row_number"]
    values = [f"{c}_player{n}" for c in ("first_won", "serve_points", "ace") for n in (1, 2)]
    one = holds(stats.select(*key, *values), key, [F.lit(1)])
    path = F.regexp_replace("lineage_source_file_path", "^atp_matchstats_", "atp_matches_")
    met = rows.join(one.withColumn("lineage_source_file_path", path), key, "left")
    usable = F.col("serve_points_player1").isNotNull() & F.col("serve_points_player2").isNotNull()

    def side(c: str, own: bool) -> Column:
        a, b = F.col(f"{c}_player1"), F.col(f"{c}_player2")
        return F.when(usable, F.when((F.col("won") == 1) == F.lit(own), a).otherwise(b))

    return met.withColumns(
        {
            "first_won": side("first_won", True), "served": side("serve_points", True), "first_won_against": side("first_won", False),
            "served_against": side("serve_points", False), "aces": side("ace", True), "stat_matches": F.when(usable, 1).otherwise(0),
            "aces_unknown": F.when(usable & side("ace", True).isNull(), 1).otherwise(0),
        }
    ).drop(*values)


def stats_before(rows: DataFrame) -> DataFrame:
    """Rates of serve, return and aces before the cohort: null while missing or below ``STAT_SAMPLE`` points."""
    out = sums_before(rows, ["player"], "year", "cohort", list(SEQ), _STAT_SUMS)
    served, against = F.col("served_before"), F.col("served_against_before")
    enough = served >= STAT_SAMPLE
    return out.withColumns(
        {
            "service_rate": F.when(enough, F.try_divide(F.col("first_won_before"), served)),
            "return_allowed_rate": F.when(enough, F.try_divide(F.col("first_won_against_before"), against)),
            "ace_rate": F.when(enough & (F.col("aces_unknown_before") == 0), F.try_divide(F.col("aces_before"), served)),
            "stats_missing": F.col("stat_matches_before") == 0, "stats_low_sample": (F.col("stat_matches_before") > 0) & ~enough,
        }
    )


def pair_rate(rows: DataFrame) -> DataFrame:
    """Head-to-head win rate: null below ``PAIR_SAMPLE`` earlier meetings, with flags for none and too few."""
    met = F.col("h2h_count")
    return rows.withColumns(
        {
            "h2h_win_rate": F.when(met >= PAIR_SAMPLE, F.try_divide(F.col("h2h_wins"), met)),
            "h2h_missing": met == 0, "h2h_low_sample": (met > 0) & (met < PAIR_SAMPLE),
        }
    )


def audit_counts(rows: DataFrame) -> DataFrame:
    """Matches and wins of a player just before and after each match, in match order (also within a cohort)."""
    step = rows.withColumn("played", F.lit(1))
    out = sums_before(step, ["player"], "year", "canonical_match_id", list(SEQ), ["played", "won"])
    parts = [("matches", F.col("played_before"), F.lit(1)), ("wins", F.col("won_before"), F.col("won"))]
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), pre.cast("bigint").alias("pre"), (pre + d).cast("bigint").alias("post")) for n, pre, d in parts])
    return out.select("canonical_match_id", "player", F.inline(metrics))


def _steps(rows: DataFrame, parts: list[tuple[str, Column, Column, Column | None, Column | None]]) -> DataFrame:
    none = F.lit(None).cast("bigint")
    cells = [
        F.struct(
            F.lit(name).alias("metric"), pre.cast("double").alias("pre_value"), post.cast("double").alias("post_value"),
            (none if n is None else n.cast("bigint")).alias("pre_count"), (none if m is None else m.cast("bigint")).alias("post_count"),
        )
        for name, pre, post, n, m in parts
    ]
    return rows.select("canonical_match_id", "player", F.inline(F.array(*cells)))


def form_audit(rows: DataFrame) -> DataFrame:
    """Form just before and after each match, in match order (also within a cohort)."""
    out = recent_form(rows, cohort="canonical_match_id", after=True)
    rate, count = (lambda k, end, what=what: F.col(f"form_{k}_{what}{end}") for what in ("win_rate", "count"))
    return _steps(out, [(f"form_last_{k}_win_rate", rate(k, ""), rate(k, "_after"), count(k, ""), count(k, "_after")) for k in FORM_WINDOWS])


def stats_audit(rows: DataFrame) -> DataFrame:
    """Serve statistics just before and after each match that has any; ``rows`` as from :func:`with_match_stats`."""
    out = sums_before(rows, ["player"], "year", "canonical_match_id", list(SEQ), _STAT_SUMS).where("stat_matches = 1")
    pre = {c: F.col(f"{c}_before") for c in _STAT_SUMS}
    post = {c: F.col(f"{c}_before") + F.coalesce(c, F.lit(0)) for c in _STAT_SUMS}

    def rate(top: str, below: str, complete: bool = False) -> tuple[Column, Column]:
        both = [F.try_divide(x[top], F.nullif(x[below], F.lit(0))) for x in (pre, post)]
        return tuple(F.when(x["aces_unknown"] == 0, r) if complete else r for x, r in zip((pre, post), both))

    return _steps(
        out,
        [
            ("service_first_won_rate", *rate("first_won", "served"), pre["served"], post["served"]),
            ("return_first_won_allowed_rate", *rate("first_won_against", "served_against"), pre["served_against"], post["served_against"]),
            ("ace_rate", *rate("aces", "served", True), pre["served"], post["served"]),
            ("stats_match_count", pre["stat_matches"], post["stat_matches"], None, None),
        ],
    )


def pair_audit(rows: DataFrame) -> DataFrame:
    """Head-to-head record just before and after each match, in match order."""
    out = head_to_head(rows.where("player <> opponent"), "canonical_match_id")
    n, s = F.col("h2h_count"), F.col("h2h_wins")
    rate = lambda wins, met: F.when(met >= PAIR_SAMPLE, F.try_divide(wins.cast("double"), met))
    return _steps(
        out,
        [
            ("head_to_head_win_rate", rate(s, n), rate(s + F.col("won"), n + 1), n, n + 1),
            ("head_to_head_match_count", n, n + 1, None, None),
        ],
    )


def elo_audit(matches: DataFrame) -> DataFrame:
    """Ratings of both players just before and after each match, over all and on its surface."""
    out = None
    for name, group in (("elo_overall", None), ("elo_surface", "surface")):
        fold = elo_fold(matches, group).join(matches.select("canonical_match_id", "winner_canonical_player_id", "loser_canonical_player_id"), "canonical_match_id")
        sides = F.inline(F.array(*[F.struct(F.col(f"{s}_canonical_player_id").alias("player"), F.col(f"{s}_pre").alias("pre"), F.col(f"{s}_post").alias("post")) for s in ("winner", "loser")]))
        part = _steps(fold.select("canonical_match_id", sides), [(name, F.col("pre"), F.col("post"), None, None)])
        out = part if out is None else out.unionByName(part)
    return out


def state_audit(rows: DataFrame, matches: DataFrame, with_stats: DataFrame | None = None) -> DataFrame:
    """Every metric just before and after each match: canonical_match_id, player, metric, pre_value, post_value, pre_count, post_count."""
    parts = [form_audit(rows), pair_audit(rows), elo_audit(matches), *([stats_audit(with_stats)] if with_stats is not None else [])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def side_rows(snapshots: DataFrame, shared: list[str], own: list[str]) -> DataFrame:
    """One row per match: the ``shared`` columns, and each side's ``own`` columns as player_a_..., player_b_...; a is the winner."""
    side = lambda won, p: snapshots.where(F.col("won") == won).select("canonical_match_id", *[F.col(c).alias(f"player_{p}_{c}") for c in own])
    common = snapshots.where("won = 1").select("canonical_match_id", *[c for c in shared if c != "canonical_match_id"])
    return common.join(side(1, "a"), "canonical_match_id").join(side(0, "b"), "canonical_match_id")
