import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import history as H
from rallyframe.plans.pipelines import feature_tables

LINEAGE = "lineage_source_repo string, lineage_source_commit_sha string, lineage_source_file_path string, lineage_source_row_number int, lineage_source_snapshot_root string"
MATCH = f"canonical_match_id string, winner_canonical_player_id string, loser_canonical_player_id string, surface string, tourney_date string, round_name string, {LINEAGE}"
RANKING = f"canonical_ranking_id string, canonical_player_id string, ranking_date string, rank int, points int, {LINEAGE}"
STATS = "lineage_source_file_path string, lineage_source_row_number int, first_won_player1 int, first_won_player2 int, ace_player1 int, ace_player2 int, serve_points_player1 int, serve_points_player2 int"


def matches(spark, rows):
    """rows: (winner, loser, date, round, surface)"""
    data = [(f"m{n}", w, l, s, d, r, "repo", "c", f"atp_matches_{d[:4]}.csv", n + 2, "root") for n, (w, l, d, r, s) in enumerate(rows)]
    return spark.createDataFrame(data, MATCH)


def rankings(spark, rows):
    return spark.createDataFrame([(f"{p}{d}", p, d, k, pts, "r", "c", "f", n, "root") for n, (p, d, k, pts) in enumerate(rows)], RANKING)


def of(frame, player, column):
    return [r[column] for r in frame.where(F.col("player") == player).orderBy("tourney_date", "round_order", "canonical_match_id").collect()]


def test_elo_of_one_cohort_and_surfaces(spark):
    m = H.one_row_per_match(matches(spark, [("a", "b", "20240115", "R32", "Hard"), ("a", "c", "20240115", "R32", "Hard"), ("a", "b", "20240120", "R32", "Clay"), ("a", "b", "20240127", "F", "Hard")]))
    rows = H.player_rows(m)
    over = of(H.elo_before(rows, m), "a", "elo")
    assert over[:2] == [1500.0, 1500.0] and 1500 < over[2] < over[3]
    surface = of(H.elo_before(rows, m, "surface"), "a", "elo")
    assert surface[:3] == [1500.0] * 3 and surface[3] > 1500


def test_form_and_rest(spark):
    games = [("p", "20240101", 1), ("p", "20240105", 0), ("p", "20240110", 1), ("p", "20240115", 1), ("p", "20240120", 0), ("p", "20240125", 1)]
    rows = [("p", f"o{n}", d, "F", "Hard") if w else (f"o{n}", "p", d, "F", "Hard") for n, (_, d, w) in enumerate(games)]
    f = H.last_date_before(H.recent_form(H.player_rows(H.one_row_per_match(matches(spark, rows)))))
    assert of(f, "p", "form_5_count") == [0, 1, 2, 3, 4, 5]
    assert of(f, "p", "form_5_win_rate")[2] == 0.5 and of(f, "p", "form_5_win_rate")[5] == 0.6 and of(f, "p", "form_5_win_rate")[0] is None
    assert of(f, "p", "rest_days") == [None, 4, 5, 5, 5, 5]


def test_stats_and_head_to_head(spark):
    games = [("1", "2"), ("2", "1"), ("1", "2"), ("1", "3"), ("1", "4")]
    stat = [(35, 28, 8, 4, 50, 48), (30, 33, 5, 7, 45, 52), (40, 34, 10, 6, 60, 55), (12, 10, None, None, 20, 18), (25, 22, 6, 3, 38, 40)]
    m = matches(spark, [(w, l, f"202401{10 + n}", "F", "Hard") for n, (w, l) in enumerate(games)])
    stats = spark.createDataFrame([("atp_matchstats_2024.csv", n + 2, *s) for n, s in enumerate(stat)] + [("atp_matchstats_2023.csv", 2, 1, 1, 1, 1, 1, 1)], STATS)
    rows = H.player_rows(H.one_row_per_match(m))
    s = H.stats_before(H.with_match_stats(rows, stats))
    near = lambda got, want: all(g == w or abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True))
    assert near(of(s, "1", "service_rate"), [None, 35 / 50, 68 / 102, 108 / 162, 120 / 182])
    assert near(of(s, "1", "return_allowed_rate"), [None, 28 / 48, 58 / 93, 92 / 148, 102 / 166])
    assert near(of(s, "1", "ace_rate"), [None, 8 / 50, 15 / 102, 25 / 162, None])
    assert of(s, "1", "stats_missing") == [True, False, False, False, False]
    h = H.pair_rate(H.head_to_head(rows))
    assert of(h, "1", "h2h_count") == [0, 1, 2, 0, 0] and of(h, "1", "h2h_wins") == [0, 1, 1, 0, 0]
    assert of(h, "1", "h2h_win_rate") == [None, None, 0.5, None, None]


def test_ranking_as_of_is_inclusive_with_previous(spark):
    rows = H.player_rows(H.one_row_per_match(matches(spark, [("a", "b", "20240120", "F", "Hard"), ("c", "d", "20240115", "F", "Hard")])))
    table = rankings(spark, [("a", "20240101", 12, 1200), ("a", "20240115", 8, 1450), ("a", "20240201", 5, 1700), ("c", "20240108", 14, 1100), ("c", "20240115", 10, 1300), ("c", "20240114", None, 1), (None, "20240101", 1, 1)])
    got = {r.player: r for r in H.ranking_as_of(rows, table).collect()}
    assert (got["a"]["rank"], got["a"].points, got["a"].previous_rank, got["a"].rank_change, got["a"].ranking_age_days) == (8, 1450, 12, -4, 5)
    assert (got["c"]["rank"], got["c"].previous_rank, got["c"].ranking_age_days) == (10, 14, 0)
    assert got["b"].rank_missing and not got["a"].rank_missing


def random_matches(rng, n=120):
    rounds = ("R32", "QF", "F")
    return [(*rng.sample("abcdefgh", 2), f"20{rng.randrange(18, 22)}0{rng.randrange(1, 4)}01", rng.choice(rounds), rng.choice(["Hard", "Clay", None])) for _ in range(n)]


def test_features_ignore_the_future_and_cohort_order(spark):
    rng = random.Random(11)
    rows = sorted(random_matches(rng), key=lambda r: r[2])
    table = rankings(spark, [(p, f"20{y}0101", k + 1, 100) for y in range(18, 22) for k, p in enumerate("abcdefg")])
    whole = feature_tables(matches(spark, rows), table)["differentials"]
    cut = rows[100][2]
    early = [r for r in rows if r[2] < cut]
    part = feature_tables(matches(spark, early), table)["differentials"]
    ids = {f"m{n}" for n in range(len(early))}
    assert sorted(map(str, part.collect())) == sorted(str(r) for r in whole.collect() if r.canonical_match_id in ids)


def test_feature_build_is_whole(spark, tmp_path):
    from rallyframe.cli import main
    from rallyframe.plans.reference import QUERIES

    games = [("a", "b", "Hard"), ("a", "b", "Clay"), ("b", "a", "Hard")]
    m = matches(spark, [(w, l, f"202401{10 + n}", "F", s) for n, (w, l, s) in enumerate(games)])
    m = m.withColumns({"tourney_level": F.lit("G"), "best_of": F.lit(5)})
    stats = spark.createDataFrame([("atp_matchstats_2024.csv", n + 2, 40, 30, 8, 4, 50, 60) for n in range(3)], STATS)
    table = rankings(spark, [("a", "20240101", 9, 10), ("a", "20240105", 4, 20), ("b", "20240101", 7, 10), ("b", "20240105", 8, 20)])
    for name, rows in (("canonical_matches", m), ("canonical_rankings", table), ("canonical_match_stats", stats)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    assert main(["build-features", str(tmp_path), str(tmp_path / "out")]) == 0
    for built in (feature_tables(m, table, stats)["differentials"], spark.read.parquet(f"{tmp_path}/out/differentials.parquet")):
        last = {r.canonical_match_id: r for r in built.collect()}["m2"]
        assert abs(last.service_rate_diff - (60 / 120 - 80 / 100)) < 1e-12 and abs(last.ace_rate_diff - (8 / 120 - 16 / 100)) < 1e-12
        assert abs(last.return_allowed_rate_diff - (80 / 100 - 60 / 120)) < 1e-12
        assert last.surface_elo_diff == -32.0 and last.elo_diff < -32 and last.rank_change_diff == 1 + 5
        assert (last.h2h_match_count, last.as_of_date, last.surface, last.round_name, last.tourney_level, last.best_of) == (2, "20240112", "Hard", "F", "G", 5)
        assert sum(c.endswith("_diff") for c in built.columns) == 13
    bare = feature_tables(m, table)["differentials"]
    assert bare.columns == built.columns and not bare.where("service_rate_diff is not null").count()
    assert QUERIES["dc06_feature_build"](spark, "/root/testdata/sf0.001").columns == built.columns


def test_elo_fold_against_plain_loop(spark):
    rng = random.Random(12)
    rows = random_matches(rng)
    m = H.one_row_per_match(matches(spark, rows))
    order = sorted(range(len(rows)), key=lambda n: (rows[n][2], H.ROUNDS.index(rows[n][3]), f"atp_matches_{rows[n][2][:4]}.csv", n + 2))
    rating, want = {}, {}
    for n in order:
        w, l = rows[n][:2]
        a, b = rating.get(w, 1500.0), rating.get(l, 1500.0)
        rating[w] = a + 32 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        rating[l] = b + 32 * (0 - 1 / (1 + 10 ** ((a - b) / 400)))
        want[f"m{n}"] = (a, rating[w], b, rating[l])
    got = {r.canonical_match_id: (r.winner_pre, r.winner_post, r.loser_pre, r.loser_post) for r in H.elo_fold(m).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


def test_unknown_round_raises(spark):
    with pytest.raises(Exception, match="WEIRD"):
        H.one_row_per_match(matches(spark, [("a", "b", "20240101", "WEIRD", "Hard")])).collect()
