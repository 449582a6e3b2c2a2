import json

import pytest
from pyspark.sql import functions as F

from rallyframe.cli import main
from rallyframe.functions import ladders, text
from rallyframe.ml import dataset, models, preprocess
from rallyframe.operators import metrics as M
from rallyframe.operators import relational as R
from rallyframe.plans.pipelines import canonical_tables, persist
from rallyframe.session import Settings
from rallyframe.sources import artifacts, csv_snapshot, market_api
from rallyframe.streaming import latest


def test_plain_names_and_title_pairs(spark):
    rows = spark.createDataFrame([("Zoë   Marañón!", "Round 3: Pell Varga vs Ilke Stam"), ("Søltan", "Winner of the Harbour Cup"), (None, None), ("a_b", "A VS B:")], "n string, t string")
    a, b = text.title_pair(F.col("t"))
    got = rows.select(text.plain_name(F.col("n")).alias("n"), a.alias("a"), b.alias("b")).collect()
    assert [r.n for r in got] == ["zoe maranon", "sltan", None, "a_b"]
    assert [(r.a, r.b) for r in got] == [("Pell Varga", "Ilke Stam"), (None, None), (None, None), ("A", "B:")]


def test_ladders(spark):
    rows = spark.createDataFrame([('[["0.37","3"],["0.3","9"]]',), ("[]",), (None,)], "j string")
    tops = [r[0] for r in rows.select(ladders.top_of_book(F.col("j"))).collect()]
    assert (str(tops[0].price), str(tops[0].quantity)) == ("0.3700", "3.0000") and tops[1:] == [None, None]


def test_metrics_on_small_tables(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.3, 1), (0.95, 1), (1.0, 0)], "p double, y int")
    bins = {r.bin: r.n for r in M.calibration_bins(rows).collect()}
    assert bins == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}
    assert M.roc_auc(rows).first().auc == 4 / 6
    assert M.roc_auc(rows.where("y = 1")).first().auc is None
    assert M.calibration_error(rows.where("false")).first().ece == 0.0
    data = [("20240103", "c", 0.6, 0.4), ("20240101", "a", 0.8, -0.2), ("20240102", "b", 0.7, 0.3)]
    curve = M.equity_curve(spark.createDataFrame(data, "date string, id string, stake double, profit double")).orderBy("date").collect()
    assert [round(r.cumulative, 6) for r in curve] == [-0.2, 0.1, 0.5] and [round(r.drawdown, 6) for r in curve] == [0.2, 0, 0]
    low, high = M.bootstrap_exact([0.4, -0.2, 0.3, 0.1])
    assert low < 0.15 < high and M.bootstrap_exact([0.4, -0.2, 0.3, 0.1]) == (low, high)
    spread = M.bootstrap_mean(spark.range(400).select((F.col("id") % 2).cast("double").alias("x"), "id"), "x").first()
    assert 0.42 < spread.lower < 0.5 < spread.upper < 0.58


def test_relational_helpers(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in R.holds(rows, ["k"], [F.col("o")]).collect()} == {"a": "y", "b": "z"}
    assert R.differences(rows, rows).count() == 0 and R.differences(rows, rows.where("k = 'a'")).count() == 1
    with pytest.raises(ValueError):
        R.check_columns(rows, ["k"])
    with pytest.raises(ValueError):
        R.single_value(rows, "k")
    assert R.single_value(rows.where("k = 'b'"), "k") == "b"


FILES = {
    "atp_players.csv": "player_id,name_first,name_last\n7,Odalys,Brenk\n31,Tamsin,Orwa\n31,Tam,Orwa\nxx,Pell,Varga\nyy,Ilke,Stam\n",
    "atp_rankings_2019.csv": "rank,player,ranking_date,points\n4,7,20190701,3120\n9,31,20190701,2455\n12,31,20190231,2300\n",
    "atp_matches_2018.csv": "tourney_id,surface,tourney_name,tourney_date,tourney_level,winner_id,loser_id,score,best_of,round,comment\n"
    'k9,Clay,Harbour Cup,20180611,A,7,31,7-5 6-1,3,Q2,\nk9,Clay,"Harbour, ""old"" Cup",20180611,A,31,7,6-0 6-2,3,QF,\nk9,Clay,Harbour Cup,20180611,A,7,31,3-1,3,SF,Incomplete\n'
    "k9,Clay,Harbour Cup,20180611,A,nobody,31,6-2 6-2,3,F,\nk9,Clay,Harbour Cup\n",
    "atp_matches_2019.csv": "winner_id,loser_id,round,score,best_of,tourney_id,tourney_name,tourney_date,tourney_level,surface\n7,31,R16,6-1 6-4,3,k9,Harbour Cup,20190610,A,Grass\n",
    "atp_matchstats_2019.csv": "match_id,svpt1,svpt2,1stWon1,1stWon2,ace1,ace2\n55,61,47,29,18,6,\n56,many,47,29,18,6,\n",
    "itf_matches_2019.csv": "a\nb\n",
}


def test_snapshot_to_canonical_tables(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, body in FILES.items():
        (source / name).write_text(body)
    copied = csv_snapshot.copy_snapshot(str(source), str(tmp_path / "raw"), "0badc0de")
    assert len(copied) == len(FILES)
    with pytest.raises(FileExistsError):
        csv_snapshot.copy_snapshot(str(source), str(tmp_path / "raw"), "0badc0de")
    root = str(tmp_path / "raw/0badc0de")
    tables = canonical_tables(spark, root, "repo", "0badc0de")
    assert {k: t.count() for k, t in tables.items()} == {
        "canonical_players": 2, "canonical_rankings": 2, "quarantined_rows": 2, "canonical_tournaments": 2, "canonical_matches": 2,
        "canonical_match_stats": 1, "failed_rows": 6,
    }
    failed = sorted((r.source_file, r.column or "", r.reason) for r in tables["failed_rows"].collect())
    assert failed == [
        ("atp_matches_2018.csv", "", "field_count"), ("atp_matches_2018.csv", "winner_id", "bad_integer"), ("atp_matchstats_2019.csv", "svpt1", "bad_integer"),
        ("atp_players.csv", "player_id", "bad_integer"), ("atp_players.csv", "player_id", "bad_integer"), ("atp_rankings_2019.csv", "ranking_date", "bad_date"),
    ]
    assert tables["canonical_players"].where("canonical_player_id is null").count() == 0
    by_year = {r.tourney_date: r for r in tables["canonical_matches"].collect()}
    assert by_year["20180611"].lineage_source_row_number == 2 and by_year["20180611"].tourney_name == 'Harbour, "old" Cup'
    assert (by_year["20190610"].surface, by_year["20190610"].score, by_year["20190610"].winner_canonical_player_id[-2:]) == ("Grass", "6-1 6-4", ":7")
    physical = canonical_tables(spark, root, "repo", "0badc0de", "physical")["canonical_matches"].where("tourney_date = '20180611'").first()
    assert physical.lineage_source_row_number == 3
    assert sorted(r.reason for r in tables["quarantined_rows"].collect()) == ["excluded_incomplete", "excluded_qualifier"]
    assert tables["canonical_players"].where("source_player_id = 31").first().first_name == "Tamsin"
    with pytest.raises(ValueError, match="bad_integer"):
        canonical_tables(spark, root, "repo", "0badc0de", strict=True)
    persist({"canonical_players": tables["canonical_players"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/canonical_players.parquet")).count() == 2
    with pytest.raises(ValueError, match="empty: canonical_players"):
        persist({"canonical_players": tables["canonical_players"].where("false")}, str(tmp_path / "out"), empty=False)
    pinned = spark.createDataFrame(csv_snapshot.manifest(spark, root).collect())
    assert canonical_tables(spark, root, "repo", "0badc0de", pinned=pinned).keys() == tables.keys()
    (tmp_path / "raw/0badc0de/atp_players.csv").write_text("player_id\n")
    assert csv_snapshot.changed_files(pinned, csv_snapshot.manifest(spark, root)).count() == 1
    with pytest.raises(ValueError, match="pinned manifest: atp_players.csv"):
        canonical_tables(spark, root, "repo", "0badc0de", pinned=pinned)
    with pytest.raises(ValueError, match="missing required"):
        csv_snapshot.read_csv(spark, f"{root}/atp_players.csv", ["player_id", "name_first"])
    with pytest.raises(ValueError):
        csv_snapshot.checked_commit("XYZ")


def test_aliases_and_sinks(spark, tmp_path):
    good = {c: "x" for c in artifacts.ALIAS_FIELDS}
    (tmp_path / "a.json").write_text(json.dumps([good, {**good, "raw_market_name": "y", "normalized_market_name": "y"}]))
    assert artifacts.read_aliases(spark, str(tmp_path / "a.json")).count() == 2
    for bad in ([good, good], [{**good, "source_note": " "}], [{**good, "normalized_market_name": "z"}]):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            artifacts.read_aliases(spark, str(tmp_path / "b.json"))
    rows = spark.range(3)
    artifacts.write_once(rows, str(tmp_path / "w"), "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_once(rows, str(tmp_path / "w"), "csv")
    artifacts.replace_table(rows.where("false"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["id"]
    settings = Settings(data_dir=tmp_path)
    assert settings.inside("x").parent == tmp_path.resolve()
    with pytest.raises(ValueError):
        settings.inside("../x")


def test_market_pages(spark, tmp_path):
    page = {"markets": [{"ticker": "T1", "status": "open", "yes_bid_dollars": "0.40", "can_close_early": "True", "close_time": "2024-06-20T10:00:00+02:00"}], "cursor": "n"}
    (tmp_path / "markets.json").write_text(json.dumps(page))
    (tmp_path / "markets.n.json").write_text(json.dumps({"markets": [{"ticker": "T2", "yes_bid_dollars": "bad", "close_time": "2024-06-20T10:00:00"}], "cursor": ""}))
    spark.dataSource.register(market_api.MarketPages)
    raw = spark.read.format("market_pages").option("folder", str(tmp_path)).option("paths", "markets").load()
    got = {r.ticker: r for r in market_api.typed_markets(raw).collect()}
    assert str(got["T1"].yes_bid_dollars) == "0.4000" and got["T1"].can_close_early and got["T1"].close_time.hour == 8
    assert got["T2"].yes_bid_dollars is None and got["T2"].close_time.hour == 10 and got["T2"].page == 1
    for n, body in {
        "markets_T1": {"market": page["markets"][0]}, "markets_T1_orderbook": {"orderbook_fp": {"yes_dollars": [["0.31", "5"], ["0.4", "2.5"]], "no_dollars": None}},
    }.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(body))
    tables = market_api.collect_tables(spark, market_api.file_transport(str(tmp_path)), ["markets"], {"limit": 2})
    assert {k: t.count() for k, t in tables.items()} == {"request_logs": 4, "market_snapshots": 2, "market_detail_snapshots": 1, "orderbook_snapshots": 1}
    book = tables["orderbook_snapshots"].first()
    assert (book.ticker, book.yes_level_count, str(book.yes_best_price_dollars), str(book.yes_best_quantity_fp), book.no_level_count, book.no_best_price_dollars) == ("T1", 2, "0.4000", "2.5000", 0, None)
    assert json.loads(book.yes_levels_json) == [["0.3100", "5.0000"], ["0.4000", "2.5000"]]
    assert sorted(r.request_cursor or "" for r in tables["request_logs"].collect()) == ["", "", "", "n"]
    (tmp_path / "markets_T1.json").write_text("{}")
    with pytest.raises(Exception, match="no market object"):
        market_api.collect_tables(spark, market_api.file_transport(str(tmp_path)), ["markets"])["market_detail_snapshots"].collect()
    waits, answers = [], iter([(429, {}), (429, {}), (200, {"markets": []})])
    assert market_api.fetch(lambda p, q: next(answers), "markets", {}, sleep=waits.append) == {"markets": []} and waits == [0.25, 0.5]
    with pytest.raises(RuntimeError, match="repeated cursor"):
        list(market_api.pages(lambda p, q: (200, {"cursor": "same"}), "markets", {}))
    with pytest.raises(ValueError):
        list(market_api.pages(lambda p, q: (200, {}), "markets", {"nope": 1}))
    assert market_api.request_id({"b": 1, "a": 2}) == market_api.request_id({"a": 2, "b": 1})


def test_strict_helpers(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    listed = spark.createDataFrame([("b", 0), ("a", 1), ("z", 2)], "k string, pos int")
    assert R.in_listed_order(listed, rows, "k").count() == 2 and R.in_listed_order(listed.where("k <> 'z'"), rows, "k", True).count() == 2
    with pytest.raises(Exception, match="unknown id: z"):
        R.in_listed_order(listed, rows, "k", True).collect()
    with pytest.raises(ValueError, match="no rows: x"):
        R.non_empty(rows.where("false"), "x")
    other = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3)], "k string, n int")
    got = {r.n: (r.saved and r.saved.k, r.replayed and r.replayed.k) for r in R.differences_by_position(rows, other, "n").collect()}
    assert got == {2: ("b", "c"), 3: (None, "d")}
    dates = spark.createDataFrame([("20190101",), (None,)], "d string").select(text.year_of(F.col("d")).alias("y"), text.currency(F.lit(1.5)).alias("c")).collect()
    assert [(r.y, r.c) for r in dates] == [("2019", "$1.50"), (None, "$1.50")]
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("19",)], "d string").select(text.year_of(F.col("d"))).collect()
    m = F.create_map(F.lit("a"), F.lit(1))
    assert spark.range(1).select(R.map_value(m, F.lit("b"), F.lit(9)).alias("x"), R.map_updated(m, F.lit("a"), F.lit(5)).alias("y")).first().asDict() == {"x": 9, "y": {"a": 5}}
    kinds = preprocess.feature_groups(spark.createDataFrame([], "a int, b string, c boolean, d double, e void"), ["d"])
    assert kinds == (["a", "e"], ["b", "c"])


def test_models_and_splits(spark, tmp_path):
    from rallyframe.ml.registry import load_bundle, write_bundle

    rows = spark.range(240).select(
        F.concat(F.lit("2024"), F.format_string("%02d%02d", (F.col("id") / 20).cast("int") + 1, F.col("id") % 20 + 1)).alias("d"),
        ((F.col("id") * 37) % 100 / 100.0).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("c"),
    ).withColumn("y", (F.col("x") + (F.hash("d") % 20) / 100.0 > 0.5).cast("int"))
    rows = rows.withColumn("split", dataset.split_of(F.col("d"), "20240801", "20241001"))
    assert dataset.check_splits(rows) is rows
    train, validation, test = (rows.where(F.col("split") == s) for s in ("train", "validation", "test"))
    for family in models.FAMILIES:
        fitted = models.fit(train, ["x"], ["c"], family, trees=5)
        for calibrate in (models.platt, models.isotonic):
            out = models.prediction_rows(calibrate(fitted.score(validation))(fitted.score(test)), ["d", "y"])
            wrong = out.where("calibrated_probability < 0 or calibrated_probability > 1 or favoured_probability < 0.5").count()
            assert out.count() == test.count() and not wrong
            assert M.roc_auc(out.select("y", F.col("calibrated_probability").alias("p"))).first().auc > 0.7
    for bad in (("2024-01-01", "20240201"), ("20240201", "20240101")):
        with pytest.raises(ValueError):
            dataset.split_of(F.col("d"), *bad)
    with pytest.raises(ValueError, match="empty"):
        dataset.check_splits(rows.where("split = 'train'"))
    with pytest.raises(ValueError):
        models.fit(train, ["x"], [], "other")
    assert preprocess.most_frequent(rows, ["c"]).first()["mode"] == "a"
    assert dataset.check_boundaries(rows, "d", "20240801", "20241001", "20241220").count() == 240
    with pytest.raises(ValueError, match="boundary of: train"):
        dataset.check_boundaries(rows, "d", "20240799", "20241001", "20241220")
    calibrator = models.isotonic(fitted.score(validation))
    folder = write_bundle(str(tmp_path / "run"), fitted, calibrator, "v1", "s1", {"auc": 1})
    loaded, again, manifest = load_bundle(folder, "v1", "s1")
    assert manifest["metrics"] == {"auc": 1} and loaded.prepare == fitted.prepare
    one, two = (c(f.score(test)).select("d", "x", "p").toPandas() for f, c in ((fitted, calibrator), (loaded, again)))
    assert one.equals(two)
    with pytest.raises(ValueError, match="feature_version"):
        load_bundle(folder, "v2", "s1")
    next(p for p in (tmp_path / "run/model").rglob("part-*") if p.suffix != ".crc").write_text("x")
    for crc in (tmp_path / "run/model").rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="file"):
        load_bundle(folder, "v1", "s1")
    with pytest.raises(FileExistsError):
        write_bundle(folder, fitted, calibrator, "v1", "s1", {})


def test_sigmoid_calibration_scores_each_row_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def score(k):
        scored.add(1)
        return float(k % 7)

    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), F.udf(score, "double")("id").alias("score"))
    calibrator = models.platt(rows)
    assert scored.value == 60 and calibrator.model.numFeatures == 1


def _cut(spark, folder, where):
    """The modelling tables of sf0.01 with those modelling rows only."""
    given = "/root/testdata/sf0.01"
    spark.read.parquet(f"{given}/modeling_rows.parquet").where(where).write.parquet(f"{folder}/modeling_rows.parquet")
    spark.read.parquet(f"{given}/canonical_matches.parquet").write.parquet(f"{folder}/canonical_matches.parquet")
    return str(folder)


NO_VALIDATION = "as_of_date <= '20141231' or as_of_date > '20181231'"


def test_sigmoid_calibration_of_no_rows(spark, tmp_path):
    from rallyframe.ml.registry import write_bundle
    from rallyframe.plans.reference import QUERIES

    ml02 = QUERIES["ml02_logistic_regression"]
    assert ml02(spark, _cut(spark, tmp_path / "a", "as_of_date <= '20141231'")).count() == 0
    got = ml02(spark, _cut(spark, tmp_path / "b", NO_VALIDATION)).toPandas()
    whole = ml02(spark, "/root/testdata/sf0.01").toPandas()
    # the calibrator alone sees the validation rows: the rest is as it is with them
    same = ["pos", "canonical_match_id", "y", "raw_probability"]
    assert len(got) == 200 and got[same].sort_values("pos", ignore_index=True).equals(whole[same].sort_values("pos", ignore_index=True))
    assert got[["calibrated_probability", "favoured_side", "favoured_probability"]].isna().all(axis=None)
    with pytest.raises(ValueError, match="no rows"):
        write_bundle(str(tmp_path / "bundle"), None, models.Calibrator("sigmoid", None), "v1", "s1", {})
    assert not (tmp_path / "bundle").exists()


def test_metric_bundle_without_validation_rows(spark, tmp_path):
    from rallyframe.plans.reference import QUERIES

    metrics = lambda folder: {r.metric: r.value for r in QUERIES["ml11_metric_bundle"](spark, folder).collect()}
    none = {"accuracy": None, "log_loss": None, "brier": None, "auc": None}
    assert metrics(_cut(spark, tmp_path / "a", "as_of_date <= '20141231'")) == {"n": 0.0, "ece": 0.0} | none
    assert metrics(_cut(spark, tmp_path / "b", NO_VALIDATION)) == {"n": 200.0, "ece": None} | none


def test_boosting_with_training_rows_alone(spark, tmp_path, monkeypatch):
    from rallyframe.plans.reference import QUERIES

    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda *args, trees=400, **kwargs: fit(*args, trees=3, **kwargs))
    ml04 = QUERIES["ml04_boosted_trees"]
    assert ml04(spark, _cut(spark, tmp_path / "a", "as_of_date <= '20141231'")).count() == 0
    got = ml04(spark, _cut(spark, tmp_path / "b", NO_VALIDATION)).collect()
    assert len(got) == 200 and all(0 <= r.raw_probability <= 1 and r.calibrated_probability is None for r in got)


def test_boosting_stops_early_with_patience(spark):
    assert models.best_iteration([3.0, 2.0, 2.5, 2.4, 1.0, 1.5]) == 5 and models.best_iteration([3.0, 2.0, 2.5, 2.4, 1.0], 2) == 2
    rows = spark.range(300).select(F.rand(1).alias("x"), (F.col("id") >= 250).alias("is_tail"))
    rows = rows.withColumn("y", ((F.col("x") > 0.5) != F.col("is_tail")).cast("int"))
    held = models.fit(rows, ["x"], [], "gradient_boosted_trees", trees=12)
    plain = models.fit(rows.where("not is_tail").drop("is_tail"), ["x"], [], "gradient_boosted_trees", trees=12)
    losses = plain.model.evaluateEachIteration(plain.pipeline.transform(plain.prepare(rows.where("is_tail"))).withColumn("_label", F.col("y").cast("double")))
    n = models.best_iteration(losses)
    assert n < 12 == plain.model.getNumTrees and held.model.getNumTrees == n
    assert held.score(rows).where("raw_probability between 0 and 1").count() == 300


def test_tree_queries_fit_400_trees(spark, monkeypatch):
    from rallyframe.plans.reference import QUERIES

    fit, seen = models.fit, []

    def short(train, *args, trees=400, **kwargs):
        tail = train.where("is_tail").count() if "is_tail" in train.columns else 0
        seen.append((args[2], trees, tail, train.count()))
        return fit(train, *args, trees=3, **kwargs)

    monkeypatch.setattr(models, "fit", short)
    for name in ("ml03_random_forest", "ml04_boosted_trees"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert [(f, t) for f, t, _, _ in seen] == [("random_forest", 400), ("gradient_boosted_trees", 400)]
    assert seen[0][2] == 0 and 0.1 < seen[1][2] / seen[1][3] < 0.2 and seen[0][3] == seen[1][3]


def test_parity_shows_both_sides_exactly(spark, tmp_path):
    from rallyframe.plans.reference import QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/modeling_rows.parquet").where("feature_version = 'v1' and elo_diff is not null").limit(3)
    same = given.where("true").withColumn("feature_version", F.lit("v2"))
    first = given.agg(F.min("canonical_match_id")).first()[0]
    moved = same.withColumn("elo_diff", F.col("elo_diff") + F.when(F.col("canonical_match_id") == first, 0.0001).otherwise(0.0))
    given.unionByName(moved).write.parquet(f"{tmp_path}/modeling_rows.parquet")
    got = QUERIES["jn15_parity_both"](spark, str(tmp_path)).collect()
    assert {r.side for r in got} == {"saved", "replayed"} and {r.canonical_match_id for r in got} == {first}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:01:00"), ("b", 1, "2024-01-01 00:02:00"), ("b", 1, "2024-01-01 00:02:00")], "k string, v int, t string")
    rows = rows.withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))

    def drained(frame, mode, name):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).collect()

    stream = lambda: latest.stream_table(spark, str(tmp_path / "in"), rows.schema)
    assert {r.k: r.v for r in drained(latest.latest_per_key(stream(), "k", ["t", "v"], ["v"]), "complete", "one")} == {"a": 2, "b": 1}
    assert len(drained(latest.once_within(stream(), ["k", "v"], "t", "1 hour"), "append", "two")) == 3
    assert sum(r.n for r in drained(latest.counts_by_window(stream(), "t", "1 minute", "1 hour", ["k"]), "complete", "three")) == 4


def test_cli_lists_and_runs(spark, tmp_path, capsys):
    assert main(["version"]) == 0 and main(["queries"]) == 0
    assert "p4_found" in capsys.readouterr().out
    assert main(["run", "wn01_latest_market", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_cli_trains_evaluates_and_replays(spark, tmp_path, capsys):
    data = "/root/testdata/sf0.01"
    assert main(["train", data, str(tmp_path / "b"), "--calibrator", "isotonic"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["auc"] > 0.5
    assert main(["evaluate", data, str(tmp_path / "b"), str(tmp_path / "r")]) == 0
    assert json.loads((tmp_path / "r/summary.json").read_text())["metrics"]["n"] == spark.read.parquet(str(tmp_path / "r/predictions.parquet")).count() > 0
    with pytest.raises(FileExistsError):
        artifacts.write_report(str(tmp_path / "r"), {}, {})
    assert main(["replay", data, str(tmp_path / "b"), str(tmp_path / "r")]) == 0
    assert "0 predictions differ" in capsys.readouterr().out


def test_evidence_and_expected_columns(spark, tmp_path):
    from rallyframe.sources.tables import table

    rows = table(spark, "/root/testdata/sf0.001", "market_mapping_evidence", list(artifacts.EVIDENCE))
    artifacts.write_evidence(rows, str(tmp_path / "market_mapping_evidence.parquet"))
    assert table(spark, str(tmp_path), "market_mapping_evidence").count() == rows.count()
    with pytest.raises(ValueError, match="columns differ"):
        artifacts.write_evidence(rows.drop("raw_title"), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="columns differ"):
        table(spark, "/root/testdata/sf0.001", "region", ["r_name"])
