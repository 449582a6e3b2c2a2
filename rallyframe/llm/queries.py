"""Queries of problems 3 and 6 to 10, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.corpus_encoding import encode_corpus
from rallyframe.llm.leakage import leaked_items
from rallyframe.llm.name_variants import link_variants
from rallyframe.llm.nearest_time import micros, nearest_in_time
from rallyframe.llm.pairwise_ranking import rank_items
from rallyframe.llm.subjects import document_subjects
from rallyframe.sources.tables import table


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    matches = table(spark, folder, "canonical_matches")
    ids = ["canonical_match_id", "winner_canonical_player_id", "loser_canonical_player_id"]
    results = matches.select(*ids).dropna().distinct()
    ranked = rank_items(results.select(F.col(ids[1]).alias("winner"), F.col(ids[2]).alias("loser")))
    return ranked.withColumnRenamed("item", "canonical_player_id")


def p3_strengths(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking's figures, iterated far enough to be compared to six places (places of equal strengths are left out)."""
    matches = table(spark, folder, "canonical_matches")
    ids = ["canonical_match_id", "winner_canonical_player_id", "loser_canonical_player_id"]
    results = matches.select(*ids).dropna().distinct()
    ranked = rank_items(results.select(F.col(ids[1]).alias("winner"), F.col(ids[2]).alias("loser")), tolerance=1e-11)
    return ranked.select(F.col("item").alias("canonical_player_id"), F.round("strength", 6).alias("strength"), "wins", "losses")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    def side(name: str) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.select(F.col("ticker").alias("entity"), micros(F.col("collected_at_utc")).alias("at"), F.col("request_id").alias("id"))

    near = nearest_in_time(side("kalshi_orderbook_snapshots"), side("kalshi_market_snapshots"), 120_000_000)
    return near.select(F.col("left_id").alias("orderbook_request_id"), F.col("right_id").alias("market_request_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    evidence, aliases = table(spark, folder, "market_mapping_evidence"), table(spark, folder, "player_alias_overrides")
    market = evidence.select(
        F.lit("market_mapping_evidence").alias("source_table"), F.col("market_ticker").alias("record_key"),
        F.col("raw_yes_sub_title").alias("name"), F.col("yes_canonical_player_id").alias("entity"),
    )
    alias = aliases.select(
        F.lit("player_alias_overrides").alias("source_table"), F.col("raw_market_name").alias("record_key"),
        F.col("raw_market_name").alias("name"), F.nullif(F.col("canonical_player_id"), F.lit("")).alias("entity"),
    )
    names = market.unionByName(alias)
    open_rows = names.where("entity is null and name is not null and record_key is not null")
    players = table(spark, folder, "canonical_players")
    known = players.select(F.col("canonical_player_id").alias("entity"), F.col("full_name").alias("name"))
    links = link_variants(open_rows, known, names.where("entity is not null"))
    found = open_rows.drop("entity").join(links, "name")
    return found.select("source_table", "record_key", F.col("entity").alias("canonical_player_id")).distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    names = ("documents", "doc_subject_labels", "subject_areas", "eval_items")
    return document_subjects(*(table(spark, folder, n) for n in names))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels, subjects, items = (table(spark, folder, n) for n in ("documents", "doc_subject_labels", "subject_areas", "eval_items"))
    known = labels.where("doc_id is not null").select("doc_id").distinct()
    judged = documents.select("doc_id", "text").join(known, "doc_id", "left_anti")
    return document_subjects(documents, labels, subjects, items, judged=judged).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (p3_ranking, p3_strengths, p6_found, p7_found, p8_ids, p9_found, p10_found, p10_composition)}

ORACLES = {
    # the iteration on a dense list of adjacency lists, far beyond convergence
    "p3_strengths": """
WITH RECURSIVE x AS (SELECT DISTINCT canonical_match_id, winner_canonical_player_id AS w, loser_canonical_player_id AS l FROM canonical_matches
           WHERE canonical_match_id IS NOT NULL AND winner_canonical_player_id IS NOT NULL AND loser_canonical_player_id IS NOT NULL),
 p AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT w AS id FROM x UNION SELECT l FROM x)),
 g AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM x JOIN p a ON a.id = x.w JOIN p b ON b.id = x.l WHERE x.w <> x.l GROUP BY ALL),
 t AS (SELECT (SELECT list(coalesce(f, []) ORDER BY i) FROM p LEFT JOIN (SELECT a, list({'j': b, 'n': n}) AS f FROM g GROUP BY a) ON a = i) AS won,
              (SELECT list(coalesce(f, []) ORDER BY i) FROM p LEFT JOIN (SELECT b, list({'j': a, 'n': n}) AS f FROM g GROUP BY b) ON b = i) AS lost,
              (SELECT 1.0::DOUBLE / count(*) FROM p) AS h),
 s AS (SELECT 0 AS k, list_transform(won, lambda f: 1.0::DOUBLE) AS o, list_transform(won, lambda f: 1.0::DOUBLE) AS d FROM t
   UNION ALL
   SELECT k + 1, o2, list_transform(t.lost, lambda f: coalesce(list_sum(list_transform(f, lambda y: y.n / o2[y.j])), 0) + t.h * so)
   FROM (SELECT k, o2, list_sum(list_transform(o2, lambda z: 1 / z)) AS so
         FROM (SELECT s.k, list_transform(t.won, lambda f: coalesce(list_sum(list_transform(f, lambda y: y.n / s.d[y.j])), 0) + t.h * s.sd) AS o2
               FROM (SELECT k, d, list_sum(list_transform(d, lambda z: 1 / z)) AS sd FROM s WHERE k < 60) s, t)), t),
 r AS (SELECT p.id, s.o[p.i] / s.d[p.i] AS raw, p.i FROM s, p WHERE s.k = 60)
SELECT id AS canonical_player_id, round(raw / (SELECT exp(avg(ln(raw))) FROM r), 6) AS strength, (SELECT count(*) FROM x WHERE w = id) AS wins,
       (SELECT count(*) FROM x WHERE l = id) AS losses FROM r""",
    "p6_found": """
WITH pairs AS (
  SELECT DISTINCT o.request_id AS orderbook_request_id, m.request_id AS market_request_id,
         abs(date_diff('microsecond', o.collected_at_utc, m.collected_at_utc)) AS gap
  FROM kalshi_orderbook_snapshots o JOIN kalshi_market_snapshots m
    ON o.ticker = m.ticker AND m.collected_at_utc BETWEEN o.collected_at_utc - INTERVAL 120 SECOND
                                                      AND o.collected_at_utc + INTERVAL 120 SECOND)
SELECT orderbook_request_id, market_request_id FROM pairs
QUALIFY row_number() OVER (PARTITION BY orderbook_request_id ORDER BY gap, market_request_id) = 1""",
}
