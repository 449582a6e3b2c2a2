"""Stable ids built from the natural key of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def player_id(source_id: Column) -> Column:
    return F.concat(F.lit("player:sackmann:"), source_id.cast("int").cast("string"))


def tournament_id(source_id: Column, name: Column, date: Column) -> Column:
    return F.concat(F.lit("tournament:synthetic:"), _digest(F.lit("tournament"), F.trim(source_id), F.lower(F.trim(name)), F.trim(date)))


def match_id(path: Column, row: Column, tournament: Column, winner: Column, loser: Column, round_name: Column) -> Column:
    parts = (F.lit("match"), path, row.cast("string"), F.trim(tournament), winner, loser, F.upper(F.trim(round_name)))
    return F.concat(F.lit("match:synthetic:"), _digest(*parts))


def ranking_id(player: Column, date: Column) -> Column:
    return F.concat(F.lit("ranking:synthetic:"), _digest(F.lit("ranking"), player, F.trim(date)))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def ordered_list_hash(ids: Column) -> Column:
    """SHA-256 of ids in order, each followed by a line feed."""
    return F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256)
