"""Paged market listings and point reads behind an injected transport."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from decimal import Decimal
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rallyframe.util import materialize, shuffle_partitions

Transport = Callable[[str, dict], tuple[int, dict]]
# Retries of throttled requests, and the filters a listing takes.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 0.25, 2.0
FILTERS = (
    "limit", "cursor", "event_ticker", "series_ticker", "tickers", "status", "mve_filter", "min_created_ts", "max_created_ts",
    "min_updated_ts", "min_close_ts", "max_close_ts", "min_settled_ts", "max_settled_ts",
)


def canonical_json(value) -> str:
    """Compact JSON with sorted keys; decimals and times as text."""

    def plain(x):
        if isinstance(x, Decimal):
            return str(x)
        if isinstance(x, datetime):
            return x.isoformat(timespec="microseconds")
        raise TypeError(type(x).__name__)

    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=plain)


def request_id(parts: dict) -> str:
    return hashlib.sha256(canonical_json(parts).encode()).hexdigest()


def fetch(transport: Transport, path: str, params: dict, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request; status 429 is retried with doubling waits, any other failure raises."""
    wait = FIRST_WAIT
    for n in range(attempts):
        status, body = transport(path, params)
        if status == 200:
            return body
        if status != 429 or n == attempts - 1:
            raise RuntimeError(f"{path}: status {status}")
        sleep(wait)
        wait = min(2 * wait, LONGEST_WAIT)
    raise RuntimeError(f"{path}: no attempt made")


def pages(transport: Transport, path: str, params: dict, **options) -> Iterator[dict]:
    """All pages of a listing; an empty or missing cursor ends it, a repeated one raises."""
    if unknown := set(params) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    seen, cursor = set(), None
    while True:
        body = fetch(transport, path, params | ({"cursor": cursor} if cursor else {}), **options)
        yield body
        cursor = body.get("cursor")
        if not cursor:
            return
        if cursor in seen:
            raise RuntimeError(f"repeated cursor {cursor!r}")
        seen.add(cursor)


def file_transport(folder: str) -> Transport:
    """Transport over recorded answers: ``<folder>/<path with _ for />[.<cursor>].json``."""

    def call(path: str, params: dict) -> tuple[int, dict]:
        name = path.strip("/").replace("/", "_") + (f".{params['cursor']}" if params.get("cursor") else "")
        file = Path(folder) / f"{name}.json"
        return (200, json.loads(file.read_text())) if file.exists() else (404, {})

    return call


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.paths = options["folder"], options["paths"].split(",")
        self.params = {k: options[k] for k in FILTERS if k in options}

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for n, body in enumerate(pages(file_transport(self.folder), partition.value, self.params)):
            yield partition.value, n, json.dumps(body)


class MarketPages(DataSource):
    """``spark.read.format("market_pages")``: one partition per listing path, one row per page.

    Options: ``folder`` of recorded answers, ``paths`` (comma-separated), and any of ``FILTERS``.
    """

    @classmethod
    def name(cls):
        return "market_pages"

    def schema(self):
        return "path string, page int, body string"

    def reader(self, schema):
        return _Reader(self.options)


# Fields of a market by type.
TEXTS = ("ticker", "event_ticker", "status", "title", "yes_sub_title", "no_sub_title")
TIMES = ("created_time", "updated_time", "open_time", "close_time", "latest_expiration_time")
AMOUNTS = (
    "yes_bid_dollars", "yes_bid_size_fp", "yes_ask_dollars", "yes_ask_size_fp", "no_bid_dollars", "no_bid_size_fp", "no_ask_dollars", "no_ask_size_fp",
    "last_price_dollars", "volume_fp", "volume_24h_fp", "open_interest_fp", "notional_value_dollars", "previous_yes_bid_dollars", "previous_yes_ask_dollars",
    "previous_no_bid_dollars", "previous_no_ask_dollars",
)
FLAGS = ("can_close_early", "fractional_trading_enabled")
COUNTS = ("settlement_timer_seconds",)
MARKET = "struct<" + ",".join(f"{c}:string" for c in (*TEXTS, *TIMES, *COUNTS, *AMOUNTS, *FLAGS)) + ">"
REQUEST = (
    "request_id string, collected_at_utc timestamp_ntz, request_method string, request_path string, request_query_params_json string, request_cursor string, "
    "response_status_code int, response_cursor string, response_checksum string, response_payload_json string"
)


def parse_time(text: Column) -> Column:
    """Zone-less UTC timestamp of an ISO-8601 text; without a zone it is UTC; null if it is no time."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)\s*\z"), text).otherwise(F.concat(text, F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(zoned))
    return F.timestamp_add("MICROSECOND", micros, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def _market_columns() -> list[Column]:
    field = lambda c: F.col(f"m.{c}")
    flag = lambda c: F.when(F.lower(field(c)) == "true", True).when(F.lower(field(c)) == "false", False)
    return [
        *[field(c).alias(c) for c in TEXTS], *[parse_time(field(c)).alias(c) for c in TIMES], *[field(c).try_cast("int").alias(c) for c in COUNTS],
        *[field(c).try_cast("decimal(18,4)").alias(c) for c in AMOUNTS], *[flag(c).alias(c) for c in FLAGS],
    ]


def typed_markets(raw: DataFrame, body: str = "body") -> DataFrame:
    """Typed listing rows of page bodies: one row per market, with its place on the page; other columns of ``raw`` stay."""
    kept = [c for c in raw.columns if c != body]
    markets = F.from_json(body, f"struct<markets:array<{MARKET}>>")["markets"]
    return raw.select(*kept, F.posexplode(markets).alias("response_index", "m")).select(*kept, "response_index", *_market_columns())


def typed_details(raw: DataFrame, body: str) -> DataFrame:
    """Typed market of each detail answer; an answer without a market raises."""
    kept = [c for c in raw.columns if c != body]
    market = F.from_json(body, f"struct<market:{MARKET}>")["market"]
    none = F.raise_error(F.concat(F.lit("no market object in the answer of "), F.col("request_path")))
    return raw.select(*kept, F.when(market.isNull(), none).otherwise(market).alias("m")).select(*kept, *_market_columns())


def typed_books(raw: DataFrame, body: str) -> DataFrame:
    """Typed order book of each answer: both ladders as JSON of decimals, their depth and best level (the last one); no book raises."""
    kept = [c for c in raw.columns if c != body]
    book = F.from_json(body, "struct<orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>>")["orderbook_fp"]
    none = F.raise_error(F.concat(F.lit("no order book in the answer of "), F.col("request_path")))
    rows = raw.select(*kept, F.when(book.isNull(), none).otherwise(book).alias("b"))

    def ladder(side: str) -> list[Column]:
        odd = F.raise_error(F.concat(F.lit("a level is no price and size: "), F.col("request_path")))
        number = lambda x: F.coalesce(x.try_cast("decimal(18,4)"), odd.cast("decimal(18,4)"))
        level = lambda x: F.when(F.size(x) == 2, F.array(number(x[0]).cast("string"), number(x[1]).cast("string"))).otherwise(odd.cast("array<string>"))
        levels = F.transform(F.coalesce(F.col(f"b.{side}_dollars"), F.array().cast("array<array<string>>")), level)
        best = F.try_element_at(F.array_sort(F.transform(levels, lambda x: F.struct(x[0].cast("decimal(18,4)").alias("p"), x[1].cast("decimal(18,4)").alias("q")))), F.lit(-1))
        return [
            F.to_json(levels).alias(f"{side}_levels_json"), F.size(levels).alias(f"{side}_level_count"),
            best["p"].alias(f"{side}_best_price_dollars"), best["q"].alias(f"{side}_best_quantity_fp"),
        ]

    ticker = F.element_at(F.split("request_path", "/"), -2).alias("ticker")
    return rows.select(*kept, ticker, *ladder("yes"), *ladder("no"))


def _logged(path: str, params: dict, body: dict, now: Callable[[], datetime]) -> tuple:
    text = canonical_json(body)
    at = now()
    name = request_id({"path": path, "params": params, "at": at})
    return (
        name, at, "GET", path, canonical_json(params), params.get("cursor"), 200, body.get("cursor") or None, hashlib.sha256(text.encode()).hexdigest(), text,
    )


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _request(rows: DataFrame, ask: Callable[[str], Iterator[tuple[str, dict, dict]]], now: Callable[[], datetime]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in REQUEST.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                got = [_logged(*answer, now) for answer in ask(path)]
                if got:
                    yield pd.DataFrame(got, columns=names)

    return rows.select("path").mapInPandas(run, REQUEST)


def collect_tables(
    spark: SparkSession, transport: Transport, paths: list[str], params: dict | None = None, now: Callable[[], datetime] = _utc_now, **options
) -> dict[str, DataFrame]:
    """The four tables of a collection: request logs, listed markets, details of open markets and their order books.

    Listings are paged in one task per path; details and books are read in
    parallel, one request per open market.  Answers are written before anything
    is derived from them, so each request is made once.
    """
    params = params or {}

    def listing(path: str) -> Iterator[tuple[str, dict, dict]]:
        cursor = None
        for body in pages(transport, path, params, **options):
            yield path, params | ({"cursor": cursor} if cursor else {}), body
            cursor = body.get("cursor")

    def point(path: str) -> Iterator[tuple[str, dict, dict]]:
        yield path, {}, fetch(transport, path, {}, **options)

    asked = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    listed = materialize(_request(asked, listing, now))
    markets = typed_markets(listed, "response_payload_json")
    # fixed value: the state in which a market's detail and book are read
    open_ones = markets.where("status = 'open' or status = 'active'").select("ticker").distinct().repartition(shuffle_partitions(spark))
    one = lambda suffix: materialize(_request(open_ones.select(F.concat(F.lit("markets/"), "ticker", F.lit(suffix)).alias("path")), point, now))
    details, books = one(""), one("/orderbook")
    return {
        "request_logs": listed.unionByName(details).unionByName(books), "market_snapshots": markets,
        "market_detail_snapshots": typed_details(details, "response_payload_json"), "orderbook_snapshots": typed_books(books, "response_payload_json"),
    }
