"""Delivered CSV records: typed rows, or a reason with its offset.

Method: a quote-aware finite-state tokenizer.  Records of a batch lie end to
end in one byte buffer that is cut into equal chunks without regard to record
borders.  Each chunk yields a transition map (state in -> state out); the maps
are composed by a doubling scan, so every chunk knows the state it starts in,
and one more pass marks field ends and the first wrong byte of each record.
Very long records simply span many chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.util import salted_join

OTHER, COMMA, QUOTE, END = 0, 1, 2, 3
START, PLAIN, QUOTED, CLOSING, BROKEN = 0, 1, 2, 3, 4
# rows: state; columns: OTHER, COMMA, QUOTE, END
TRANSITIONS = np.array(
    [
        [PLAIN, START, QUOTED, START],
        [PLAIN, START, BROKEN, START],
        [QUOTED, QUOTED, CLOSING, START],
        [BROKEN, START, QUOTED, START],
        [BROKEN, BROKEN, BROKEN, START],
    ],
    dtype=np.uint8,
)
CHUNK = 256

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord(",")] = COMMA
_CLASS[ord('"')] = QUOTE

TOKENS = "struct<fields:array<string>,starts:array<int>,error:string,error_offset:int>"


@dataclass(frozen=True)
class FileFamily:
    """Typed columns of one family of delivered files, known by its name prefix."""

    prefix: str
    integers: tuple[str, ...] = ()
    optional_integers: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()


# The typed columns of each file family.
FAMILIES = (
    FileFamily("atp_players", integers=("player_id",)),
    FileFamily("atp_rankings_", integers=("rank", "player", "points"), dates=("ranking_date",)),
    FileFamily("atp_matches_", integers=("winner_id", "loser_id", "best_of"), dates=("tourney_date",)),
    FileFamily(
        "atp_matchstats_",
        integers=("match_id",),
        optional_integers=("ace1", "ace2", "svpt1", "svpt2"),
    ),
)


def states_of(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State after each byte of ``classes``, by composition of chunk maps."""
    n = len(classes)
    if not n:
        return np.zeros(0, dtype=np.uint8)
    chunks = -(-n // chunk)
    padded = np.full(chunks * chunk, END, dtype=np.uint8)
    padded[:n] = classes
    grid = padded.reshape(chunks, chunk)
    flat = TRANSITIONS.ravel()
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (chunks, 5)).copy()
    for j in range(chunk):
        maps = flat[maps * 4 + grid[:, j, None]]
    # inclusive doubling scan: after it, maps[c] leads from the start to the end of chunk c
    step = 1
    while step < chunks:
        later = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty_like(grid)
    for j in range(chunk):
        state = flat[state * 4 + grid[:, j]]
        out[:, j] = state
    return out.ravel()[:n]


def tokenize_batch(records: pa.Array) -> pa.Array:
    """Split a batch of records into fields; null records give null."""
    size = len(records)
    valid = np.array(records.is_valid())
    data = [x.as_buffer() if x.is_valid else b"" for x in records.cast(pa.large_binary())]
    data = [bytes(x) for x in data]
    data = [x[:-1] if x.endswith(b"\r") else x for x in data]
    buffer = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(x) for x in data), dtype=np.int64, count=size)
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    classes = _CLASS[buffer]
    classes[ends] = END
    states = states_of(classes)
    last = np.where(lengths > 0, states[np.maximum(ends - 1, 0)], START)

    broken = np.flatnonzero(states == BROKEN)
    first = np.searchsorted(broken, begins)
    inside = np.zeros(size, dtype=bool)
    has = first < len(broken)
    inside[has] = broken[first[has]] < ends[has]
    error = np.where(inside, "stray_quote", np.where(last == QUOTED, "unclosed_quote", ""))
    offset = np.where(inside, broken[np.minimum(first, max(len(broken) - 1, 0))] - begins if len(broken) else 0, lengths)

    cuts = np.flatnonzero((classes == END) | ((classes == COMMA) & (states == START)))
    kept = np.ones(len(buffer), dtype=bool)
    kept[cuts] = False
    before = np.cumsum(kept)
    field_offsets = np.concatenate([[0], before[cuts]]).astype(np.int64)
    body = buffer[kept].tobytes()
    fields = pa.Array.from_buffers(
        pa.large_binary(), len(cuts), [None, pa.py_buffer(field_offsets), pa.py_buffer(body)]
    ).to_pylist()
    starts = np.concatenate([[0], cuts[:-1] + 1])
    owner = np.searchsorted(ends, cuts)
    starts = (starts - begins[owner]).astype(np.int32)
    fields = [_unquoted(x) if x[:1] == b'"' else x for x in fields]
    text = pa.array(fields, type=pa.binary()).cast(pa.string())
    per_record = np.concatenate([[0], np.searchsorted(cuts, ends, side="right")]).astype(np.int32)
    failed = error != ""
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(per_record), text),
            pa.ListArray.from_arrays(pa.array(per_record), pa.array(starts)),
            pa.array(error, mask=~failed),
            pa.array(offset.astype(np.int32), mask=~failed),
        ],
        names=["fields", "starts", "error", "error_offset"],
        mask=pa.array(~valid),
    )


def _unquoted(field: bytes) -> bytes:
    inner = field[1:-1] if len(field) > 1 and field.endswith(b'"') else field
    return inner.replace(b'""', b'"')


def tokenized(record: Column) -> Column:
    """``fields``, their ``starts``, and the quoting ``error`` of each record."""

    @F.arrow_udf(TOKENS)
    def run(records: pa.Array) -> pa.Array:
        return tokenize_batch(records)

    return run(record)


def _is_integer(value: Column) -> Column:
    return value.rlike(r"\A[ \t]*[+-]?[0-9]+[ \t]*\z") & F.trim(F.translate(value, "\t", " ")).try_cast("int").isNotNull()


def _is_date(value: Column) -> Column:
    return value.rlike(r"\A[0-9]{8}\z") & F.try_to_timestamp(value, F.lit("yyyyMMdd")).isNotNull()


def _is_blank(value: Column) -> Column:
    return value.rlike(r"\A\s*\z")


def _in(name: Column, names: tuple[str, ...]) -> Column:
    return name.isin(*names) if names else F.lit(False)


def _wrong(family: FileFamily, cell: Column) -> Column:
    """Reason why a (name, value) cell fails under ``family``, else null."""
    name, value = cell["name"], cell["value"]
    return (
        F.when(_in(name, family.integers) & ~_is_integer(value), F.lit("bad_integer"))
        .when(
            _in(name, family.optional_integers) & ~_is_blank(value) & ~_is_integer(value),
            F.lit("bad_integer"),
        )
        .when(_in(name, family.dates) & ~_is_date(value), F.lit("bad_date"))
    )


def typed_failure(family: FileFamily, columns: list[str]) -> Column:
    """struct(column, reason) of the first column of a row that fails under ``family``; null if none does.  Nulls count as empty."""
    cells = [(c, F.struct(F.lit(c).alias("name"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("value"))) for c in columns]
    found = [F.when(reason.isNotNull(), F.struct(F.lit(c).alias("column"), reason.alias("reason"))) for c, x in cells if (reason := _wrong(family, x)) is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<column:string,reason:string>")


def family_of(path: str, families: tuple[FileFamily, ...] = FAMILIES) -> FileFamily | None:
    """The family that a file's name prefix tells."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((f for f in families if name.startswith(f.prefix)), None)


def _cells(family: FileFamily) -> Column:
    zipped = F.arrays_zip(
        F.col("header").alias("name"), F.col("t.fields").alias("value"), F.col("t.starts").alias("start")
    )
    return F.transform(
        zipped, lambda x: F.struct(x["name"].alias("column"), x["start"].alias("offset"), _wrong(family, x).alias("reason"))
    )


def file_layouts(lines: DataFrame, refused: DataFrame) -> DataFrame:
    """One row per file: parsed header (null if the file has none) and whether it was refused whole."""
    heads = (
        lines.where("line_number = 1")
        .groupBy("relative_path")
        .agg(F.min_by("raw_line", "line_id").alias("raw_header"))
        .select("relative_path", tokenized(F.col("raw_header"))["fields"].alias("header"))
    )
    gone = refused.select("relative_path").distinct().withColumn("refused", F.lit(True))
    return heads.join(gone, "relative_path", "full_outer").select(
        "relative_path", "header", F.coalesce("refused", F.lit(False)).alias("refused")
    )


def load_records(
    lines: DataFrame, refused: DataFrame, families: tuple[FileFamily, ...] = FAMILIES, salts: int = 16
) -> DataFrame:
    """Every record with its parsed ``values`` or its ``reason``.

    ``lines``: line_id, relative_path, line_number, raw_line.  ``refused``:
    relative_path of files refused as a whole.  Further columns of either side
    are ignored.  Not records, hence absent: line 1 of a file, blank lines,
    null lines, and all lines of refused files.

    Result: line_id, relative_path, line_number, values (map column -> text,
    null for failures; of repeated header names the last holds), reason, column,
    offset (byte offset in the record, null where none applies).  Reasons:
    ``stray_quote``, ``unclosed_quote``, ``field_count``, ``bad_integer``,
    ``bad_date``, ``missing_header`` (the file delivered no line 1).  A file of
    no known family only has its quoting and field count tested.  An empty
    table gives an empty result; repeated rows are each judged.
    """
    body = lines.where("line_number <> 1 and raw_line is not null").where(~_is_blank(F.col("raw_line")))
    body = body.select("line_id", "relative_path", "line_number", "raw_line")
    spread = [F.col("line_id"), F.col("line_number")]
    joined = salted_join(body, file_layouts(lines, refused), ["relative_path"], spread, "left", salts)
    joined = joined.where(~F.coalesce("refused", F.lit(False)))
    parsed = joined.withColumn("t", tokenized(F.col("raw_line")))
    base = F.element_at(F.split("relative_path", "/"), -1)
    bad = None
    for f in families:
        first = F.get(F.filter(_cells(f), lambda x: x["reason"].isNotNull()), F.lit(0))
        test = base.startswith(f.prefix)
        bad = F.when(test, first) if bad is None else bad.when(test, first)
    none = F.lit(None)
    plain = "struct<column:string,offset:int,reason:string>"

    def failure(reason: Column, at: Column) -> Column:
        return F.struct(none.cast("string").alias("column"), at.cast("int").alias("offset"), reason.alias("reason")).cast(plain)

    verdict = (
        F.when(F.col("header").isNull(), failure(F.lit("missing_header"), none))
        .when(F.col("t.error").isNotNull(), failure(F.col("t.error"), F.col("t.error_offset")))
        .when(F.size("t.fields") != F.size("header"), failure(F.lit("field_count"), none))
    )
    if bad is not None:
        verdict = verdict.otherwise(bad)
    judged = parsed.withColumn("v", verdict)
    def kept(name: Column, i: Column) -> Column:
        last = F.size("header") - F.array_position(F.reverse(F.col("header")), name)
        return F.struct(name.alias("key"), F.get(F.col("t.fields"), i).alias("value"), (last == i).alias("holds"))

    entries = F.filter(F.transform(F.col("header"), kept), lambda x: x["holds"])
    pairs = F.transform(entries, lambda x: F.struct(x["key"], x["value"]))
    values = F.when(F.col("v.reason").isNull(), F.map_from_entries(pairs))
    return judged.select(
        "line_id", "relative_path", "line_number", values.alias("values"),
        F.col("v.reason").alias("reason"), F.col("v.column").alias("column"), F.col("v.offset").alias("offset"),
    )


def failed_records(lines: DataFrame, refused: DataFrame, **options) -> DataFrame:
    """The failing part of :func:`load_records`, without the values."""
    return load_records(lines, refused, **options).where("reason is not null").drop("values")


def loaded_records(lines: DataFrame, refused: DataFrame, **options) -> DataFrame:
    """The loading part of :func:`load_records`."""
    return load_records(lines, refused, **options).where("reason is null").drop("reason", "column", "offset")
