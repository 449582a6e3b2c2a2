"""SQL of delivered CSV records: a record's grammar as one regular expression, its fields by extraction."""

from rallyframe.operators.record_quarantine import FAMILIES

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_WHOLE = f"'{_FIELD}(?:,{_FIELD})*'"
_OPEN = f"'(?:{_FIELD},)*\"(?:[^\"]|\"\")*'"


def _fields(record: str) -> str:
    bare = "CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END"
    return f"list_transform(regexp_extract_all(',' || {record}, ',({_FIELD})', 1), lambda x: {bare})"


def _names(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names or ("",)) + ")"


def _wrong(cell: str) -> str:
    """Reason of a cell (struct of name and value) under the family of its file, else NULL."""
    value = f"{cell}.v"
    number = f"coalesce(regexp_full_match({value}, '[ \\t]*[+-]?[0-9]+[ \\t]*') AND abs(TRY_CAST(replace(trim({value}, ' ' || chr(9)), '+', '') AS HUGEINT) + 0.5) <= 2147483648, false)"
    date = f"coalesce(regexp_full_match({value}, '[0-9]{{8}}') AND try_strptime({value}, '%Y%m%d') IS NOT NULL, false)"
    tests = []
    for f in FAMILIES:
        own = f"starts_with(base, '{f.prefix}') AND {cell}.n IN "
        tests += [f"WHEN {own}{_names(f.integers)} AND NOT {number} THEN 'bad_integer'"]
        tests += [f"WHEN {own}{_names(f.optional_integers)} AND NOT regexp_full_match({value}, '\\s*') AND NOT {number} THEN 'bad_integer'"]
        tests += [f"WHEN {own}{_names(f.dates)} AND NOT {date} THEN 'bad_date'"]
    return f"CASE {' '.join(tests)} END"


RECORDS_SQL = f"""
given AS (SELECT *, regexp_replace(relative_path, '^.*/', '') AS base, regexp_replace(raw_line, '\\r$', '') AS rec FROM raw_csv_lines
          WHERE raw_line IS NOT NULL AND relative_path NOT IN (SELECT relative_path FROM file_quarantine_records WHERE relative_path IS NOT NULL)),
heads AS (SELECT relative_path, {_fields("arg_min(rec, line_id)")} AS header FROM given WHERE line_number = 1 GROUP BY relative_path),
split AS (SELECT g.*, h.header, regexp_full_match(rec, {_WHOLE}) AS whole, {_fields("rec")} AS fields FROM given g LEFT JOIN heads h USING (relative_path)
          WHERE line_number <> 1 AND NOT regexp_full_match(raw_line, '\\s*')),
cells AS (SELECT *, list_transform(range(1, len(header) + 1), lambda i: {{'n': header[i], 'v': fields[i]}}) AS cell FROM split),
records AS (SELECT line_id, relative_path, base, line_number, header, fields,
    CASE WHEN header IS NULL THEN 'missing_header' WHEN NOT whole AND regexp_full_match(rec, {_OPEN}) THEN 'unclosed_quote' WHEN NOT whole THEN 'stray_quote'
         WHEN len(fields) <> len(header) THEN 'field_count' ELSE list_filter(list_transform(cell, lambda c: {_wrong("c")}), lambda r: r IS NOT NULL)[1] END AS reason,
    CASE WHEN header IS NOT NULL AND whole AND len(fields) = len(header) THEN list_filter(list_transform(cell, lambda c: CASE WHEN {_wrong("c")} IS NOT NULL THEN c.n END), lambda r: r IS NOT NULL)[1] END AS col
  FROM cells)"""


def _stat(name: str) -> str:
    return f"TRY_CAST(replace(trim(fields[list_position(header, '{name}')]), '+', '') AS INTEGER)"


STATS_SQL = f"""{RECORDS_SQL},
delivered AS (SELECT base AS path, line_number AS line, {_stat("1stWon1")} AS f1, {_stat("1stWon2")} AS f2, {_stat("svpt1")} AS s1, {_stat("svpt2")} AS s2, {_stat("ace1")} AS a1, {_stat("ace2")} AS a2
  FROM records WHERE reason IS NULL AND relative_path LIKE '%/atp_matchstats_%'),
stats AS (SELECT * FROM delivered QUALIFY row_number() OVER (PARTITION BY path, line
  ORDER BY f1 DESC NULLS LAST, f2 DESC NULLS LAST, s1 DESC NULLS LAST, s2 DESC NULLS LAST, a1 DESC NULLS LAST, a2 DESC NULLS LAST) = 1)"""
