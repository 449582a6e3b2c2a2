import csv
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rallyframe.operators import record_quarantine as Q

LINES = "line_id bigint, relative_path string, line_number int, raw_line string, header string"


def brute(record):
    """(fields, error) by a plain character loop."""
    record = record[:-1] if record.endswith("\r") else record
    fields, field, state = [], "", "start"
    for c in record:
        if state == "start":
            if c == '"':
                state = "quoted"
            elif c == ",":
                fields.append("")
            else:
                field, state = c, "plain"
        elif state == "plain":
            if c == ",":
                fields.append(field)
                field, state = "", "start"
            elif c == '"':
                return None, "stray_quote"
            else:
                field += c
        elif state == "quoted":
            if c == '"':
                state = "closing"
            else:
                field += c
        elif c == '"':
            field, state = field + '"', "quoted"
        elif c == ",":
            fields.append(field)
            field, state = "", "start"
        else:
            return None, "stray_quote"
    return (None, "unclosed_quote") if state == "quoted" else ([*fields, field], None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n\ré ', max_size=40), min_size=1, max_size=30))
def test_tokenizer_equals_character_loop(records):
    for got, record in zip(Q.tokenize_batch(pa.array(records)).to_pylist(), records, strict=True):
        fields, error = brute(record)
        assert got["error"] == error
        if error is None:
            assert got["fields"] == fields


def test_long_records_span_chunks():
    long = '"' + "x,\n" * 5000 + '",end'
    got = Q.tokenize_batch(pa.array([long, None, "a,b"])).to_pylist()
    assert got[0]["fields"] == ["x,\n" * 5000, "end"] and got[1] is None and got[2]["fields"] == ["a", "b"]
    assert len(Q.states_of(np.zeros(0, np.uint8))) == 0


def test_reasons_and_values(spark):
    head = "ranking_date,rank,player,points"
    rows = [
        (0, "d/atp_rankings_20s.csv", 1, f"{head}\r"),
        (1, "d/atp_rankings_20s.csv", 2, "20240115,1,7,1000\r"),
        (2, "d/atp_rankings_20s.csv", 3, '"20240115"," +2 ",7,"1000"'),
        (3, "d/atp_rankings_20s.csv", 4, "20240230,1,7,1000"),
        (4, "d/atp_rankings_20s.csv", 5, "20240115,1.5,7,1000"),
        (5, "d/atp_rankings_20s.csv", 6, "20240115,1,7"),
        (6, "d/atp_rankings_20s.csv", 7, '20240115,1,7,"10"x'),
        (7, "d/atp_rankings_20s.csv", 8, "   \r"),
        (8, "d/atp_rankings_20s.csv", 9, "20240115,1,7,3000000000"),
        (9, "d/atp_rankings_20s.csv", 10, '20240115,1,7,"10'),
        (10, "d/refused.csv", 1, head),
        (11, "d/refused.csv", 2, "x"),
        (12, "d/atp_players.csv", 2, "1,a"),
        (13, "d/atp_rankings_20s.csv", 11, None),
        (14, "d/atp_matchstats_2011.csv", 1, "match_id,ace1,note"),
        (15, "d/atp_matchstats_2011.csv", 2, "5,,free 1.5"),
        (16, "d/atp_matchstats_2011.csv", 3, "5,x,"),
    ]
    lines = spark.createDataFrame([(*r, "clash") for r in rows], LINES)
    refused = spark.createDataFrame([("d/refused.csv", "unknown")], "relative_path string, raw_line string")
    got = {r.line_id: r for r in Q.load_records(lines, refused).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        1: None, 2: None, 3: "bad_date", 4: "bad_integer", 5: "field_count", 6: "stray_quote", 8: "bad_integer",
        9: "unclosed_quote", 12: "missing_header", 15: None, 16: "bad_integer",
    }
    assert got[2]["values"] == {"ranking_date": "20240115", "rank": " +2 ", "player": "7", "points": "1000"}
    assert (got[4].column, got[4].offset) == ("rank", 9) and got[6].offset == 17
    none = lines.where("false")
    assert Q.load_records(none, refused).count() == 0
    assert Q.failed_records(lines, refused.where("false")).where("line_id = 11").count() == 1


def test_random_records_against_csv(spark):
    rng = random.Random(5)
    rows = [(0, "atp_players.csv", 1, "player_id,name_first,dob", "")]
    want = {}
    for n in range(1, 400):
        fields = [rng.choice(["1", "-5", "x", "", " 7"]), rng.choice(["Ann", 'A "B"', "C,D", "E\nF"]), datetime(2000, 1, 1).strftime("%Y")]
        if rng.random() < 0.1:
            fields.append("z")
        out = []
        writer = csv.writer(type("W", (), {"write": lambda self, x: out.append(x)})(), lineterminator="")
        writer.writerow(fields)
        rows.append((n, "atp_players.csv", n + 1, "".join(out), ""))
        want[n] = len(fields) != 3 or fields[0] in ("x", "")
    lines = spark.createDataFrame(rows, LINES)
    failed = {r.line_id for r in Q.failed_records(lines, lines.where("false").select("relative_path")).collect()}
    assert failed == {n for n, bad in want.items() if bad}
