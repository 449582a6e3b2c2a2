from oracle import DATA, connection, rows_of
from rallyframe.llm import queries


def test_nearest_equals_sql(spark):
    got = queries.QUERIES["p6_found"](spark, DATA).toPandas()
    assert rows_of(got) == rows_of(connection().execute(queries.ORACLES["p6_found"]).df())


def test_found_queries_give_stated_columns(spark):
    want = {
        "p7_found": ["source_table", "record_key", "canonical_player_id"], "p8_ids": ["doc_id", "ids"],
        "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
    }
    for name, columns in want.items():
        out = queries.QUERIES[name](spark, DATA)
        assert out.columns == columns and out.count() > 0
