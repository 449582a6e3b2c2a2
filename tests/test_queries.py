import pytest

import __spark_entry__ as entry
from oracle import DATA, connection, rows_of
from rallyframe.plans import general, reference

ORACLES = general.ORACLES | reference.ORACLES
QUERIES = general.QUERIES | reference.QUERIES
SLOW = ("ml03_", "ml04_")  # 400 trees: fitted with fewer in test_parts


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = connection().execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith(SLOW)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
