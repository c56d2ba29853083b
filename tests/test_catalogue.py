"""Every query that has SQL gives the same rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corvane.plans import catalogue
from tools.compare import rows_of


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    have, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.SQL:
        assert have
        return
    r = duck.execute(catalogue.SQL[name])
    want, sql_names = rows_of([d[0] for d in r.description], r.fetchall())
    assert names == sql_names and have == want


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
