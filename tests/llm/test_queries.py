"""The registered queries on the smallest tables: columns, distinct rows, and the rows of the SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

from corvane.llm import queries
from tools.compare import rows_of

COLUMNS = {
    "p1_found": ["page_id", "line_no"], "p2_found": ["page_id"], "p4_found": ["page_id"], "p5_found": ["entry_id"], "p6_found": ["page_id"],
    "p7_found": ["page_id", "term"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "para_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    have, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(have)) == len(have)
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        r = con.execute(queries.SQL[name])
        want, sql_names = rows_of([d[0] for d in r.description], r.fetchall())
        assert names == sql_names and have == want
