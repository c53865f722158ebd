"""The queries with SQL equals against DuckDB, and all queries' columns, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tesserae.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["page_id"], "p2_found": ["page_id", "field"], "p3_found": ["page_id", "lang"], "p4_found": ["origin", "term", "mark"], "p5_found": ["page_id", "line_no"],
    "p6_found": ["page_id", "kind"], "p7_found": ["page_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = [repr(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
