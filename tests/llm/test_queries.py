"""Every query of the subpackage on the smallest tables, and against DuckDB where SQL can express it."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries as Q

COLUMNS = {
    "p1_found": ["result_id", "line_no"],
    "p2_found": ["point_a", "point_b"],
    "p3_found": ["chunk_id", "line_no", "defect"],
    "p4_found": ["src", "id_a", "id_b"],
    "p5_found": ["chunk_id", "boundary"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", Q.queries())
def test_query(spark, tables, name):
    df = Q.queries()[name](spark, tables)
    assert df.columns == COLUMNS.get(name, df.columns)
    found = [tuple(r) for r in df.collect()]
    assert found
    if name.endswith("_found"):
        assert len(found) == len(set(found))
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for p in Path(tables).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
        assert sorted(found) == sorted(rows)
