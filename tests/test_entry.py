import __spark_entry__
import duckdb
import pytest
from graphlens import dump_queries
from graphlens.cli import completed

SF = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["d_objects", "d_edges", "d_roots", "d_fields", "d_inspect_doubles", "d_where_inherited", "s_undo", "s_reopened_that", "s_sql"])
def test_dump_queries(spark, name):
    rows = dump_queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for table in ("region", "nation"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = db.execute(f"select {', '.join(f'"{c}"' for c in rows.columns)} from ({dump_queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, expected)) and expected


def test_completion():
    assert "RETAINING" in completed("CLASS java.lang.String RET", "RET")
    assert "TOP" in completed("ALL TO", "TO") and completed("ALL NOPE", "NOPE") == []
