"""Every registered query against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sedimenta.plans import fixture_queries, registry, section_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table, columns):
    held = [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in zip(*(table[c].to_pylist() for c in columns), strict=True)]
    return sorted(held, key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, other, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    columns = sorted(got.column_names)
    if name not in registry.ORACLE_SQL:
        assert columns
        return
    want = other.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    if name in fixture_queries.QUERIES or name in section_queries.QUERIES:
        assert got.num_rows, "a fixture must give rows"
        assert {c: str(want[c].type) for c in columns} == {c: str(got[c].type) for c in columns}
    assert rows(got, columns) == rows(want, columns)
