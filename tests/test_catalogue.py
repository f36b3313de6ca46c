"""Every registered query of the engine against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from millrace import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: v + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted(([value(row[k]) for k in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    expected = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in expected.description]
    left, right = comparable(got.columns, [tuple(r) for r in got.collect()]), comparable(names, expected.fetchall())
    assert left[0] == right[0] and len(left[1]) == len(right[1])
    assert [(a, b) for a, b in zip(left[1], right[1], strict=True) if repr(a) != repr(b)][:3] == []
