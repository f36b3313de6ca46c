"""Positions, zips and wide counts beyond toy size."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.relational import numbered, zip_rows

SF = "/root/testdata/sf0.1"
large = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@large
@pytest.mark.parametrize("order", [["l_orderkey", "l_linenumber"], ["l_quantity"], ["l_extendedprice"]])
def test_positions_are_whole(spark, order):
    """Each place from 0 to n - 1 once and no row lost, at a size whose ranges are sampled, with ties too."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    placed = numbered(lines, order)
    n = lines.count()
    got = placed.agg(F.count("*"), F.countDistinct("__position"), F.min("__position"), F.max("__position"), F.sum("l_partkey")).first()
    assert tuple(got) == (n, n, 0, n - 1, lines.agg(F.sum("l_partkey")).first()[0])
    if order == ["l_quantity"]:
        edges = placed.groupBy("l_quantity").agg(F.min("__position"), F.max("__position")).orderBy("l_quantity").collect()
        assert all(a[2] + 1 == b[1] for a, b in zip(edges, edges[1:], strict=False))


@large
def test_zip_keeps_every_row(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    zipped = zip_rows((orders.select("o_orderkey"), ["o_orderkey"]), (lines.select("l_orderkey"), ["l_orderkey"]))
    got = zipped.agg(F.count("*"), F.count("o_orderkey"), F.countDistinct("o_orderkey"), F.count("l_orderkey"), F.sum("l_orderkey")).first()
    n, m = orders.count(), lines.count()
    assert tuple(got) == (max(n, m), n, n, m, lines.agg(F.sum("l_orderkey")).first()[0])


def test_zip_of_unequal_and_empty_sides(spark):
    a, b = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    rows = zip_rows((a, [F.desc("a")]), (b, ["b"]), (b.limit(0).toDF("c"), ["c"])).collect()
    assert sorted(((r["a"], r["b"], r["c"]) for r in rows), key=lambda r: r[1]) == [(2, 0, None), (1, 1, None), (0, 2, None), (None, 3, None), (None, 4, None)]


def test_counts_and_ranges_beyond_32_bits(spark, session):
    session.attach("many", spark.range(3_000_000_000))
    assert session.run("SELECT COUNT(id) FROM many")[1] == [(3_000_000_000,)]
    assert session.run("SELECT range FROM range(2147483646, 2147483649)")[1] == [(2147483646,), (2147483647,), (2147483648,)]
    assert session.sql("SELECT range FROM range(0, 3)").dtypes == [("range", "int")]
