"""The registered queries of the engine itself, each with the SQL that must give the same rows.

Most are statements of the dialect over attached Parquet tables; those that write use a
keyed table in a fresh folder below the shared one that the session names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import latest, numbered, zip_rows
from millrace.session import Session
from millrace.sources.keyed import KeyedTable
from millrace.sources.shared import shared_dir

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")

Query = Callable[[SparkSession, str], DataFrame]


def _session(spark: SparkSession, sf_dir: str, root: str | None = None) -> Session:
    return Session(spark, root).attach_parquet(sf_dir, *TABLES)


def _dialect(statement: str, names: str, digits: int | None = None) -> Query:
    """A statement with its result columns renamed, doubles rounded to ``digits``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _session(spark, sf_dir).sql(statement).toDF(*names.split())
        if digits is None:
            return out
        return out.select(*[F.round(n, digits).alias(n) if k == "double" else n for n, k in out.dtypes])

    return run


#: name: (statement, result columns, DuckDB SQL, digits that doubles are rounded to)
STATEMENTS: dict[str, tuple[str, str, str, int | None]] = {
    "flagship_revenue": (
        "SELECT SUM(l_extendedprice * (1 - l_discount)) FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05",
        "revenue",
        "SELECT round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05",
        2,
    ),
    "scan_columns": (
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
        "o_orderkey o_orderstatus o_totalprice",
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
        None,
    ),
    "scan_star": ("SELECT * FROM nation", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation", None),
    "proj_arith_double": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax, l_extendedprice / l_quantity, l_extendedprice % l_quantity, l_quantity - 2.5 FROM lineitem",
        "k n charge unit rest less",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount) + l_tax, 9) AS charge, round(l_extendedprice / l_quantity, 9) AS unit, round(l_extendedprice % l_quantity, 9) AS rest, round(l_quantity - 2.5, 9) AS less FROM lineitem",
        9,
    ),
    "proj_int_div_mod": (
        "SELECT l_orderkey, (0 - l_linenumber) / 2, (0 - l_linenumber) % 3, l_linenumber * 3 - 1, l_linenumber + 10, -l_linenumber, +l_linenumber FROM lineitem",
        "k d m t p neg pos",
        "SELECT l_orderkey AS k, CAST(trunc((0 - l_linenumber) / 2) AS INTEGER) AS d, (0 - l_linenumber) % 3 AS m, l_linenumber * 3 - 1 AS t, l_linenumber + 10 AS p, 0 - l_linenumber AS neg, l_linenumber AS pos FROM lineitem",
        None,
    ),
    "cmp_as_int": (
        "SELECT o_orderkey, o_totalprice < 100000, o_totalprice <= 100000, o_totalprice > 100000, o_totalprice >= 100000, o_orderstatus = 'F', o_orderstatus != 'F' FROM orders",
        "k lt le gt ge eq ne",
        "SELECT o_orderkey AS k, (o_totalprice < 100000)::INT AS lt, (o_totalprice <= 100000)::INT AS le, (o_totalprice > 100000)::INT AS gt, (o_totalprice >= 100000)::INT AS ge, (o_orderstatus = 'F')::INT AS eq, (o_orderstatus <> 'F')::INT AS ne FROM orders",
        None,
    ),
    "logic_as_int": (
        "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'F', o_totalprice > 100000 OR o_orderstatus = 'F', (o_totalprice > 100000) + (o_orderstatus = 'F') FROM orders",
        "k both either n",
        "SELECT o_orderkey AS k, (o_totalprice > 100000 AND o_orderstatus = 'F')::INT AS both, (o_totalprice > 100000 OR o_orderstatus = 'F')::INT AS either, (o_totalprice > 100000)::INT + (o_orderstatus = 'F')::INT AS n FROM orders",
        None,
    ),
    "filter_and_or_precedence": (
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50 OR o_totalprice > 200000 AND o_orderstatus = 'O'",
        "o_orderkey o_custkey",
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50 OR o_totalprice > 200000 AND o_orderstatus = 'O'",
        None,
    ),
    "filter_pushdown_count": (
        "SELECT COUNT(o_orderkey) FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
        "n",
        "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
        None,
    ),
    "filter_string_order": (
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'C' OR c_mktsegment >= 'MB' AND c_mktsegment <> 'NONE'",
        "c_custkey c_mktsegment",
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'C' OR c_mktsegment >= 'MB' AND c_mktsegment <> 'NONE'",
        None,
    ),
    "filter_columns_compared": (
        "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > l_linenumber * 10 AND l_tax <= l_discount",
        "l_orderkey l_partkey",
        "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > l_linenumber * 10 AND l_tax <= l_discount",
        None,
    ),
    "filter_constant": ("SELECT n_name FROM nation WHERE 1 = 1", "n_name", "SELECT n_name FROM nation", None),
    "filter_null_literal": ("SELECT n_name FROM nation WHERE n_name = NULL", "n_name", "SELECT n_name FROM nation WHERE false", None),
    "filter_by_aggregate": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 2 * SUM(o_totalprice) / COUNT(o_orderkey)",
        "o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 2 * (SELECT sum(o_totalprice) / count(*) FROM orders)",
        None,
    ),
    "agg_count": ("SELECT COUNT(l_orderkey), COUNT(1) FROM lineitem", "n m", "SELECT count(*) AS n, count(*) AS m FROM lineitem", None),
    "agg_sum_int": ("SELECT SUM(l_linenumber) FROM lineitem", "s", "SELECT round(sum(l_linenumber::DOUBLE), 2) AS s FROM lineitem", 2),
    "agg_sum_double": ("SELECT SUM(l_extendedprice) FROM lineitem", "s", "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem", 2),
    "agg_simd_sum": ("SELECT SIMD_SUM(l_quantity) FROM lineitem", "s", "SELECT round(sum(l_quantity), 2) AS s FROM lineitem", 2),
    "agg_empty_input": (
        "SELECT SUM(l_quantity), COUNT(l_quantity), SIMD_SUM(l_tax) FROM lineitem WHERE l_quantity < 0",
        "s n v",
        "SELECT 0.0::DOUBLE AS s, 0::BIGINT AS n, 0.0::DOUBLE AS v",
        None,
    ),
    "agg_expression": (
        "SELECT SUM(o_totalprice) / COUNT(o_orderkey), SUM(o_totalprice > 100000) FROM orders",
        "mean n",
        "SELECT round(sum(o_totalprice) / count(*), 4) AS mean, round(sum((o_totalprice > 100000)::DOUBLE), 4) AS n FROM orders",
        4,
    ),
    "agg_broadcast_share": (
        "SELECT l_orderkey, l_linenumber, l_quantity / SUM(l_quantity) FROM lineitem WHERE l_discount > 0.02",
        "k n share",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity / sum(l_quantity) OVER (), 12) AS share FROM lineitem WHERE l_discount > 0.02",
        12,
    ),
    "agg_nested": ("SELECT SUM(COUNT(l_orderkey)), COUNT(SUM(l_tax)) FROM lineitem", "s n", "SELECT count(*)::DOUBLE AS s, 1::BIGINT AS n FROM lineitem", None),
    "fn_trigonometry": (
        "SELECT l_orderkey, l_linenumber, SIN(l_quantity), COS(l_quantity), TAN(l_quantity), ASIN(l_discount), ACOS(l_discount), ATAN(l_quantity) FROM lineitem",
        "k n s c t a b d",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(tan(l_quantity), 9) AS t, round(asin(l_discount), 9) + 0.0 AS a, round(acos(l_discount), 9) AS b, round(atan(l_quantity), 9) AS d FROM lineitem",
        9,
    ),
    "fn_sqrt_exp_log": (
        "SELECT l_orderkey, l_linenumber, SQRT(l_quantity), EXP(l_tax), LOG(l_quantity), LOG10(l_extendedprice), SQRT(l_linenumber) FROM lineitem",
        "k n q e g h i",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(sqrt(l_quantity), 9) AS q, round(exp(l_tax), 9) AS e, round(ln(l_quantity), 9) AS g, round(log10(l_extendedprice), 9) AS h, round(sqrt(l_linenumber), 9) AS i FROM lineitem",
        9,
    ),
    "fn_log_domain": (
        "SELECT l_orderkey, l_linenumber, CAST(LOG(l_discount), 'STRING'), CAST(LOG10(0 - l_quantity), 'STRING') FROM lineitem WHERE l_discount <= 0",
        "k n g h",
        "SELECT l_orderkey AS k, l_linenumber AS n, '-inf' AS g, 'nan' AS h FROM lineitem WHERE l_discount <= 0",
        None,
    ),
    "fn_ceil_floor_round": (
        "SELECT l_orderkey, l_linenumber, CEIL(l_extendedprice), FLOOR(l_extendedprice), ROUND(l_extendedprice), ROUND(0 - l_quantity / 2) FROM lineitem",
        "k n c f r h",
        "SELECT l_orderkey AS k, l_linenumber AS n, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(l_extendedprice) AS r, round(0 - l_quantity / 2) AS h FROM lineitem",
        None,
    ),
    "fn_abs": (
        "SELECT l_orderkey, ABS(0 - l_linenumber), ABS(0.5 - l_quantity) FROM lineitem",
        "k a d",
        "SELECT l_orderkey AS k, abs(0 - l_linenumber) AS a, abs(0.5 - l_quantity) AS d FROM lineitem",
        None,
    ),
    "fn_upper_lower": (
        "SELECT c_custkey, TO_UPPER(c_name), TO_LOWER(c_mktsegment) FROM customer",
        "k u l",
        "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_mktsegment) AS l FROM customer",
        None,
    ),
    "cast_double_int": (
        "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice, 'INT'), CAST(0 - l_quantity * 1.5, 'int'), CAST(l_linenumber, 'DOUBLE') FROM lineitem",
        "k n i j d",
        "SELECT l_orderkey AS k, l_linenumber AS n, CAST(trunc(l_extendedprice) AS INTEGER) AS i, CAST(trunc(0 - l_quantity * 1.5) AS INTEGER) AS j, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem",
        None,
    ),
    "cast_to_string": (
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity, 'STRING'), CAST(l_linenumber, 'STRING') FROM lineitem",
        "k n s t",
        "SELECT l_orderkey AS k, l_linenumber AS n, printf('%.6f', l_quantity) AS s, CAST(l_linenumber AS VARCHAR) AS t FROM lineitem",
        None,
    ),
    "cast_string_prefix": (
        "SELECT p_partkey, CAST(CAST(p_retailprice, 'STRING'), 'INT'), CAST(CAST(p_retailprice, 'STRING'), 'DOUBLE'), CAST('12abc', 'INT'), CAST(' -3.75e1x', 'DOUBLE') FROM part",
        "k i d c e",
        "SELECT p_partkey AS k, CAST(trunc(CAST(printf('%.6f', p_retailprice) AS DOUBLE)) AS INTEGER) AS i, CAST(printf('%.6f', p_retailprice) AS DOUBLE) AS d, 12 AS c, -37.5::DOUBLE AS e FROM part",
        None,
    ),
    "tvf_range": ("SELECT range, range * 2 FROM range(0, 10, 3)", "r d", "SELECT range::INT AS r, (range * 2)::INT AS d FROM range(0, 10, 3)", None),
    "tvf_range_down": ("SELECT range FROM range(5, -4, -2)", "r", "SELECT range::INT AS r FROM range(5, -4, -2)", None),
    "tvf_range_filtered": ("SELECT SUM(range) FROM range(1, 101) WHERE range % 2 = 0", "s", "SELECT sum(range)::DOUBLE AS s FROM range(1, 101) WHERE range % 2 = 0", None),
    "const_select": (
        "SELECT 1, 2.5, 'x', -3, 7 / 2, 7 % 4, 1 + 2 * 3 < 8",
        "a b c d e f g",
        "SELECT 1 AS a, 2.5::DOUBLE AS b, 'x' AS c, -3 AS d, 3 AS e, 3 AS f, 1 AS g",
        None,
    ),
    "subquery_nested": (
        "SELECT * FROM (SELECT * FROM (SELECT COUNT(range) FROM range(1, 6)))",
        "n",
        "SELECT count(*) AS n FROM range(1, 6)",
        None,
    ),
    "subquery_filtered": (
        "SELECT n_name FROM (SELECT n_name, n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3) WHERE n_nationkey % 2 = 1",
        "n_name",
        "SELECT n_name FROM nation WHERE n_regionkey < 3 AND n_nationkey % 2 = 1",
        None,
    ),
    "join_comma": (
        "SELECT nation.n_name, region.* FROM nation, region WHERE nation.n_regionkey = r_regionkey",
        "n_name r_regionkey r_name",
        "SELECT n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        None,
    ),
}

# --- keyed tables ---

_ORDERS = "o_custkey INT, o_orderkey INT, o_totalprice DOUBLE, o_orderstatus STRING"
_NEWEST = """SELECT o_custkey::INT AS o_custkey, o_orderkey::INT AS o_orderkey, o_totalprice, o_orderstatus FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1"""


def _keyed(spark: SparkSession, sf_dir: str, columns: str, key: str) -> Session:
    session = _session(spark, sf_dir, shared_dir(spark))
    for statement in ("CREATE DATABASE d", "USE d", f"CREATE TABLE t ({columns}) UNIQUE KEY ({key})"):
        session.sql(statement)
    return session


def _upserted(spark: SparkSession, sf_dir: str, turns: int = 4) -> Session:
    """Orders by customer, put in by several statements of rising order keys; the newest wins."""
    session = _keyed(spark, sf_dir, _ORDERS, "o_custkey")
    orders = session.rows("orders")
    most = orders.agg(F.max("o_orderkey")).first()[0] + 1
    for k in range(turns):
        part = orders.where((F.col("o_orderkey") >= k * most // turns) & (F.col("o_orderkey") < (k + 1) * most // turns))
        one = latest(part, ["o_custkey"], [F.desc("o_orderkey")])
        session.table("t").put(one.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"))
    return session


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).sql("SELECT * FROM t")


def flush_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _upserted(spark, sf_dir)
    session.sql("FLUSH t")
    return session.sql("SELECT * FROM t")


def compact_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _upserted(spark, sf_dir)
    table: KeyedTable = session.table("t")
    table.compact()
    table.vacuum()
    return session.sql("SELECT * FROM t")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _upserted(spark, sf_dir, 2)
    session.table("t").compact()
    session.sql("DELETE FROM t WHERE o_totalprice > 150000 OR o_orderstatus = 'P'")
    return session.sql("SELECT * FROM t")


def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, 2).sql("DELETE FROM t WHERE o_totalprice > 150000").toDF("n")


def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _upserted(spark, sf_dir, 2)
    session.sql("DELETE FROM t")
    return session.sql("SELECT COUNT(o_custkey) FROM t").toDF("n")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "k INT, name STRING, region DOUBLE", "k")
    session.sql("INSERT INTO t SELECT n_nationkey, TO_LOWER(n_name), n_regionkey FROM nation WHERE n_nationkey >= 5")
    return session.sql("SELECT * FROM t")


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "k INT, name STRING, x DOUBLE", "k")
    session.sql("INSERT INTO t VALUES (1, 'a', 1.5), (2, 'b', 2), (1, 'c', SQRT(16)), (3, NULL, 0.123456789)")
    session.sql("INSERT INTO t VALUES (2, 'd', 7 / 2)")
    return session.sql("SELECT * FROM t")


def insert_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "id INT, x DOUBLE, name STRING", "id")
    session.sql("INSERT INTO t BULK 500")
    session.sql("INSERT INTO t BULK 500")
    return session.sql("SELECT * FROM t")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _upserted(spark, sf_dir)
    session.table("t").compact()
    return session.sql("SELECT * FROM t WHERE o_custkey = 7")


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key, looked up in a compacted base with changes behind it."""
    session = _upserted(spark, sf_dir, 2)
    table: KeyedTable = session.table("t")
    table.compact()
    session.sql("INSERT INTO t VALUES (8, 1, 0.5, 'new')")
    session.sql("DELETE FROM t WHERE o_custkey = 10")
    return table.get(7).union(table.get(8)).union(table.get(10))


_LINES = "l_line STRING, l_partkey INT, l_suppkey INT, l_extendedprice DOUBLE"


def upsert_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem upserted under its order and line, in two statements by price; the dearer line of a key is put last and wins."""
    session = _keyed(spark, sf_dir, _LINES, "l_line")
    lines = session.rows("lineitem").withColumn("l_line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    dear = F.col("l_extendedprice") >= 50000
    for part in (lines.where(~dear), lines.where(dear)):
        one = latest(part, ["l_line"], [F.desc(c) for c in ("l_extendedprice", "l_partkey", "l_suppkey")])
        session.attach("part_of_lines", one.select("l_line", "l_partkey", "l_suppkey", "l_extendedprice"))
        session.sql("INSERT INTO t SELECT * FROM part_of_lines")
    return session.sql("SELECT * FROM t")


def upsert_many_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of all orders, then changes to half of them, read without a shuffle of the base."""
    session = _keyed(spark, sf_dir, "o_orderkey INT, o_totalprice DOUBLE, o_orderstatus STRING", "o_orderkey")
    session.sql("INSERT INTO t SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
    session.table("t").compact()
    session.sql("INSERT INTO t SELECT o_orderkey, o_totalprice + 1, TO_LOWER(o_orderstatus) FROM orders WHERE o_orderkey % 2 = 0")
    return session.sql("SELECT * FROM t")


def zip_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lineitem row by row, each in its order, nulls where the shorter one has ended."""
    s = _session(spark, sf_dir)
    orders = s.rows("orders").select("o_orderkey", "o_totalprice")
    lines = s.rows("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return zip_rows((orders, ["o_orderkey"]), (lines, lines.columns)).select("o_orderkey", "o_totalprice", *lines.columns)


def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with the place of each row by price."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return numbered(rows, rows.columns, "place")


def values_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples of literals and of constant expressions, as VALUES takes them; of tuples with one key the last counts."""
    session = _keyed(spark, sf_dir, "k INT, price DOUBLE, s STRING", "k")
    session.sql("INSERT INTO t VALUES (0, 1 + 2 * 3, 'a'), (7 / 2, SQRT(4), TO_UPPER('bé')), (-1, -2.5, NULL), (3, ABS(-1.25), CAST(12, 'STRING'))")
    return session.sql("SELECT * FROM t")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "id INT", "id")
    session.sql("CREATE TABLE a (id STRING) UNIQUE KEY (id)")
    return session.sql("SHOW TABLES")


def show_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "id INT", "id")
    session.sql("CREATE DATABASE b")
    return session.sql("SHOW DATABASES")


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is dropped and made anew has none of its rows."""
    session = _keyed(spark, sf_dir, "id INT", "id")
    session.sql("INSERT INTO t BULK 5")
    session.sql("CREATE TABLE gone (id STRING) UNIQUE KEY (id)")
    for statement in ("DROP TABLE gone", "DROP TABLE t", "CREATE TABLE t (id INT) UNIQUE KEY (id)"):
        session.sql(statement)
    names = session.sql("SHOW TABLES").toDF("name")
    return names.crossJoin(session.sql("SELECT COUNT(id) FROM t").toDF("n"))


def drop_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _keyed(spark, sf_dir, "id INT", "id")
    session.sql("CREATE DATABASE e")
    session.sql("DROP DATABASE d")
    return session.sql("SHOW DATABASES")


def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions that write to one table by turns; a third one sees what both have written."""
    one = _keyed(spark, sf_dir, "k INT, s STRING", "k")
    two, three = Session(spark, one.root.uri), Session(spark, one.root.uri)
    for session in (two, three):
        session.sql("USE d")
    for k in range(3):
        for name, session in (("one", one), ("two", two)):
            session.sql(f"INSERT INTO t VALUES ({2 * k + (name == 'two')}, '{name}'), (100, '{name}')")
    return three.sql("SELECT * FROM t")


WRITES: dict[str, tuple[Query, str]] = {
    "upsert_latest": (upsert_latest, _NEWEST),
    "flush_invariance": (flush_invariance, _NEWEST),
    "compact_invariance": (compact_invariance, _NEWEST),
    "delete_where": (delete_where, f"SELECT * FROM ({_NEWEST}) WHERE NOT (o_totalprice > 150000 OR o_orderstatus = 'P')"),
    "delete_count": (delete_count, f"SELECT count(*)::INT AS n FROM ({_NEWEST}) WHERE o_totalprice > 150000"),
    "delete_all": (delete_all, "SELECT 0::BIGINT AS n"),
    "insert_select": (insert_select, "SELECT n_nationkey AS k, lower(n_name) AS name, n_regionkey::DOUBLE AS region FROM nation WHERE n_nationkey >= 5"),
    "insert_values": (insert_values, "SELECT * FROM (VALUES (1, 'c', 4.0::DOUBLE), (2, 'd', 3.0::DOUBLE), (3, NULL, 0.123456789::DOUBLE)) v(k, name, x)"),
    "insert_bulk": (insert_bulk, "SELECT range::INT AS id, range + 0.01::DOUBLE AS x, 'name_' || range AS name FROM range(0, 1000)"),
    "point_lookup": (point_lookup, f"SELECT * FROM ({_NEWEST}) WHERE o_custkey = 7"),
    "point_get": (point_get, f"SELECT * FROM ({_NEWEST}) WHERE o_custkey = 7 UNION ALL SELECT 8, 1, 0.5, 'new'"),
    "upsert_natural_key": (
        upsert_natural_key,
        """SELECT l_line, l_partkey::INT AS l_partkey, l_suppkey::INT AS l_suppkey, l_extendedprice FROM (SELECT *, l_orderkey || '-' || l_linenumber AS l_line, row_number() OVER
           (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""",
    ),
    "upsert_many_then_read": (
        upsert_many_then_read,
        """SELECT o_orderkey::INT AS o_orderkey, o_totalprice + (o_orderkey % 2 = 0)::INT AS o_totalprice,
           CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders""",
    ),
    "zip_from": (
        zip_from,
        """SELECT o_orderkey, o_totalprice, l_orderkey, l_linenumber, l_partkey, l_extendedprice
           FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders)
           FULL JOIN (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem) USING (p)""",
    ),
    "row_positions": (
        row_positions,
        """SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey,
           row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem""",
    ),
    "values_tuples": (values_tuples, "SELECT * FROM (VALUES (0, 7.0::DOUBLE, 'a'), (3, 1.25::DOUBLE, '12'), (-1, -2.5::DOUBLE, NULL)) v(k, price, s)"),
    "show_tables": (show_tables, "SELECT * FROM (VALUES ('a'), ('t')) v(\"Tables\")"),
    "show_databases": (show_databases, "SELECT * FROM (VALUES ('b'), ('d')) v(\"Databases\")"),
    "drop_table": (drop_table, "SELECT 't' AS name, 0::BIGINT AS n"),
    "drop_database": (drop_database, "SELECT 'e' AS \"Databases\""),
    "two_writers": (two_writers, "SELECT * FROM (VALUES (0, 'one'), (1, 'two'), (2, 'one'), (3, 'two'), (4, 'one'), (5, 'two'), (100, 'two')) v(k, s)"),
}

QUERIES: dict[str, Query] = {n: _dialect(sql, names, digits) for n, (sql, names, _, digits) in STATEMENTS.items()} | {n: q for n, (q, _) in WRITES.items()}
ORACLES: dict[str, str] = {n: oracle for n, (_, _, oracle, _) in STATEMENTS.items()} | {n: oracle for n, (_, oracle) in WRITES.items()}
