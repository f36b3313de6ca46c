"""Parsing, binding, types and errors of the dialect."""

import math

import pytest

from millrace import errors as e
from millrace.plans.lexer import tokens
from millrace.plans.parser import parse


def rows(session, sql):
    return session.run(sql)[1]


def value(session, expression):
    return rows(session, f"SELECT {expression}")[0][0]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("10 + 3", 13),
        ("10 / 3", 3),
        ("-7 / 2", -3),
        ("-7 % 3", -1),
        ("7.5 % 3", 1.5),
        ("2 + 3 * 4 - 6 / 2", 11),
        ("(2 + 3) * 4", 20),
        ("1 < 2 AND 2 < 1 OR 3 = 3", 1),
        ("(1 < 2) + 1", 2),
        ("5 AND 0", 0),
        ("- - 4", 4),
        ("'abc' < 'abd'", 1),
        ("1 = 1.0", 1),
        ("1 == 2", 0),
        ("1 <> 2", 1),
        ("SQRT(16)", 4.0),
        ("ROUND(2.5)", 3.0),
        ("ROUND(-2.5)", -3.0),
        ("ROUND(2.4, 7)", 2.0),
        ("CEIL(3)", 3.0),
        ("ABS(-3)", 3),
        ("ABS(-3.5)", 3.5),
        ("LOG(0)", -math.inf),
        ("LOG10(100)", 2.0),
        ("CAST(3.99, 'INT')", 3),
        ("CAST(-3.99, 'int')", -3),
        ("CAST('3.7', 'INT')", 3),
        ("CAST('  12abc', 'INT') + 1", 13),
        ("CAST('1e2x', 'DOUBLE')", 100.0),
        ("CAST(2.5, 'STRING')", "2.500000"),
        ("CAST(LOG(-1), 'STRING')", "nan"),
        ("TO_UPPER('aé1')", "Aé1"),
        ("to_lower('ÀB')", "Àb"),
        ("NULL", None),
        ("0x10", 16.0),
        ("1e3", 1000.0),
        ("'it -- is'", "it -- is"),
        ("COUNT(5)", 1),
        ("SUM(5)", 5.0),
        ("SUM(COUNT(1))", 1.0),
    ],
)
def test_values(session, expression, expected):
    assert value(session, expression) == expected


@pytest.mark.parametrize("expression", ["LOG(-1)", "SQRT(-1)", "ASIN(2)", "ACOS(2)"])
def test_not_a_number(session, expression):
    assert math.isnan(value(session, expression))


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT 1 / 0", e.ExecutionError),
        ("SELECT 1.0 % 0.0", e.ExecutionError),
        ("SELECT 2147483647 + 1", e.ExecutionError),
        ("SELECT CAST('x1', 'INT')", e.ExecutionError),
        ("SELECT 2147483648", e.BindError),
        ("SELECT 'a' + 1", e.BindError),
        ("SELECT NULL + 1", e.BindError),
        ("SELECT 'a' = 1", e.BindError),
        ("SELECT 1.5 AND 1", e.BindError),
        ("SELECT SQRT('a')", e.BindError),
        ("SELECT SQRT()", e.BindError),
        ("SELECT TO_UPPER(1)", e.BindError),
        ("SELECT NOPE(1)", e.BindError),
        ("SELECT COUNT(1, 2)", e.BindError),
        ("SELECT CAST(1, 'DATE')", e.BindError),
        ("SELECT x", e.BindError),
        ("SELECT *", e.BindError),
        ("SELECT COUNT(*)", e.SyntaxError_),
        ("SELECT range FROM range(5)", e.BindError),
        ("SELECT range FROM range(1, 5, 0)", e.BindError),
        ("SELECT a FROM other(1, 2)", e.BindError),
        ("SELECT", e.SyntaxError_),
        ("CREATE", e.SyntaxError_),
        ("WHERE 1", e.SyntaxError_),
        ("SELECT 1 2 FROM", e.SyntaxError_),
        ("SELECT 'open", e.SyntaxError_),
        ("SELECT 1 /* open", e.SyntaxError_),
        ("SELECT 1; SELECT 2", e.SyntaxError_),
        ("SELECT ?", e.SyntaxError_),
        ("USE missing", e.DatabaseNotExists),
        ("SHOW TABLES", e.NotChoiceDatabase),
        ("DROP DATABASE missing", e.DropError),
        ("CREATE TABLE t (a INT) UNIQUE KEY (a)", e.NotChoiceDatabase),
    ],
)
def test_errors_leave_the_session_usable(session, sql, kind):
    with pytest.raises(kind):
        session.run(sql)
    assert rows(session, "SELECT 1") == [(1,)]


def test_comments_and_case():
    sql = "select 1 -- one\n, 2 // two\n # three\n #! four\n, /* five /* six */ seven */ 3;"
    assert [i.value for i in parse(sql).items] == [1, 2, 3]
    assert [t.text for t in tokens("a==b<>c −d")][:-1] == ["a", "=", "b", "!=", "c", "-", "d"]


def test_names_of_results(session):
    names, _ = session.run("SELECT range, COUNT(range) + 1, -2, 2.5, 'x', SQRT(range * 2), range < 3 FROM range(1, 3)")
    assert names == ["range", "ADD(COUNT(range), 1)", "-2", "2.500000", "x", "SQRT(MUL(range, 2))", "LT(range, 3)"]


def test_range_and_derived_tables(session):
    assert rows(session, "SELECT * FROM range(5, 0, -2)") == [(5,), (3,), (1,)]
    assert rows(session, "SELECT * FROM range(3, 3)") == []
    assert rows(session, "SELECT range + 1 FROM (SELECT * FROM range(0, 10)) WHERE range > 7") == [(9,), (10,)]
    assert rows(session, "SELECT 7 FROM range(0, 2)") == [(7,), (7,)]


def test_aggregates_beside_rows(session):
    assert rows(session, "SELECT range, range / SUM(range) FROM range(1, 4) WHERE range > 1") == [(2, 0.4), (3, 0.6)]
    assert rows(session, "SELECT SUM(range / SUM(range)) FROM range(1, 4)") == [(1.0,)]
    assert rows(session, "SELECT range FROM range(0, 5) WHERE range > SUM(range) / COUNT(range)") == [(3,), (4,)]
    assert rows(session, "SELECT SUM(range), COUNT(range) FROM range(1, 1)") == [(0.0, 0)]


def test_attached_tables_keep_their_types(spark, session):
    session.attach("a", spark.sql("SELECT 5000000000 AS big, TIMESTAMP '2020-01-01' AS at, CAST(1.5 AS DECIMAL(5, 2)) AS d, true AS yes, CAST(NULL AS INT) AS n"))
    session.attach("b", spark.sql("SELECT 1 AS big, 'x' AS s"))
    got = rows(session, "SELECT big + 1, big / 2, d * 2, yes + 1, n, at FROM a")[0]
    assert got[:5] == (5000000001, 2500000000, 3.0, 2, None)
    assert rows(session, "SELECT s, a.big FROM a, b WHERE yes AND b.big = 1") == [("x", 5000000000)]
    assert rows(session, "SELECT b.*, COUNT(n), SUM(n) FROM a, b") == [(1, "x", 1, 0.0)]
    for sql in ("SELECT big FROM a, b", "SELECT c.s FROM a", "SELECT a.s FROM a, b", "SELECT c.* FROM a", "SELECT at + 1 FROM a", "SELECT x FROM c"):
        with pytest.raises(e.EngineError):
            session.run(sql)


def test_conditions_of_comma_tables_become_a_join(spark, session):
    session.attach("a", spark.range(1000).selectExpr("id AS x")).attach("b", spark.range(1000).selectExpr("id AS y"))
    plan = session.sql("EXPLAIN SELECT COUNT(x) FROM a, b WHERE x = y").collect()
    text = "\n".join(r[0] for r in plan).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Join" in text


def test_predicates_reach_the_scan(spark, session, tmp_path):
    spark.range(100).selectExpr("id AS k", "id * 2.0 AS v", "'s' AS s").write.parquet(str(tmp_path / "p.parquet"))
    session.attach_parquet(str(tmp_path), "p")
    text = "\n".join(r[0] for r in session.sql("EXPLAIN SELECT SUM(v) FROM p WHERE k > 10 AND v <= 50").collect())
    assert "GreaterThan(k,10)" in text and "ReadSchema: struct<k:bigint,v:" in text
