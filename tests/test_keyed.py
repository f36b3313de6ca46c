"""Keyed tables: upserts, deletes, and that upkeep never changes a result."""

import random
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from millrace import errors as e
from millrace.session import Session
from millrace.sources import keyed
from millrace.streaming.ingest import upsert_stream


@pytest.fixture
def db(session):
    for sql in ("CREATE DATABASE d", "USE d", "CREATE TABLE t (k INT, v DOUBLE, s STRING) UNIQUE KEY (k)"):
        session.run(sql)
    return session


def rows(session, sql="SELECT * FROM t"):
    return session.run(sql)[1]


def test_last_write_wins_and_empty_stays_apart_from_null(db):
    assert rows(db, "INSERT INTO t VALUES (2, 1.5, 'b'), (1, 1, ''), (2, 2.5, NULL)") == [(3,)]
    assert rows(db) == [(1, 1.0, ""), (2, 2.5, None)]
    db.run("INSERT INTO t VALUES (1, SQRT(4), 'x')")
    assert rows(db) == [(1, 2.0, "x"), (2, 2.5, None)]


def test_delete_and_insert_again(db):
    db.run("INSERT INTO t BULK 10")
    assert rows(db, "DELETE FROM t WHERE k % 2 = 0") == [(5,)]
    assert rows(db, "DELETE FROM t WHERE k = 99") == [(0,)]
    assert rows(db, "SELECT COUNT(k) FROM t") == [(5,)]
    db.run("INSERT INTO t VALUES (4, 0.5, 'back')")
    assert rows(db, "SELECT s FROM t WHERE k = 4") == [("back",)]
    assert rows(db, "DELETE FROM t WHERE 1 = 1") == [(6,)]
    assert rows(db) == []


def test_bulk_goes_on_from_the_counter(db):
    db.run("INSERT INTO t BULK 3")
    db.run("INSERT INTO t BULK 2")
    assert rows(db, "SELECT k, v, s FROM t WHERE k > 2") == [(3, 3.01, "s_3"), (4, 4.01, "s_4")]
    assert db.table("t").manifest.row_counter == 5


def test_insert_select(db):
    db.run("INSERT INTO t SELECT range, range * 2, 'n' FROM range(0, 4)")
    db.run("INSERT INTO t SELECT k, v + 0.5, TO_UPPER(s) FROM t WHERE k >= 2")
    assert rows(db) == [(0, 0.0, "n"), (1, 2.0, "n"), (2, 4.5, "N"), (3, 6.5, "N")]


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO t VALUES (1, 2)",
        "INSERT INTO t VALUES (NULL, 2, 'a')",
        "INSERT INTO t VALUES ('a', 2, 'a')",
        "INSERT INTO t SELECT range, range FROM range(0, 2)",
        "INSERT INTO t SELECT 'a', 1.0, 'b'",
        "INSERT INTO t SELECT NULL, 1.0, 'b'",
        "INSERT INTO t BULK 0",
        "INSERT INTO t VALUES (k, 1, 'a')",
        "INSERT INTO missing VALUES (1)",
        "DELETE FROM t WHERE nope = 1",
        "DROP TABLE missing",
        "CREATE TABLE t (k INT) UNIQUE KEY (k)",
        "CREATE TABLE u (k INT)",
        "CREATE TABLE u (k INT) UNIQUE KEY (j)",
        "CREATE TABLE u (k DOUBLE) UNIQUE KEY (k)",
        "CREATE TABLE u (k INT, k INT) UNIQUE KEY (k)",
        "CREATE TABLE u (k DATE) UNIQUE KEY (k)",
        "CREATE DATABASE d",
    ],
)
def test_refused(db, sql):
    with pytest.raises(e.EngineError):
        db.run(sql)
    assert rows(db) == []


def test_catalog(db, spark):
    db.run("CREATE TABLE a (id STRING, n INT) UNIQUE KEY (id)")
    db.run("INSERT INTO a VALUES ('z', 1), ('y', 2)")
    assert rows(db, "SHOW TABLES") == [("a",), ("t",)]
    assert rows(db, "SHOW DATABASES") == [("d",)]
    again = Session(spark, db.root.uri)
    again.run("USE d")
    assert rows(again, "SELECT * FROM a") == [("y", 2), ("z", 1)]
    db.run("DROP TABLE a")
    db.run("DROP DATABASE d")
    with pytest.raises(e.NotChoiceDatabase):
        db.run("SELECT * FROM t")


def test_upkeep_never_changes_results(db, monkeypatch):
    monkeypatch.setattr(keyed, "RUNS", 3)
    rng, expected = random.Random(1), {}
    table = db.table("t")
    for turn in range(12):
        puts = [(rng.randrange(30), turn + k / 2, f"s{turn}") for k in range(8)]
        db.run("INSERT INTO t VALUES " + ", ".join(f"({k}, {v}, '{s}')" for k, v, s in puts))
        expected |= {k: (k, v, s) for k, v, s in puts}
        if turn % 3 == 1:
            db.run(f"DELETE FROM t WHERE k < {turn}")
            expected = {k: r for k, r in expected.items() if k >= turn}
        monkeypatch.setattr(keyed, "BROADCAST_BYTES", rng.choice((0, 1 << 26)))
        if turn % 4 == 2:
            db.run("FLUSH t")
        if turn == 7:
            table.compact()
            table.vacuum()
        assert rows(db) == sorted(expected.values())
    assert [tuple(r) for r in table.get(next(iter(expected))).collect()] == [expected[next(iter(expected))]] and table.get(-1).isEmpty()


def test_two_sessions_lose_no_rows(db, spark):
    """Each writes on the state that the other has left, even if it has read an older one."""
    other = Session(spark, db.root.uri)
    other.run("USE d")
    mine, theirs = db.table("t"), other.table("t")
    for k in range(4):
        (mine, theirs)[k % 2].put_rows([(k, float(k), "x")])  # without another look at the manifest
    other.run("INSERT INTO t VALUES (9, 9, 'y')")
    assert rows(db) == rows(other) == [(k, float(k), "x") for k in range(4)] + [(9, 9.0, "y")]
    other.run("DELETE FROM t WHERE k < 9")
    assert rows(db, "SELECT k FROM t") == [(9,)]
    other.run("DROP TABLE t")
    with pytest.raises(e.NotFound):
        db.run("SELECT * FROM t")


def test_a_merge_keeps_what_is_written_meanwhile(db, spark, monkeypatch):
    table, other = db.table("t"), Session(spark, db.root.uri)
    other.run("USE d")
    for k in range(3):
        db.run(f"INSERT INTO t VALUES ({k}, {k}, 'x')")
    write = table._write

    def slow(*args, **options):
        other.run("INSERT INTO t VALUES (1, 7, 'late')")
        return write(*args, **options)

    monkeypatch.setattr(table, "_write", slow)
    table.compact()
    assert rows(db) == [(0, 0.0, "x"), (1, 7.0, "late"), (2, 2.0, "x")]
    monkeypatch.setattr(table, "_write", lambda *a, **o: (other.table("t").compact(), write(*a, **o))[1])
    table.compact()  # the other session's merge came first; this one is given up
    assert rows(db) == [(0, 0.0, "x"), (1, 7.0, "late"), (2, 2.0, "x")]
    assert len(table.refresh().manifest.segments) == 1


def test_writers_at_the_same_time_lose_no_rows(db, spark):
    """Threads that commit against each other, merges included."""
    import threading

    sessions = [Session(spark, db.root.uri) for _ in range(3)]
    tables = []
    for session in sessions:
        session.run("USE d")
        tables.append(session.table("t"))
    failed = []

    def write(w):
        try:
            for k in range(7):
                tables[w].put_rows([(100 * w + k, float(w), "x")])
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed and [r[0] for r in rows(db)] == sorted(100 * w + k for w in range(3) for k in range(7))


def test_two_generators_get_different_numbers(db, spark):
    other = Session(spark, db.root.uri)
    other.run("USE d")
    mine, theirs = db.table("t"), other.table("t")
    for table in (mine, theirs, mine):
        table.put_generated(5)
    assert rows(db, "SELECT COUNT(k), SUM(k) FROM t") == [(15, 105.0)]
    with pytest.raises(e.InsertError):
        mine.put_generated(1 << 31)


@pytest.mark.parametrize("base", [0, 1000, 10**6])
def test_small_writes_rewrite_little(base):
    """Rows that 300 writes of one row rewrite, by the policy alone: each row about a logarithm of times, the base hardly ever."""
    sizes, rewritten = [base] * (base > 0), 0
    for _ in range(300):
        sizes.append(1)
        run = keyed.pick(sizes, base > 0)
        if run:
            rewritten += sum(sizes[run[0] : run[1]])
            sizes[run[0] : run[1]] = [sum(sizes[run[0] : run[1]])]
        assert len(sizes) <= keyed.RUNS + 1 and sum(sizes) >= base
    assert rewritten < 300 * 10 + (5 * base if base <= 1000 else 0)


def test_small_writes_leave_the_base_alone(db):
    db.run("INSERT INTO t BULK 20000")
    table = db.table("t")
    table.compact()
    base = table.manifest.segments[0].name
    for k in range(12):
        db.run(f"INSERT INTO t VALUES ({k}, 0.5, 'new')")
    assert table.manifest.segments[0].name == base and len(table.manifest.segments) <= keyed.RUNS + 1
    assert rows(db, "SELECT COUNT(k), SUM(k) FROM t WHERE s = 'new'") == [(12, 66.0)] and rows(db, "SELECT COUNT(k) FROM t") == [(20000,)]


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_reads_do_not_shuffle_the_base(db, monkeypatch, limit):
    """With 200,000 changed rows: broadcast within the limit, beyond it dealt to the base's buckets."""
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 1 << 20)
    db.run("INSERT INTO t BULK 300000")
    table = db.table("t")
    table.compact()
    assert table.manifest.segments[0].buckets > 1
    db.run("INSERT INTO t SELECT range, range, 'new' FROM range(0, 200000)")
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    anti = plan[plan.index("LeftAnti") :].split("Union")[0]
    above_base = anti.split("Exchange")[0]
    assert ("BroadcastHashJoin" in plan) == (limit > 0) and "FileScan" in above_base and "Bucketed: true" in plan or limit > 0
    assert rows(db, "SELECT COUNT(k), SUM(v) FROM t WHERE s = 'new'") == [(200000, 19999900000.0)] and rows(db, "SELECT COUNT(k) FROM t") == [(300000,)]


def test_a_bucket_fits_a_task_however_well_it_compresses(db, monkeypatch):
    """200,000 rows that take little of a file: buckets follow the memory that sorting them takes, also by a manifest that doesn't tell it."""
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 1 << 21)
    db.run("INSERT INTO t SELECT range, 0, 'the same long text in each row' FROM range(0, 200000)")
    table = db.table("t")
    table.compact()
    (base,) = table.manifest.segments
    files = [pq.read_metadata(f) for f in Path(table.files.path(base.name)).glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 200000 and sum(f.row_group(0).total_byte_size for f in files) < 1 << 21
    assert len(files) == base.buckets and max(f.num_rows for f in files) * (5 * 8 + 30 + 16) < 1.1 * keyed.BUCKET_BYTES
    known, base.sort_bytes = base.sort_bytes, 0
    assert table._buckets([base]) == base.buckets and table._measured(base.name)[3] == known
    table.put_rows([(7, 1.0, "é"), (8, None, None)])
    assert table.manifest.segments[-1].sort_bytes == table._measured(table.manifest.segments[-1].name)[3]


@pytest.mark.parametrize("changes", [2000, 200000])
def test_large_changes_to_a_base_of_few_buckets(db, monkeypatch, changes):
    """The base isn't shuffled where its buckets take the changes in, though they are fewer than shuffle partitions; beyond that no task takes them all."""
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 1 << 20)
    db.run("INSERT INTO t BULK 15000")
    table = db.table("t")
    table.compact()
    assert table.manifest.segments[0].buckets == 2
    db.run(f"INSERT INTO t SELECT range + 5000, range, 'new' FROM range(0, {changes})")
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    above_base, _, changed = plan[plan.index("LeftAnti") :].split("Union")[0].partition("FileScan")
    dealt = int(re.search(r"hashpartitioning\(k#\d+, (\d+)\), REPARTITION_BY_NUM", changed)[1])
    assert ("Exchange" in above_base) == (changes > 2000) and (dealt == 2 if changes == 2000 else dealt * keyed.BUCKET_BYTES > changes * 50)
    assert rows(db, "SELECT COUNT(k) FROM t") == [(max(15000, 5000 + changes),)]
    assert rows(db, "SELECT COUNT(k), SUM(v) FROM t WHERE s = 'new'") == [(changes, changes * (changes - 1) / 2)]


def test_a_point_get_reads_one_bucket_and_asks_the_bloom_filter(db, spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 1 << 18)
    db.run("INSERT INTO t BULK 100000")
    table = db.table("t")
    table.compact()
    assert [tuple(r) for r in table.get(777).collect()] == [(777, 777.01, "s_777")]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells of the buckets
    plan, n = table.get(777)._jdf.queryExecution().executedPlan().toString(), table.manifest.segments[0].buckets
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "EqualTo(k,777)" in plan and n > 1 and f"SelectedBucketsCount: 1 out of {n}" in plan
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table.files.uri}/{table.manifest.segments[0].name}")
    files = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.getPath().getName().endswith(".parquet")]
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(files[0], spark._jsc.hadoopConfiguration())
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    column = reader.getFooter().getBlocks().get(0).getColumns().get(0)
    assert column.getBloomFilterOffset() > 0 and len(files) == n
    reader.close()


def test_equal_keys_of_one_statement(db, spark):
    """Rows of a DataFrame have no order: the greatest values count."""
    some = spark.createDataFrame([(1, 2.0, "b"), (1, None, "z"), (1, 2.0, "a"), (2, None, None)], "k int, v double, s string")
    db.table("t").put(some.repartition(3))
    assert rows(db) == [(1, 2.0, "b"), (2, None, None)]


def test_stream_replays_change_nothing(db, spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, s string").write.parquet(str(source))
    stream = spark.readStream.schema("k int, v double, s string").parquet(str(source))
    upsert_stream(stream, db.table("t"), str(tmp_path / "checkpoint"), "in").awaitTermination()
    assert rows(db) == [(1, 1.0, "a"), (2, 2.0, "b")]
    late = spark.createDataFrame([(1, 9.0, "late")], "k int, v double, s string")
    assert db.table("t").put(late, stream="in", epoch=0) == 0
    assert rows(db)[0] == (1, 1.0, "a")
