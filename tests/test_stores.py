"""Databases and keyed tables: what is pushed down, what a batch leaves alone, and what a failed one leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from playmill.sources import databases
from playmill.sources.keyed import KeyedTable

SCHEMA = "id long, name string, day date, at timestamp, price double, ok boolean"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('n', id % 5)) as name", "date_add(date'2020-01-01', cast(id as int)) as day", "timestamp_seconds(id * 1000.5) as at", "cast(id as double) / 3 as price", "id % 2 = 0 as ok")


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "runs")
    databases.save(rows, path, "runs", ["id"], [F.col("id")], 4)
    return path


def test_rows_come_back(spark, rows, folder):
    got = databases.scan(spark, "runs", SCHEMA, folder, rows=60)
    assert got.count() == 1000 and got.exceptAll(rows).count() == 0
    assert got.rdd.getNumPartitions() > 16


@pytest.mark.parametrize(
    ("where", "pushed"),
    [
        ("id >= 990", "GreaterThanOrEqual(id,990)"),
        ("name = 'n3' and price < 20", "EqualTo(name,n3)"),
        ("name is null", "IsNull(name)"),
        ("day between date'2020-02-01' and date'2020-02-10'", "LessThanOrEqual(day,2020-02-10)"),
        ("id in (3, 5, 70000)", "In(id, [3,5,70000])"),
    ],
)
def test_filters_run_inside(spark, rows, folder, where, pushed):
    got = databases.scan(spark, "runs", SCHEMA, folder).where(where)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert pushed in got._jdf.queryExecution().explainString(mode).split("PushedFilters", 1)[1]
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(where).collect())


def test_filters_left_to_spark(spark, rows, folder):
    where = "at > timestamp'1970-01-05 00:00:00' and name like 'n%' and price = double('NaN') is false"
    got = databases.scan(spark, "runs", SCHEMA, folder).where(where)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where(where).collect())


def test_missing_databases_and_columns(spark, folder, tmp_path):
    one = os.path.join(folder, next(n for n in os.listdir(folder) if n.endswith(".db")))
    named = {"a": one, "gone": str(tmp_path / "none.db")}
    got = databases.scan(spark, "runs", "id long, absent string", databases=named, provenance="source")
    assert {(r.source, r.absent) for r in got.collect()} == {("a", None)}
    assert got.where("absent = 'x'").count() == 0 and got.where("absent is null").count() == got.count()
    assert databases.scan(spark, "other", "id long", databases=named).count() == 0


def test_wide_gaps_of_row_ids(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "gaps.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
        db.executemany("INSERT INTO t VALUES (?)", [(i * 10**12,) for i in range(25)])
    got = databases.scan(spark, "t", "id long", databases={"a": path}, rows=10)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 25


def test_failed_save_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "failing")
    databases.save(rows, path, "runs", ["id"], [F.col("id")], 4)
    before = sorted(os.listdir(path))
    bad = rows.select(F.when(F.col("id") == 500, F.lit(None)).otherwise(F.col("id")).alias("id"), "name", "day", "at", "price", "ok")
    with pytest.raises(Exception, match="id is null"):
        databases.save(bad, path, "runs", ["id"], [F.col("name")], 4)
    assert sorted(os.listdir(path)) == before
    assert databases.scan(spark, "runs", SCHEMA, path).exceptAll(rows).count() == 0


def test_second_of_two_saves_fails(spark, rows, tmp_path):
    path = str(tmp_path / "racing")
    options = {"path": path, "table": "runs", "key": '["id"]'}
    first, second = (databases.DatabaseWriter(rows.schema, options, False) for _ in range(2))
    first.commit([])
    with pytest.raises(FileExistsError):
        second.commit([])
    assert sorted(os.listdir(path)) == ["manifest-0000000001.json"]


def parquet_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_keyed_table_touches_few_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "keyed"), ["id"], 16)
    rows = spark.range(5000).selectExpr("id", "'a' as v", "0 as turn")
    assert table.upsert(rows, [F.col("turn")]) == 16
    held = set(table._manifest()["buckets"].values())
    files = parquet_files(tmp_path)
    # one key a thousand times: its last turn counts, and one bucket is written
    hot = spark.range(1000).selectExpr("7L as id", "concat('b', id) as v", "cast(id as int) as turn")
    assert table.upsert(hot, [F.col("turn")]) == 1
    assert len(held & set(table._manifest()["buckets"].values())) == 15 and files < parquet_files(tmp_path)
    more = spark.range(4999, 5002).selectExpr("id", "'c' as v", "0 as turn", "1.5D as added")
    table.upsert(more, [F.col("turn")])
    got = {r.id: (r.v, r.added) for r in table.read().collect()}
    assert len(got) == 5002 and got[7] == ("b999", None) and got[5001] == ("c", 1.5) and got[8] == ("a", None)
    assert table.lookup(7).select("v").collect()[0].v == "b999" and table.lookup(10**6).count() == 0
    assert table.vacuum() == 0 or table.read().count() == 5002
    assert {r.id: r.v for r in table.read().collect()} == {k: v for k, (v, _) in got.items()}


def test_keyed_table_edges(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "edges"), ["a", "b"], 4)
    empty = spark.createDataFrame([], "a int, b string, v int")
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    assert table.upsert(empty, [F.col("v")]) == 0 and table.read().count() == 0
    table.upsert(spark.createDataFrame([(None, "x", 1), (None, "x", 2), (1, None, 3)], "a int, b string, v int"), [F.col("v")])
    assert sorted(r.v for r in table.read().collect()) == [2, 3]
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, str(tmp_path / "edges"), ["a", "b"], 8).upsert(empty, [F.col("v")])


def test_dead_and_second_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "dead"), ["id"], 4)
    rows = spark.range(100).selectExpr("id", "'a' as v")
    table.upsert(rows, [F.col("v")])
    bad = rows.withColumn("v", F.when(F.col("id") == 50, F.raise_error(F.lit("dies"))).otherwise(F.lit("b")))
    with pytest.raises(Exception, match="dies"):
        table.upsert(bad, [F.col("id")])
    assert {r.v for r in table.read().collect()} == {"a"}
    old = table._manifest()
    table.upsert(rows.withColumn("v", F.lit("c")), [F.col("v")])
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit({**old, "version": old["version"] + 1})
    assert {r.v for r in table.read().collect()} == {"c"}
    assert table.vacuum() >= 1 and table.read().count() == 100
