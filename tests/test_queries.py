"""Every registered query runs; those with SQL equal DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else repr(value)


def ordered(columns, data):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in place) for row in data)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = [tuple(row) for row in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    relation = db.sql(sql)
    assert sorted(frame.columns) == sorted(relation.columns)
    assert ordered(frame.columns, got) == ordered(relation.columns, relation.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_changes_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from ledgerline.plans import stream_queries

    made = {}
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, name: made.setdefault(name, str(tmp_path / name)))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "tables/events.parquet"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20k")
    try:
        got = entry.queries()["stream_changes"](spark, str(tmp_path / "tables")).collect()
    finally:
        spark.conf.set(name, before)
    view = duckdb.connect()
    view.sql(f"create view events as select * from '{FOLDER}/events.parquet'")
    assert ordered(["key", "state", "outcome"], map(tuple, got)) == ordered(["key", "state", "outcome"], view.sql(entry.oracle_sql()["stream_changes"]).fetchall())
    assert len(list((tmp_path / "changes").glob("part-*"))) > 2
    assert [p.name for p in sorted((tmp_path / "changed-progress/commits").glob("[0-9]*"))] == ["0", "1", "2"]
