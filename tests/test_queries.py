"""Every registered table query against its SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import operator_queries, store_queries, table_queries  # noqa: F401  all register queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(values, order):
    return sorted(tuple(repr(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_query(spark, db, name):
    frame = table_queries.QUERIES[name](spark, DATA)
    want = db.execute(table_queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(frame.columns)
    got = [tuple(r) for r in frame.collect()]
    assert got and rows(got, [frame.columns.index(c) for c in sorted(names)]) == rows(want.fetchall(), [names.index(c) for c in sorted(names)])


def test_entry_point_lists_everything():
    import __spark_entry__ as e

    assert set(table_queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Twice as many tasks where a task may hold half as many rows, and no exchange below them that gathers the rows again."""
    for name in ("numeric_signature", "classify_rows", "second_reading_merged", "template_match_resolution"):
        n = {}
        for share in (1, 2):
            monkeypatch.setattr(table_queries, "LINES", 200 // share)
            monkeypatch.setattr(table_queries, "CARDS", 10 // share)
            n[share] = table_queries.QUERIES[name](spark, DATA).rdd.getNumPartitions()
        assert n[2] >= 1.9 * n[1] > 4, (name, n)


@pytest.mark.parametrize("name", ["second_reading_merged", "classify_rows"])
def test_no_task_gathers_the_cells_it_was_dealt(spark, monkeypatch, name):
    """As large tables are joined, which aren't broadcast: no task returns many more rows than the lines a task takes."""
    monkeypatch.setattr(table_queries, "LINES", 100)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = table_queries.QUERIES[name](spark, DATA).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(made) >= 50 and max(r["count"] for r in made) <= 200, (name, len(made))


def test_cards_are_dealt_by_their_number(spark, monkeypatch):
    """Ten small suppliers lie in one file; their cards aren't all made in one task."""
    monkeypatch.setattr(table_queries, "WHOLE_CARDS", 1)
    obs = table_queries.generated_cards(spark, DATA)
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert n > 4 and obs.rdd.getNumPartitions() == n
