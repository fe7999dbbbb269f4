from pyspark.sql import functions as F

from tallyframe.sources import catalog
from tallyframe.streaming import updates


def test_learned_layouts_are_merged(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "table")
    one = catalog.encode(catalog.seed(spark).limit(3))
    one.write.parquet(src)
    for number in (2, 3):
        if number == 3:
            one.limit(1).withColumn("version", F.lit(7)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(one.schema).parquet(src)
        updates.merge_learned(stream, at, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(f"{at}/current")
    assert got.count() == 3 and got.agg(F.max("version")).first()[0] == 7


def test_a_broken_swap_loses_nothing(spark, tmp_path):
    at = str(tmp_path / "table")
    one = catalog.encode(catalog.seed(spark).limit(3))
    one.write.parquet(f"{at}/current")
    (tmp_path / "table" / "current").rename(tmp_path / "table" / "previous")  # as if it had stopped between the two renames
    assert updates.read(spark, at, one).count() == 3
    one.limit(2).write.parquet(f"{at}/next")
    updates.swap(spark, at)
    assert updates.read(spark, at, one).count() == 2 and spark.read.parquet(f"{at}/previous").count() == 3


def test_latest_edit_wins(spark):
    rows = [("a", 1, 4, "2025-01-01 10:00:00"), ("a", 1, 6, "2025-01-01 11:00:00"), ("a", 2, 3, "2025-01-01 09:00:00")]
    e = spark.createDataFrame(rows, "card_id string, hole int, value int, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r.hole, r.value) for r in updates.latest_edits(e).collect()} == {(1, 6), (2, 3)}


EDIT = "round_id string, hole_count int, hole_number int, strokes int, par int, at string, edit_id long"


def _edits(spark, rows):
    return spark.createDataFrame(rows, EDIT).withColumn("at", F.to_timestamp("at"))


def test_live_totals_equal_the_batch_after_every_step(spark, tmp_path, monkeypatch):
    """Late edits, repeated ones, ties, cleared holes, rounds without a valid edit; with a whole table every second batch."""
    monkeypatch.setattr(updates, "WHOLE_EVERY", 2)
    nine = [("a", 9, h, 4 + h % 3, 4, f"2025-01-01 10:0{h}:00", h) for h in range(1, 10)]
    steps = [
        nine[:5] + [("b", 2, 1, 3, 3, "2025-01-01 09:00:00", 1)],
        nine[5:] + nine[:2],  # two edits come twice
        [("a", 9, 1, 9, 4, "2025-01-01 08:00:00", 99), ("a", 9, 2, 7, 4, "2025-01-02 08:00:00", 5), ("b", 2, 2, None, 4, "2025-01-01 10:00:00", 2)],  # late and older, later, cleared
        [("b", 2, 2, 4, 4, "2025-01-01 11:00:00", 3), ("b", 2, 2, 5, 4, "2025-01-01 11:00:00", 4), ("c", 9, 40, 4, 4, "2025-01-01 11:00:00", 1), ("d", 9, 1, 4, 4, None, 1), (None, 9, 1, 4, 4, "2025-01-01 11:00:00", 1)],  # a tie in time
        [("a", 9, 9, None, 4, "2025-02-01 08:00:00", 5)],
    ]
    src, at, seen = str(tmp_path / "in"), str(tmp_path / "live"), []
    for rows in steps:
        _edits(spark, rows).coalesce(1).write.mode("append").parquet(src)
        seen += rows
        edits = _edits(spark, seen)
        updates.keep_live(spark.readStream.schema(edits.schema).parquet(src), at, str(tmp_path / "checkpoint")).awaitTermination()
        got = {r.round_id: r.asDict() for r in updates.live(spark, at).collect()}
        assert got == {r.round_id: r.asDict() for r in updates.live_totals(updates.live_holes(edits)).collect()}
    assert got["b"]["total"] == 8 and got["a"]["total"] is None and got["c"]["total"] is None and set(got) == {"a", "b", "c", "d"}
    assert sorted(p.name for p in (tmp_path / "live").iterdir()) == ["batch=2", "batch=3", "batch=4"]


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "live")
    edits = _edits(spark, [("a", 1, 1, 4, 4, "2025-01-01 10:00:00", 1)])
    edits.write.parquet(src)
    updates.keep_live(spark.readStream.schema(edits.schema).parquet(src), at, str(tmp_path / "checkpoint")).awaitTermination()
    updates.live_totals(updates.live_holes(_edits(spark, [("a", 1, 1, 9, 4, "2025-01-03 10:00:00", 1)]))).write.parquet(f"{at}/batch=1")
    (tmp_path / "live" / "batch=1" / "_SUCCESS").unlink()
    assert [r.total for r in updates.live(spark, at).collect()] == [4]


def test_no_edits_no_rounds(spark):
    assert updates.live_totals(updates.live_holes(_edits(spark, []))).count() == 0
