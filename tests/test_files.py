import pytest
from pyspark.sql import functions as F

from tallyframe.operators import remote
from tallyframe.sources import files, store


def _names(root):
    return sorted(p.name for p in root.rglob("*") if p.is_file())


def _scans(spark, rows):
    return spark.createDataFrame([(i, o.encode() if o is not None else None, n.encode() if n else None) for i, o, n in rows], "id string, original binary, normalized binary")


def test_images_are_stored_listed_and_read(spark, tmp_path):
    at = str(tmp_path / "images")
    refs = store.store_images(_scans(spark, [("a", "large", "sm"), ("b", "x", None), ("c", None, "lost"), ("d", "", None)]).repartition(3), at)
    assert {tuple(r) for r in refs.collect()} == {("a", "a-original.jpg", "a-normalized.jpg"), ("b", "b-original.jpg", None), ("c", None, None), ("d", "d-original.jpg", None)}
    assert {(r.filename, r.bytes) for r in store.images(spark, at).collect()} == {("a-original.jpg", 5), ("a-normalized.jpg", 2), ("b-original.jpg", 1), ("d-original.jpg", 0)}
    assert store.bytes_on_disk(store.images(spark, at)).first().bytes == 8
    one = files.stored(spark, at, contents=True).where("filename = 'a-original.jpg'")
    assert [bytes(r.content) for r in one.collect()] == [b"large"]


def test_a_later_file_of_a_name_wins(spark, tmp_path):
    at = str(tmp_path / "images")
    for text in ("first", "second one"):
        store.store_images(_scans(spark, [("a", text, None)]), at)
    assert files.stored(spark, at).count() == 2
    assert [(r.filename, r.bytes) for r in store.images(spark, at).collect()] == [("a-original.jpg", 10)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    at = tmp_path / "images"
    store.store_images(_scans(spark, [("kept", "x", None)]), str(at))
    rows = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../out.jpg")).otherwise(F.concat(F.col("id"), F.lit(".jpg"))).alias("filename"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="not a file name"):
        files.store(rows.repartition(4), str(at))
    assert [n for n in _names(at) if not n.startswith(".")] == ["committed.txt", "kept-original.jpg"]
    assert not (tmp_path / "out.jpg").exists() and files.stored(spark, str(at)).count() == 1


def test_files_without_their_jobs_mark_are_not_read(spark, tmp_path):
    at = tmp_path / "images"
    store.store_images(_scans(spark, [("a", "x", None)]), str(at))
    lost = at / "job=broken" / "task=1"
    lost.mkdir(parents=True)
    (lost / "z.jpg").write_bytes(b"z")
    assert [r.filename for r in files.stored(spark, str(at)).collect()] == ["a-original.jpg"]


def test_the_sweep_deletes_old_orphans_only(spark, tmp_path):
    at = str(tmp_path / "images")
    refs = store.store_images(_scans(spark, [("a", "x", "y"), ("b", "x", "y")]), at)
    kept = refs.where("id = 'a'")
    store.sweep_images(spark, at, kept, F.current_timestamp())  # all within the grace period
    assert store.images(spark, at).count() == 4
    store.sweep_images(spark, at, kept, F.current_timestamp() + F.expr("INTERVAL 2 HOURS"))
    assert {r.filename for r in store.images(spark, at).collect()} == {"a-original.jpg", "a-normalized.jpg"}
    files.delete(spark, at, spark.createDataFrame([("a-original.jpg",), ("never-there.jpg",)], "filename string"))
    assert {r.filename for r in store.images(spark, at).collect()} == {"a-normalized.jpg"}


def test_an_empty_store(spark, tmp_path):
    assert store.images(spark, str(tmp_path / "nothing")).count() == 0
    assert store.bytes_on_disk(store.images(spark, str(tmp_path / "nothing"))).first().bytes == 0
    store.store_images(_scans(spark, []), str(tmp_path / "empty"))
    assert store.images(spark, str(tmp_path / "empty")).count() == 0


def test_second_readings_of_a_plain_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    good = '{"courseName": "A", "players": [{"name": "Ann", "holes": []}]}'
    for name, text in {"1.json": good.encode(), "x/2.json": good.encode(), "3.json": b"{broken", "4.json": b"\xff\xfe", "5.json": b"", "6.json": b'{"players": 3}', ".hidden.json": b"x"}.items():
        (tmp_path / name).write_bytes(text)
    payloads, bad = remote.second_readings(files.stored(spark, str(tmp_path), contents=True))
    assert {r.card_id for r in payloads.collect()} == {"1", "2"}
    assert {(r.filename, r.reason) for r in bad.collect()} == {("3.json", "not a reading"), ("4.json", "not UTF-8"), ("5.json", "not a reading"), ("6.json", "not a reading")}


def test_names_reach_the_reader(spark, tmp_path):
    """Files that a filter leaves out are not opened: an unreadable one gives no error row."""
    reader = files.FileReader(str(tmp_path), True)
    left = list(reader.pushFilters([files.EqualTo(("filename",), "1.json"), files.In(("filename",), ("1.json", "2.json")), files.EqualTo(("bytes",), 3)]))
    assert [f.attribute for f in left] == [("bytes",)] and reader.names == {"1.json"}
    for n in "12":
        (tmp_path / f"{n}.json").write_text("{}")
    assert [r[0] for r in reader.read(reader.partitions()[0])] == ["1.json"]


def test_packed_files_take_an_archive_a_task(spark, tmp_path):
    """Thousands of small files take no block of the disk each, and are read as they were."""
    at, n = tmp_path / "packed", 3000
    rows = spark.range(n).select(F.concat(F.col("id"), F.lit(".json")).alias("filename"), F.when(F.col("id") % 10 != 9, F.concat(F.lit("{}"), F.col("id").cast("string")).cast("binary")).alias("content"))
    files.store(rows.repartition(3), str(at), packed=True)
    assert len([p for p in at.rglob("*") if p.is_file() and not p.name.startswith(".")]) == 4 and sum(p.stat().st_blocks * 512 for p in at.rglob("*")) < n * 100
    want = {f"{i}.json": f"{{}}{i}".encode() for i in range(n) if i % 10 != 9}
    got = files.stored(spark, str(at), contents=True)
    assert {r.filename: bytes(r.content) for r in got.collect()} == want
    listed = files.stored(spark, str(at)).where("filename IN ('7.json', '9.json', '10.json')").collect()
    assert {(r.filename, r.bytes, r.content) for r in listed} == {("7.json", 3, None), ("10.json", 4, None)} and all(r.modified is not None for r in listed)
    with pytest.raises(Exception, match="packed files"):
        files.delete(spark, str(at), spark.createDataFrame([("7.json",)], "filename string"))
    bad = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../out.jpg")).otherwise(F.concat(F.col("id"), F.lit(".jpg"))).alias("filename"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="not a file name"):
        files.store(bad.repartition(4), str(at), packed=True)
    assert files.stored(spark, str(at)).count() == len(want)
