import zlib

from tallyframe.llm import sharding

from .helpers import corpus, docs, save


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_law_slots_and_digests(spark, tmp_path):
    rows = [*corpus(), *((i, f"t{i}") for i in range(1000, 3000)), (-5, "neg"), (2**62, "big")]
    out = sharding.op2_sharding(spark, save(docs(spark, rows), tmp_path)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        t = texts[r.doc_id]
        assert r.size == 1 + len((t or "").encode()) and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    for s in range(16):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


def test_repeated_rows_nulls_and_clashes(spark):
    rows = [(7, "same")] * 5 + [(None, "a"), (None, None)]
    out = sharding.shard(docs(spark, rows).selectExpr("doc_id", "text", "1 AS shard", "2 AS slot", "'k' AS law")).collect()
    assert len(out) == 7 and {r.shard for r in out if r.doc_id == 7} == {jump(7, 16)}
    assert {r.shard for r in out if r.doc_id is None} == {jump(0, 16)}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard(docs(spark, [])).count() == 0


def test_text_keys(spark):
    f = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    assert all(0 <= r.shard < 16 for r in sharding.shard(f).collect())


def test_plan_is_native(spark):
    plan = sharding.shard(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_keep_their_values(spark):
    names = ["_n", "_jump", "_bucket", "_before", "hi", "lo"]
    clash = docs(spark, [(1, "a"), (1, "a"), (2, None)]).selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    out = sharding.shard(clash)
    assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))] and out.count() == 3
