import math
from functools import reduce
from operator import add, mul

import numpy as np
import pytest

from tallyframe.llm import ann, exact_topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, folder, rows):
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    out += [(300 + i, out[0][1]) for i in range(60)]  # ties
    out += [(400, None), (401, [1.0, None, 0, 0, 0, 0, 0, 0]), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, [0.0] * 8), (450, [0.0] * 8), (None, [1.0] * 8), (406, [1.0, 2.0])]
    return out


def usable(rows, zero):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute(rows, every, k, measure):
    out = {}
    for i, q in rows:
        if i % every == 0:
            found = sorted(((-measure(q, v), j) for j, v in rows if j != i and len(v) == len(q)))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return {i: v for i, v in out.items() if v}


def results(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def as_ints(v):
    return [math.floor(256 * float(x)) for x in v]


@pytest.mark.parametrize("blocks", [(16384, 1024, 1), (40, 3, 2)])
def test_exact_topk(spark, tmp_path, rows, monkeypatch, blocks):
    for name, value in zip(("CANDIDATES", "QUERIES", "SPREAD"), blocks, strict=True):
        monkeypatch.setattr(vectors, name, value)
    got = results(exact_topk.op3_exact_topk(spark, table(spark, tmp_path, rows)))
    whole = [(i, as_ints(v)) for i, v in usable(rows, True)]
    assert got == brute(whole, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


@pytest.mark.parametrize("blocks", [(16384, 1024, 1), (40, 3, 2)])
def test_nearest(spark, tmp_path, rows, monkeypatch, blocks):
    for name, value in zip(("CANDIDATES", "QUERIES", "SPREAD"), blocks, strict=True):
        monkeypatch.setattr(vectors, name, value)
    got = results(ann.op6_ann(spark, table(spark, tmp_path, rows)))
    assert got == brute(usable(rows, False), 20, 20, lambda a, b: reduce(add, map(mul, a, b)))  # sum() would compensate


@pytest.mark.parametrize("query", [exact_topk.op3_exact_topk, ann.op6_ann])
def test_few_repeated_and_none(spark, tmp_path, query):
    few = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.5, 0.5]), (3, [0.25, 1.0])]
    got = results(query(spark, table(spark, tmp_path / "a", few)))
    assert [x[1] for x in got[0]] == [100, 3] and sorted(x[1] for x in got[100]) == [0, 0, 3]
    assert query(spark, table(spark, tmp_path / "b", [])).count() == 0
    assert query(spark, table(spark, tmp_path / "c", [(0, [1.0])])).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(50, 16)), r.normal(size=(60, 16))
    ca, sa, na, la = ann.rounded(a)
    cb, sb, nb, lb = ann.rounded(b)
    near = ann.products(ca, cb) * np.outer(sa, sb)
    wrong = np.outer(la, np.linalg.norm(b, axis=1)) + np.outer(na, lb)
    assert (np.abs(a @ b.T - near) <= wrong + 1e-12).all()


@pytest.mark.parametrize("read", [1, 2, 100])
def test_exact_vectors_are_read_until_certain(spark, read):
    r = np.random.default_rng(9)
    rows = [(i, r.integers(-3000, 3000, 6).tolist()) for i in range(200)] + [(500 + i, [2999] * 6) for i in range(20)] + [(7, [1, 2, 3, 4, 5, 6])] * 3
    frame = spark.createDataFrame(rows, "id long, ints array<long>")
    from pyspark.sql import functions as F

    for bits in (3, 8):
        got = results(exact_topk.top_k(frame, F.col("id") % 40 == 0, k=5, bits=bits, read=read))
        assert got == brute(rows, 40, 5, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_an_outlier_widens_no_other_cell(spark):
    from pyspark.sql import functions as F

    from tallyframe.llm.common import stored

    r = np.random.default_rng(6)
    rows = [(i, r.integers(-100, 100, 16).tolist()) for i in range(2000)]
    rows[3][1][5] = 2_560_000
    frame = spark.createDataFrame(rows, "id long, ints array<long>")
    exact = stored(frame.withColumn("dim", F.size("ints")).withColumn("h", F.xxhash64("ints")))
    filed, low, high = exact_topk.approximate(exact)
    held = {x.id: np.array(x.cells) + 128 for x in filed.collect()}
    place = np.arange(16)
    assert all((low[place, held[i]] <= v).all() and (v <= high[place, held[i]]).all() for i, v in ((i, np.array(v)) for i, v in rows))
    queries = frame.where("id % 50 = 0").select(F.col("id").alias("id"), F.col("ints").alias("ints"), F.size("ints").alias("dim"))
    met = vectors.tiles(queries, filed, exact_topk.scanner(low, high, 5), exact_topk._BOUNDS).count()
    assert met < 0.1 * 40 * 2000
    assert results(exact_topk.top_k(frame, F.col("id") % 50 == 0)) == brute(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_components_that_do_not_fit_take_no_part(spark, tmp_path):
    some = [(0, [1.0, 2.0]), (50, [3e38, 1.0]), (3, [1e17, 0.0]), (4, [0.5, 0.5]), (5, [-3e38, -3e38]), (6, [1e5, -1e5])]
    got = results(exact_topk.op3_exact_topk(spark, table(spark, tmp_path, some)))
    assert got == {0: [(1, 4, 256 * 128 + 512 * 128), (2, 6, 256 * 25_600_000 - 512 * 25_600_000)]}
