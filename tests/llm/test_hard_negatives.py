import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def save(spark, folder, rows):
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = [(i, r.normal(size=8).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(400)]
    out += [(400 + i, out[50][1], i % 3) for i in range(60)]  # ties
    out += [(500, None, 1), (501, [1.0, None, 0, 0, 0, 0, 0, 0], 1), (550, [math.nan] * 8, 1), (503, [math.inf] * 8, 1), (600, [0.0] * 8, 2), (650, out[0][1], None), (None, [1.0] * 8, 1), (700, [1.0, 2.0], 1), (701, [1.0, 2.5], 1), (702, [0.5, 1.0], 0), (750, [3e38] * 8, 1), (800, [1.0] * 8, 9)]
    out += [out[100], out[100], (100, out[100][1], 2), out[7], out[8]]  # repeated rows and ids
    return out


def ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    ok = [(i, ints(v), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [x for x in ok if sum(c * c for c in x[1]) < 2**62]
    anchors = {}
    for i, v, y in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, y)), (v, y))
    out = []
    for i, (v, y) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in ok if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == y][:positives]:
            band = [x for x in scored if x[2] != y and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 11, 64, 2048, 4, 6), (50, 3, 2, 16, 4, 6), (200, 5, 64, 64, 1, 2)])
def test_against_brute_force(spark, tmp_path, rows, monkeypatch, sizes):
    for name, value in zip(("CANDIDATES", "ANCHORS", "STRIP", "CHUNK", "LEVELS", "PLANES"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    out = hard_negatives.op11_hard_negatives(spark, save(spark, tmp_path, rows))
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(rows) and {x[0] for x in got} >= {0, 50, 100}


def test_empty_and_single(spark, tmp_path):
    for n, few in enumerate(([], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)])):
        assert hard_negatives.op11_hard_negatives(spark, save(spark, tmp_path / str(n), few)).count() == 0


def test_bounds_hold_and_filter():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(20, 100)) * 300, r.normal(size=(500, 100)) * 300
    b[:5], b[5], b[6] = a[:5], 0, a[0] * 1e6
    planes = hard_negatives.Planes(a, 6)
    under, over = planes.bounds(slice(0, 20), *hard_negatives.coded(b, 4))
    exact = a @ b.T
    assert (under <= exact).all() and (exact <= over).all()
    width = (over - under)[:, 7:] / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)[7:])
    assert np.median(width) < 0.45  # twice the rest's norm after four rounds


def test_rotation_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(7, 130))
    y = hard_negatives.rotated(x)
    assert y.shape == (7, 256) and np.allclose(x @ x.T, y @ y.T)


def test_many_labels_and_own_interface(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-50, 50, 6).tolist(), int(i % 40)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, ints array<long>, label long")
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(frame, F.col("id") % 10 == 0, positives=2, negatives=4, low=10, high=100).collect())
    want = []
    for i, v, y in rows:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in rows if j != i)
            for p, j, _ in [x for x in scored if x[2] == y][:2]:
                want += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate([x for x in scored if x[2] != y and 10 * -p <= 100 * -x[0] <= 100 * -p][:4])]
    assert got == sorted(want)
