import hashlib
import math

import numpy as np
import pytest

from tallyframe.llm import compress
from tallyframe.llm.common import with_totals

SCHEMA = "vec_id long, embedding array<float>, label int"


def save(spark, folder, rows):
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def brute(rows, parts=8, entries=16, rounds=6, limit=2**25):
    ok = [(i, [4096 * float(np.float32(x)) for x in v], y) for i, v, y in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted(((i, [math.floor(x) for x in v], y) for i, v, y in ok if all(abs(x) <= limit for x in v) and len(v) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    w = len(ok[0][1]) // parts
    piece = lambda v, p: v[p * w : (p + 1) * w]
    books = [[piece(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(piece(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in ok:
                got[near(v, p)[1]].append(piece(v, p))
            new.append([[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(got, books[p], strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = [(i, [near(v, p) for p in range(parts)], y) for i, v, y in ok]
    total = {}
    for _, c, y in coded:
        total[y] = total.get(y, 0) + sum(d for d, _ in c)
    return sorted([(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), total[y], digest) for i, c, y in coded], key=repr)


def run(spark, folder, rows):
    out = compress.op13_compress(spark, save(spark, folder, rows))
    return sorted([tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = [(i, r.normal(size=16).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(20, 260)]
    out += [(300 + i, out[0][1], 1) for i in range(120)]  # a third of all rows are the same vector
    out += [(0, None, 1), (1, [1.0, None] * 8, 1), (2, [math.nan] * 16, 1), (3, [math.inf] * 16, 1), (600, [0.0] * 16, None), (601, [-0.5] * 16, None), (None, [1.0] * 16, 1), (700, [1.0, 2.0], 1), (701, [1.0] * 24, 1), (702, [], 0), (703, [3e38] * 16, 0)]
    return out + [out[5], out[5], (out[6][0], out[7][1], 2)]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 17, 1 << 14, 3, 1 << 16), (64, 30, 8, 2, 7)])
def test_against_brute_force(spark, tmp_path, rows, monkeypatch, sizes):
    for name, value in zip(("PARTITION_ROWS", "OWNER_ROWS", "BLOCK_ROWS", "CUT", "LABEL_ROWS"), sizes, strict=True):
        monkeypatch.setattr(compress, name, value)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_few_and_none(spark, tmp_path):
    few = [(5, [0.5] * 8, 1), (3, [0.25] * 8, None), (5, [0.5] * 8, 1)]
    assert run(spark, tmp_path / "a", few) == brute(few)
    assert run(spark, tmp_path / "b", []) == [] and run(spark, tmp_path / "c", [(1, None, 1)]) == []


def test_only_parts_that_change_entry_travel(spark):
    r = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, r.integers(-99, 99, 8).tolist()) for i in range(300)], "row long, ints array<long>")
    seen, was = [], compress.updated

    def noted(residents, books):
        seen.append(residents.getNumPartitions())
        assert residents.partitioner is not None
        homes = residents.mapPartitionsWithIndex(lambda n, it: [(n, compress.home(owner)) for owner, _ in it]).collect()
        assert all(h % seen[0] == n for n, h in homes)
        return was(residents, books)

    compress.updated = noted
    try:
        compress.train(frame, np.arange(32).reshape(4, 8), 4, 4, 300)
    finally:
        compress.updated = was
    assert len(set(seen)) == 1 and len(seen) == 4  # the union keeps the owners' partitions


def test_own_interface_decodes(spark):
    r = np.random.default_rng(8)
    data = {i: r.integers(-999, 999, 12).tolist() for i in range(200)}
    frame = spark.createDataFrame([(i, v, i, "x") for i, v in data.items()], "id long, ints array<long>, CODE long, _row string")
    coded, books = compress.compress(frame, parts=3, entries=32, rounds=3)
    got = coded.collect()
    assert {c.lower() for c in coded.columns} == {"id", "ints", "code", "error", "_row"} and books.shape == (3, 32, 4) and {x._row for x in got} == {"x"}
    back = compress.decode(np.array([x.code for x in got]), books)
    assert [x.error for x in got] == ((np.array([x.ints for x in got]) - back) ** 2).sum(axis=1).tolist()
    assert compress.codebook_table(spark, books).count() == 96


def test_totals_by_part(spark):
    frame = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(200)] + [(1, 1)] * 3, "k int, x long")
    from pyspark.sql import functions as F

    out = with_totals(frame, ["k"], [F.sum("x").alias("t")], 5).collect()
    want = {}
    for k, x in ((r.k, r.x) for r in out):
        want[k] = want.get(k, 0) + x
    assert len(out) == 203 and all(r.t == want[r.k] for r in out)


def test_blocks_are_joined_up_to_a_size(monkeypatch):
    monkeypatch.setattr(compress, "BLOCK_ROWS", 10)
    given = [((0, i % 2, 0), np.full((4, 2), i, np.int32)) for i in range(9)]
    got = list(compress.joined(given))
    assert all(len(x) <= 13 for _, x in got) and len(got) < len(given)
    for owner in ((0, 0, 0), (0, 1, 0)):
        assert sorted(np.concatenate([x for o, x in got if o == owner])[:, 0].tolist()) == sorted(np.concatenate([x for o, x in given if o == owner])[:, 0].tolist())
