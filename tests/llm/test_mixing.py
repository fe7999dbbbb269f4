import re

import pytest

from tallyframe.llm import mixing

from .helpers import corpus, docs, save, words


def fixpoint(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by rounds of resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, done, rest = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in done]
        if not free:
            return target
        total = sum(w[s] for s in free)
        now = {s: rest * w[s] / total for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return target | now
        for s in over:
            target[s] = most * sizes[s]
            done.add(s)
            rest -= target[s]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, None, "big" if i < 150 else None) for i, t in corpus()]
    for k in range(400):
        out.append((1000 + k, " ".join(words(k, 5 + k % 40)), None, f"s{k % 7}" if k % 3 else "big"))
    return out + [(5000, "", None, "blank"), (5001, None, None, "blank")]


def test_targets_and_copies(spark, tmp_path, rows):
    out = mixing.op4_mixing(spark, save(docs(spark, rows), tmp_path)).collect()
    assert len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    sums = {}
    for i, s in source.items():
        sums[s] = sums.get(s, 0) + size[i]
    want = fixpoint(sums)
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        rate = want[s] / sums[s] if sums[s] else 0
        assert r.copies in (int(rate), int(rate) + 1)
    again = mixing.op4_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_mix_emits_copies(spark, rows):
    frame = docs(spark, rows)
    counts = {r.doc_id: r._copies for r in mixing.copies(frame).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in counts.items() if n}


def test_expected_rate(spark):
    frame = docs(spark, [(i, "a b c d", None, f"s{i % 5}") for i in range(20000)])
    out = mixing.copies(frame).groupBy("source", "_source_size", "_target").sum("_copies").collect()
    for r in out:
        assert r["sum(_copies)"] * 4 == pytest.approx(r._target, rel=0.05)


def test_empty(spark):
    assert mixing.copies(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "a", None, None)]).selectExpr("*", "5 AS extra")).count() in (1, 2)


def test_columns_keep_their_values(spark, rows):
    names = ["_size", "_source_size", "_target", "_copies", "_source", "_copy", "k", "row", "top", "w"]
    clash = docs(spark, rows).selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    out = mixing.mix(clash)
    assert out.columns == clash.columns
    assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))]
    assert mixing.mix(docs(spark, rows)).count() == out.count()


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 11), None, f"http://s{i * 7919 % 3000:04d}") for i in range(6000)] + [(9999, "w " * 4000, None, "a"), (10000, "w", None, None)]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    sized = docs(spark, rows).repartition(7).selectExpr("source", "size(split(trim(text), ' ')) AS size")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = fixpoint(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
