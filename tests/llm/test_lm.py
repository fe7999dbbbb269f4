import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import blocks, lm

from .helpers import corpus, docs, save, words


def brute(rows, order, discount=0.75):
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    toks = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for i, t in rows:
        if train(i):
            w = toks(t)
            for k in range(1, order + 1):
                for p in range(len(w)):
                    context = tuple(w[p - j] if p - j >= 0 else b"\n" for j in range(k - 1, 0, -1))
                    counts[k][context][w[p]] += 1
    c = counts[1][()]
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w, base, total, known = toks(t), 0.0, 0.0, 0
        for p, x in enumerate(w):
            pr = (c[x] + 1) / (n + v + 1)
            base += math.log10(pr)
            known += c[x] > 0
            for k in range(2, order + 1):
                own = counts[k].get(tuple(w[p - j] if p - j >= 0 else b"\n" for j in range(k - 1, 0, -1)))
                if own:
                    s = sum(own.values())
                    pr = max(own[x] - discount, 0) / s + discount * len(own) / s * pr
            total += math.log10(pr)
        out[i] = (not train(i), len(w), known, n, base, total)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(3000 + i, " ".join(words(i % 17, 40 + i % 9))) for i in range(150)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, rows, order):
    from tallyframe.llm.common import crc_mod

    want = brute(rows, order)
    out = lm.score(docs(spark, rows), crc_mod(F.col("doc_id"), 7) != 2, order=order).collect()
    assert len(out) == len(rows)
    for r in out:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, abs=0.03 * n)  # quantised to a byte
    held = [r for r in out if r.held_out and r.doc_id >= 3000]  # texts that resemble the training texts
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_query_with_many_blocks_and_shards(spark, tmp_path, rows, monkeypatch):
    path = save(docs(spark, rows), tmp_path)
    one = {r.doc_id: r for r in lm.op9_lm_score(spark, path).collect()}
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20000)
    many = {r.doc_id: r for r in lm.op9_lm_score(spark, path).collect()}
    for i, r in one.items():
        assert many[i].base_score == pytest.approx(r.base_score, rel=1e-12) and many[i].score == pytest.approx(r.score, abs=1e-9) and many[i].n_known == r.n_known


def test_tries_hold_the_model(spark, rows):
    got = lm.tries(docs(spark, rows), F.lit(True)).collect()
    assert {r.level for r in got} == {1, 2}
    two = [lm.Shard(np.frombuffer(r.trie, np.uint8)) for r in got if r.level == 2]
    pairs = {(a, b) for _, t in rows for w in [[b"\n", *(t or "").encode().lower().split(), b" "]] for a, b in zip(w, w[1:], strict=False)}
    assert sum(s.successors.size for s in two) == len(pairs)


def test_empty_and_odd_tables(spark):
    for frame in (docs(spark, []), docs(spark, [(None, None), (5, ""), (5, "")])):
        out = lm.score(frame, F.col("doc_id").isNotNull())
        assert out.count() == frame.count()
    nothing = lm.score(docs(spark, [(1, "a b")]), F.lit(False)).first()
    assert nothing.train_tokens == 0 and nothing.score == 0 == nothing.base_score


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_elias_fano(n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 60, n).astype(np.uint64))
    raw = np.concatenate([*lm.EliasFano.of(values).parts(), np.zeros(3, np.uint8)])
    back, at = lm.EliasFano.read(raw, 0)
    assert (back.all() == values).all() and at == len(raw) - 3
    assert (blocks.from_gaps(blocks.gaps(values)) == values).all()
    dense = np.arange(n, dtype=np.uint64)
    assert (blocks.from_gaps(blocks.gaps(dense)) == dense).all() and (lm.EliasFano.of(dense).all() == dense).all()


def test_query_scores_contexts_of_two_words(spark, tmp_path, rows):
    want = brute(rows, 3)
    for r in lm.op9_lm_score(spark, save(docs(spark, rows), tmp_path)).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], abs=0.03 * r.n_tokens)


def test_scores_are_log_probabilities(spark):
    rows = [(i, "alpha beta") for i in range(3000)] + [(5000 + i, " ".join(words(i, 30))) for i in range(20)]
    want = brute(rows, 3)
    for r in lm.score(docs(spark, rows), F.lit(True), order=3).collect():
        assert r.score <= 0 and r.base_score <= 0
    for r in lm.score(docs(spark, rows), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2, order=3).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], abs=0.001 * r.n_tokens)


@pytest.mark.parametrize("sizes", [{"shard_tokens": 4000, "fan": 3, "ranked": 50}, {"shard_tokens": 300, "fan": 256, "ranked": 1000}, {"ranked": 1}])
def test_sizes_of_shards_and_messages_do_not_change_scores(spark, rows, sizes, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20000)
    want = brute(rows, 3)
    train = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2
    got = lm.score(docs(spark, rows), train, order=3, **sizes).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, abs=0.001 * n)


def test_repeated_and_null_rows(spark):
    rows = [(i, None) for i in range(20000)] + [(7, "one and the same text")] * 3000 + [(None, "one and the same text")] * 5
    got = lm.score(docs(spark, rows), F.lit(True), order=3)
    assert got.count() == len(rows)
    of = {(r.doc_id, r.n_tokens): r["count"] for r in got.groupBy("doc_id", "n_tokens").count().collect()}
    assert of[(7, 6)] == 3000 and of[(None, 6)] == 5 and of[(7, 1)] == 1
    assert got.select("n_tokens", F.round("score", 9)).distinct().count() == 2


def test_no_context_gives_away_more_than_its_mass():
    r = np.random.default_rng(1)
    for size in (1, 2, 5, 300):
        count = r.integers(1, 1000, size)
        codes = lm.quantised((count - lm.DISCOUNT) / count.sum())
        weight = lm.quantised(np.array([lm.DISCOUNT * size / count.sum()]))
        assert 0.998 < lm._P[codes].sum() + lm._P[weight][0] <= 1


@pytest.mark.parametrize("n", [1, 3, 700, 5000])
def test_successor_search(n):
    r = np.random.default_rng(n)
    for values in (np.sort(r.integers(0, 1 << 62, n).astype(np.uint64)), np.arange(n, dtype=np.uint64), np.concatenate([np.arange(n - n // 2), np.sort(r.integers(1 << 40, 1 << 41, n // 2))]).astype(np.uint64)):
        coded = lm.EliasFano.of(values)
        ask = np.concatenate([values, values + np.uint64(1), np.maximum(values, np.uint64(1)) - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        assert (coded.successor(ask) == np.searchsorted(values, ask)).all() and (coded.get(np.arange(n)) == values).all()
