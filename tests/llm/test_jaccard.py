import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import graph, jaccard

from .helpers import brute_components, corpus, docs, near_copy, save, words


def check(spark, rows, **kw):
    out = jaccard.near_duplicates(docs(spark, rows), **kw).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_query(spark, tmp_path):
    rows = corpus()
    out = jaccard.op10_ngram_jaccard(spark, save(docs(spark, rows), tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


@pytest.fixture(scope="module")
def hot():
    """One large group of near copies with chains and near misses, one of exact copies, common passages."""
    r = random.Random(5)
    base = " ".join(words(77, 120))
    rows = [(i, near_copy(base, i, r.choice([1, 2, 4, 6, 9, 14]))) for i in range(150)]
    rows += [(200 + i, base) for i in range(20)]
    rows += [(300 + i, " ".join(words(77, 60)) + " " + " ".join(words(900 + i, 70, 9000))) for i in range(40)]
    rows += [(400 + i, " ".join(base.split()[: 60 + 3 * i])) for i in range(20)]
    return rows


@pytest.mark.parametrize("tiles", [{}, {"tile_sets": 8}, {"tile_bytes": 1 << 13, "tile_sets": 20}])
def test_hot_groups(spark, hot, tiles):
    check(spark, hot, **tiles)


def test_threshold_is_exact(spark):
    a = [f"t{i}" for i in range(11)]  # seven shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:9] + ["z"])), (3, " ".join(a[:10])), (4, " ".join([*a, "q", "r"])), (5, " ".join([*a, "q", "r", "s"]))]
    check(spark, rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "")]
    out = jaccard.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted([("1", 2, "1"), ("1", 2, "1"), ("None", 2, "1"), ("None", 0, "None"), ("2", 0, "2")])
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a b")]).selectExpr("*", "1 AS k", "2 AS block", "3 AS component_id")
    assert jaccard.near_duplicates(clash).first().component_id == 1


def test_components_of_long_chains(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_blocks_stay_within_bounds(spark):
    from tallyframe.llm import blocks

    for rows in (spark.range(100000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text"), spark.range(20000).selectExpr("1L AS doc_id", f"repeat('word ', 2000) AS text")):
        dealt, n = blocks.blocked(rows, "doc_id", "text")
        sizes = [(r["c"], r["b"]) for r in dealt.groupBy("block").agg(F.count("*").alias("c"), F.sum(F.length("text")).alias("b")).collect()]
        assert n > 1 and max(c for c, _ in sizes) < 1.5 * blocks.BLOCK_ROWS and max(b or 0 for _, b in sizes) < 1.5 * blocks.BLOCK_BYTES


def test_many_rows_without_words_and_repeats(spark):
    rows = [(i, None) for i in range(40000)] + [(7, "a b c d e f g")] * 300 + [(9, "a b c d e f g h")]
    out = jaccard.near_duplicates(docs(spark, rows))
    assert out.count() == len(rows)
    assert {(r.n_shingles, r.component_id) for r in out.where("n_shingles > 0").collect()} == {(3, 7), (4, 7)}


def test_messages_merged_on_the_way(spark, monkeypatch):
    from tallyframe.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 11)
    rows = corpus()
    whole = docs(spark, rows)
    assert blocks.blocked(whole, "doc_id", "text")[1] // 3 > 7
    fields = ["id", "n", "k", "tokens", "shingles"]
    plain = {(r.id, r.h): [r[f] for f in fields] for r in jaccard.shingle_sets(whole).collect()}
    routed = {(r.id, r.h): [r[f] for f in fields] for r in jaccard.shingle_sets(whole, routes=3, fan=4).collect()}
    assert plain == routed and any(p[3] for p in plain.values())


def test_hubs_are_spread(spark):
    star = spark.range(1, 3001).selectExpr("0L AS a", "id AS b")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        met = graph.with_least(star, "a", "b").groupBy(F.spark_partition_id(), "m").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in met) == 3000 and {r.m for r in met} == {1} and max(r["count"] for r in met) < 1500
    assert {r.component for r in graph.components(star).collect()} == {0}
