from collections import Counter

import pytest

from tallyframe.llm import sentencepiece_codec as sp

from .helpers import corpus, docs, save, words

TEXTS = ["a", "  a", "", " ", " a\n\n b", "ﬁ ½ é é ▁x\x00 ▁▁ 漢字 🎉", "x" * 5000, "▁", "the " * 3, "漢" * 40, "\t\r\n", "é" * 33]


@pytest.fixture(scope="module")
def known():
    return sp.Lattices(sp.Vocabulary(sp.model_bytes()))


def split(ids, ends):
    start, out = 0, []
    for e in ends.tolist():
        out.append(ids[start:e].tolist())
        start = e
    return out


def test_round_trip_is_lossless(known):
    got = split(*sp.encode_texts(TEXTS, [str(i) for i in range(len(TEXTS))], known))
    assert [known.v.decode(x) for x in got] == TEXTS


def paths(v, word, start=0):
    """All segmentations with their weights, by brute force."""
    if start == len(word):
        yield (), 1.0
    for end in range(start + 1, len(word) + 1):
        if p := v.pieces.get(word[start:end]):
            for rest, w in paths(v, word, end):
                yield (p[0], *rest), p[1] * w


@pytest.mark.parametrize("one_by_one", [False, True])
def test_draws_follow_the_lattice(known, one_by_one):
    fresh = sp.Lattices(known.v)
    if one_by_one:
        fresh.add("▁then")
    want = dict(paths(known.v, "▁then"))
    total, n = sum(want.values()), 30_000
    got = Counter(map(tuple, split(*sp.encode_texts(["then"] * n, [f"k{i}" for i in range(n)], fresh))))
    assert set(got) <= set(want)
    assert max(abs(got[p] / n - w / total) for p, w in want.items()) < 0.012


def test_both_forward_filters_agree(known):
    words = ["▁then", "▁▁the", "ingly", "▁x", "é漢"]
    a, b = sp.Lattices(known.v), sp.Lattices(known.v)
    a.add_many(words)
    for w in words:
        b.add(w)

    def edges(k, w):
        last = k.word[w]
        out = []
        for node in range(last - len(w) + 1, last + 1):
            before, own = 0.0, {}
            for e in range(k.edge[node], k.edge[node + 1]):
                share = min(k.share[e], 1.0)
                own[k.piece[e] if k.piece[e] >= 0 else k.spelled[~k.piece[e]]] = (round(share - before, 5), k.back[e])
                before = share
            out.append(own)
        return out

    for w in words:
        assert edges(a, w) == edges(b, w)


def test_same_key_same_draw_in_any_partitioning(spark):
    rows = corpus()
    one = {r.doc_id: r.ids for r in sp.encode(docs(spark, rows).repartition(1)).collect()}
    many = {r.doc_id: r.ids for r in sp.encode(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert one == many
    other = {r.doc_id: r.ids for r in sp.encode(docs(spark, rows), seed=99).collect()}
    assert other != one


def test_query_and_columns(spark, tmp_path):
    rows = [*corpus(), (10, corpus()[0][1]), (None, "no id")]
    out = sp.op1_sentencepiece(spark, save(docs(spark, rows), tmp_path)).collect()
    assert len(out) == len(rows)
    assert all(r.text_crc32 == r.decoded_crc32 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[200].ids is None and by[200].n_pieces is None and by[201].ids == []
    back = sp.decode(sp.encode(docs(spark, rows))).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back)


def test_empty_table_and_clashing_names(spark):
    assert sp.encode(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a b")]).selectExpr("doc_id", "text", "'x' AS ids", "'y' AS n_pieces", "1 AS _key")
    assert sp.encode(clash).first().n_pieces == 2


def test_copies_draw_anew(spark):
    text = "many other people read this whole story again and wonder about its ending " * 6
    frame = docs(spark, [(1, text)] * 3 + [(2, text), (2, text + " x"), (3, None), (3, None)]).coalesce(1)
    got = sp.encode(frame, keep=["doc_id"], copies=True).collect()
    ids = [None if r.ids is None else tuple(r.ids) for r in got if r.doc_id == 1]
    assert len(set(ids)) == 3 and all(r.text_crc32 == r.decoded_crc32 for r in got)
    assert len({tuple(r.ids) for r in sp.encode(frame, keep=["doc_id"]).where("doc_id = 1").collect()}) == 1
    assert sp.encode(frame.selectExpr("*", "7 AS _key")).first()._key == 7


def test_texts_over_several_parts_of_a_batch(spark):
    """Parts of a batch of about 4 MB don't change what a row gets."""
    long = " ".join(words(4, 400000))
    rows = [(i, " ".join(words(i, 30))) for i in range(40)] + [(100, long), (101, long), (102, None)] + [(200 + i, " ".join(words(i, 30))) for i in range(40)]
    whole = {r.doc_id: r for r in sp.encode(docs(spark, rows).coalesce(1), keep=["doc_id"]).collect()}
    assert all(r.text_crc32 == r.decoded_crc32 for r in whole.values()) and len(whole) == len(rows)
    for i in (0, 39, 200, 239):
        one = sp.encode(docs(spark, [(i, dict(rows)[i])]), keep=["doc_id"]).first()
        assert list(one.ids) == list(whole[i].ids)


def test_columns_that_differ_by_case(spark):
    from tallyframe.llm import sentencepiece_codec

    frame = spark.createDataFrame([(1, "some words", 7, 8)], "doc_id long, text string, IDS int, other int")
    out = sentencepiece_codec.encode(frame)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.first().other == 8 and out.first().text_crc32 == out.first().decoded_crc32
