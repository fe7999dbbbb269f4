import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import mixing
from tallyframe.llm import sentencepiece_codec as sp

from .helpers import brute_components, brute_line_dedup, docs, near_copy, save, words


def rows():
    block = "\n".join(" ".join(words(s, 12)) for s in range(4))
    base = " ".join(words(31, 90))
    out = [(i, " ".join(words(100 + i, 40 + i, 3000)), "en", f"s{i % 4}") for i in range(40)]
    out += [(50, block + "\nunique one here", "en", "s1"), (51, block + "\nanother unique line", "en", "s1"), (52, block, "en", "s2")]
    out += [(60, base, "en", "s0"), (61, near_copy(base, 1, 2), "en", "s0"), (62, base, None, None), (63, base.upper(), "en", "s3")]
    out += [(70, None, "en", "s0"), (71, "", "en", "s0"), (72, "12 34", "en", "s0")]
    return out


def test_stages_and_result(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    frame = docs(spark, rows())
    path = save(frame, tmp_path)
    got = corpus_pipeline.run(spark, path).collect()
    # by brute force: undetermined documents go, then lines, then near duplicates
    kept = {i: t for i, t, _, _ in rows() if t and any(c.isalpha() for c in t)}
    cut = {i: t for i, t in brute_line_dedup(list(kept.items())).items() if t != "" or kept[i] == ""}
    groups = brute_components(list(cut.items()))
    stay = {i: t for i, t in cut.items() if groups[i][1] == i}
    source = {i: s for i, _, _, s in rows()}
    copies = {r.doc_id: r._copies for r in mixing.copies(docs(spark, [(i, t, None, source[i]) for i, t in stay.items()])).collect()}
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: n for i, n in copies.items() if n}
    v = sp.Vocabulary(sp.model_bytes())
    assert all(v.decode(list(r.ids)) == stay[r.doc_id] and r.text_crc32 == r.decoded_crc32 for r in got)
    assert 52 not in count and 61 not in count and {62, 63}.isdisjoint(count)


def test_all_but_the_last_keep_the_columns(spark, tmp_path):
    frame = docs(spark, rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes), name


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, save(docs(spark, []), tmp_path)).count() == 0


def test_rows_without_labels(spark, tmp_path):
    frame = docs(spark, [(1, "some words here", None, None), (2, "x y z", None, "a"), (3, None, None, None), (4, "12", None, None)]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, frame, str(tmp_path)).collect()
    assert {(r.doc_id, r.lang) for r in kept} == {(1, None), (2, None)}  # nothing learned: only texts without letters go
    assert np.isfinite(corpus_pipeline.drop_repeated_lines(spark, frame, str(tmp_path)).count())


def test_passages_inside_lines_go(spark, tmp_path):
    passage = "This passage is one line. It has sentences. They come again."
    frame = docs(spark, [(1, "First text. " + passage), (2, "Other text. " + passage + " Its end.")])
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, frame, str(tmp_path)).collect()} == {1: "First text. " + passage, 2: "Other text. Its end."}


def test_null_texts_stay_in_line_dedup(spark, tmp_path):
    assert corpus_pipeline.drop_repeated_lines(spark, docs(spark, [(1, None), (2, "a b")]), str(tmp_path)).count() == 2


def test_one_row_of_each_group_stays(spark, tmp_path):
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, near_copy(b, 1, 1)), (8, None), (8, None), (9, " "), (5, b)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (8, None), (8, None), (9, " ")], key=str)
    clash = docs(spark, [(1, a), (2, a)]).selectExpr("*", "1 AS row", "2 AS id", "3 AS h", "4 AS first", "5 AS nth")
    assert [(r.doc_id, r.row, r.nth) for r in corpus_pipeline.drop_near_duplicates(spark, clash, str(tmp_path)).collect()] == [(1, 1, 5)]
