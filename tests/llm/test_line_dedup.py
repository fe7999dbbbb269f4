from tallyframe.llm import line_dedup

from .helpers import brute_line_dedup, corpus, docs, save

ROWS = [
    (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ne\ny"), (3, "a\nb"), (4, "q\nq\nq\nq\nq"), (5, None), (6, ""), (7, "\n\n\n\n"), (8, "\n\n\n\n"),
    (9, "a\nb\nc\nd\ne"), (10, "1\n2\n3\nlong\n" + "\n".join(str(i) for i in range(5000))), (11, "0\n1\n2\nother"), (12, "b\nc \nd"), (13, "tail\nq\nq\nq"), (14, "ab\n\nc\n"), (15, "ab\n\nc\n"),
]


def test_against_brute_force(spark, tmp_path):
    rows = [(1000 + i, t) for i, t in ROWS] + corpus()
    out = line_dedup.op8_line_dedup(spark, save(docs(spark, rows), tmp_path)).collect()
    want = brute_line_dedup(rows)
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(rows)
    for r in out:
        if r.text is not None:
            assert r.n_removed == r.n_lines - (len(r.text.split("\n")) if r.n_removed < r.n_lines else 0)


def test_repeated_rows_null_ids_and_clashes(spark):
    frame = docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nz"), (2, "k\nl\nm")]).selectExpr("*", "'x' AS n_lines", "'p' AS pos")
    out = line_dedup.dedup_lines(frame).collect()
    assert len(out) == 4 and {r.pos for r in out} == {"p"}
    by = sorted((str(r.doc_id), r.text) for r in out)
    assert by == [("1", ""), ("1", ""), ("2", "k\nl\nm"), ("None", "a\nb\nc\nz")]  # a null id comes first in the order
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_sentences_cover_passages_inside_lines(spark):
    passage = "One thing is here. Another follows it! Does a third? It does."
    long = " ".join(f"v{i}" for i in range(60)) + "."
    rows = [
        (1, "Start of one. " + passage + " End of one."), (2, "Start of two.\nMore of two. " + passage + " End of two.\nLast"), (3, passage),
        (4, "Alone. " + long), (5, "x y\n" + long + " Then this.\nz"), (6, "a.  b\tc. \n\n d!"), (7, None), (8, ""), (9, "tail\n" + passage),
    ]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows), sentences=True).collect()}
    assert {i: out[i] for i in (1, 4, 6)} == {i: (dict(rows)[i], n, 0) for i, n in ((1, 6), (4, 2), (6, 4))}
    assert out[2] == ("Start of two.\nMore of two. End of two.\nLast", 8, 4)
    assert out[3] == ("", 4, 4) and out[9] == ("tail", 5, 4)
    assert out[5] == ("x y\n Then this.\nz", 4, 1)
    assert out[7] == (None, None, None) and out[8] == ("", 1, 0)


def test_few_short_sentences_stay(spark):
    rows = [(1, "a b. c. d.\ne f. g h."), (2, "x. y. z. q. a b. c. Then.\ne f. g h."), (3, "g h. " * 2 + "p.")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows), sentences=True).collect()} == dict(rows)


def test_columns_keep_their_values(spark):
    names = ["positions", "_key", "_id", "_text", "_lines", "_kept", "_rest", "w", "pos", "h", "g"]
    clash = docs(spark, [(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne"), (3, None)]).selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    for sentences in (False, True):
        out = line_dedup.dedup_lines(clash, sentences=sentences)
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))]
        assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nb\nc\nd", 2: "e", 3: None}
