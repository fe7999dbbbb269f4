import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate

from .helpers import docs, save, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        w, hit, names = cut(text), set(), set()
        for item, t in items:
            x = cut(t) if item is not None else []
            n = min(window, len(x))
            grams = {tuple(x[p : p + n]) for p in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if grams else 0):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    item = [" ".join(words(s, 25, 60)) for s in range(6)]
    items = [(n, t) for n, t in enumerate(item)] + [(10, "Zwei Wörter"), (11, "one"), (12, "zwei wörter, und mehr"), (13, ""), (14, None), (15, "--- !"), (16, item[0]), (2, "an item of the same id"), (17, "a a a a a a a a a a a a a"), (None, "nobody asked"), (18, " ".join(words(77, 90, 40)))]
    rows = [(1, "x " + item[0] + " y"), (2, item[1].upper()), (3, "start " + " ".join(item[2].split()[3:13]) + " end"), (4, " ".join(item[3].split()[:9])), (5, "so ZWEI, wörter! now"), (6, "and one, and ONE"), (7, None), (8, ""), (9, "a " * 30), (10, "nobody asked")]
    rows += [(20 + n, " ".join(words(500 + n, 300, 60))) for n in range(5)] + [(1, "x " + item[0] + " y"), (30, item[0] + " " + item[4] + " zwei wörter und mehr"), (31, "zwei\x00wörter 漢字 one\x7fone"), (32, "an item of the same id")]
    rows += [(33, " ".join(words(8, 30000, 5000)) + " " + item[5] + " " + " ".join(words(9, 20000, 60))), (34, " ".join(words(77, 90, 40)[20:60]))]
    return rows, items


def run(spark, folder, rows, items):
    save(spark.createDataFrame(items, "item_id long, text string"), folder, "benchmark")
    out = decontaminate.op12_decontaminate(spark, save(docs(spark, rows), folder))
    return sorted([tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=repr)


@pytest.mark.parametrize("part,piece,group,slice_", [(1 << 19, 1 << 15, 8, 1 << 20), (60, 16, 2, 50)])
def test_against_brute_force(spark, tmp_path, tables, monkeypatch, part, piece, group, slice_):
    for name, value in (("PART_WORDS", part), ("PIECE_WORDS", piece), ("GROUP", group), ("SLICE", slice_)):
        monkeypatch.setattr(decontaminate, name, value)
    rows, items = tables
    assert run(spark, tmp_path, rows, items) == brute(rows, items)


def test_empty_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert run(spark, tmp_path / "a", [], [(1, "some item")]) == []
    assert run(spark, tmp_path / "b", [(1, "some text"), (2, None)], []) == brute([(1, "some text"), (2, None)], [])


def test_spans_are_removed_and_covered_documents_go(spark):
    item = " ".join(words(1, 14, 100))
    rows = docs(spark, [(1, "Keep this: well. " + item + ", and that.  " * 9), (2, item), (3, None), (4, "clean  text\n"), (5, "")]).selectExpr("*", "'p' AS _found", "doc_id AS FIRST")
    out = {r.doc_id: r for r in decontaminate.decontaminate(rows, spark.createDataFrame([("i", item)], "item_id string, text string"), most=0.5).collect()}
    assert set(out) == {1, 3, 4, 5} and out[1].text == "Keep this: well. " + ", and that.  " * 9
    assert (out[3].text, out[4].text, out[5].text) == (None, "clean  text\n", "") and all(r._found == "p" and r.FIRST == r.doc_id for r in out.values())


def test_longest_match_and_spans(spark):
    item = words(1, 40, 10**6)
    frame = docs(spark, [(1, " ".join(["u", *item[5:30], "v", *item[:10], *item[20:31]])), (2, " ".join(item[:9]))])
    got = {r.doc_id: r.found for r in decontaminate.matches(frame, spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")).collect()}
    assert (got[1].first, got[1].last, got[1].longest, got[1]["items"]) == ([1, 27], [25, 47], 25, ["7"])
    assert (got[2].n_words, got[2].first, got[2].longest) == (9, [], 0)


def test_no_shuffle_of_documents(spark):
    frame = docs(spark, [(1, "a b")])
    plan = decontaminate.matches(frame, spark.createDataFrame([(7, "a b c")], "item_id int, text string")).select("doc_id", F.size("found.items"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_slices_cut_between_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    for text in (b"", b"one", b"a-b  c" * 20, b"x" * 50 + b" y", "ä".encode() * 30 + b" end "):
        assert [w for piece in decontaminate.slices(text) for w in piece.split()] == decontaminate.words(text)
