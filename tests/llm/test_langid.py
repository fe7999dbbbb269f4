import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid

from .helpers import docs, save

SYLLABLES = {"aa": "ba be bi bo ka ke ki ko", "bb": "thr ing ous sch ght est", "cc": "éa ñu çe ãi ôu"}


def text(lang, seed, n):
    r = np.random.default_rng(seed)
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s, size=3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(la, i, 30), la, None) for i, la in enumerate(list(SYLLABLES) * 60)]
    out += [(500, None, "aa", None), (501, "", "aa", None), (502, "123 !?", "bb", None), (503, text("aa", 9, 20), None, None), (504, "x", None, None), (505, text("bb", 3, 30000), "bb", None), (506, text("cc", 3, 20), "", None)]
    return out


def test_held_out_accuracy_and_undetermined(spark, tmp_path, rows):
    out = langid.op7_language_id(spark, save(docs(spark, rows), tmp_path)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, _, la, _ in rows[:180]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(by[i].lang_pred, la) for i, _, la, _ in rows[:180] if by[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502))
    assert by[503].lang_pred == "aa" and by[504].lang_pred in SYLLABLES and by[505].lang_pred == "bb" and by[506].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in out)


def test_mixtures_are_found(spark, rows):
    model = langid.fit(docs(spark, rows), F.lit(True))
    mixed = text("aa", 1, 60) + " " + text("bb", 2, 30)
    lang, score, langs, shares = model.predict(mixed)
    assert lang == "aa" and set(langs) == {"aa", "bb"} and 0.5 < score < 0.9
    assert model.predict(text("cc", 5, 50))[2] == ["cc"]


def test_nothing_learned_and_clashes(spark):
    frame = docs(spark, [(1, "abc", None, None), (2, None, None, None)])
    model = langid.fit(frame, F.lit(True))
    assert {r.lang_pred for r in langid.identify(frame, model).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).count() == 0
    clash = frame.selectExpr("*", "1 AS score", "2 AS lang_pred")
    assert langid.identify(clash, model).columns[-4:] == ["lang_pred", "score", "langs", "shares"]


def test_proportions_against_a_plain_version():
    """Expectation-maximisation with responsibilities written out, one trigram at a time."""
    r = np.random.default_rng(3)
    p = r.dirichlet(np.ones(40), size=3)
    count = r.integers(0, 9, 40).astype(float)
    share = [1 / 3] * 3
    for _ in range(langid.ROUNDS):
        sums = [0.0] * 3
        for b in range(40):
            every = sum(share[i] * p[i, b] for i in range(3))
            for i in range(3):
                sums[i] += count[b] * share[i] * p[i, b] / every
        share = [x / count.sum() for x in sums]
    likelihood = sum(count[b] * math.log(sum(share[i] * p[i, b] for i in range(3))) for b in range(40))
    got, value = langid.Model.fit(p, count, count.sum())
    assert got == pytest.approx(share, rel=1e-9) and value == pytest.approx(likelihood, rel=1e-9)


def test_every_label_is_learned(spark):
    rows = [(i, f"alpha{i % 70} beta{i % 70}x gamma{i % 70 * 7}", f"l{i % 70:02}", None) for i in range(700)] + [(1000 + i, "the usual words of the usual language", "en", None) for i in range(3000)]
    frame = docs(spark, rows)
    model = langid.fit(frame, F.lit(True))
    assert len(model.langs) == 71 and "l69" in model.langs
    out = langid.identify(frame.where("doc_id < 700"), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 70:02}" for r in out) > 650


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    with pytest.raises(ValueError):
        langid.fit(docs(spark, [(i, "some text", f"l{i}", None) for i in range(6)]), F.lit(True))


def test_columns_that_differ_by_case(spark):
    frame = docs(spark, [(1, "some words", "en", None)]).selectExpr("*", "1 AS Score", "2 AS LANGS", "3 AS other")
    out = langid.identify(frame, langid.fit(frame, F.lit(True)))
    assert {c.lower() for c in out.columns} >= {"score", "langs", "other"} and len({c.lower() for c in out.columns}) == len(out.columns) and out.first().other == 3
