import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fields, numeric, text
from tallyframe.operators import folds, rows


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("c")).first().c


@pytest.mark.parametrize("raw, among", [("33B", 333), ("l71", 171), ("S", 5), ("9A", 94), ("1O0", 100)])
def test_candidates_hold_the_number(one, raw, among):
    assert among in one(numeric.integer_candidates(F.lit(raw)))


@pytest.mark.parametrize("raw", ["OUT", "IN", "PAR", "TOT", "TOTAL", "HCP", "HOLE", "B", "", "1234567", "x1"])
def test_words_are_no_numbers(one, raw):
    assert one(numeric.integer_candidates(F.lit(raw))) == []


def test_best_readings(one):
    b = one(numeric.best_integer(F.lit("33B")))
    assert (b.value, b.penalty) == (338, 0.25)
    assert one(numeric.best_integer(F.lit("B3"), 30, 40)).value == 33
    b = one(numeric.best_integer(F.lit("88"), 1, 15))
    assert (b.value, b.penalty) == (88, 1.0)
    assert one(numeric.best_integer(F.lit("HOLE"))) is None
    assert one(numeric.integer_candidates(F.lit("BB1"))) == [881, 831, 381, 331]


@pytest.mark.parametrize("a, b, want", [(338, 333, 2.5 / 3), (17, 12, 0.75), (500, 4, 0.0), (33, 333, 1 / 3)])
def test_number_similarity(one, a, b, want):
    assert one(numeric.number_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_names(one):
    assert one(text.normalize_name(F.lit("Bear's Best Atlanta"))) == "bear s best atlanta"
    assert one(text.normalize_name(F.lit(" Château  Élan "))) == "chateau elan"
    same = ("Château Élan", "CHÂTEAU ÉLAN", "Cha\u0302teau E\u0301lan", "chateau elan")
    assert {one(text.normalize_name(F.lit(x))) for x in same} == {"chateau elan"}
    # outside the letters that Western names need: stacked accents, Greek, Cyrillic, and letters with strokes
    assert [one(text.normalize_name(F.lit(x))) for x in ("Nguyễn Ǻ", "Ἀθῆναι", "Йошкар", "Łódź Ørsted")] == ["nguyen a", "αθηναι", "иошкар", "lodz orsted"]
    assert one(text.normalize_name(F.lit("漢字 हिन्दी"))) == "漢字 हिन्दी"
    assert one(text.significant_tokens(F.lit("The Golf Club"))) == ["the", "golf", "club"]
    good = one(text.name_similarity(F.lit("STEE CANYQN GOLE CLUB"), F.lit("Steel Canyon Golf Club")))
    bad = one(text.name_similarity(F.lit("Browns Mill Golf Course"), F.lit("Steel Canyon Golf Club")))
    assert good >= 0.78 and bad <= 0.6
    assert one(text.joined_fragments(F.array(*map(F.lit, "abcd")))) == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]


def test_fields(one):
    assert [one(fields.relative_text(F.lit(x).cast("int"))) for x in (0, 4, -2, None)] == ["E", "+4", "-2", "—"]
    assert [one(fields.level(F.lit(1), F.lit(x))) for x in (0.95, 0.7, 0.4, 0.0)] == ["high", "medium", "low", "none"]
    assert [one(fields.plausible_score(F.lit(s), F.lit(p))) for s, p in ((1, 5), (1, 3), (12, 3), (20, 4))] == [False, True, True, False]
    assert one(fields.make_field(F.lit(3), 1.7, "ocr")).confidence == 1.0
    assert one(fields.permitted_for_score(F.lit("verifiedCourseTemplate"))) is False
    e = [one(fields.edited_score(F.lit(x))) for x in ("", "7", "99", "x")]
    assert [(r.accepted, r.value) for r in e] == [(True, None), (True, 7), (False, None), (False, None)]
    assert [one(fields.within_box(F.lit(a), F.lit(b))) for a, b in ((30.355, -85.605), (35.001, -80.751), (30.354, -83.0), (33.0, -80.7))] == [True, True, False, False]


def test_labels(one):
    label = lambda *t: one(rows.match_label(F.array(*map(F.lit, t))))
    assert label("Blue", "Tees").tee == "Blue" and label("STROKE", "INDEX").kind == "handicap" and label("RED", "PAR").kind == "par" and label("SAM") is None
    assert one(rows.looks_like_player(F.array(F.lit("J. PEARLMAN")))) and not one(rows.looks_like_player(F.array(F.lit("YDS"))))
    assert one(rows.clean_player_name(F.lit(" PAR "))) is None and one(rows.clean_player_name(F.lit(" Sam "))) == "Sam"


def test_folds(one):
    run = lambda v: [h.value for h in one(folds.best_run(F.array(*[F.lit(x).cast("int") for x in v])))]
    assert run([None, 1, 2, 4, 5, 5, 99, 6]) == [1, 2, 4, 5, 6]
    assert run([10, 11, 12, 13]) == [10, 11, 12, 13]
    pair = lambda p: F.struct(F.lit(p[0]).alias("l"), F.lit(p[1]).alias("r"))
    got = one(folds.one_to_one(F.array(*map(pair, [(0, 1), (0, 2), (1, 1), (1, 3)]))))
    assert [(x.l, x.r) for x in got] == [(0, 1), (1, 3)]
