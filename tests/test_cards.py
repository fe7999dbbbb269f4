import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import extract, remote, report
from tallyframe.plans import cards as pipeline
from tallyframe.sources import catalog, fixtures, store
from tallyframe.sources.fixtures import Card, Row, golden_card

C = (4, 4, 3, 4, 3, None, 3, 4, 4, 4, 3, 3, 3, 4, 4, 4, 4, None)
J = (6, 4, 3, 5, 3, 8, 5, 3, 3, 4, 5, 4, 3, 4, 4, 6, 4, 3)
DAMAGE = {"WHITE": (16, "33B"), "BLACK": (12, None), "HCP": (5, "l7"), "PAR": (6, "S"), "RED": (3, "9A")}


def made() -> dict[str, Card]:
    base = golden_card()
    nine = Card((Row.printed("WHITE", (310, 145, 402, 168, 355, 290, 175, 388, 330)), Row.printed("PAR", (4, 3, 4, 3, 4, 4, 3, 4, 4)), Row.printed("HCP", (3, 9, 1, 7, 5, 4, 8, 2, 6)), Row.handwritten("SAM", (5, 3, 6, 4, 5, 4, 3, 5, 4))), holes=9, titles=("PINE NINE GOLF COURSE",))
    mess = tuple(fixtures.GOLDEN_SCORES[:3]) + ("~",) + tuple(fixtures.GOLDEN_SCORES[4:6]) + (None,) + tuple(fixtures.GOLDEN_SCORES[7:10]) + ("88",) + tuple(fixtures.GOLDEN_SCORES[11:])
    two = replace(base, rows=(*base.rows[:5], Row.handwritten("MIKE", fixtures.GOLDEN_SCORES), Row.handwritten("DANA", C)))
    return {
        "flat": base, "stacked": golden_card(stacked=True), "skewed": golden_card(skew=-7.0), "real": golden_card(C, "C", confidence=0.60, totals=(35, 33, 68)), "mess": golden_card(mess), "nine": nine, "two": two,
        "damaged": replace(base, rows=tuple(r.corrupting(*DAMAGE[r.label]) if r.label in DAMAGE else r for r in base.rows), titles=("STEE CANYQN GOLE CLUB",)),
        "off": golden_card(fixtures.GOLDEN_SCORES, "OFF", confidence=0.60, totals=(36, 35, 71)),
        "receipt": Card((), titles=("CORNER SHOP", "MILK 3.50"), header=(None,) * 18), "blank": golden_card(None), "blank2": golden_card(None),
    }


@pytest.fixture(scope="module")
def read(spark):
    asked = spark.createDataFrame([("silent",), ("flat",)], "card_id string")
    return pipeline.parse(fixtures.frame(spark, made()), catalog.seed(spark), requested=asked, keep=pipeline.cut)


@pytest.fixture(scope="module")
def cards(read):
    return {r.card_id: r for r in read.cards.collect()}


@pytest.fixture(scope="module")
def holes(read):
    out = {}
    for r in read.holes.orderBy("hole").collect():
        out.setdefault(r.card_id, []).append(r)
    return out


def test_layout(read, cards):
    cols = {(r.card_id, r.section): r.n for r in read.table.hole_columns.groupBy("card_id", "section").agg(F.count("*").alias("n")).collect()}
    assert cols["flat", 0] == 18 and (cols["stacked", 0], cols["stacked", 1]) == (9, 9) and cols["nine", 0] == 9
    assert abs(cards["skewed"].skew * 57.29578 + 7) <= 1.2
    roles = [r.role for r in read.table.rows.where("card_id = 'flat'").orderBy("row").collect()]
    assert roles[2:] == ["holeHeader", "yardage", "yardage", "yardage", "par", "handicap", "player"]


def test_what_a_report_shows(read):
    """Rows with roles, labels and cells, columns of holes and totals, and the best templates."""
    rows = {r.row: r for r in report.row_summaries(read.table).where("card_id = 'mess'").collect()}
    player = next(r for r in rows.values() if r.role.startswith("player"))
    assert player.label == "J. PEARLMAN" and len(player.cells) == 18 and player.cells[3] == "~" and player.cells[6] == report.EMPTY_CELL and player.section == 0
    assert rows[0].role == "unknown" and rows[0].label == ""
    bare = report.row_summaries(read.table).where("card_id = 'receipt'").orderBy("row").collect()
    assert bare[0].cells == ["CORNER SHOP"] and (bare[0].role, bare[0].section, bare[0].confidence, bare[0].label) == ("unknown", None, 0.0, "")
    columns = {r.label: r for r in report.column_summaries(read.table).where("card_id = 'flat'").collect()}
    assert set(columns) == {*(f"H{i}" for i in range(1, 19)), "OUT", "IN", "TOTAL"} and columns["H1"].min_x < columns["H1"].centre < columns["H1"].max_x
    best = report.candidate_summaries(read.ranking).where("card_id = 'flat'").orderBy("rank").collect()
    assert best[0].template_id == catalog.GOLDEN_ID and len(best) == report.MOST_CANDIDATES and best[0].score >= best[1].score


@pytest.mark.parametrize("card", ["flat", "stacked", "skewed"])
def test_scores_are_read(holes, card):
    assert [h.score.value for h in holes[card]] == list(fixtures.GOLDEN_SCORES)
    assert [h.par.value for h in holes[card]] == list(catalog.GOLDEN_PARS)


def test_damage_is_repaired_but_scores_are_not_invented(cards, holes):
    assert cards["damaged"].template_id == catalog.GOLDEN_ID and cards["damaged"].course_confidence >= 0.72
    assert [h.stroke_index.value for h in holes["damaged"]] == list(catalog.GOLDEN_INDEX)
    values = [h.score.value for h in holes["mess"]]
    assert (values[3], values[6], values[10]) == (None, None, None) and holes["mess"][3].score.raw_text == "~" and holes["mess"][6].score.provenance == "none"
    for rows in holes.values():
        assert all(h.score.provenance not in ("verifiedCourseTemplate", "inferredFromLayout") for h in rows)


def test_checksum_on_a_card(cards, holes):
    assert (holes["real"][5].score.value, holes["real"][17].score.value) == (6, 4)
    assert cards["real"].support == "confirmed" and cards["real"].overall > 0.90


def test_other_cards(cards, holes):
    assert cards["nine"].hole_count == 9 and cards["nine"].resolution == "noMatch" and sum(h.score.value for h in holes["nine"]) == 39
    assert "nineHoleRoundDetected" in [w.kind for w in cards["nine"].warnings]
    assert cards["two"].n_players == 2 and cards["two"].selected is None and all(h.score.value is None for h in holes["two"])
    assert cards["receipt"].quality == "failed" and cards["receipt"].warnings[0].kind == "noScorecardTableDetected"
    assert any(w.kind == "someScoresLowConfidence" and w.holes == [] for w in cards["off"].warnings) and cards["off"].support == "contradicted"
    assert cards["silent"].status == "noTextRecognized"


def payload(name, scores, totals):
    return json.dumps({"players": [{"name": name, "holes": [{"holeNumber": i, "playerScore": v, "confidence": 0.9} for i, v in enumerate(scores, 1)], **dict(zip(("writtenOut", "writtenIn", "writtenTotal"), totals, strict=True))}]})


@pytest.fixture(scope="module")
def second(spark, read):
    rows = [("blank", payload("J", J, (40, 37, 77))), ("blank2", payload("J", J[:5] + (5,) + J[6:], (40, 37, 77))), ("real", payload("C", (9,) * 18, (35, 33, 68)))]
    edits = spark.createDataFrame([("real", 3, 9)], "card_id string, hole int, value int")
    return pipeline.integrate(pipeline.apply_edits(read, edits), spark.createDataFrame(rows, "card_id string, payload string"), keep=pipeline.cut)


def test_second_reading(second):
    after, audits = second
    a = {r.card_id: r for r in audits.collect()}
    assert (a["blank"].verdict, a["blank"].checks, a["blank"].ceiling) == ("corroborated", 3, 0.95)
    assert (a["blank2"].verdict, a["blank2"].failures, a["blank2"].ceiling) == ("contradicted", 2, 0.45)
    c = {r.card_id: r for r in after.cards.where("card_id IN ('blank', 'blank2', 'real', 'flat')").collect()}
    assert c["blank"].quality == "readyToReview" and c["blank"].overall > 0.8 and c["blank"].support == "confirmed"
    h = {(r.card_id, r.hole): r.score for r in after.holes.where("card_id IN ('blank', 'real')").collect()}
    assert sum(h["blank", i].value for i in range(1, 19)) == 77
    assert h["real", 3].value == 9 and h["real", 3].provenance == "userEdited" and h["real", 1].value == 4


def test_audits_are_told(second):
    after, _ = second
    w = {r.card_id: {x.kind: x for x in r.warnings} for r in after.cards.where("card_id IN ('blank', 'blank2', 'real', 'flat')").collect()}
    ok, bad = w["blank"]["remoteParseCorroborated"], w["blank2"]["remoteParseContradicted"]
    assert (ok.severity, ok.text) == ("info", "J: agrees with the written 18-hole total, back nine and front nine")
    assert (bad.severity, bad.text) == ("warning", "J: the front nine adds up to 37, written is 40")
    assert not any(k.startswith("remoteParse") for k in w["flat"])


def test_verdicts_and_their_warnings(spark):
    """All four verdicts, a row without a name, and a local total that is sure enough only for one card."""
    cards = spark.createDataFrame([(c, 9) for c in "abcde"], "card_id string, hole_count int")
    players = spark.createDataFrame([("a", 0, "Ann", None, None, None), ("a", 1, " ", 36, None, 36), ("b", 0, "Bo", None, None, None), ("c", 0, "Cy", 36, None, 40), ("d", 0, "Di", None, None, None), ("e", 0, "Ed", 36, None, None)], "card_id string, remote_seq int, name string, out int, back int, total int")
    scores = spark.createDataFrame([(c, s, h, None if c == "b" and h == 9 else 4) for c, s in (("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0), ("e", 0)) for h in range(1, 10)], "card_id string, remote_seq int, hole int, value int")
    made = "struct<value:int,confidence:double,provenance:string,raw_text:string>"
    local = spark.createDataFrame([("d", 0, "Di", (35, 0.59, "ocr", ""), None, None), ("e", 0, "Ed", (35, 0.6, "ocr", ""), None, None)], f"card_id string, player_seq int, name string, written_out {made}, written_back {made}, written_total {made}")
    audits = remote.audit(players, scores, local, cards)
    got = {(r.card_id, r.remote_seq): (r.verdict, r.checks, r.failures) for r in audits.collect()}
    assert got == {("a", 0): ("noSubtotals", 0, 0), ("a", 1): ("corroborated", 2, 0), ("b", 0): ("rowIncomplete", 0, 0), ("c", 0): ("contradicted", 2, 1), ("d", 0): ("noSubtotals", 0, 0), ("e", 0): ("contradicted", 2, 1)}
    told = {r.card_id: [(w.kind, w.severity, w.text) for w in r.audit_warnings] for r in report.audit_warnings(audits).collect()}
    assert told["a"] == [("remoteParseUnverified", "info", "Ann: no written totals to check against"), ("remoteParseCorroborated", "info", "Player 2: agrees with the written 18-hole total and front nine")]
    assert told["b"] == [("remoteParseUnverified", "info", "Bo: holes are missing, so nothing could be checked")]
    assert told["c"] == [("remoteParseContradicted", "warning", "Cy: the 18-hole total adds up to 36, written is 40")]
    assert told["e"] == [("remoteParseContradicted", "warning", "Ed: the front nine adds up to 36, written is 35")]


def test_solver_warnings_have_words(cards):
    texts = [w.text for w in cards["off"].warnings if w.kind == "someScoresLowConfidence" and w.holes == []]
    assert len(texts) == 1 and texts[0].startswith("front nine: scores sum to 35")
    assert any(w.text and "worked out as" in w.text for w in cards["real"].warnings)


@pytest.fixture(scope="module")
def looked_again(spark, read):
    made_of = {k: v for k, v in made().items() if k in ("mess", "skewed", "flat")}
    skewed = replace(made_of["skewed"], rows=(*made_of["skewed"].rows[:5], made_of["skewed"].rows[5].dropping(7)))
    obs = fixtures.frame(spark, {**made_of, "skewed": skewed}).transform(pipeline.cut)
    old = pipeline.parse(obs, catalog.seed(spark), keep=pipeline.cut)
    work = extract.reread_work(old.table, old.scores, old.players).collect()
    # a doubtful and a surer reading of an empty cell, and one that is no number; a cell with a mark in it; a cell of a skewed card
    said = [(w.card_id, w.row, w.hole, t, c, []) for w in work for t, c in {("mess", 4): (("4", 0.9),), ("mess", 7): (("3", 0.9), ("x", 0.99), ("6", 0.2)), ("skewed", 7): (("3", 0.5),)}.get((w.card_id, w.hole), ())]
    readings = spark.createDataFrame(said, "card_id string, row int, hole int, text string, confidence double, alternatives array<string>")
    return work, old, *pipeline.reread(obs, old, readings, catalog.seed(spark), keep=pipeline.cut)


def test_a_second_look_at_unread_cells(looked_again):
    work, old, new, cells = looked_again
    assert {(w.card_id, w.hole) for w in work} == {("mess", 4), ("mess", 7), ("mess", 11), ("skewed", 7)}
    assert {(r.card_id, r.hole) for r in cells.collect()} == {("mess", 4), ("mess", 7), ("skewed", 7)}
    h = {(r.card_id, r.hole): r.score for r in new.holes.collect()}
    assert h["mess", 7].value == 3 and h["mess", 7].confidence <= pipeline.REREAD
    assert h["mess", 4].value is None and h["mess", 4].raw_text == "~4"  # a cell is read as one text
    assert h["skewed", 7].value == 3 and [h["flat", i].value for i in range(1, 19)] == list(fixtures.GOLDEN_SCORES)
    assert new.cards.count() == old.cards.count() == 3


def test_payloads_are_made_safe(spark):
    raw = json.dumps({"players": [{"name": " ", "holes": [{"holeNumber": 1, "playerScore": 40, "confidence": 7}, {"holeNumber": 1, "playerScore": 4}, {"holeNumber": 30, "playerScore": 4}, {"holeNumber": 2, "playerScore": 5}], "writtenOut": 500, "writtenIn": 40}] * 9})
    players, scores = remote.sanitise(spark.createDataFrame([("a", 18, raw), ("b", 18, "not json")], "card_id string, hole_count int, payload string"))
    p = players.collect()
    assert len(p) == 8 and all((r.name, r.out, r.back) == (None, None, 40) for r in p)
    assert [(r.hole, r.value, r.confidence) for r in scores.where("remote_seq = 0").orderBy("hole").collect()] == [(1, None, 1.0), (2, 5, None)]


def test_saving_and_editing(spark, read):
    saved = store.save(read, F.to_timestamp(F.lit("2025-05-01 10:00:00")))
    r = {x.round_id: x for x in saved.rounds.collect()}
    assert (r["flat"].front, r["flat"].back, r["flat"].total, r["flat"].relative_to_par) == (35, 35, 70, 9) and r["mess"].total is None and r["nine"].total == 39
    edit = spark.createDataFrame([("flat", 1, 6)], "round_id string, hole_number int, strokes int")
    rounds, holes = store.update_scores(saved.rounds, saved.hole_scores, edit)
    assert rounds.where("round_id = 'flat'").first().total == 71 and holes.where("score_provenance = 'userEdited'").count() == 1
    left, _ = store.delete_rounds(saved, spark.createDataFrame([("flat",)], "round_id string"))
    assert left.rounds.where("round_id = 'flat'").count() == left.hole_scores.where("round_id = 'flat'").count() == left.visits.where("id = 'visit-flat'").count() == 0


def test_learning(spark):
    wolf = spark.createDataFrame([("w", "ga-wolf-creek", "Blue"), ("x", "ga-uga", "Blue")], "card_id string, template_id string, tee string")
    rows = [(k, h, None if k == "x" and h == 5 else 4, "ocr", h, "ocr", 300 + h, "ocr") for k in "wx" for h in range(1, 19)]
    h = spark.createDataFrame(rows, "card_id string, hole int, par int, par_provenance string, stroke_index int, stroke_index_provenance string, yards int, yards_provenance string")
    got = catalog.learn(wolf, h, catalog.seed(spark)).collect()
    assert len(got) == 1 and (got[0].template_id, got[0].verification, got[0].version) == ("ga-wolf-creek", "userConfirmed", 2) and got[0].tees[0].yards[0] == 301


def test_cards_of_one_batch_are_folded(spark):
    cards = spark.createDataFrame([("a", "ga-wolf-creek", "Blue"), ("b", "ga-wolf-creek", "White"), ("c", "ga-wolf-creek", "blue"), ("d", catalog.GOLDEN_ID, "Red")], "card_id string, template_id string, tee string")
    rows = [(k, h, 4, "ocr", h, "ocr", None if (k, h) == ("c", 2) else n + h, "ocr") for k, n in zip("abcd", (300, 200, 400, 100), strict=True) for h in range(1, 19)]
    h = spark.createDataFrame(rows, "card_id string, hole int, par int, par_provenance string, stroke_index int, stroke_index_provenance string, yards int, yards_provenance string")
    got = {r.template_id: r for r in catalog.learn(cards, h, catalog.seed(spark)).collect()}
    wolf, golden = got["ga-wolf-creek"], got[catalog.GOLDEN_ID]
    assert len(got) == 2 and wolf.version == 2 and {t.name.lower(): t.yards[:3] for t in wolf.tees} == {"blue": [401, 302, 403], "white": [201, 202, 203]}
    assert [t.name for t in golden.tees] == ["Black", "White", "Red"] and golden.tees[2].yards[0] == 101 and golden.tees[0].yards == list(catalog.GOLDEN_YARDS["Black"]) and golden.version == 3


def test_catalogue(spark):
    seed = catalog.seed(spark)
    assert seed.count() == 17 and seed.where(catalog.hole_data_usable()).count() == 1
    assert sorted(catalog.GOLDEN_INDEX) == list(range(1, 19)) and {n: sum(y) for n, y in catalog.GOLDEN_YARDS.items()} == {"Black": 3799, "White": 3375, "Red": 2702}
    stored = catalog.encode(seed.where("template_id = 'ga-uga'").withColumn("version", F.lit(9))).unionByName(spark.createDataFrame([("bad", 1, "{nope")], "template_id string, version int, payload string"))
    both = catalog.available(spark, stored)
    assert both.count() == 17 and both.where("template_id = 'ga-uga'").first().version == 9


def test_two_recognitions_are_merged(spark):
    a = [("c", 0, "l2", 0.1, 0.1, 0.05, 0.03, 0.8, "languageCorrected", []), ("c", 1, "PAR", 0.3, 0.1, 0.05, 0.03, 0.9, "languageCorrected", [])]
    b = [("c", 0, "12", 0.1, 0.1, 0.05, 0.03, 0.7, "numeric", []), ("c", 1, "P4R", 0.3, 0.1, 0.05, 0.03, 0.5, "numeric", []), ("c", 2, "7", 0.6, 0.1, 0.02, 0.03, 0.5, "numeric", [])]
    out = remote.merge_passes(spark.createDataFrame(a, fixtures.OBSERVATIONS), spark.createDataFrame(b, fixtures.OBSERVATIONS))
    assert sorted(r.text for r in out.collect()) == ["12", "7", "PAR"]  # digits from the numeric pass; of two words the surer
