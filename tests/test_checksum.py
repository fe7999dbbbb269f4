import pytest

from tallyframe.operators import checksum

C = [4, 4, 3, 4, 3, None, 3, 4, 4, 4, 3, 3, 3, 4, 4, 4, 4, None]
J = [6, 4, 3, 5, 3, 8, 5, 3, 3, 4, 5, 4, None, 4, 4, 6, 4, 3]


def change(row, **holes):
    return [holes.get(f"h{i}", v) for i, v in enumerate(row, 1)]


CASES = {
    "c": (C, (35, 33, 68)), "j": (J, (40, 37, 77)), "c3": (change(C, h3=None), (35, 33, 68)), "c85": (C, (85, 33, None)), "j31": (change(J, h13=3), (40, 31, None)),
    "c_in": (C, (35, None, 68)), "c_none": (C, (None, None, None)), "edited": (change(C, h6=(7, 1.0, "userEdited")), (35, 33, 68)), "low": (change(C, h6=(4, 0.30, "ocr")), (35, 33, 68)), "high": (change(C, h6=(4, 0.95, "ocr")), (35, 33, 68)),
    "short": ([5, 3, None, 4, 5, 4, 3, 5, 4], (None, None, 39)),
}


@pytest.fixture(scope="module")
def solved(spark):
    rows = [(k, i, *(v if isinstance(v, tuple) else (v, 0.60, "ocr" if v else "none"))) for k, (row, _) in CASES.items() for i, v in enumerate(row, 1)]
    scores = spark.createDataFrame(rows, "card_id string, hole int, value int, confidence double, provenance string")
    written = spark.createDataFrame([(k, *w) for k, (_, w) in CASES.items()], "card_id string, out long, back long, total long")
    long, short = written.where("card_id <> 'short'"), written.where("card_id = 'short'")
    both = checksum.infer_subtotals(long, 18).select("card_id", "out", "back").unionByName(checksum.infer_subtotals(short, 9).select("card_id", "out", "back"))
    halves = checksum.solve_halves(scores, both)
    out = {(r.card_id, r.half): r for r in halves.collect()}
    support = {r.card_id: (r.support, r.confirmed) for r in checksum.support(halves).collect()}
    holes = {(r.card_id, r.hole): r for r in checksum.apply_solved(scores, halves).collect()}
    return out, support, holes


def test_solved_and_verified(solved):
    out, support, holes = solved
    assert (holes["c", 6].value, holes["c", 18].value, holes["c", 6].provenance) == (6, 4, "solvedFromSubtotal") and support["c"] == ("confirmed", 2)
    assert out["j", "front"].outcome == "verified" and holes["j", 13].value == 3
    assert out["c3", "front"].outcome == "underdetermined" and out["c3", "front"].unread == [3, 6] and holes["c3", 18].value == 4
    assert holes["c_in", 6].value == 6 and holes["c_in", 18].value == 4
    assert (holes["short", 3].value, out["short", "front"].outcome) == (6, "solved")


def test_refusals(solved):
    out, support, holes = solved
    assert (out["c85", "front"].outcome, out["c85", "front"].missing, holes["c85", 6].value) == ("implausible", 56, None) and support["c85"][0] == "contradicted"
    assert (out["j31", "back"].outcome, out["j31", "back"].computed, out["j31", "back"].expected) == ("discrepancy", 37, 31)
    assert out["c_none", "front"].outcome == out["c_none", "back"].outcome == "noSubtotal" and support["c_none"][0] == "unavailable"
    assert (out["edited", "front"].outcome, holes["edited", 6].value) == ("discrepancy", 7)
    assert holes["low", 6].value == 6 and out["high", "front"].outcome == "discrepancy" and holes["high", 6].value == 4


def test_totals(spark):
    golden = [5, 4, 3, 4, 3, 6, 3, 4, 3, 4, 5, 3, 3, 4, 5, 4, 3, 4]
    pars = [4, 4, 3, 3, 3, 5, 3, 3, 3, 3, 4, 3, 3, 3, 4, 4, 3, 3]
    rows = [("g", i, v, p) for i, (v, p) in enumerate(zip(golden, pars, strict=True), 1)] + [("m", i, None if i == 4 else v, p) for i, (v, p) in enumerate(zip(golden, pars, strict=True), 1)]
    got = {r.card_id: r for r in checksum.totals(spark.createDataFrame(rows, "card_id string, hole int, value int, par int")).collect()}
    g, m = got["g"], got["m"]
    assert (g.front, g.back, g.total, g.relative) == (35, 35, 70, 9)
    assert (m.front, m.back, m.total, m.partial, m.played, m.relative, m.relative_played) == (None, 35, None, 66, 17, None, 8)
