from pyspark.sql import functions as F

from tallyframe.functions.geometry import Box
from tallyframe.operators import report


def test_lines(spark):
    rounds = spark.createDataFrame([("a", "c1", 70, 9, "White"), ("b", "c1", None, None, None)], "round_id string, course_id string, total long, relative_to_par long, tee_name string")
    assert {r.round_id: r.line for r in report.summary_line(rounds).collect()} == {"a": "70 (+9) White tees", "b": "incomplete"}
    courses = spark.createDataFrame([("c1", None), ("c2", "2025-01-02"), ("c3", None)], "course_id string, marked_at string").withColumn("marked_at", F.to_timestamp("marked_at"))
    assert {r.course_id: r.summary for r in report.played_summary(courses, rounds).collect()} == {"c1": "2 rounds, best 70", "c2": "marked 2025-01-02", "c3": None}


def test_breakdown_and_outcome(spark):
    h = spark.createDataFrame([("r", 4, "ocr"), ("r", 5, "userEdited"), ("r", None, "none"), ("r", 3, "solvedFromSubtotal")], "round_id string, strokes int, score_provenance string")
    b = report.provenance_breakdown(h).first()
    assert (b.scored, b.edited, b.solved, b.read) == (3, 1, 1, 1)
    a = spark.createDataFrame([("c", "corroborated")], "card_id string, verdict string")
    u = spark.createDataFrame([("c", 1), ("c", 2)], "card_id string, hole int")
    assert report.outcome_summary(a, u, u.limit(0)).first().line == "2 holes filled, 1 row confirmed by its totals"


def test_tokens_and_boxes(spark):
    lines = spark.createDataFrame([("c", 0, "AB  CD", 0.1, 0.2, 0.5, 0.1, 0.9, "numeric", ["x"]), ("c", 1, "Z", 0.1, 0.4, 0.1, 0.1, 0.9, "numeric", ["2"])], "card_id string, line_seq int, text string, x double, y double, w double, h double, confidence double, pass string, alternatives array<string>")
    got = report.split_tokens(lines).orderBy("line_seq", "place").collect()
    assert [(r.text, round(r.x, 3), round(r.w, 3), r.alternatives) for r in got] == [("AB", 0.1, 0.2, []), ("CD", 0.4, 0.2, []), ("Z", 0.1, 0.1, ["2"])]
    box = Box.of()
    turned = box.rotated(F.lit(0.3), F.lit(0.5), F.lit(0.5))
    back = report.in_original_image(turned, F.lit(-0.3), F.lit(0.5), F.lit(0.5))
    assert all(abs(r[0]) < 1e-9 for r in lines.select(back.x - box.x).collect())
