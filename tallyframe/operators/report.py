"""What people are shown of a card or a round: breakdowns, summaries, short texts; and small conversions of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.fields import height_uniformity, promotable, relative_text, requires_review
from tallyframe.functions.geometry import Box
from tallyframe.functions.text import trimmed
from tallyframe.model import Config
from tallyframe.operators.confidence import warning
from tallyframe.operators.layout import Layout


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def provenance_breakdown(hole_scores: DataFrame, by: str = "round_id") -> DataFrame:
    """Of the scored holes of a round: how many were edited, solved, read by the second reading, or read."""
    p, scored = F.col("score_provenance"), F.col("strokes").isNotNull()
    n = lambda c: F.count_if(scored & c)
    return hole_scores.groupBy(by).agg(F.count("strokes").alias("scored"), n(p == "userEdited").alias("edited"), n(p == "solvedFromSubtotal").alias("solved"), n(p == "multimodalFallback").alias("second_reading"), n(p == "ocr").alias("read"))


def played_summary(courses: DataFrame, rounds: DataFrame) -> DataFrame:
    """courses (course_id, marked_at): rounds and the best total, or the day of the mark, as a line."""
    r = rounds.groupBy("course_id").agg(F.count("*").alias("n"), F.min("total").alias("best"))
    both = courses.join(r, "course_id", "left")
    line = F.when(F.col("n") > 0, F.concat(plural(F.col("n"), "round"), F.when(F.col("best").isNotNull(), F.concat(F.lit(", best "), F.col("best").cast("string"))).otherwise(""))).when(F.col("marked_at").isNotNull(), F.concat(F.lit("marked "), F.date_format("marked_at", "yyyy-MM-dd")))
    return both.select("course_id", F.coalesce("n", F.lit(0)).alias("rounds"), "best", line.alias("summary"))


def summary_line(rounds: DataFrame) -> DataFrame:
    """(round_id, line): total, relative to par, tee; what is missing drops out."""
    total = F.when(F.col("total").isNotNull(), F.col("total").cast("string")).otherwise("incomplete")
    relative = F.when(F.col("relative_to_par").isNotNull(), F.concat(F.lit("("), relative_text(F.col("relative_to_par")), F.lit(")")))
    return rounds.select("round_id", F.concat_ws(" ", total, relative, F.when(F.col("tee_name").isNotNull(), F.concat(F.col("tee_name"), F.lit(" tees")))).alias("line"))


def outcome_summary(audits: DataFrame, updated: DataFrame, adopted: DataFrame) -> DataFrame:
    """(card_id, line): rows adopted, holes filled and rows that the totals confirm, after a second reading."""
    a = audits.groupBy("card_id").agg(F.count_if(F.col("verdict") == "corroborated").alias("ok"))
    u = updated.groupBy("card_id").agg(F.count("*").alias("holes"))
    p = adopted.groupBy("card_id").agg(F.count("*").alias("rows"))
    all_of = a.join(u, "card_id", "full_outer").join(p, "card_id", "full_outer").na.fill(0, ["ok", "holes", "rows"])
    part = lambda c, one, many=None: F.when(F.col(c) > 0, plural(F.col(c), one, many))
    line = F.concat_ws(", ", part("rows", "row adopted", "rows adopted"), part("holes", "hole filled", "holes filled"), part("ok", "row confirmed by its totals", "rows confirmed by their totals"))
    return all_of.select("card_id", "rows", "holes", "ok", F.when(line == "", "nothing changed").otherwise(line).alias("line"))


def audit_line(verdict: Column, name: Column, checks: Column, failures: Column) -> Column:
    """A row's verdict in short, with how many totals were compared."""
    return (
        F.when(verdict == "corroborated", F.concat(name, F.lit(": confirmed by "), plural(checks, "written total")))
        .when(verdict == "contradicted", F.concat(name, F.lit(": differs from "), failures.cast("string"), F.lit(" of "), plural(checks, "written total")))
        .when(verdict == "rowIncomplete", F.concat(name, F.lit(": incomplete, nothing to check")))
        .otherwise(F.concat(name, F.lit(": no written totals")))
    )


#: The kind of warning that each verdict of a second reading's audit gives.
VERDICT_KINDS = {"corroborated": "remoteParseCorroborated", "contradicted": "remoteParseContradicted", "rowIncomplete": "remoteParseUnverified", "noSubtotals": "remoteParseUnverified"}


def listing(items: Column) -> Column:
    """a; a and b; a, b and c."""
    last = F.element_at(items, -1)
    return F.when(F.size(items) > 1, F.concat_ws(" and ", F.array_join(F.slice(items, 1, F.size(items) - 1), ", "), last)).when(F.size(items) == 1, last)


def audit_text(name: Column, verdict: Column, checked: Column, failed: Column) -> Column:
    """A row's verdict in words. checked: names of the sums compared; failed: the first that differs, as struct(label, sum, written)."""
    return (
        F.when(verdict == "corroborated", F.concat(name, F.lit(": agrees with the written "), listing(F.array_sort(checked))))
        .when(verdict == "contradicted", F.concat(name, F.lit(": the "), failed["label"], F.lit(" adds up to "), failed["sum"].cast("string"), F.lit(", written is "), failed["written"].cast("string")))
        .when(verdict == "rowIncomplete", F.concat(name, F.lit(": holes are missing, so nothing could be checked")))
        .otherwise(F.concat(name, F.lit(": no written totals to check against")))
    )


def audit_warnings(audits: DataFrame) -> DataFrame:
    """(card_id, audit_warnings): one for each audited row in its order; only a contradiction is more than a note."""
    v = F.col("verdict")
    kind = F.create_map(*[F.lit(x) for pair in VERDICT_KINDS.items() for x in pair])[v]
    one = warning(F.lit(True), kind, F.when(v == "contradicted", "warning").otherwise("info"), text=audit_text(F.col("name"), v, F.col("checked"), F.col("failed")))
    return audits.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("remote_seq", one.alias("w"))))["w"].alias("audit_warnings"))


def role_text(role: Column, payload: Column) -> Column:
    return F.when(payload.isNotNull(), F.concat(role, F.lit("("), payload, F.lit(")"))).otherwise(role)


def can_teach(holes: DataFrame) -> DataFrame:
    """(card_id, can_teach): every par was read or edited."""
    return holes.groupBy("card_id").agg(F.bool_and(promotable(F.col("par.value"), F.col("par.provenance"))).alias("can_teach"))


def can_offer_remote(holes: DataFrame, players: DataFrame) -> DataFrame:
    """(card_id, offer_remote): some score needs review, or no row was found. players: (card_id, n_players)."""
    weak = requires_review(F.col("score.value"), F.col("score.confidence"), F.col("score.provenance"))
    open_cards = holes.groupBy("card_id").agg(F.bool_or(weak).alias("weak"))
    return open_cards.join(players.select("card_id", "n_players"), "card_id", "left").select("card_id", (F.col("weak") | (F.coalesce("n_players", F.lit(0)) == 0)).alias("offer_remote"))


def half_text(half: Column, outcome: Column, total: Column, written: Column, unread: Column, hole: Column, missing: Column) -> Column:
    """What to tell of a half's checksum; null where all is well."""
    side = F.concat(half, F.lit(" nine"))
    return (
        F.when(outcome == "discrepancy", F.concat(side, F.lit(": scores sum to "), total.cast("string"), F.lit(", written is "), written.cast("string")))
        .when(outcome == "underdetermined", F.concat(side, F.lit(": "), plural(F.size(unread), "score"), F.lit(" unread, the written total can't settle them")))
        .when(outcome == "implausible", F.concat(side, F.lit(": hole "), hole.cast("string"), F.lit(" would be "), missing.cast("string"), F.lit(", so the written total is doubtful")))
        .when(outcome == "solved", F.concat(side, F.lit(": hole "), hole.cast("string"), F.lit(" worked out as "), missing.cast("string")))
    )


def split_tokens(lines: DataFrame) -> DataFrame:
    """lines (card_id, line_seq, text, x, y, w, h, confidence, pass, alternatives) to one observation per word, its box in proportion to its place in the text; alternatives stay with single words."""
    words = F.filter(F.split(trimmed(F.col("text")), r"\s+"), lambda t: t != "")
    e = lines.withColumn("_words", words).withColumn("_n", F.length(F.array_join("_words", " ")))
    e = e.select("*", F.posexplode("_words").alias("_i", "token"))
    before = F.when(F.col("_i") > 0, F.length(F.array_join(F.slice("_words", 1, F.col("_i")), " ")) + 1).otherwise(0)
    unit = F.col("w") / F.greatest(F.col("_n"), F.lit(1))
    none = F.array().cast("array<string>")
    return e.select("card_id", "line_seq", F.col("_i").alias("place"), F.col("token").alias("text"), (F.col("x") + unit * before).alias("x"), "y", (unit * F.length("token")).alias("w"), "h", "confidence", "pass", F.when(F.size("_words") == 1, F.col("alternatives")).otherwise(none).alias("alternatives"))


def in_original_image(box: Box, skew: Column, px: Column, py: Column) -> Box:
    """A box of the upright card, back in the photograph."""
    return box.rotated(skew, px, py)


def image_quality(edge_mean: Column, bright_mean: Column) -> Column:
    """struct(sharpness, glare) from two measured means."""
    return F.struct(F.least(F.lit(1.0), edge_mean / 0.06).alias("sharpness"), F.greatest(F.lit(0.0), (bright_mean - 0.93) / 0.07).alias("glare"))


#: What a hole's cell without text shows, and how many templates a report lists.
EMPTY_CELL, MOST_CANDIDATES = "\u00b7", 8


def row_summaries(table: Layout) -> DataFrame:
    """(card_id, row, section, role, confidence, label, mean_confidence, uniformity, x, y, w, h, cells) of every row of a card. cells: in a section a text for each of its holes, elsewhere the row's texts from left to right."""
    box = Box.of()
    grid = table.hole_columns.groupBy("card_id", "section").agg(F.min("min_x").alias("_grid"))
    of_rows = table.rows.select("card_id", "row", "section", role_text(F.col("role"), F.col("payload")).alias("role"), "confidence").join(grid, ["card_id", "section"], "left")
    seen = table.observations.select("card_id", "row", "obs_seq", trimmed(F.col("text")).alias("t"), "x", "y", "w", "h", F.col("confidence").alias("_c")).join(of_rows, ["card_id", "row"], "left")
    in_order = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("x", "obs_seq", "t"))))["t"]
    left = box.max_x <= F.col("_grid") + F.col("w") * Config().grid.label_slack
    one = seen.groupBy("card_id", "row").agg(
        F.first("section").alias("section"), F.coalesce(F.first("role"), F.lit("unknown")).alias("role"), F.coalesce(F.first("confidence"), F.lit(0.0)).alias("confidence"), F.array_join(in_order(left), " ").alias("label"),
        F.avg("_c").alias("mean_confidence"), height_uniformity(F.col("h")).alias("uniformity"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(box.max_x) - F.min("x")).alias("w"), (F.max(box.max_y) - F.min("y")).alias("h"), in_order(F.lit(True)).alias("_texts"),
    )
    every = one.where("section IS NOT NULL").select("card_id", "section", "row").join(table.hole_columns.select("card_id", "section", "hole"), ["card_id", "section"])
    cell = every.join(table.cells.select("card_id", "section", "row", "hole", "text"), ["card_id", "section", "row", "hole"], "left")
    cells = cell.groupBy("card_id", "row").agg(F.array_sort(F.collect_list(F.struct("hole", F.coalesce(F.nullif("text", F.lit("")), F.lit(EMPTY_CELL)).alias("t"))))["t"].alias("_cells"))
    return one.join(cells, ["card_id", "row"], "left").withColumn("cells", F.coalesce("_cells", "_texts")).drop("_cells", "_texts")


def column_summaries(table: Layout) -> DataFrame:
    """(card_id, section, label, min_x, max_x, centre, interpolated) of the columns of holes and of totals."""
    holes = table.hole_columns.select("card_id", "section", F.concat(F.lit("H"), F.col("hole").cast("string")).alias("label"), "min_x", "max_x", "centre", "interpolated")
    return holes.unionByName(table.agg_columns.select("card_id", "section", F.upper("kind").alias("label"), "min_x", "max_x", "centre", F.lit(False).alias("interpolated")))


def candidate_summaries(ranking: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Each card's best templates with what spoke for them, in order."""
    order = Window.partitionBy("card_id").orderBy(F.desc("score"), "template_seq")
    return ranking.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
