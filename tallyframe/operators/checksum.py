"""Scores against written subtotals: inferring the missing subtotal, solving the one unread hole, and the verdict.

Scores are long rows (card_id, hole, value, confidence, provenance); written totals one row per card. All
steps are grouped sums by card and half, so partial sums happen before the one shuffle by card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.fields import strict_sum
from tallyframe.model import NINE_TOTAL_RANGE, SCORE_RANGE, Checksum, Remote


def totals(scores: DataFrame, hole_count: int = 18, nine: int = 9) -> DataFrame:
    """Per card: strict front, back and total (null if any hole is missing), partial sum, holes played, and both relative figures. Rows may hold a par."""
    par = F.col("par") if "par" in scores.columns else F.lit(None).cast("int")
    hole, value = F.col("hole"), F.col("value")
    inside = hole.between(1, hole_count)
    played = inside & value.isNotNull()
    total = F.when(F.count(F.when(inside, value)) == hole_count, F.sum(F.when(inside, value)))
    par_total = F.when(F.count(F.when(inside, par)) == hole_count, F.sum(F.when(inside, par)))
    first = min(nine, hole_count)
    front = F.when(F.count(F.when(hole.between(1, first), value)) == first, F.sum(F.when(hole.between(1, first), value))) if hole_count >= nine else F.lit(None).cast("long")
    rest = hole_count - nine
    back = F.when(F.count(F.when(hole.between(nine + 1, hole_count), value)) == rest, F.sum(F.when(hole.between(nine + 1, hole_count), value))) if rest > 0 else F.lit(None).cast("long")
    return scores.groupBy("card_id").agg(
        front.alias("front"), back.alias("back"), total.alias("total"),
        F.coalesce(F.sum(F.when(inside, value)), F.lit(0)).alias("partial"), F.count(F.when(inside, value)).alias("played"),
        (total - par_total).alias("relative"),
        F.when((F.count(F.when(played, F.lit(1))) > 0) & (F.count(F.when(played, par)) == F.count(F.when(played, F.lit(1)))), F.sum(F.when(played, value - par))).alias("relative_played"),
    )


def infer_subtotals(written: DataFrame, hole_count: int = 18, nine: int = 9, within: tuple[int, int] = NINE_TOTAL_RANGE) -> DataFrame:
    """written (card_id, out, back, total): a missing half is the total less the other, if plausible; on short cards the total is the front."""
    if hole_count <= nine:
        return written.withColumn("out", F.coalesce("out", "total"))
    fill = lambda own, other: F.when(F.col(own).isNull() & (F.col("total") - F.col(other)).between(*within), F.col("total") - F.col(other)).otherwise(F.col(own))
    return written.select(*[c for c in written.columns if c not in ("out", "back")], fill("out", "back").alias("out"), fill("back", "out").alias("back"))


def is_known(known: float = Checksum().known) -> Column:
    return F.col("value").isNotNull() & ((F.col("provenance") == "userEdited") | (F.col("confidence") > known))


def solve_halves(scores: DataFrame, written: DataFrame, nine: int = 9, score_range: tuple[int, int] = SCORE_RANGE, known: float = Checksum().known) -> DataFrame:
    """One row per card and half: outcome, the hole concerned, the solved value, and the two sums."""
    half = F.when(F.col("hole") <= nine, "front").otherwise("back")
    sure = is_known(known)
    summed = scores.groupBy("card_id", half.alias("half")).agg(
        F.coalesce(F.sum(F.when(sure, F.col("value"))), F.lit(0)).cast("long").alias("computed"), F.count(F.when(~sure, F.lit(1))).alias("unknown"),
        F.min(F.when(~sure, F.col("hole"))).alias("hole"), F.array_sort(F.collect_list(F.when(~sure, F.col("hole")))).alias("unread"),
    )
    both = summed.join(written.select("card_id", "out", "back"), "card_id", "left")
    expected = F.when(F.col("half") == "front", F.col("out")).otherwise(F.col("back"))
    missing = expected - F.col("computed")
    outcome = (
        F.when(expected.isNull(), "noSubtotal").when(F.col("unknown") > 1, "underdetermined")
        .when((F.col("unknown") == 0) & (missing == 0), "verified").when(F.col("unknown") == 0, "discrepancy")
        .when(missing.between(*score_range), "solved").otherwise("implausible")
    )
    return both.select(
        "card_id", "half", outcome.alias("outcome"), F.when(F.col("unknown") == 1, F.col("hole")).alias("hole"),
        F.when(F.col("unknown") == 1, missing).cast("long").alias("missing"), "computed", expected.cast("long").alias("expected"), "unread",
    )


def apply_solved(scores: DataFrame, halves: DataFrame, solved: float = Checksum().solved) -> DataFrame:
    """scores with solved holes filled in; what was read by a person or surely enough stays."""
    fix = halves.where(F.col("outcome") == "solved").select("card_id", "hole", F.col("missing").cast("int").alias("_fix"))
    out = scores.join(fix, ["card_id", "hole"], "left")
    hit = F.col("_fix").isNotNull()
    return out.select(
        *[c for c in scores.columns if c not in ("value", "confidence", "provenance")], F.when(hit, F.col("_fix")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.lit(solved)).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, F.lit("solvedFromSubtotal")).otherwise(F.col("provenance")).alias("provenance"),
    )


def support(halves: DataFrame) -> DataFrame:
    """Per card: contradicted, confirmed with the number of halves, or unavailable."""
    against = F.bool_or(F.col("outcome").isin("discrepancy", "implausible"))
    n = F.count_if(F.col("outcome").isin("verified", "solved"))
    return halves.groupBy("card_id").agg(F.when(against, "contradicted").when(n > 0, "confirmed").otherwise("unavailable").alias("support"), n.alias("confirmed"))


def ceiling(verdict: Column, policy: Remote = Remote()) -> Column:
    return F.when(verdict == "contradicted", policy.contradicted).when(verdict == "corroborated", policy.corroborated).otherwise(policy.unverifiable)
