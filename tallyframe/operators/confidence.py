"""How far a read card can be trusted: coverage, overall confidence, a quality grade, and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.fields import requires_review
from tallyframe.model import Config

WARNING = "struct<kind:string,severity:string,holes:array<int>,text:string>"


def warning(when: Column, kind: str | Column, severity: str | Column, holes: Column | None = None, text: Column | None = None) -> Column:
    """A warning where the condition holds, else null. text: what there is to say beyond the kind."""
    k, s = (F.lit(v) if isinstance(v, str) else v for v in (kind, severity))
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(k.alias("kind"), s.alias("severity"), (F.array().cast("array<int>") if holes is None else holes).alias("holes"), (none if text is None else text).alias("text")))


def listed(*warnings: Column) -> Column:
    return F.filter(F.array(*warnings), lambda w: w.isNotNull())


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "blocking", 2).when(severity == "warning", 1).otherwise(0)


def by_severity(warnings: Column) -> Column:
    """Blocking first; within a severity in the order given."""
    numbered = F.transform(warnings, lambda w, i: F.struct((-severity_rank(w["severity"])).alias("r"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(numbered), lambda s: s["w"])


def evaluate(cards: DataFrame, holes: DataFrame, config: Config = Config()) -> DataFrame:
    """cards: card_id, hole_count, n_players, course_confidence, resolved, support, confirmed, warnings; holes: par, stroke_index, yardage, score fields.

    Gives cards with overall, quality and all warnings. Cards without a grid fail with a blocking warning.
    """
    e = config.evaluation
    value, conf, prov = F.col("score.value"), F.col("score.confidence"), F.col("score.provenance")
    hole_list = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("hole"))))
    doubtful = value.isNotNull() & requires_review(value, conf, prov)
    share = lambda c: F.count(F.col(f"{c}.value")) / F.count(F.lit(1))
    sums = holes.groupBy("card_id").agg(share("par").alias("par_c"), share("stroke_index").alias("index_c"), share("yardage").alias("yard_c"), F.count(value).alias("scored"), F.avg(F.when(value.isNotNull(), conf)).alias("mean"), hole_list(value.isNull()).alias("missing"), hole_list(doubtful).alias("low"))
    r = cards.join(sums, "card_id", "left")
    n = F.col("hole_count")
    grid = n.isNotNull() & (n > 0) & F.col("par_c").isNotNull()
    coverage = F.coalesce(F.col("scored") / F.when(n > 0, n), F.lit(0.0))
    mean = F.coalesce("mean", F.lit(0.0))
    halves = F.when(n > 9, 2).otherwise(1)
    lifted = F.when(F.col("support") == "confirmed", mean + (e.lift - mean) * (F.least(F.col("confirmed"), halves) / halves)).when(F.col("support") == "contradicted", mean * e.contradicted).otherwise(mean)
    static = F.col("par_c") * 0.5 + F.col("index_c") * 0.2 + F.col("yard_c") * 0.3
    overall = F.col("course_confidence") * e.course + static * e.static + coverage * lifted * e.scores
    quality = (
        F.when(~grid, "failed")
        .when(~F.col("resolved") & (coverage < 0.25), "needsManualEntry")
        .when(F.col("resolved") & (F.col("course_confidence") >= e.floor) & (coverage >= e.ready) & (F.size("low") <= F.greatest(F.lit(1), F.floor(n / 6))), "readyToReview")
        .when((coverage >= 0.25) | (F.col("par_c") > 0), "needsAttention").otherwise("needsManualEntry")
    )
    some, players = F.size("missing") > 0, F.col("n_players") > 0
    made = listed(
        warning(F.col("par_c") == 0, "parRowNotFound", "warning"), warning(F.col("index_c") == 0, "handicapRowNotFound", "info"), warning(F.col("yard_c") == 0, "yardageRowNotFound", "info"),
        warning(players, "playerCountNeedsConfirmation", "info"), warning(~players, "noPlayerRowsDetected", "warning"),
        warning(some & players, F.when(F.size("missing") == n, "noPlayerRowsDetected").otherwise("someScoresMissing"), "warning", F.col("missing")),
        warning(F.size("low") > 0, "someScoresLowConfidence", "warning", F.col("low")),
        warning(n == 9, "nineHoleRoundDetected", "info"), warning(~n.isin(9, 18), "holeCountMismatch", "warning"), warning(~n.isin(9, 18), "cardLikelyCropped", "warning"),
        warning((F.col("scored") > 0) & (F.col("scored") < n), "incompleteRound", "info", F.col("missing")),
    )
    blocked = F.array(warning(F.lit(True), "noScorecardTableDetected", "blocking"))
    own = F.coalesce("warnings", F.array().cast(f"array<{WARNING}>"))
    return r.select(
        *[c for c in cards.columns if c != "warnings"], F.when(grid, F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall))).otherwise(0.0).alias("overall"), quality.alias("quality"),
        F.concat(own, F.when(grid, made).otherwise(blocked)).alias("warnings"), F.coalesce("scored", F.lit(0)).alias("scored"), "missing", "low",
    )


def needs_tee(tee: Column, confidence: Column) -> Column:
    return tee.isNull() | (confidence < 0.6)


def has_blocking(warnings: Column) -> Column:
    return F.exists(warnings, lambda w: w["severity"] == "blocking")


def of_kind(warnings: Column, kind: str) -> Column:
    return F.filter(warnings, lambda w: w["kind"] == kind)
