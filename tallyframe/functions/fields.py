"""Fields with provenance, scores and totals: predicates and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.model import LATITUDES, LONGITUDES, NINE_TOTAL_RANGE, SCORE_RANGE


def make_field(value: Column, confidence: Column | float, provenance: str | Column, raw: Column | None = None) -> Column:
    """A field; the confidence is held within 0 and 1."""
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    p = provenance if isinstance(provenance, Column) else F.lit(provenance)
    return F.struct(value.cast("int").alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double"))).alias("confidence"), p.alias("provenance"), (F.lit(None).cast("string") if raw is None else raw).alias("raw_text"))


def empty_field() -> Column:
    return make_field(F.lit(None), 0.0, "none")


#: Confidences that come with a provenance: template, layout, edit, solved.
template_field = lambda v: make_field(v, 1.0, "verifiedCourseTemplate")
layout_field = lambda v: make_field(v, 0.9, "inferredFromLayout")
edited_field = lambda v: make_field(v, 1.0, "userEdited")
solved_field = lambda v: make_field(v, 0.93, "solvedFromSubtotal")


def permitted_for_score(provenance: Column) -> Column:
    """A player's score never comes from a template or the layout."""
    return ~provenance.isin("verifiedCourseTemplate", "inferredFromLayout")


def requires_review(value: Column, confidence: Column, provenance: Column) -> Column:
    return F.when(provenance == "userEdited", False).when(value.isNull(), True).otherwise(confidence < 0.82)


def level(value: Column, confidence: Column) -> Column:
    return F.when(value.isNull() | (confidence < 0.01), "none").when(confidence < 0.55, "low").when(confidence < 0.82, "medium").otherwise("high")


def level_rank(name: Column) -> Column:
    return F.when(name == "none", 0).when(name == "low", 1).when(name == "medium", 2).otherwise(3)


def promotable(value: Column, provenance: Column) -> Column:
    return provenance.isin("ocr", "userEdited") & value.isNotNull()


def plausible_score(score: Column, par: Column) -> Column:
    """Within 1 and 15, and with a known par from par - 3 (1 at least) to par + 9."""
    fits = F.when(par.isNull(), True).otherwise((score >= F.greatest(F.lit(1), par - 3)) & (score <= par + 9))
    return score.between(*SCORE_RANGE) & fits


def plausible_nine(total: Column) -> Column:
    return total.between(*NINE_TOTAL_RANGE)


def within_box(lat: Column, lon: Column) -> Column:
    return lat.between(*LATITUDES) & lon.between(*LONGITUDES)


def relative_text(n: Column) -> Column:
    return F.when(n.isNull(), "—").when(n == 0, "E").when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def strict_sum(value: Column, n: Column | int) -> Column:
    """The sum if all n values are there, else null: an aggregate."""
    expected = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.count(value) == expected, F.sum(value))


def coverage(value: Column) -> Column:
    """The share of values that are there; 0 of nothing: an aggregate."""
    return F.when(F.count(F.lit(1)) > 0, F.count(value) / F.count(F.lit(1))).otherwise(0.0)


def height_uniformity(h: Column) -> Column:
    """1 - 2.5 times the coefficient of variation of positive heights, within 0 and 1: an aggregate."""
    positive = F.when(h > 0, h)
    spread = F.stddev_pop(positive) / F.avg(positive) * 2.5
    return F.when(F.count(positive) <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), spread)))


def upper_median(name: str) -> Column:
    """The middle value of a column, the upper of two: an aggregate for groups of few distinct values, which it counts; operators.medians serves large ones."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def confidence_text(c: Column) -> Column:
    return F.when(c >= 0.999, "chosen").when(c >= 0.72, "recognised").otherwise("low")


def edited_score(text: Column) -> Column:
    """struct(accepted, value): blank clears, a number of the range is set, anything else is ignored."""
    t = F.trim(text)
    n = t.try_cast("int")
    return F.when(t == "", F.struct(F.lit(True).alias("accepted"), F.lit(None).cast("int").alias("value"))).otherwise(F.struct(F.coalesce(n.between(*SCORE_RANGE), F.lit(False)).alias("accepted"), F.when(n.between(*SCORE_RANGE), n).alias("value")))


def quality_flags(sharpness: Column, glare: Column) -> Column:
    return F.filter(F.array(F.when(sharpness < 0.45, "imageBlurry"), F.when(glare > 0.35, "imageGlare")), lambda x: x.isNotNull())


def valid_endpoint(url: Column) -> Column:
    return url.rlike(r"^https://[^/\s]+") & F.try_parse_url(url, F.lit("HOST")).isNotNull()
