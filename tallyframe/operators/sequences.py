"""Sequences in long form (key, hole, value): densifying, merging, overlaying, comparing, ranking, bands and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import number_similarity
from tallyframe.functions.numeric import yardage_similarity as yards
from tallyframe.model import Grid, Matching


def densify(cards: DataFrame, values: DataFrame) -> DataFrame:
    """cards (card_id, hole_count) times holes 1 to hole_count (1 at least), left-joined with values."""
    every = cards.select("card_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("hole_count")))).alias("hole"))
    return every.join(values, ["card_id", "hole"], "left")


def merge_first(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with value, confidence, seq: the first value that isn't null, the highest confidence, and how many rows merged."""
    first = F.min(F.when(F.col("value").isNotNull(), F.struct("seq", "value")))
    return df.groupBy(*by).agg(first["value"].alias("value"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"))


def overlay(df: DataFrame, template: DataFrame, on: list[str]) -> DataFrame:
    """A template's value wins over anything but a person's edit; `changed` where that alters the value."""
    both = df.join(template, on, "left")
    wins = F.col("template_value").isNotNull() & (F.col("provenance") != "userEdited")
    keep = [c for c in df.columns if c not in ("value", "provenance", "confidence")]
    return both.select(
        *keep, F.when(wins, F.col("template_value")).otherwise(F.col("value")).alias("value"), F.when(wins, F.lit("verifiedCourseTemplate")).otherwise(F.col("provenance")).alias("provenance"),
        F.when(wins, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), (wins & ~F.col("value").eqNullSafe(F.col("template_value"))).alias("changed"),
    )


def compare(pairs: DataFrame, by: list[str], yardages: bool = False) -> DataFrame:
    """pairs with value and expected: mean similarity of those compared, their share of the known expected ones, and counts."""
    how = yards if yardages else number_similarity
    able = F.col("value").isNotNull() & (F.col("expected") > 0 if yardages else F.col("expected").isNotNull())
    sim = F.when(able, how(F.col("value"), F.col("expected")))
    s = pairs.withColumn("_sim", sim)
    n = F.count("_sim")
    return s.groupBy(*by).agg((F.sum("_sim") / F.when(n > 0, n)).alias("score"), (n / F.when(F.count("expected") > 0, F.count("expected"))).alias("coverage"), n.alias("compared"), F.count("expected").alias("known"))


def top1(df: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def resolve(scored: DataFrame, config: Matching = Matching(), strong: Column | None = None) -> DataFrame:
    """scored (card_id, template_id, score): confident if high, isolated and (where given) strongly evidenced; else ambiguous. Cards without a plausible one are absent."""
    ranked = Window.partitionBy("card_id").orderBy(F.desc("score"), "template_id")
    kept = scored.where(F.col("score") >= config.plausible).withColumn("_k", F.row_number().over(ranked)).where(F.col("_k") <= config.kept)
    second = F.max(F.when(F.col("_k") == 2, F.col("score")))
    first = F.max(F.when(F.col("_k") == 1, F.col("score")))
    isolated = second.isNull() | (first - second > config.margin)
    evidence = F.lit(True) if strong is None else F.bool_or((F.col("_k") == 1) & strong)
    return kept.groupBy("card_id").agg(F.when((first >= config.confident) & isolated & evidence, "confident").otherwise("ambiguous").alias("resolution"), F.max(F.when(F.col("_k") == 1, F.col("template_id"))).alias("template_id"), first.alias("score"))


def next_within(df: DataFrame, by: list[str], value: str, row_id: str, most: float) -> DataFrame:
    """For each row the nearest one strictly above it, within `most`: a range self-join's best, found by one sorted window instead.

    Rows of equal value share the first row above them, which the smallest id represents.
    """
    levels = df.groupBy(*by, value).agg(F.min(row_id).alias("_first"))
    up = Window.partitionBy(*by).orderBy(value)
    above = levels.withColumn("_next", F.lead(value).over(up)).withColumn("next_id", F.lead("_first").over(up)).withColumn("gap", F.col("_next") - F.col(value)).where(F.col("gap") <= most)
    return df.join(above, [*by, value]).select(row_id, "next_id", "gap")


def bands(centres: DataFrame, centre: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Columns from centres: each reaches halfway to its neighbours, the outer ones without end; numbered from the left."""
    order = Window.partitionBy(*(by or [])).orderBy(centre, tie)
    c = F.col(centre)
    return centres.select(
        *(by or []), F.row_number().over(order).alias("hole"), c.alias("centre"),
        F.coalesce((F.lag(c).over(order) + c) / 2, F.lit(-1e308)).alias("low"), F.coalesce((F.lead(c).over(order) + c) / 2, F.lit(1e308)).alias("high"),
    )


def pitch(df: DataFrame, by: list[str], value: str, ties: list[str], default: float = Grid().default_pitch) -> DataFrame:
    """The median gap between neighbours."""
    order = Window.partitionBy(*by).orderBy(value, *ties)
    gaps = df.withColumn("_gap", F.col(value) - F.lag(value).over(order))
    return gaps.groupBy(*by).agg(F.coalesce(F.median("_gap"), F.lit(default)).alias("pitch"))
