"""Rounds and courses over time: summaries, groups, duplicates, clean-up, and layered catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ranks import ranked


def summary(rounds: DataFrame) -> DataFrame:
    """rounds (round_id, course_id, total): counts, the average and best of complete ones, and where the best was."""
    best = F.min(F.when(F.col("total").isNotNull(), F.struct("total", "round_id", "course_id")))
    return rounds.agg(F.count("*").alias("rounds"), F.count_distinct("course_id").alias("courses"), F.round(F.sum("total") / F.count("total"), 6).alias("average"), F.min("total").alias("best"), best["course_id"].alias("best_course"))


def best_rounds(rounds: DataFrame) -> DataFrame:
    """Per course: the best complete round."""
    return rounds.where(F.col("total").isNotNull()).groupBy("course_id").agg(F.min(F.struct("total", "date_played", "round_id")).alias("b")).select("course_id", "b.total", "b.round_id")


def _placed(rounds: DataFrame, by: str) -> DataFrame:
    """rounds with `position`, newest first within `by`. Days are counted first, so no task orders more than a day of a group."""
    r = rounds.withColumn("_day", F.coalesce(F.to_date("date_played"), F.lit("0001-01-01").cast("date")))
    later = Window.partitionBy(by).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy(by, "_day").count().select(by, "_day", F.coalesce(F.sum("count").over(later), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_day").orderBy(F.desc("date_played"), "round_id")
    return r.withColumn("_n", F.row_number().over(within)).join(before, [by, "_day"]).withColumn("position", (F.col("_before") + F.col("_n")).cast("int"))


def by_month(rounds: DataFrame) -> DataFrame:
    """Each round's month, the month's place (newest first) and the round's place in it. Months are ranked in a table of months."""
    r = rounds.withColumn("_m", F.date_trunc("month", "date_played"))
    months = r.select("_m").distinct().transform(ranked, F.desc("_m"), name="group_rank")
    return _placed(r, "_m").join(months, "_m").select("round_id", F.date_format("_m", "yyyy-MM").alias("month"), "group_rank", "position")


def by_course(rounds: DataFrame) -> DataFrame:
    """As by_month, by title; rounds without a course share a bucket."""
    r = rounds.withColumn("title", F.coalesce("course_name", F.lit("Unknown course")))
    titles = r.select("title").distinct().transform(ranked, "title", name="group_rank")
    return _placed(r, "title").join(titles, "title").select("round_id", "title", "group_rank", "position")


def duplicates(rounds: DataFrame) -> DataFrame:
    """For each round with another on the same course and day, the likeliest duplicate: of equal total if there is one, else the first of the day."""
    r = rounds.withColumn("_day", F.date_trunc("day", "date_played"))
    day = Window.partitionBy("course_id", "_day")
    in_order = day.orderBy("date_played", "round_id")
    same = Window.partitionBy("course_id", "_day", "total").orderBy("date_played", "round_id")

    def other(first: Column, second: Column) -> Column:
        return F.when(first != F.col("round_id"), first).otherwise(second)

    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = lambda w, n: F.nth_value("round_id", n).over(whole(w))
    equal = F.when(F.col("total").isNotNull(), other(nth(same, 1), nth(same, 2)))
    return r.select("round_id", F.coalesce(equal, other(nth(in_order, 1), nth(in_order, 2))).alias("duplicate_of")).where("duplicate_of IS NOT NULL")


def played(courses: DataFrame, rounds: DataFrame) -> DataFrame:
    """courses (course_id, name, marked): played if marked by hand or with a round."""
    counts = rounds.groupBy("course_id").agg(F.count("round_id").alias("rounds"), F.count_distinct("player").alias("players"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return courses.join(counts, "course_id", "left").select("course_id", "name", (F.col("marked") | (zero("rounds") > 0)).alias("played"), zero("rounds").alias("rounds"), zero("players").alias("players"))


def learned_over_seed(seed: DataFrame, learned: DataFrame, key: str) -> DataFrame:
    """Seed rows, each replaced by the learned one of its key; then what was only learned."""
    renamed = learned.select(F.col(key).alias("_key"), F.col("name").alias("_name"))
    top = seed.join(renamed, seed[key] == renamed["_key"], "left").select(seed[key], F.coalesce("_name", "name").alias("name"), F.col("_key").isNotNull().alias("learned"))
    return top.unionByName(learned.join(seed, key, "left_anti").select(key, "name", F.lit(True).alias("learned")))


def scratched(df: DataFrame, by: list[str], width: int, height: int, enough: float = 0.55) -> DataFrame:
    """The share of a grid's cells that were touched."""
    share = F.count_distinct("x", "y") / F.lit(width * height)
    return df.groupBy(*by).agg(share.alias("coverage"), (share >= enough).alias("revealed"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """old with new's rows by key: new columns win where they are set; with a version, the later row wins whole."""
    if version:
        both = old.unionByName(new, allowMissingColumns=True)
        # of equal versions the greatest content, so that the result is determined
        last = Window.partitionBy(key).orderBy(F.desc(version), F.desc(F.to_json(F.struct(*[c for c in both.columns if c != key]))))
        return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    other = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    out = old.join(other, old[key] == other[f"_{key}"], "full_outer")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns])
