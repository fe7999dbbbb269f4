"""Saved rounds, holes, visits and images as tables: derived frames in, new frames out; the caller writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.fields import strict_sum
from tallyframe.functions.text import normalize_name
from tallyframe.plans.cards import Scorecards
from tallyframe.sources import files

GRACE_SECONDS = 3600


@dataclass(frozen=True)
class Saved:
    rounds: DataFrame
    hole_scores: DataFrame
    image_refs: DataFrame
    visits: DataFrame


def scan(spark: SparkSession, path: str, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """A stored table with filter, order and limit, which reach the reader as far as it takes them."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    df = df if order is None else df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(filename, bytes, modified) of stored images; the contents aren't read."""
    return files.latest(files.stored(spark, path)).select("filename", "bytes", "modified")


def store_images(scans: DataFrame, path: str) -> DataFrame:
    """scans (id, original, normalized): both versions are written, or none of any; gives (id, original_filename, normalized_filename). The small version may be missing; a scan without an original has no names."""
    has, small = F.col("original").isNotNull(), F.col("original").isNotNull() & F.col("normalized").isNotNull()
    named = scans.withColumn("original_filename", F.when(has, F.concat("id", F.lit("-original.jpg")))).withColumn("normalized_filename", F.when(small, F.concat("id", F.lit("-normalized.jpg"))))
    pairs = F.array(F.struct(F.col("original_filename").alias("filename"), F.col("original").alias("content")), F.struct(F.col("normalized_filename").alias("filename"), F.col("normalized").alias("content")))
    files.store(named.select(F.explode(pairs).alias("f")).select("f.*").where("filename IS NOT NULL"), path)
    return named.select("id", "original_filename", "normalized_filename")


def sweep_images(spark: SparkSession, path: str, refs: DataFrame, now: Column) -> None:
    """Stored images that no reference names and that are older than the grace period are deleted."""
    files.delete(spark, path, orphan_images(images(spark, path), refs, now))


def bytes_on_disk(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes"))


def orphan_images(found: DataFrame, refs: DataFrame, now: Column) -> DataFrame:
    """Files that no reference names, older than the grace period."""
    named = refs.select(F.explode(F.array("original_filename", "normalized_filename")).alias("filename")).where("filename IS NOT NULL").distinct()
    old = found.where(now.cast("long") - F.col("modified").cast("long") > GRACE_SECONDS)
    return old.join(named, "filename", "left_anti")


def round_totals(hole_scores: DataFrame) -> DataFrame:
    """hole_scores (round_id, hole_count, hole_number, strokes, par) densified to the round's holes: front, back, total, course par and relative, each null unless complete."""
    r = hole_scores.groupBy("round_id").agg(F.max("hole_count").alias("hole_count"))
    every = r.withColumn("hole_number", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("hole_count")))))
    d = every.join(hole_scores.drop("hole_count"), ["round_id", "hole_number"], "left")
    n, hole = F.first("hole_count"), F.col("hole_number")
    half = lambda inside, k: F.when(F.count(F.when(inside, F.col("strokes"))) == k, F.sum(F.when(inside, F.col("strokes"))))
    total, par = strict_sum(F.col("strokes"), n), strict_sum(F.col("par"), n)
    return d.groupBy("round_id").agg(F.when(n >= 9, half(hole <= 9, F.lit(9))).alias("front"), F.when(n >= 18, half(hole > 9, n - 9)).alias("back"), total.alias("total"), par.alias("course_par"), (total - par).alias("relative_to_par"))


def save(cards: Scorecards, when: Column, images_of: DataFrame | None = None) -> Saved:
    """New rounds of read cards, their holes, image references and visits; totals are worked out, not taken over."""
    c = cards.cards.where("status = 'read'").join(cards.players.select("card_id", F.col("player_seq").alias("selected"), F.coalesce("name", "label").alias("player_name")), ["card_id", "selected"], "left")
    base = c.select(F.col("card_id").alias("round_id"), F.col("template_id").alias("course_id"), "hole_count", F.col("tee").alias("tee_name"), F.col("overall").alias("parser_confidence"), F.col("template_id").alias("applied_template_id"), "player_name", when.alias("date_played"))
    h = cards.holes.join(c.select("card_id", "hole_count"), "card_id").select(F.col("card_id").alias("round_id"), "hole_count", F.col("hole").alias("hole_number"), F.col("score.value").alias("strokes"), F.col("par.value").alias("par"), F.col("stroke_index.value").alias("handicap_index"), F.col("yardage.value").alias("yardage"), F.col("score.provenance").alias("score_provenance"), F.col("score.confidence").alias("score_confidence"))
    rounds = base.join(round_totals(h), "round_id", "left")
    visits = rounds.where("course_id IS NOT NULL").select(F.concat(F.lit("visit-"), F.col("round_id")).alias("id"), F.col("course_id").alias("course_catalog_id"), F.col("date_played").alias("visited_at"), F.lit("savedRound").alias("source"))
    refs = images_of if images_of is not None else rounds.select(F.lit(None).cast("string").alias("id"), "round_id", F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("normalized_filename")).where("id IS NOT NULL")
    return Saved(rounds, h, refs, visits)


def update_scores(rounds: DataFrame, hole_scores: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits (round_id, hole_number, strokes): holes edited and all totals of their rounds worked out anew."""
    e = edits.select("round_id", "hole_number", F.col("strokes").alias("_s"), F.lit(True).alias("_e"))
    out = hole_scores.join(e, ["round_id", "hole_number"], "left")
    holes = out.select(*[F.when(F.col("_e"), F.col("_s")).otherwise(F.col(c)).alias(c) if c == "strokes" else F.when(F.col("_e"), F.lit("userEdited")).otherwise(F.col(c)).alias(c) if c == "score_provenance" else F.col(c) for c in hole_scores.columns])
    made = ("front", "back", "total", "course_par", "relative_to_par")
    return rounds.drop(*made).join(round_totals(holes), "round_id", "left").select(rounds.columns), holes


def delete_rounds(saved: Saved, ids: DataFrame) -> tuple[Saved, DataFrame]:
    """Without the rounds of ids (round_id) and all that hangs on them, and the file names to delete first."""
    gone = saved.image_refs.join(ids, "round_id", "left_semi").select(F.explode(F.array("original_filename", "normalized_filename")).alias("filename")).where("filename IS NOT NULL").distinct()
    keep = lambda df: df.join(ids, "round_id", "left_anti")
    visits = saved.visits.join(ids.select(F.concat(F.lit("visit-"), F.col("round_id")).alias("id")), "id", "left_anti")
    return Saved(keep(saved.rounds), keep(saved.hole_scores), keep(saved.image_refs), visits), gone


def mark_played(visits: DataFrame, courses: DataFrame, when: Column) -> DataFrame:
    """visits with one manual mark for each course (catalog_id) that has none."""
    new = courses.select(F.concat(F.lit("manual-"), F.col("catalog_id")).alias("id"), F.col("catalog_id").alias("course_catalog_id"), when.alias("visited_at"), F.lit("manual").alias("source"))
    return visits.unionByName(new.join(visits.where("source = 'manual'").select("course_catalog_id"), "course_catalog_id", "left_anti").select(visits.columns))


def clear_mark(visits: DataFrame, courses: DataFrame) -> DataFrame:
    """Only manual visits go."""
    return visits.where("source <> 'manual'").unionByName(visits.where("source = 'manual'").join(courses.select(F.col("catalog_id").alias("course_catalog_id")), "course_catalog_id", "left_anti").select(visits.columns))


def seed_courses(courses: DataFrame, templates: DataFrame) -> DataFrame:
    """courses (catalog_id, name, city, hole_count, lat, lon) brought up to the catalogue: known hole counts only, coordinates that are there stay."""
    t = templates.select(F.col("template_id").alias("catalog_id"), F.col("name").alias("_name"), F.col("city").alias("_city"), F.when(F.col("hole_count") > 0, F.col("hole_count")).alias("_holes"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    both = courses.join(t, "catalog_id", "full_outer")
    return both.select("catalog_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_city", "city").alias("city"), F.coalesce("_holes", "hole_count").alias("hole_count"), F.coalesce("lat", "_lat").alias("lat"), F.coalesce("lon", "_lon").alias("lon"))


def search(courses: DataFrame, query: str) -> DataFrame:
    """Courses whose name or city holds the query, in normal form; a blank query finds all."""
    q = normalize_name(F.lit(query))
    return courses.where((q == "") | normalize_name(F.col("name")).contains(q) | normalize_name(F.coalesce("city", F.lit(""))).contains(q))


def accept_places(results: DataFrame) -> DataFrame:
    """results (catalog_id, rank, name, city, found_name, found_city, lat, lon): the first inside the box that is like the course or its city, or unnamed."""
    from functools import reduce
    from operator import and_

    from pyspark.sql import Window

    from tallyframe.functions.fields import within_box
    from tallyframe.functions.text import name_similarity
    from tallyframe.operators.similar import once

    # results often bear the same names, and likeness is what costs: each combination is judged once
    texts = ["found_name", "name", "found_city", "city"]
    inside = results.where(within_box(F.col("lat"), F.col("lon")))
    like = (name_similarity(F.col("found_name"), F.col("name")) >= 0.5) | (name_similarity(F.col("found_city"), F.col("city")) >= 0.9) | F.col("found_name").isNull()
    judged = inside.select(*texts).distinct().select(*[F.col(c).alias(f"_{c}") for c in texts], once(F.coalesce(like, F.lit(False))).alias("_like")).where("_like")
    ok = inside.join(judged, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts]), "left_semi")
    first = Window.partitionBy("catalog_id").orderBy("rank")
    return ok.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def suggested(ids: DataFrame, courses: DataFrame) -> DataFrame:
    """ids (card_id, ids array): the courses found, in the array's order; unknown ids drop out."""
    return ids.select("card_id", F.posexplode("ids").alias("place", "catalog_id")).join(courses, "catalog_id").orderBy("card_id", "place")
