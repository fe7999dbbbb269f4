"""The reference dimension of layouts: the seed, learned layouts stored as JSON, and how both are layered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.fields import promotable, within_box
from tallyframe.operators import history

# The verified layout.
GOLDEN_ID = "ga-steel-canyon"
GOLDEN_PARS = (4, 4, 3, 3, 3, 5, 3, 3, 3, 3, 4, 3, 3, 3, 4, 4, 3, 3)
GOLDEN_INDEX = (3, 5, 15, 9, 17, 1, 11, 7, 13, 12, 4, 16, 18, 8, 6, 2, 14, 10)
GOLDEN_YARDS = {
    "Black": (317, 279, 121, 187, 123, 501, 155, 185, 153, 137, 293, 138, 95, 170, 301, 351, 140, 153),
    "White": (289, 257, 100, 171, 103, 486, 135, 145, 125, 113, 254, 127, 89, 148, 270, 333, 114, 116),
    "Red": (262, 214, 67, 105, 86, 397, 92, 115, 119, 90, 122, 115, 71, 117, 233, 316, 98, 83),
}
# Layouts known by name only: id, name, layout, city, aliases, holes (0: unknown).
BY_NAME = (
    ("ga-bobby-jones", "Bobby Jones Golf Course", None, "Atlanta", ("Bobby Jones", "Bobby Jones GC", "Bobby Jones Golf Club"), 0),
    ("ga-charlie-yates", "Charlie Yates Golf Course", None, "Atlanta", ("Charlie Yates", "Charlie Yates GC"), 0),
    ("ga-north-fulton", "North Fulton Golf Course", None, "Atlanta", ("North Fulton", "North Fulton GC", "Chastain Park"), 18),
    ("ga-tup-holmes", 'Alfred "Tup" Holmes Golf Course', None, "Atlanta", ("Tup Holmes", "Alfred Tup Holmes", "Holmes Golf Course", "Alfred Holmes"), 18),
    ("ga-browns-mill", "Browns Mill Golf Course", None, "Atlanta", ("Browns Mill", "Brown's Mill", "Browns Mill GC"), 18),
    ("ga-sugar-creek", "Sugar Creek Golf Course", None, "Atlanta", ("Sugar Creek", "Sugar Creek GC"), 18),
    ("ga-wolf-creek", "Wolf Creek Golf Club", None, "Atlanta", ("Wolf Creek", "Wolf Creek GC"), 18),
    ("ga-cobblestone", "Cobblestone Golf Course", None, "Acworth", ("Cobblestone", "Cobblestone GC"), 18),
    ("ga-heritage-golf-links", "Heritage Golf Links", None, "Tucker", ("Heritage Golf Links", "Heritage GC", "Heritage"), 18),
    ("ga-uga", "University of Georgia Golf Course", None, "Athens", ("UGA Golf Course", "Georgia Golf Course", "University of Georgia"), 18),
    ("ga-bears-best", "Bear's Best Atlanta", None, "Suwanee", ("Bears Best", "Bear's Best", "Bears Best Atlanta"), 18),
    ("ga-lanier-islands-legacy", "Lanier Islands Legacy Golf Course", None, "Buford", ("Legacy on Lanier", "Lanier Islands Legacy", "Lanier Islands", "Legacy Golf Course"), 18),
    ("ga-stone-mountain-stonemont", "Stone Mountain Golf Club", "Stonemont", "Stone Mountain", ("Stonemont", "Stone Mountain Stonemont"), 18),
    ("ga-stone-mountain-lakemont", "Stone Mountain Golf Club", "Lakemont", "Stone Mountain", ("Lakemont", "Stone Mountain Lakemont"), 18),
    ("ga-chateau-elan-chateau", "Chateau Elan Golf Club", "Chateau", "Braselton", ("Chateau Elan", "Chateau Course", "Chateau Elan Chateau"), 18),
    ("ga-chateau-elan-woodlands", "Chateau Elan Golf Club", "Woodlands", "Braselton", ("Woodlands", "Woodlands Course", "Chateau Elan Woodlands"), 18),
)

TEE = "struct<name:string,color:string,yards:array<int>>"
TEMPLATES = f"template_id string, template_seq int, name string, layout string, facility string, city string, state string, aliases array<string>, hole_count int, pars array<int>, indexes array<int>, tees array<{TEE}>, verification string, version int, lat double, lon double"
_PAYLOAD = f"struct<template_id:string,name:string,layout:string,facility:string,city:string,state:string,aliases:array<string>,hole_count:int,pars:array<int>,indexes:array<int>,tees:array<{TEE}>,verification:string,version:int,lat:double,lon:double>"


def seed(spark: SparkSession) -> DataFrame:
    """The built-in layouts; template_seq keeps their order for ties."""
    tees = [(n, n.lower(), list(y)) for n, y in GOLDEN_YARDS.items()]
    name = "Steel Canyon Golf Club"
    rows = [(GOLDEN_ID, 0, name, None, name, "Sandy Springs", "GA", ["Steel Canyon", "Steel Canyon GC", "Steelcanyon"], 18, list(GOLDEN_PARS), list(GOLDEN_INDEX), tees, "verified", 2, None, None)]
    rows += [(i, n, name, layout, name, city, "GA", list(aliases), holes, [], [], [], "needsVerification", 1, None, None) for n, (i, name, layout, city, aliases, holes) in enumerate(BY_NAME, 1)]
    return spark.createDataFrame(rows, TEMPLATES)


def template(templates: DataFrame, template_id: str) -> DataFrame:
    return templates.where(F.col("template_id") == template_id).limit(1)


def hole_data_usable() -> Column:
    """Verified, partial or confirmed, and with all pars or any tee."""
    pars = (F.size("pars") > 0) & F.forall("pars", lambda p: p.isNotNull())
    return F.col("verification").isin("verified", "partial", "userConfirmed") & (pars | (F.size("tees") > 0))


def complete_yards(yards: Column) -> Column:
    return (F.size(yards) > 0) & F.forall(yards, lambda y: y.isNotNull())


def holes(templates: DataFrame) -> DataFrame:
    """(template_id, hole, par, stroke_index) in long form."""
    n = F.greatest(F.size("pars"), F.size("indexes"))
    at = templates.where(n > 0).select("template_id", "pars", "indexes", F.explode(F.sequence(F.lit(1), n)).alias("hole"))
    return at.select("template_id", "hole", F.get("pars", F.col("hole") - 1).alias("par"), F.get("indexes", F.col("hole") - 1).alias("stroke_index"))


def tees(templates: DataFrame) -> DataFrame:
    """(template_id, tee_seq, tee, hole, yards, tee_total) in long form; the total is null unless all are known."""
    t = templates.select("template_id", F.posexplode("tees").alias("tee_seq", "t"))
    total = F.when(complete_yards(F.col("t.yards")), F.aggregate("t.yards", F.lit(0), lambda a, y: a + y))
    return t.select("template_id", "tee_seq", F.col("t.name").alias("tee"), total.alias("tee_total"), F.posexplode("t.yards").alias("i", "yards")).select("template_id", "tee_seq", "tee", (F.col("i") + 1).alias("hole"), "yards", "tee_total")


def encode(templates: DataFrame) -> DataFrame:
    """Stored form: (template_id, version, payload JSON)."""
    return templates.select("template_id", "version", F.to_json(F.struct(*[c for c in templates.columns if c != "template_seq"])).alias("payload"))


def decode(stored: DataFrame) -> DataFrame:
    """Payloads that don't parse are skipped."""
    p = stored.withColumn("p", F.from_json("payload", _PAYLOAD, {"mode": "PERMISSIVE"})).where(F.col("p").isNotNull() & F.col("p.template_id").isNotNull())
    return p.select(F.lit(None).cast("int").alias("template_seq"), "p.*")


def available(spark: SparkSession, learned: DataFrame | None = None) -> DataFrame:
    """Learned layouts over the seed: each replaces the seed's of its id, and others are appended."""
    base = seed(spark)
    if learned is None:
        return base
    own = decode(learned)
    order = base.select("template_id", F.col("template_seq").alias("_seq"))
    over = own.join(order, "template_id", "left").withColumn("template_seq", F.coalesce("_seq", F.lit(1_000_000))).drop("_seq")
    return base.join(own.select("template_id"), "template_id", "left_anti").select(base.columns).unionByName(over.select(base.columns))


def learn(scorecards: DataFrame, card_holes: DataFrame, existing: DataFrame) -> DataFrame:
    """Templates from confirmed cards, one row each: (template_id, hole_count, pars, indexes, tees, verification, version).

    scorecards: (card_id, template_id, tee); card_holes: (card_id, hole, and value and provenance of par,
    stroke_index, yards). Only what was read or edited is promoted; a card with an unknown par teaches
    nothing. All cards of a template are folded at once: of pars, indexes and a tee's yards, the value of the
    last card (by id) that knows it, then what was known before; the version rises by one.
    """
    take = lambda c: F.when(promotable(F.col(c), F.col(f"{c}_provenance")), F.col(c))
    fields = card_holes.select("card_id", "hole", *[take(c).alias(c) for c in ("par", "stroke_index", "yards")])
    whole = fields.groupBy("card_id").agg(F.bool_and(F.col("par").isNotNull()).alias("ok")).where("ok").select("card_id")
    taught = fields.join(whole, "card_id").join(scorecards.select("card_id", "template_id", "tee"), "card_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("card_id")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("hole", c))), lambda s: s[c]).alias(c)
    course = taught.groupBy("template_id", "hole").agg(last("par").alias("pars"), last("stroke_index").alias("indexes")).groupBy("template_id").agg(listed("pars"), listed("indexes"))
    by_hole = taught.where("tee IS NOT NULL").groupBy("template_id", F.lower("tee").alias("key"), "hole").agg(F.max("tee").alias("tee"), last("yards").alias("yards"))
    read = by_hole.groupBy("template_id", "key").agg(F.max("tee").alias("name"), listed("yards")).where(F.exists("yards", lambda y: y.isNotNull()))
    old = existing.select("template_id", F.col("version").alias("old_version"), F.posexplode_outer("tees").alias("place", "t"))
    known = old.where("t IS NOT NULL").select("template_id", F.lower("t.name").alias("key"), "place", "t").join(course.select("template_id"), "template_id", "left_semi")
    both = known.join(read, ["template_id", "key"], "full_outer")
    longest = F.greatest(F.size(F.coalesce("yards", F.array().cast("array<int>"))), F.size(F.coalesce("t.yards", F.array().cast("array<int>"))))
    merged = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.coalesce(F.get("yards", i), F.get("t.yards", i)))
    tee = F.struct(F.coalesce("t.name", "name").alias("name"), F.coalesce("t.color", "key").alias("color"), F.when(longest > 0, merged).otherwise(F.array().cast("array<int>")).alias("yards"))
    # tees keep their order; new ones follow by name
    tees = both.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(1_000_000)).alias("place"), "key", tee.alias("tee")))), lambda s: s["tee"]).alias("tees"))
    versions = existing.select("template_id", F.col("version").alias("old_version"))
    out = course.join(tees, "template_id", "left").join(versions, "template_id", "left").withColumn("tees", F.coalesce("tees", F.array().cast(f"array<{TEE}>")))
    done = (F.size("tees") > 0) & F.forall("tees", lambda t: complete_yards(t["yards"])) & F.forall("indexes", lambda i: i.isNotNull())
    return out.select("template_id", F.size("pars").alias("hole_count"), "pars", "indexes", "tees", F.when(done, "userConfirmed").otherwise("partial").alias("verification"), (F.coalesce("old_version", F.lit(0)) + 1).alias("version"))


def save_learned(stored: DataFrame, new: DataFrame) -> DataFrame:
    return history.upsert(stored, new, "template_id", "version")


def update_coordinates(courses: DataFrame, found: DataFrame) -> DataFrame:
    """Coordinates for courses that lack them, from a lookup table; only inside the box."""
    ok = found.where(within_box(F.col("lat"), F.col("lon"))).select(F.col("template_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    lacks = F.col("lat").isNull() | F.col("lon").isNull()
    return courses.join(ok, "template_id", "left").select(*[c for c in courses.columns if c not in ("lat", "lon")], F.when(lacks, F.col("_lat")).otherwise(F.col("lat")).alias("lat"), F.when(lacks, F.col("_lon")).otherwise(F.col("lon")).alias("lon"))
