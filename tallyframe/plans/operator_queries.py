"""More registered queries: operators of saved rounds, catalogues, second readings, edits and short texts, each called itself on the plain tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields, geometry, numeric, text
from tallyframe.functions.geometry import Box
from tallyframe.model import Matching
from tallyframe.operators import bands, confidence, history, match, overlaps, remote, report, similar
from tallyframe.operators.ranks import ranked
from tallyframe.plans import cards as pipeline
from tallyframe.plans.table_queries import CELLS, _number_sql, cells, query, table
from tallyframe.sources import catalog, store

_NAME = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey AS catalog_id, p_name AS name, p_type AS city FROM part WHERE contains({_NAME.format(c='p_name')}, 'econ') OR contains({_NAME.format(c='p_type')}, 'econ')")
def course_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("catalog_id"), F.col("p_name").alias("name"), F.col("p_type").alias("city"))
    return store.search(p, "  Econ ")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, 30 + (l_partkey % 70) / 10.0::DOUBLE AS lat, -86 + (l_suppkey % 60) / 10.0::DOUBLE AS lon, l_partkey % 3 AS k FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
 a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM r WHERE lat BETWEEN 30.355 AND 35.001 AND lon BETWEEN -85.605 AND -80.751 AND k <> 2)
 SELECT l_orderkey AS catalog_id, l_linenumber AS rank, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon FROM a WHERE n = 1""")
def accepted_places(spark, sf_dir):
    """One in three results bears the course's name, one no name, and one a name and a town unlike it."""
    k = F.col("l_partkey") % 3
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    r = one.select(
        F.col("l_orderkey").alias("catalog_id"), F.col("l_linenumber").alias("rank"), F.lit("North Fulton Golf Course").alias("name"), F.lit("Atlanta").alias("city"), F.when(k == 0, "North Fulton Golf Course").when(k == 2, "Zzyzx Pub").alias("found_name"),
        F.when(k == 0, "Atlanta").when(k == 2, "Quincy").alias("found_city"), (F.lit(30) + (F.col("l_partkey") % 70) / 10.0).alias("lat"), (F.lit(-86) + (F.col("l_suppkey") % 60) / 10.0).alias("lon"),
    )
    return store.accept_places(r).select("catalog_id", "rank", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a visit; each seventh is a mark by hand."""
    manual = F.col("o_orderkey") % 7 == 0
    return table(spark, sf_dir, "orders").select(F.concat(F.when(manual, "manual-").otherwise("visit-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").alias("course_catalog_id"), F.col("o_orderdate").cast("timestamp").alias("visited_at"), F.when(manual, "manual").otherwise("savedRound").alias("source"))


_VISITS = "WITH v AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'manual-' ELSE 'visit-' END || o_orderkey AS id, o_custkey AS course_catalog_id, CASE WHEN o_orderkey % 7 = 0 THEN 'manual' ELSE 'savedRound' END AS source FROM orders)"


@query(_VISITS + """ SELECT id, course_catalog_id, source FROM v UNION ALL SELECT 'manual-' || c_custkey, c_custkey, 'manual' FROM customer WHERE c_custkey NOT IN (SELECT course_catalog_id FROM v WHERE source = 'manual')""")
def marks_set(spark, sf_dir):
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("catalog_id"))
    return store.mark_played(_visits(spark, sf_dir), courses, F.to_timestamp(F.lit("2025-01-01"))).select("id", "course_catalog_id", "source")


@query(_VISITS + """ SELECT id, course_catalog_id, source FROM v WHERE source <> 'manual' OR course_catalog_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)""")
def marks_cleared(spark, sf_dir):
    courses = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("catalog_id"))
    return store.clear_mark(_visits(spark, sf_dir), courses).select("id", "course_catalog_id", "source")


@query("""WITH c AS (SELECT p_partkey AS id, p_name AS name, p_size AS holes, CASE WHEN p_partkey % 2 = 0 THEN 33.5::DOUBLE END AS lat FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT p_partkey AS id, 'the ' || p_name AS name, p_brand AS city, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 18 END AS holes, 34.0::DOUBLE AS lat FROM part WHERE p_partkey % 4 <> 0)
 SELECT COALESCE(c.id, t.id) AS catalog_id, COALESCE(t.name, c.name) AS name, COALESCE(t.city, CASE WHEN c.id IS NOT NULL THEN 'old' END) AS city, CAST(COALESCE(CASE WHEN t.holes > 0 THEN t.holes END, c.holes) AS INT) AS hole_count, COALESCE(c.lat, t.lat) AS lat FROM c FULL OUTER JOIN t ON c.id = t.id""")
def courses_seeded(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    courses = p.where(k % 3 != 0).select(k.alias("catalog_id"), F.col("p_name").alias("name"), F.lit("old").alias("city"), F.col("p_size").cast("int").alias("hole_count"), F.when(k % 2 == 0, 33.5).alias("lat"), F.when(k % 2 == 0, -84.0).alias("lon"))
    t = p.where(k % 4 != 0).select(k.alias("template_id"), F.concat(F.lit("the "), F.col("p_name")).alias("name"), F.col("p_brand").alias("city"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(18).alias("hole_count"), F.lit(34.0).alias("lat"), F.lit(-84.5).alias("lon"))
    return store.seed_courses(courses, t).select("catalog_id", "name", "city", "hole_count", "lat")


@query("""SELECT o_custkey AS card_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS place, o_orderkey % 4000 AS catalog_id, p_name AS name FROM (SELECT o_custkey, o_orderkey, p_partkey, p_name FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 4000) QUALIFY p_partkey IS NOT NULL""")
def suggested_courses(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k % 4000).alias("ids"))
    courses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("catalog_id"), "p_name")
    return store.suggested(ids, courses).select("card_id", "place", "catalog_id", F.col("p_name").alias("name"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def stored_scan(spark, sf_dir):
    """The limit is the operator's own: a filtered, ordered fetch of a stored table."""
    return store.scan(spark, f"{sf_dir}/orders.parquet", F.col("o_totalprice") > 100000, [F.desc("o_totalprice"), F.col("o_orderkey")], 25).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey AS filename, CAST(c_custkey % 7 AS BIGINT) AS bytes FROM customer WHERE c_custkey % 5000 > 3600 / 60 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def images_to_clean(spark, sf_dir):
    """Images that no round names and that are older than the grace period; a file is as many minutes old as its number modulo 5000."""
    now = F.to_timestamp(F.lit("2025-01-10 00:00:00"))
    k = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(k.alias("filename"), (k % 7).cast("long").alias("bytes"), (now.cast("long") - (k % 5000) * 60).cast("timestamp").alias("modified"))
    refs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("original_filename"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("normalized_filename"))
    return store.orphan_images(files, refs, now).select("filename", "bytes")


@query("SELECT CAST(COALESCE(SUM(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 END), 0) AS BIGINT) AS bytes FROM customer")
def image_bytes(spark, sf_dir):
    return store.bytes_on_disk(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 100).cast("long").alias("bytes")))


_HOLES = CELLS + """, h AS (SELECT card_id, hole, value, 4 AS par, n FROM (SELECT *, MAX(hole) OVER (PARTITION BY card_id) AS n FROM cells))"""


def _hole_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    n = c.groupBy("card_id").agg(F.max("hole").cast("int").alias("hole_count"))
    p = F.when(F.col("value").isNotNull(), "ocr").otherwise("none")
    return c.join(n, "card_id").select(F.col("card_id").alias("round_id"), "hole_count", F.col("hole").cast("int").alias("hole_number"), F.col("value").alias("strokes"), F.lit(4).alias("par"), p.alias("score_provenance"))


@query(_HOLES + """ SELECT card_id AS round_id, CAST(CASE WHEN COUNT(value) = MAX(n) THEN SUM(value) END AS BIGINT) AS total, CAST(CASE WHEN COUNT(*) = MAX(n) THEN 4 * MAX(n) END AS BIGINT) AS course_par, CAST(CASE WHEN COUNT(value) = MAX(n) THEN SUM(value) - 4 * MAX(n) END AS BIGINT) AS relative_to_par FROM h GROUP BY card_id""")
def saved_totals(spark, sf_dir):
    return store.round_totals(_hole_scores(spark, sf_dir)).select("round_id", "total", "course_par", "relative_to_par")


@query(_HOLES + """, e AS (SELECT *, CASE WHEN card_id % 3 = 0 AND hole = 1 THEN 5 ELSE value END AS v FROM h)
 SELECT card_id AS round_id, CAST(CASE WHEN COUNT(v) = MAX(n) THEN SUM(v) END AS BIGINT) AS total, COUNT(CASE WHEN card_id % 3 = 0 AND hole = 1 THEN 1 END) AS edited FROM e GROUP BY card_id""")
def scores_updated(spark, sf_dir):
    h = _hole_scores(spark, sf_dir)
    totals = store.round_totals(h)
    edits = h.where("round_id % 3 = 0 AND hole_number = 1").select("round_id", "hole_number", F.lit(5).alias("strokes"))
    rounds, holes = store.update_scores(totals, h, edits)
    edited = holes.groupBy("round_id").agg(F.count_if(F.col("score_provenance") == "userEdited").alias("edited"))
    return rounds.join(edited, "round_id").select("round_id", "total", "edited")


@query("""WITH r AS (SELECT o_orderkey AS k FROM orders), g AS (SELECT k FROM r WHERE k % 4 = 0)
 SELECT 'round' AS kind, CAST(k AS VARCHAR) AS name FROM r WHERE k % 4 <> 0 UNION ALL SELECT 'visit', 'visit-' || k FROM r WHERE k % 4 <> 0 UNION ALL SELECT 'file', 'o' || k FROM g UNION ALL SELECT 'file', 'n' || k FROM g WHERE k % 8 = 0""")
def rounds_deleted(spark, sf_dir):
    """Deleted rounds take their holes, references and visits along, and name the files to remove."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("round_id"))
    refs = r.select(F.col("round_id").alias("id"), "round_id", F.concat(F.lit("o"), "round_id").alias("original_filename"), F.when(k % 8 == 0, F.concat(F.lit("n"), "round_id")).alias("normalized_filename"))
    visits = r.select(F.concat(F.lit("visit-"), "round_id").alias("id"), F.col("round_id").alias("course_catalog_id"))
    left, gone = store.delete_rounds(store.Saved(r, r, refs, visits), r.where(k % 4 == 0).select("round_id"))
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return named(left.rounds, "round", "round_id").unionByName(named(left.visits, "visit", "id")).unionByName(named(gone, "file", "filename"))


@query("""WITH f AS (SELECT c_custkey AS id, 30 + (c_custkey % 70) / 10.0::DOUBLE AS lat, -86 + (c_custkey % 60) / 10.0::DOUBLE AS lon FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 33.0::DOUBLE END AS lat FROM customer)
 SELECT c.id AS template_id, ROUND(COALESCE(c.lat, f.lat), 6) AS lat FROM c LEFT JOIN f ON f.id = c.id AND f.lat BETWEEN 30.355 AND 35.001 AND f.lon BETWEEN -85.605 AND -80.751""")
def coordinates_filled(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    courses = c.select(k.alias("template_id"), F.when(k % 3 == 0, 33.0).alias("lat"), F.when(k % 3 == 0, -84.0).alias("lon"))
    found = c.where(k % 2 == 0).select(k.alias("template_id"), (F.lit(30) + (k % 70) / 10.0).alias("lat"), (F.lit(-86) + (k % 60) / 10.0).alias("lon"))
    return catalog.update_coordinates(courses, found).select("template_id", F.round("lat", 6).alias("lat"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS version, p_name AS payload FROM part UNION ALL SELECT ps, v, n FROM (SELECT p_partkey AS ps, p_size + (p_partkey % 3) - 1 AS v, 'learned ' || p_name AS n FROM part WHERE p_partkey % 2 = 0))
 SELECT id AS template_id, CAST(version AS INT) AS version, payload FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY version DESC, payload DESC) AS k FROM b) WHERE k = 1""")
def learned_saved(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    old = p.select(k.alias("template_id"), F.col("p_size").cast("int").alias("version"), F.col("p_name").alias("payload"))
    new = p.where(k % 2 == 0).select(k.alias("template_id"), (F.col("p_size") + k % 3 - 1).cast("int").alias("version"), F.concat(F.lit("learned "), F.col("p_name")).alias("payload"))
    return catalog.save_learned(old, new)


@query("""WITH t AS (SELECT p_partkey AS id, list_transform(range(1, 4), lambda i: CASE WHEN (p_partkey + i) % 5 <> 0 THEN CAST(p_size + i AS INT) END) AS y FROM part)
 SELECT id AS template_id, CAST(h AS INT) AS hole, y[h] AS yards, CASE WHEN len(list_filter(y, lambda v: v IS NULL)) = 0 THEN list_sum(y)::INT END AS tee_total FROM t, (SELECT UNNEST(range(1, 4)) AS h)""")
def tees_in_long_form(spark, sf_dir):
    """Through the stored JSON form and back."""
    k = F.col("p_partkey")
    y = F.array(*[F.when((k + i) % 5 != 0, (F.col("p_size") + i).cast("int")) for i in (1, 2, 3)])
    none = F.array().cast("array<int>")
    t = table(spark, sf_dir, "part").select(
        k.cast("string").alias("template_id"), F.lit(0).alias("template_seq"), F.col("p_name").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("layout", "facility", "city", "state")], F.array().cast("array<string>").alias("aliases"), F.lit(3).alias("hole_count"),
        none.alias("pars"), none.alias("indexes"), F.array(F.struct(F.lit("White").alias("name"), F.lit("white").alias("color"), y.alias("yards"))).alias("tees"), F.lit("partial").alias("verification"), F.lit(1).alias("version"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    return catalog.tees(catalog.decode(catalog.encode(t))).select(F.col("template_id").cast("long").alias("template_id"), "hole", "yards", "tee_total")


@query("""SELECT o_custkey AS course_id, MIN(CAST(floor(o_totalprice) AS BIGINT)) AS total, arg_min(o_orderkey, (CAST(floor(o_totalprice) AS BIGINT), o_orderdate, o_orderkey)) AS round_id FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1""")
def best_rounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_id"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("date_played"), F.when(F.col("o_orderkey") % 6 != 0, F.floor("o_totalprice").cast("long")).alias("total"))
    return history.best_rounds(o)


@query("""SELECT event_id, CASE WHEN value >= 99.9 THEN 'chosen' WHEN value >= 72 THEN 'recognised' ELSE 'low' END AS wording, value BETWEEN 9 AND 135 AS nine, array_to_string(list_filter([CASE WHEN value < 45 THEN 'imageBlurry' END, CASE WHEN user_id % 100 > 35 THEN 'imageGlare' END], lambda x: x IS NOT NULL), ',') AS flags,
 event_type NOT IN ('click', 'view') AS permitted, event_id % 5 = 0 OR value / 100 < 0.6 AS ask_tee FROM events""")
def small_predicates(spark, sf_dir):
    v = F.col("value")
    kind = F.when(F.col("event_type") == "click", "verifiedCourseTemplate").when(F.col("event_type") == "view", "inferredFromLayout").otherwise("ocr")
    tee = F.when(F.col("event_id") % 5 != 0, "White")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(v >= 99.9, fields.confidence_text(F.lit(1.0))).otherwise(fields.confidence_text(v / 100)).alias("wording"), fields.plausible_nine(v).alias("nine"),
        F.array_join(fields.quality_flags(v / 100, (F.col("user_id") % 100) / 100), ",").alias("flags"), fields.permitted_for_score(kind).alias("permitted"), confidence.needs_tee(tee, v / 100).alias("ask_tee"),
    )


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'x' ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS t FROM orders)
 SELECT o_orderkey, trim(t) = '' OR COALESCE(TRY_CAST(t AS INT) BETWEEN 1 AND 15, FALSE) AS accepted, CASE WHEN TRY_CAST(t AS INT) BETWEEN 1 AND 15 THEN TRY_CAST(t AS INT) END AS value FROM t""")
def edits_checked(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, " ").when(k % 5 == 1, "x").otherwise((k % 20).cast("string"))
    return table(spark, sf_dir, "orders").select(k, fields.edited_score(t).alias("e")).select("o_orderkey", "e.accepted", "e.value")


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://a.example/x' WHEN 1 THEN 'https://' WHEN 2 THEN 'ftp://a' ELSE 'https://h' || page_id || '.example/p' END AS u FROM pages) SELECT page_id, page_id % 4 = 3 AS valid FROM u""")
def endpoints_checked(spark, sf_dir):
    k = F.col("page_id")
    u = F.when(k % 4 == 0, "http://a.example/x").when(k % 4 == 1, "https://").when(k % 4 == 2, "ftp://a").otherwise(F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example/p")))
    return table(spark, sf_dir, "pages").select("page_id", fields.valid_endpoint(u).alias("valid"))


@query(f"""WITH p AS (SELECT DISTINCT CAST(l_quantity AS INT) AS o, CAST(l_quantity AS INT) + CAST(l_partkey % 5 AS INT) AS e FROM lineitem) SELECT o AS observed, e AS expected, {_number_sql('o', 'e')} AS similarity FROM p""")
def text_against_numbers(spark, sf_dir):
    """The observed number comes as text with marks around it, which don't count."""
    o = F.col("l_quantity").cast("int")
    p = table(spark, sf_dir, "lineitem").select(o.alias("observed"), (o + (F.col("l_partkey") % 5).cast("int")).alias("expected")).distinct()
    return p.select("observed", "expected", numeric.text_number_similarity(F.concat(F.lit(" "), F.col("observed").cast("string"), F.lit(".'")), F.col("expected")).alias("similarity"))


@query("""WITH b AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 0.05 AS w, abs(CAST(embedding[4] AS DOUBLE)) + 0.05 AS h FROM embeddings),
 p AS (SELECT a.vec_id, a.x, a.y, a.w, a.h, b.x AS x2, b.w AS w2 FROM b a JOIN b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, ROUND(CASE WHEN LEAST(x + w, x2 + w2) - GREATEST(x, x2) > 0 THEN (LEAST(x + w, x2 + w2) - GREATEST(x, x2)) / LEAST(x + w - x, x2 + w2 - x2) ELSE 0.0 END, 9) AS horizontal, ROUND(1 - y - h, 9) AS flipped_y, ROUND(GREATEST(0.0::DOUBLE, w - 0.1), 9) AS inset_w,
 ROUND(LEAST(1.0::DOUBLE, x / 0.06), 9) AS sharpness, ROUND(GREATEST(0.0::DOUBLE, (y - 0.93) / 0.07), 9) AS glare FROM p""")
def box_measures(spark, sf_dir):
    part = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    b = table(spark, sf_dir, "embeddings").select("vec_id", part(0).alias("x"), part(1).alias("y"), (part(2) + 0.05).alias("w"), (part(3) + 0.05).alias("h"))
    n = b.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"n_{c}") for c in "xywh"])
    one, q = Box.of(), report.image_quality(F.col("x"), F.col("y"))
    return b.join(n, "vec_id").select("vec_id", F.round(geometry.horizontal_overlap(one, Box.of("n_")), 9).alias("horizontal"), F.round(one.from_bottom_left().y, 9).alias("flipped_y"), F.round(one.inset(F.lit(0.05), F.lit(0.05)).w, 9).alias("inset_w"), F.round(q["sharpness"], 9).alias("sharpness"), F.round(q["glare"], 9).alias("glare"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' — ' || p_brand ELSE p_name END AS shown, CASE WHEN p_size % 2 = 0 THEN 'yardage(' || p_brand || ')' ELSE 'yardage' END AS role,
 p_brand || CASE p_size % 4 WHEN 0 THEN ': confirmed by ' || p_size || CASE WHEN p_size = 1 THEN ' written total' ELSE ' written totals' END WHEN 1 THEN ': differs from 1 of ' || p_size || CASE WHEN p_size = 1 THEN ' written total' ELSE ' written totals' END WHEN 2 THEN ': incomplete, nothing to check' ELSE ': no written totals' END AS line FROM part""")
def texts_shown(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    verdict = F.when(n % 4 == 0, "corroborated").when(n % 4 == 1, "contradicted").when(n % 4 == 2, "rowIncomplete").otherwise("noSubtotals")
    return table(spark, sf_dir, "part").select("p_partkey", text.display_name(F.col("p_name"), F.when(k % 3 == 0, F.col("p_brand"))).alias("shown"), report.role_text(F.lit("yardage"), F.when(n % 2 == 0, F.col("p_brand"))).alias("role"), report.audit_line(verdict, F.col("p_brand"), n, F.lit(1)).alias("line"))


@query("""SELECT o_orderkey AS round_id, CASE WHEN o_orderkey % 6 = 0 THEN 'incomplete' ELSE (70 + o_custkey % 9) || ' (' || CASE WHEN o_custkey % 9 = 2 THEN 'E' WHEN o_custkey % 9 > 2 THEN '+' || (o_custkey % 9 - 2) ELSE CAST(o_custkey % 9 - 2 AS VARCHAR) END || ')' END || CASE WHEN o_orderkey % 2 = 0 THEN ' White tees' ELSE '' END AS line FROM orders""")
def round_lines(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 9
    r = table(spark, sf_dir, "orders").select(k.alias("round_id"), F.when(k % 6 != 0, n + 70).alias("total"), F.when(k % 6 != 0, n - 2).alias("relative_to_par"), F.when(k % 2 == 0, "White").alias("tee_name"))
    return report.summary_line(r)


@query(CELLS + """ SELECT card_id, bool_and(hole % 4 <> 3 AND value IS NOT NULL) AS can_teach, bool_or(value IS NULL OR hole % 4 = 2) AS offer_remote FROM cells GROUP BY card_id""")
def eligibility(spark, sf_dir):
    """What a card could teach, and whether a second reading has anything to add."""
    c = cells(spark, sf_dir).withColumn("score", fields.make_field(F.col("value"), F.when(F.col("hole") % 4 == 2, 0.5).otherwise(0.9), "ocr")).withColumn("par", fields.make_field(F.col("value"), 0.9, F.when(F.col("hole") % 4 == 3, "verifiedCourseTemplate").otherwise("ocr")))
    players = c.select("card_id").distinct().withColumn("n_players", F.lit(1))
    return report.can_teach(c).join(report.can_offer_remote(c, players), "card_id").select("card_id", "can_teach", "offer_remote")


@query("""SELECT o_custkey AS card_id, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, o_orderkey) AS INT) AS position, bool_or(o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS blocked, COUNT(CASE WHEN o_orderkey % 3 = 1 THEN 1 END) OVER (PARTITION BY o_custkey) AS doubtful FROM orders""")
def warnings_ranked(spark, sf_dir):
    k = F.col("o_orderkey")
    severity = F.when(k % 3 == 0, "blocking").when(k % 3 == 1, "warning").otherwise("info")
    w = F.struct(severity.alias("kind"), severity.alias("severity"), F.array(k.cast("int")).alias("holes"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), w.alias("w")))), lambda s: s["w"]).alias("w"))
    g = g.select("card_id", F.posexplode(confidence.by_severity(F.col("w"))).alias("at", "one"), confidence.has_blocking(F.col("w")).alias("blocked"), F.size(confidence.of_kind(F.col("w"), "warning")).cast("long").alias("doubtful"))
    return g.select("card_id", F.get("one.holes", F.lit(0)).cast("long").alias("o_orderkey"), (F.col("at") + 1).alias("position"), "blocked", "doubtful")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each order: one player, its line items as holes; scores and subtotals partly out of range, one hole repeated."""
    k, h = F.col("l_orderkey"), F.col("l_linenumber")
    one = table(spark, sf_dir, "lineitem").groupBy(k.alias("card_id"), h.cast("int").alias("holeNumber")).agg(F.min("l_quantity").cast("int").alias("q"))
    each = F.struct("holeNumber", F.col("q").alias("playerScore"), (F.col("q") / 40.0).alias("confidence"))
    g = one.groupBy("card_id").agg(F.array_sort(F.collect_list(each)).alias("h"), F.sum("q").cast("int").alias("sum"))
    holes = F.concat("h", F.transform(F.slice("h", 1, 1), lambda x: F.struct(x["holeNumber"].alias("holeNumber"), F.lit(1).alias("playerScore"), F.lit(0.1).alias("confidence"))))
    player = F.struct(F.when(F.col("card_id") % 3 != 0, "SAM").otherwise(" ").alias("name"), holes.alias("holes"), F.col("sum").alias("writtenOut"), F.lit(40).alias("writtenIn"), F.col("sum").alias("writtenTotal"))
    return g.select("card_id", F.when(F.col("card_id") % 7 == 0, 9).otherwise(18).alias("hole_count"), F.to_json(F.struct(F.array(player).alias("players"))).alias("payload"))


_PAYLOADS = "WITH q AS (SELECT l_orderkey AS card_id, CAST(l_linenumber AS INT) AS hole, CAST(MIN(l_quantity) AS INT) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT card_id, CAST(SUM(q) AS INT) AS sum, CASE WHEN card_id % 7 = 0 THEN 9 ELSE 18 END AS n FROM q GROUP BY 1)"


@query(_PAYLOADS + " SELECT card_id, hole, CASE WHEN q BETWEEN 1 AND 15 THEN q END AS value, ROUND(LEAST(1.0::DOUBLE, q / 40.0::DOUBLE), 9) AS confidence FROM q")
def payload_scores(spark, sf_dir):
    _, scores = remote.sanitise(_payloads(spark, sf_dir))
    return scores.select("card_id", "hole", "value", F.round("confidence", 9).alias("confidence"))


@query(_PAYLOADS + """ SELECT card_id, CASE WHEN card_id % 3 <> 0 THEN 'SAM' END AS name, CASE WHEN sum BETWEEN 9 AND 135 THEN sum END AS out, CASE WHEN n > 9 THEN 40 END AS back, CASE WHEN sum BETWEEN n AND n * 15 THEN sum END AS total FROM s""")
def payload_players(spark, sf_dir):
    players, _ = remote.sanitise(_payloads(spark, sf_dir))
    return players.select("card_id", "name", "out", "back", "total")


_FIELD = "CASE WHEN hole = 1 THEN 'userEdited' ELSE 'ocr' END"


@query(CELLS + f""", m AS (SELECT card_id, hole, value, {_FIELD} AS p, CASE WHEN hole % 3 = 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS c, raw % 20 AS r, LEAST(CASE WHEN raw % 2 = 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END, CASE WHEN card_id % 2 = 0 THEN 0.95::DOUBLE ELSE 0.45::DOUBLE END) AS rc FROM cells),
 w AS (SELECT *, p <> 'userEdited' AND r BETWEEN 1 AND 15 AND rc >= {{least}} AND (value IS NULL OR rc >= c + {{margin}}) AS wins FROM m) SELECT card_id, hole, CAST(CASE WHEN wins THEN r ELSE value END AS INT) AS value, wins AS updated FROM w""".replace("{least}", str(remote.Config().remote.least)).replace("{margin}", str(remote.Config().remote.margin)))
def second_reading_merged(spark, sf_dir):
    c = cells(spark, sf_dir, "l_orderkey", "l_linenumber")  # as the merge joins them
    p = F.when(F.col("hole") == 1, "userEdited").otherwise("ocr")
    local = c.select("card_id", "hole", fields.make_field(F.col("value"), F.when(F.col("hole") % 3 == 0, 0.3).otherwise(0.7), p).alias("field"))
    other = c.select("card_id", "hole", (F.col("raw") % 20).alias("value"), F.when(F.col("raw") % 2 == 0, 0.9).otherwise(0.4).alias("confidence"), F.when(F.col("card_id") % 2 == 0, 0.95).otherwise(0.45).alias("ceiling"))
    return remote.merge(local, other).select("card_id", "hole", "field.value", "updated")


@query("""WITH l AS (SELECT o_custkey AS card_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS s FROM orders), n AS (SELECT card_id, COUNT(*) AS n FROM l GROUP BY 1)
 SELECT c_custkey AS card_id, CAST(k AS INT) AS remote_seq, CAST(CASE WHEN n = 1 THEN 0 WHEN k < n AND k % 2 = 0 THEN k END AS INT) AS player_seq FROM customer CROSS JOIN (SELECT UNNEST(range(0, 3)) AS k) LEFT JOIN n ON n.card_id = c_custkey""")
def rows_paired(spark, sf_dir):
    """Local rows bear names of their own by place; every second remote row bears the name of its place, others one unlike all."""
    names = F.array(*map(F.lit, ("ADAM", "BORIS", "CLEMENTINE", "DWIGHT", "EUPHEMIA", "FYODOR", "GUNHILD", "HUXLEY")))
    at = F.row_number().over(Window.partitionBy("card_id").orderBy("o_orderkey")) - 1
    local = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("card_id"), "o_orderkey").withColumn("player_seq", at).select("card_id", "player_seq", F.coalesce(F.get(names, F.col("player_seq")), F.concat(F.lit("QQ"), F.col("player_seq").cast("string"), F.lit("ZZ"))).alias("name"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("remote_seq"))
    other = other.withColumn("name", F.when(F.col("remote_seq") % 2 == 0, F.get(names, F.col("remote_seq"))).otherwise("xxxxxxxxxxxx"))
    return remote.pair(other, local)


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 4 AS m FROM customer)
 SELECT k AS card_id, CASE m WHEN 0 THEN 'forced' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'noMatch' ELSE 'confident' END AS resolution, CASE m WHEN 0 THEN 'ga-uga' WHEN 3 THEN 'ga-sugar-creek' END AS template_id, CASE m WHEN 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score, CASE WHEN m < 2 THEN 'Blue' END AS forced_tee FROM r""")
def templates_forced(spark, sf_dir):
    """A known template is forced; an unknown one leaves the match as it was, and the tee is forced either way."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    m = k % 4
    found = c.select(k.alias("card_id"), F.when(m == 3, "confident").when(m == 2, "noMatch").otherwise("ambiguous").alias("resolution"), F.when(m == 3, "ga-sugar-creek").alias("template_id"), F.lit(0.5).alias("score"), F.lit("White").alias("best_tee"), F.array(F.lit("ga-uga")).alias("alternates"))
    forced = c.where(m < 2).select(k.alias("card_id"), F.when(m == 0, "ga-uga").otherwise("nowhere").alias("forced_template_id"), F.lit("Blue").alias("forced_tee_name"))
    return match.force(found, forced, catalog.seed(spark)).select("card_id", "resolution", "template_id", "score", "forced_tee")


def _scorecards(spark: SparkSession, sf_dir: str) -> pipeline.Scorecards:
    """Line items as the rows of up to three players, by supplier."""
    c = cells(spark, sf_dir)
    field = fields.make_field(F.col("value"), 0.9, "ocr")
    scores = c.select("card_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("player_seq"), "hole", "value").select("card_id", "player_seq", "hole", F.when(F.col("player_seq") == 0, field).otherwise(fields.make_field(F.col("value") + 1, 0.8, "ocr")).alias("field"))
    players = c.select("card_id").distinct().select("card_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("player_seq"))
    holes = c.select("card_id", "hole", fields.empty_field().alias("score"))
    n = c.groupBy("card_id").agg(F.count("value").alias("scored"), F.max("hole").alias("hole_count"))
    return pipeline.Scorecards(n.withColumn("selected", F.lit(None).cast("int")), holes, players, scores, holes.limit(0))


@query(CELLS + """ SELECT card_id, hole, CASE WHEN card_id % 3 = 0 THEN value + 1 WHEN card_id % 3 = 1 THEN value END AS value, CAST(CASE WHEN card_id % 3 = 0 THEN 1 WHEN card_id % 3 = 1 THEN 0 END AS INT) AS selected FROM cells""")
def player_selected(spark, sf_dir):
    s = _scorecards(spark, sf_dir)
    chosen = s.cards.where("card_id % 3 < 2").select("card_id", F.when(F.col("card_id") % 3 == 0, 1).otherwise(0).alias("player_seq"))
    got = pipeline.select_player(s, chosen)
    return got.holes.join(got.cards.select("card_id", "selected"), "card_id").select("card_id", "hole", "score.value", "selected")


@query(CELLS + """, p AS (SELECT card_id, MAX(hole) AS n FROM cells GROUP BY 1) SELECT c.card_id, hole, CAST(CASE WHEN hole = n AND c.card_id % 2 = 0 THEN 7 ELSE value END AS INT) AS value, hole = n AND c.card_id % 2 = 0 AS edited FROM cells c JOIN p ON p.card_id = c.card_id""")
def edits_applied(spark, sf_dir):
    s = _scorecards(spark, sf_dir)
    s = pipeline.select_player(s, s.cards.select("card_id", F.lit(0).alias("player_seq")))
    edits = s.cards.where("card_id % 2 = 0").select("card_id", F.col("hole_count").alias("hole"), F.lit(7).alias("value"))
    return pipeline.apply_edits(s, edits).holes.select("card_id", "hole", "score.value", (F.col("score.provenance") == "userEdited").alias("edited"))


@query(CELLS + """ SELECT card_id, CAST(CASE WHEN card_id % 4 = 0 THEN NULL WHEN card_id % 4 = 3 THEN NULL ELSE card_id % 2 END AS INT) AS selected, COUNT(CASE WHEN value IS NULL THEN 1 END) > 0 AND card_id % 5 <> 0 AS adopt FROM cells GROUP BY card_id""")
def reparse_adopted(spark, sf_dir):
    """A new parse finds the chosen row again by its place, and is taken where it has more scores and as many holes."""
    s = _scorecards(spark, sf_dir)
    k = F.col("card_id")
    old = pipeline.replace(s, cards=s.cards.withColumn("selected", F.when(k % 4 != 0, F.when(k % 4 == 3, 2).otherwise((k % 2).cast("int")))))
    fresh = s.cards.join(cells(spark, sf_dir).groupBy("card_id").agg(F.count("raw").alias("all")), "card_id").withColumn("scored", F.col("all")).withColumn("hole_count", F.col("hole_count") + F.when(k % 5 == 0, 1).otherwise(0)).drop("all")
    new = pipeline.replace(s, cards=fresh)
    return pipeline.reidentify(old, new).cards.select("card_id", "selected").join(pipeline.better_reparse(old, new), "card_id")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_EDIT = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / GREATEST(len({a}), len({b})) END"
_ONE_WAY = "list_reduce(list_prepend(0.0::DOUBLE, list_transform({p}, lambda t: list_max(list_transform({q}, lambda u: " + _EDIT.format(a="t", b="u") + ")))), lambda a, b: a + b) / len({p})"


@query(f"""WITH names AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN ' Golf Club' ELSE '' END AS name FROM part), seen AS (SELECT DISTINCT translate(p_name, 'ei', 'cl') || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_type WHEN 2 THEN ' ' || replace(p_type, 'O', '0') || ' Club' ELSE ' ' || substr(p_brand, 7) END AS seen FROM part),
 f AS (SELECT seen, {_NAME.format(c='seen')} AS x FROM seen), g AS (SELECT name, {_NAME.format(c='name')} AS y FROM names),
 tx AS (SELECT *, string_split(x, ' ') AS e, list_filter(string_split(x, ' '), lambda t: len(t) > 1 AND t NOT IN ({_STOP})) AS k FROM f), ty AS (SELECT *, string_split(y, ' ') AS e, list_filter(string_split(y, ' '), lambda t: len(t) > 1 AND t NOT IN ({_STOP})) AS k FROM g),
 p AS (SELECT seen, name, x, y, CASE WHEN len(tx.k) > 0 THEN tx.k ELSE tx.e END AS xs, CASE WHEN len(ty.k) > 0 THEN ty.k ELSE ty.e END AS ys FROM tx CROSS JOIN ty),
 s AS (SELECT seen, name, {_EDIT.format(a='x', b='y')} AS c, ({_ONE_WAY.format(p='xs', q='ys')} + {_ONE_WAY.format(p='ys', q='xs')}) / 2 AS t FROM p)
 SELECT seen, name, ROUND(GREATEST(c, t) * 0.7::DOUBLE + LEAST(c, t) * 0.3::DOUBLE, 9) AS similarity FROM s WHERE GREATEST(c, t) * 0.7::DOUBLE + LEAST(c, t) * 0.3::DOUBLE >= 0.62::DOUBLE""")
def names_met(spark, sf_dir):
    """Damaged names against all names, by the index, at the floor of the matching."""
    p, k = table(spark, sf_dir, "part"), F.col("p_size")
    names = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(k % 3 == 0, " Golf Club").otherwise("")).alias("name"))
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" "), "p_type")).when(k % 4 == 2, F.concat(F.lit(" "), F.translate("p_type", "O", "0"), F.lit(" Club"))).otherwise(F.concat(F.lit(" "), F.substring("p_brand", 7, 9)))
    seen = p.select(F.concat(F.translate("p_name", "ei", "cl"), tail).alias("seen"))
    return similar.by_name(seen, "seen", names, "name", Matching().name_floor, few=0).select("seen", "name", F.round("similarity", 9).alias("similarity"))


@query("""WITH k AS (SELECT DISTINCT ROUND(l_extendedprice, 2) AS low FROM lineitem), b AS (SELECT low, LEAST(COALESCE(LEAD(low) OVER (ORDER BY low), low + 10), low + 25) AS high FROM k)
 SELECT o.o_orderkey, b.low AS band FROM orders o LEFT JOIN b ON o.o_totalprice / 3 >= b.low AND o.o_totalprice / 3 < b.high""")
def many_bands(spark, sf_dir):
    """Orders in price bands, as many as there are prices: bisected in chunks."""
    k = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", 2).alias("low")).distinct()
    nxt = ranked(k, "low")
    after = nxt.select((F.col("rank") - 1).alias("rank"), F.col("low").alias("_next"))
    b = nxt.join(after, "rank", "left").select("low", F.least(F.coalesce("_next", F.col("low") + 10), F.col("low") + 25).alias("high"), F.col("low").alias("band"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 3).alias("price"))
    return bands.located(o, b, "price", ["band"]).select("o_orderkey", "band")


@query("""WITH RECURSIVE b AS (SELECT vec_id, label, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 0.05 AS w, abs(CAST(embedding[4] AS DOUBLE)) + 0.05 AS h,
  abs(CAST(embedding[1] AS DOUBLE)) + CAST(embedding[5] AS DOUBLE) / 20 AS nx, abs(CAST(embedding[2] AS DOUBLE)) + CAST(embedding[6] AS DOUBLE) / 20 AS ny, abs(CAST(embedding[7] AS DOUBLE)) + 0.05 AS nw, abs(CAST(embedding[4] AS DOUBLE)) + 0.06 AS nh FROM embeddings),
 o AS (SELECT l.label, l.vec_id AS l, r.vec_id AS r, GREATEST(0.0::DOUBLE, LEAST(l.x + l.w, r.nx + r.nw) - GREATEST(l.x, r.nx)) AS ow, GREATEST(0.0::DOUBLE, LEAST(l.y + l.h, r.ny + r.nh) - GREATEST(l.y, r.ny)) AS oh, l.w * l.h AS la, r.nw * r.nh AS ra FROM b l JOIN b r ON l.label = r.label),
 p AS (SELECT label, l, r, ROW_NUMBER() OVER (PARTITION BY label ORDER BY l, ow * oh / (la + ra - ow * oh) DESC, r) AS k FROM o WHERE ow * oh / (la + ra - ow * oh) > 0.35),
 t AS (SELECT label, k, [l] AS ls, [r] AS rs FROM p WHERE k = 1 UNION ALL
  SELECT t.label, p.k, CASE WHEN list_contains(t.ls, p.l) OR list_contains(t.rs, p.r) THEN t.ls ELSE list_append(t.ls, p.l) END, CASE WHEN list_contains(t.ls, p.l) OR list_contains(t.rs, p.r) THEN t.rs ELSE list_append(t.rs, p.r) END FROM t JOIN p ON p.label = t.label AND p.k = t.k + 1),
 e AS (SELECT label, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM t GROUP BY label)
 SELECT label, UNNEST(ls) AS l, UNNEST(rs) AS r FROM e""")
def recognitions_matched(spark, sf_dir):
    """Two recognitions of a page: boxes of the same label, the second ones moved and resized, matched one to one."""
    part = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    moved = lambda i: F.get("embedding", F.lit(i)).cast("double") / 20
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("card_id"), F.col("vec_id").alias("obs_seq"), "embedding")
    one = e.select("card_id", "obs_seq", part(0).alias("x"), part(1).alias("y"), (part(2) + 0.05).alias("w"), (part(3) + 0.05).alias("h"))
    two = e.select("card_id", "obs_seq", (part(0) + moved(4)).alias("x"), (part(1) + moved(5)).alias("y"), (part(6) + 0.05).alias("w"), (part(3) + 0.06).alias("h"))
    return overlaps.matched_boxes(one, two, 0.35).select(F.col("card_id").alias("label"), "l", "r")
