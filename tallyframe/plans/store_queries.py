"""Registered queries of streams, stored files and second readings: each writes what it needs from the plain tables into the shared folder, and calls the operator itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import lineage
from tallyframe.functions import fields
from tallyframe.operators import history, remote, report
from tallyframe.plans.operator_queries import _PAYLOADS, _payloads
from tallyframe.plans.table_queries import query, table
from tallyframe.sources import files, store
from tallyframe.streaming import updates

_LIVE = """WITH e AS (SELECT l_orderkey AS k, l_linenumber AS h, CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) END AS v, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, 3 + l_suppkey % 3 DESC, CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) END DESC NULLS LAST) AS n, 3 + l_suppkey % 3 AS p FROM lineitem),
 t AS (SELECT k, CASE WHEN COUNT(CASE WHEN h <= 2 + k % 2 THEN v END) = 2 + k % 2 THEN SUM(CASE WHEN h <= 2 + k % 2 THEN v END) END AS total, CASE WHEN COUNT(CASE WHEN h <= 2 + k % 2 THEN p END) = 2 + k % 2 THEN SUM(CASE WHEN h <= 2 + k % 2 THEN p END) END AS par FROM e WHERE n = 1 GROUP BY k)"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edits of rounds of two or three holes, the last shipped counting; those returned clear the hole, and lines beyond the last hole say nothing."""
    at = f"{sf_dir}/lineitem.parquet"
    # a stream takes folders and patterns; the table may be one file
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 8).parquet(f"{at}*")
    strokes = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int"))
    edits = stream.select(F.col("l_orderkey").alias("round_id"), (F.col("l_orderkey") % 2 + 2).cast("int").alias("hole_count"), F.col("l_linenumber").alias("hole_number"), strokes.alias("strokes"), (F.col("l_suppkey") % 3 + 3).cast("int").alias("par"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("edit_id"))
    to = lineage.fresh(spark, "live")
    updates.keep_live(edits, f"{to}/table", f"{to}/progress").awaitTermination()
    return updates.live(spark, f"{to}/table")


@query(_LIVE + " SELECT k AS round_id, CAST(total AS BIGINT) AS total, CAST(par AS BIGINT) AS course_par, CAST(total - par AS BIGINT) AS relative_to_par FROM t")
def live_round_totals(spark, sf_dir):
    return _live(spark, sf_dir).select("round_id", *[F.col(c).cast("long").alias(c) for c in ("total", "course_par", "relative_to_par")])


@query(_LIVE + """, r AS (SELECT o_custkey AS course_id, total, o_orderdate, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY total, o_orderdate, o_orderkey) AS n FROM orders JOIN t ON k = o_orderkey WHERE total IS NOT NULL)
 SELECT course_id, CAST(total AS BIGINT) AS total, o_orderkey AS round_id FROM r WHERE n = 1""")
def live_best_rounds(spark, sf_dir):
    rounds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_id"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("date_played"))
    return history.best_rounds(rounds.join(_live(spark, sf_dir), "round_id")).select("course_id", F.col("total").cast("long").alias("total"), "round_id")


def _pages_stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Pages as scans: the page is the original, its address the small version, which every third lacks."""
    at, k = lineage.fresh(spark, "images"), F.col("page_id")
    scans = table(spark, sf_dir, "pages").select(k.cast("string").alias("id"), F.encode("html", "utf-8").alias("original"), F.when(k % 3 != 0, F.encode("url", "utf-8")).alias("normalized"))
    return at, store.store_images(scans, at)


_IMAGES = "WITH f AS (SELECT page_id, page_id || '-original.jpg' AS filename, CAST(strlen(html) AS BIGINT) AS bytes FROM pages WHERE html IS NOT NULL UNION ALL SELECT page_id, page_id || '-normalized.jpg', CAST(strlen(url) AS BIGINT) FROM pages WHERE page_id % 3 <> 0 AND url IS NOT NULL AND html IS NOT NULL)"


@query(_IMAGES + " SELECT filename, bytes FROM f")
def images_stored(spark, sf_dir):
    at, _ = _pages_stored(spark, sf_dir)
    return store.images(spark, at).select("filename", "bytes")


@query(_IMAGES + " SELECT filename, bytes FROM f WHERE page_id % 5 <> 0")
def images_swept(spark, sf_dir):
    """Two hours later, with every fifth page's round gone."""
    at, names = _pages_stored(spark, sf_dir)
    kept = names.where(F.col("id").cast("long") % 5 != 0)
    store.sweep_images(spark, at, kept, F.current_timestamp() + F.expr("INTERVAL 2 HOURS"))
    return store.images(spark, at).select("filename", "bytes")


@query(_PAYLOADS + """, f AS (SELECT card_id, sum, n, CASE card_id % 5 WHEN 0 THEN 'not a reading' WHEN 1 THEN 'not UTF-8' END AS reason FROM s)
 SELECT card_id, reason, CASE WHEN reason IS NULL AND sum BETWEEN 9 AND 135 THEN sum END AS out, CASE WHEN reason IS NULL AND sum BETWEEN n AND n * 15 THEN sum END AS total FROM f""")
def readings_from_files(spark, sf_dir):
    """A file for each order, packed, as each alone would take a block of the disk; of five, one is cut off and one has bytes that are no text."""
    at = lineage.fresh(spark, "readings")
    p = _payloads(spark, sf_dir)
    whole, k = F.encode("payload", "utf-8"), F.col("card_id") % 5
    content = F.when(k == 0, F.encode(F.expr("left(payload, 20)"), "utf-8")).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), whole)).otherwise(whole)
    files.store(p.select(F.concat(F.col("card_id").cast("string"), F.lit(".json")).alias("filename"), content.alias("content")), at, packed=True)
    good, bad = remote.second_readings(files.stored(spark, at, contents=True))
    good = good.withColumn("card_id", F.col("card_id").cast("long"))
    players, _ = remote.sanitise(good.join(p.select("card_id", "hole_count"), "card_id"))
    text = F.lit(None).cast("string").alias("reason")
    none = F.lit(None).cast("int")
    return players.select("card_id", text, "out", "total").unionByName(bad.select(F.regexp_extract("filename", r"^\d+", 0).cast("long").alias("card_id"), "reason", none.alias("out"), none.alias("total")))


_CUSTOMERS = """WITH o AS (SELECT o_custkey AS card_id, CAST(o_orderkey % 3 AS INT) AS k, o_orderkey, CAST(FLOOR(o_totalprice) % 40 AS INT) AS v FROM orders),
 a AS (SELECT card_id, k, ROW_NUMBER() OVER (PARTITION BY card_id, k ORDER BY o_orderkey) AS hole, v FROM o), h AS (SELECT card_id, k, CAST(hole AS INT) AS hole, CASE WHEN v BETWEEN 1 AND 15 THEN v END AS v FROM a WHERE hole <= 9)"""


def _remote_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as cards of nine holes, their orders by key modulo 3 as up to three remote rows; and what an audit of them gives."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("card_id"), (F.col("o_orderkey") % 3).cast("int").alias("remote_seq"), "o_orderkey", (F.floor("o_totalprice") % 40).cast("int").alias("v"))
    at = F.row_number().over(Window.partitionBy("card_id", "remote_seq").orderBy("o_orderkey"))
    scores = o.withColumn("hole", at).where("hole <= 9").select("card_id", "remote_seq", "hole", F.when(F.col("v").between(1, 15), F.col("v")).alias("value"), (F.col("v") / 20).alias("confidence"))
    k = F.col("card_id")
    sub = lambda c: F.when(c, (k % 30 + 20).cast("int"))
    players = scores.select("card_id", "remote_seq").distinct().select("card_id", "remote_seq", F.when(F.col("remote_seq") != 1, F.concat(F.lit("row "), F.col("remote_seq").cast("string"))).alias("name"), sub(k % 2 == 0).alias("out"), sub(F.lit(False)).alias("back"), sub(k % 3 == 0).alias("total"))
    audits = players.select("card_id", "remote_seq", F.when(k % 2 == 0, 0.45).otherwise(0.8).alias("ceiling"))
    return players, scores, audits


_ADOPTED = _CUSTOMERS + ", u AS (SELECT card_id, k, CAST(ROW_NUMBER() OVER (PARTITION BY card_id ORDER BY k) - 1 AS INT) AS player_seq, CASE WHEN card_id % 2 = 0 THEN 0.45 ELSE 0.8 END AS ceiling FROM h GROUP BY card_id, k HAVING COUNT(v) > 0)"


@query(_ADOPTED + """ SELECT card_id, player_seq, CASE WHEN k <> 1 THEN 'row ' || k END AS name, CAST(ceiling AS DOUBLE) AS row_confidence, CASE WHEN card_id % 2 = 0 THEN CAST(card_id % 30 + 20 AS INT) END AS out, CASE WHEN card_id % 3 = 0 THEN CAST(card_id % 30 + 20 AS INT) END AS total FROM u""")
def rows_adopted(spark, sf_dir):
    players, scores, audits = _remote_rows(spark, sf_dir)
    who, _ = remote.adopt(players, scores, audits)
    return who.select("card_id", "player_seq", "name", "row_confidence", F.col("written_out.value").alias("out"), F.col("written_total.value").alias("total"))


@query(_CUSTOMERS + ", f AS (SELECT DISTINCT card_id, MIN(k) OVER (PARTITION BY card_id) AS first, MAX(CASE WHEN k = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY card_id) AS two, MAX(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY card_id) AS zero FROM h) SELECT card_id, CASE WHEN card_id % 4 = 0 AND two = 1 THEN 2 WHEN card_id % 4 = 1 AND zero = 1 THEN 0 ELSE first END AS remote_seq FROM f")
def row_selected(spark, sf_dir):
    """The chosen local row bears the third row's name, the first's, one like none, or none."""
    players, _, _ = _remote_rows(spark, sf_dir)
    k = F.col("card_id")
    local = players.select("card_id").distinct().select("card_id", F.when(k % 4 == 0, "ROW 2").when(k % 4 == 1, "Row 0").when(k % 4 == 2, "Zebediah Quux").alias("name"))
    one = players.withColumn("name", F.when(F.col("remote_seq") == 1, "xxxxxxxxxx").otherwise(F.concat(F.lit("row "), F.element_at(F.array(F.lit("zero"), F.lit("-"), F.lit("twenty two")), F.col("remote_seq") + 1))))
    named = local.withColumn("name", F.when(F.col("name") == "ROW 2", "row twenty two").when(F.col("name") == "Row 0", "row zero").otherwise(F.col("name")))
    return remote.selected(one, named)


@query(_CUSTOMERS + """ SELECT DISTINCT card_id, CAST(CASE WHEN card_id % 5 = 0 THEN 33 WHEN card_id % 2 = 0 THEN card_id % 30 + 20 END AS INT) AS out, CASE WHEN card_id % 5 = 0 THEN 0.3 WHEN card_id % 2 = 0 THEN 0.45 ELSE 0.0 END::DOUBLE AS out_confidence, CAST(CASE WHEN card_id % 3 = 0 THEN card_id % 30 + 20 END AS INT) AS total FROM h WHERE k = 0""")
def subtotals_filled(spark, sf_dir):
    """Every fifth local row has its first total written already."""
    players, _, audits = _remote_rows(spark, sf_dir)
    k = F.col("card_id")
    pairs = audits.where("remote_seq = 0").withColumn("player_seq", F.lit(0))
    out = F.when(k % 5 == 0, fields.make_field(F.lit(33), 0.3, "ocr")).otherwise(fields.empty_field())
    local = pairs.select("card_id", "player_seq", out.alias("written_out"), fields.empty_field().alias("written_back"), fields.empty_field().alias("written_total"))
    return remote.fill_subtotals(local, players, pairs).select("card_id", F.col("written_out.value").alias("out"), F.col("written_out.confidence").alias("out_confidence"), F.col("written_total.value").alias("total"))


@query(_CUSTOMERS + """, t AS (SELECT card_id, k, CASE WHEN COUNT(v) = 9 THEN SUM(v) END AS s, CASE WHEN card_id % 2 = 0 THEN card_id % 30 + 20 END AS o, CASE WHEN card_id % 3 = 0 THEN card_id % 30 + 20 END AS w FROM h GROUP BY card_id, k),
 n AS (SELECT *, CASE WHEN k = 1 THEN 'Player 2' ELSE 'row ' || k END AS name FROM t)
 SELECT card_id, k AS remote_seq, CASE WHEN s <> o OR s <> w THEN 'remoteParseContradicted' WHEN s IS NOT NULL AND (o IS NOT NULL OR w IS NOT NULL) THEN 'remoteParseCorroborated' ELSE 'remoteParseUnverified' END AS kind,
 name || CASE WHEN s <> o THEN ': the front nine adds up to ' || CAST(s AS BIGINT) || ', written is ' || o WHEN s <> w THEN ': the 18-hole total adds up to ' || CAST(s AS BIGINT) || ', written is ' || w
  WHEN s IS NULL THEN ': holes are missing, so nothing could be checked' WHEN o IS NOT NULL AND w IS NOT NULL THEN ': agrees with the written 18-hole total and front nine' WHEN o IS NOT NULL THEN ': agrees with the written front nine' WHEN w IS NOT NULL THEN ': agrees with the written 18-hole total' ELSE ': no written totals to check against' END AS text FROM n""")
def audits_told(spark, sf_dir):
    players, scores, _ = _remote_rows(spark, sf_dir)
    cards = players.select("card_id").distinct().withColumn("hole_count", F.lit(9))
    made = "struct<value:int,confidence:double,provenance:string,raw_text:string>"
    none = spark.createDataFrame([], f"card_id long, player_seq int, name string, written_out {made}, written_back {made}, written_total {made}")
    audits = remote.audit(players, scores, none, cards)
    told = report.audit_warnings(audits).select("card_id", F.posexplode("audit_warnings").alias("place", "w"))
    # rows in order again have their number
    from pyspark.sql import Window

    numbered = audits.select("card_id", "remote_seq", (F.row_number().over(Window.partitionBy("card_id").orderBy("remote_seq")) - 1).alias("place"))
    return told.join(numbered, ["card_id", "place"]).select("card_id", "remote_seq", "w.kind", "w.text")
