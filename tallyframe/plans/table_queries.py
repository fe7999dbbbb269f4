"""Each registered query applies the general form of one operator to the plain tables, and says the same in SQL.

Unread cells, damaged digits and perturbed totals are made from the keys, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields, numeric, text
from tallyframe.lineage import dealt
from tallyframe.model import Matching
from tallyframe.operators import bands, checksum, folds, history, medians, remote, rows, sequences, similar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items, cards that meet all templates, and cards with all their observations, that a task takes.
LINES, CARDS, WHOLE_CARDS = 500_000, 20_000, 2_000


def cells(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Line items as score cells: one per order and line; every fifth is unread. Dealt by order, or by keys among order and line, to tasks of a bounded number of rows."""
    raw = F.min("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    one = dealt(lines, LINES, *(keys or ("l_orderkey",))).groupBy(F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("hole")).agg(raw.alias("raw"))
    return one.withColumn("value", F.when((F.col("card_id") * 7 + F.col("hole")) % 5 != 0, F.col("raw")))


CELLS = """WITH cells AS (SELECT card_id, hole, raw, CASE WHEN (card_id * 7 + hole) % 5 <> 0 THEN raw END AS value FROM
 (SELECT l_orderkey AS card_id, l_linenumber AS hole, CAST(MIN(l_quantity) AS INT) AS raw FROM lineitem GROUP BY 1, 2))"""


@query(CELLS + """ SELECT card_id, CASE WHEN COUNT(CASE WHEN hole <= 3 THEN value END) = 3 THEN SUM(CASE WHEN hole <= 3 THEN value END) END::BIGINT AS front,
 CASE WHEN COUNT(CASE WHEN hole BETWEEN 4 AND 7 THEN value END) = 4 THEN SUM(CASE WHEN hole BETWEEN 4 AND 7 THEN value END) END::BIGINT AS back,
 CASE WHEN COUNT(CASE WHEN hole <= 7 THEN value END) = 7 THEN SUM(CASE WHEN hole <= 7 THEN value END) END::BIGINT AS total FROM cells GROUP BY card_id""")
def strict_order_totals(spark, sf_dir):
    return checksum.totals(cells(spark, sf_dir), 7, 3).select("card_id", "front", "back", "total")


@query(CELLS + """, p AS (SELECT *, CASE WHEN raw % 11 <> 0 THEN CAST(3 + card_id % 4 AS INT) END AS par FROM cells)
 SELECT card_id, CAST(COALESCE(SUM(value), 0) AS BIGINT) AS partial, COUNT(value) AS played,
 CAST(CASE WHEN COUNT(value) = 7 AND COUNT(par) = 7 THEN SUM(value) - SUM(par) END AS BIGINT) AS relative,
 CAST(CASE WHEN COUNT(value) > 0 AND COUNT(CASE WHEN value IS NOT NULL THEN par END) = COUNT(value) THEN SUM(CASE WHEN value IS NOT NULL THEN value - par END) END AS BIGINT) AS relative_played FROM p GROUP BY card_id""")
def partial_totals(spark, sf_dir):
    par = F.when(F.col("raw") % 11 != 0, (F.col("card_id") % 4 + 3).cast("int"))
    return checksum.totals(cells(spark, sf_dir).withColumn("par", par), 7, 3).select("card_id", "partial", "played", "relative", "relative_played")


@query(CELLS + """ SELECT o.o_orderkey AS card_id, CAST(h.hole AS INT) AS hole, c.value, c.card_id IS NOT NULL AS present FROM orders o CROSS JOIN (SELECT UNNEST(range(1, 8)) AS hole) h LEFT JOIN cells c ON c.card_id = o.o_orderkey AND c.hole = h.hole""")
def densify_holes(spark, sf_dir):
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), F.lit(7).alias("hole_count"))
    return sequences.densify(cards, cells(spark, sf_dir).select("card_id", "hole", "value", F.lit(True).alias("present"))).select("card_id", "hole", "value", F.coalesce("present", F.lit(False)).alias("present"))


def _solver_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, sf_dir).where("hole <= 7")
    scores = c.select("card_id", "hole", "value", F.when(F.col("raw") % 9 == 0, 0.5).otherwise(0.6).alias("confidence"), F.lit("ocr").alias("provenance"))
    k = F.col("card_id")
    first, rest = F.sum(F.when(F.col("hole") <= 3, F.col("raw"))), F.sum(F.when(F.col("hole") > 3, F.col("raw")))
    written = c.groupBy("card_id").agg(F.when(k % 17 != 0, first + (k % 13 == 0).cast("int")).alias("out"), F.when(k % 19 != 0, rest).alias("back"), F.when(k % 3 != 0, F.sum("raw")).alias("total"))
    return scores, written


_SOLVER = CELLS + """, s AS (SELECT card_id, hole, value, CASE WHEN raw % 9 = 0 THEN 0.5 ELSE 0.6 END AS confidence, raw FROM cells WHERE hole <= 7),
 w0 AS (SELECT card_id, CASE WHEN card_id % 17 <> 0 THEN SUM(CASE WHEN hole <= 3 THEN raw END) + CASE WHEN card_id % 13 = 0 THEN 1 ELSE 0 END END AS o, CASE WHEN card_id % 19 <> 0 THEN SUM(CASE WHEN hole > 3 THEN raw END) END AS b, CASE WHEN card_id % 3 <> 0 THEN SUM(raw) END AS t FROM s GROUP BY card_id),
 w AS (SELECT card_id, CASE WHEN o IS NULL AND t - b BETWEEN 3 AND 150 THEN t - b ELSE o END AS o, CASE WHEN b IS NULL AND t - o BETWEEN 3 AND 150 THEN t - o ELSE b END AS b, t FROM w0)"""


@query(_SOLVER + """, h AS (SELECT card_id, CASE WHEN hole <= 3 THEN 'front' ELSE 'back' END AS half, COALESCE(SUM(CASE WHEN value IS NOT NULL AND confidence > 0.55 THEN value END), 0) AS computed,
 COUNT(CASE WHEN NOT (value IS NOT NULL AND confidence > 0.55) THEN 1 END) AS unknown, MIN(CASE WHEN NOT (value IS NOT NULL AND confidence > 0.55) THEN hole END) AS hole FROM s GROUP BY 1, 2),
 x AS (SELECT h.*, CASE WHEN half = 'front' THEN o ELSE b END AS expected FROM h LEFT JOIN w ON w.card_id = h.card_id)
 SELECT card_id, half, CASE WHEN expected IS NULL THEN 'noSubtotal' WHEN unknown > 1 THEN 'underdetermined' WHEN unknown = 0 AND expected = computed THEN 'verified' WHEN unknown = 0 THEN 'discrepancy' WHEN expected - computed BETWEEN 1 AND 50 THEN 'solved' ELSE 'implausible' END AS outcome,
 CASE WHEN unknown = 1 THEN hole END AS hole, CAST(CASE WHEN unknown = 1 THEN expected - computed END AS BIGINT) AS missing, CAST(computed AS BIGINT) AS computed, CAST(expected AS BIGINT) AS expected FROM x""")
def checksum_solve(spark, sf_dir):
    scores, written = _solver_inputs(spark, sf_dir)
    return checksum.solve_halves(scores, checksum.infer_subtotals(written, 7, 3, (3, 150)), 3, (1, 50)).drop("unread")


@query(_SOLVER + " SELECT card_id, CAST(o AS BIGINT) AS \"out\", CAST(b AS BIGINT) AS back, CAST(t AS BIGINT) AS total FROM w")
def infer_subtotals(spark, sf_dir):
    return checksum.infer_subtotals(_solver_inputs(spark, sf_dir)[1], 7, 3, (3, 150)).select("card_id", "out", "back", "total")


@query(CELLS + """, t AS (SELECT card_id, CASE WHEN COUNT(CASE WHEN hole <= 3 THEN value END) = 3 THEN SUM(CASE WHEN hole <= 3 THEN value END) END AS f, CASE WHEN COUNT(CASE WHEN hole > 3 THEN value END) = 4 THEN SUM(CASE WHEN hole > 3 THEN value END) END AS b,
  CASE WHEN COUNT(value) = 7 THEN SUM(value) END AS t, SUM(CASE WHEN hole <= 3 THEN raw END) AS rf, SUM(raw) AS rt FROM cells WHERE hole <= 7 GROUP BY card_id),
 c AS (SELECT card_id, t, CASE WHEN f IS NOT NULL AND rf IS NOT NULL THEN CASE WHEN f = rf + CASE WHEN card_id % 13 = 0 THEN 1 ELSE 0 END THEN 1 ELSE -1 END ELSE 0 END AS c1, CASE WHEN t IS NOT NULL AND card_id % 3 <> 0 THEN CASE WHEN t = rt THEN 1 ELSE -1 END ELSE 0 END AS c2,
  CASE WHEN f IS NOT NULL AND rf IS NOT NULL AND card_id % 2 = 0 THEN CASE WHEN f = rf + CASE WHEN card_id % 7 = 0 THEN 2 ELSE 0 END THEN 1 ELSE -1 END ELSE 0 END AS c3 FROM t),
 v AS (SELECT card_id, ABS(c1) + ABS(c2) + ABS(c3) AS checks, CASE WHEN c1 < 0 THEN 1 ELSE 0 END + CASE WHEN c2 < 0 THEN 1 ELSE 0 END + CASE WHEN c3 < 0 THEN 1 ELSE 0 END AS failures, t FROM c),
 u AS (SELECT *, CASE WHEN failures > 0 THEN 'contradicted' WHEN checks > 0 THEN 'corroborated' WHEN t IS NULL THEN 'rowIncomplete' ELSE 'noSubtotals' END AS verdict FROM v)
 SELECT card_id, verdict, CAST(checks AS INT) AS checks, CAST(failures AS INT) AS failures, CAST(CASE verdict WHEN 'contradicted' THEN 0.45 WHEN 'corroborated' THEN 0.95 ELSE 0.8 END AS DOUBLE) AS ceiling FROM u""")
def reconcile_verdict(spark, sf_dir):
    """Cards of seven holes, three of them the front, with one remote and one local row each."""
    c, k = cells(spark, sf_dir).where("hole <= 7"), F.col("card_id")
    raw = c.groupBy("card_id").agg(F.sum(F.when(F.col("hole") <= 3, F.col("raw"))).alias("rf"), F.sum("raw").alias("rt"))
    other = raw.select("card_id", F.lit(0).alias("remote_seq"), F.lit("A").alias("name"), (F.col("rf") + (k % 13 == 0).cast("int")).alias("out"), F.lit(None).cast("long").alias("back"), F.when(k % 3 != 0, F.col("rt")).alias("total"))
    out = fields.make_field(F.col("rf") + F.when(k % 7 == 0, 2).otherwise(0), F.when(k % 2 == 0, 0.6).otherwise(0.3), "ocr")
    local = raw.select("card_id", F.lit(0).alias("player_seq"), F.lit("A").alias("name"), out.alias("written_out"), fields.empty_field().alias("written_back"), fields.empty_field().alias("written_total"))
    audits = remote.audit(other, c.select("card_id", F.lit(0).alias("remote_seq"), "hole", "value"), local, raw.select("card_id", F.lit(7).alias("hole_count")), nine=3)
    return audits.select("card_id", "verdict", "checks", "failures", "ceiling")


_EVENT_CONF = "SELECT event_id, event_type, value, value / 100.0::DOUBLE - floor(value / 100.0::DOUBLE) AS c FROM events"


@query(f"""WITH e AS ({_EVENT_CONF}), f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 4 END AS v, c, CASE WHEN event_id % 7 = 0 THEN 'userEdited' ELSE 'ocr' END AS p FROM e)
 SELECT event_id, CASE WHEN v IS NULL OR c < 0.01 THEN 'none' WHEN c < 0.55 THEN 'low' WHEN c < 0.82 THEN 'medium' ELSE 'high' END AS level, CASE WHEN p = 'userEdited' THEN FALSE WHEN v IS NULL THEN TRUE ELSE c < 0.82 END AS review,
 p IN ('ocr', 'userEdited') AND v IS NOT NULL AS promotable FROM f""")
def confidence_buckets(spark, sf_dir):
    part = F.col("value") / 100.0
    c, v, p = part - F.floor(part), F.when(F.col("event_id") % 11 != 0, 4), F.when(F.col("event_id") % 7 == 0, "userEdited").otherwise("ocr")
    return table(spark, sf_dir, "events").select("event_id", fields.level(v, c).alias("level"), fields.requires_review(v, c, p).alias("review"), fields.promotable(v, p).alias("promotable"))


@query(CELLS + """, a AS (SELECT card_id, CAST(COUNT(value) AS DOUBLE) / COUNT(*) AS coverage, COUNT(value) AS n FROM cells GROUP BY card_id)
 SELECT card_id, coverage, CASE WHEN n = 0 THEN 'failed' WHEN coverage >= 0.8 THEN 'ready' WHEN coverage >= 0.5 THEN 'partial' ELSE 'poor' END AS quality FROM a""")
def coverage_quality(spark, sf_dir):
    a = cells(spark, sf_dir).groupBy("card_id").agg(fields.coverage(F.col("value")).alias("coverage"), F.count("value").alias("n"))
    return a.select("card_id", "coverage", F.when(F.col("n") == 0, "failed").when(F.col("coverage") >= 0.8, "ready").when(F.col("coverage") >= 0.5, "partial").otherwise("poor").alias("quality"))


_ORDERED = "l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


@query(f"""WITH s AS (SELECT l_orderkey AS card_id, l_linenumber AS hole, CASE WHEN (l_partkey + l_suppkey) % 3 <> 0 THEN CAST(l_quantity AS INT) END AS value, CAST(l_discount AS DOUBLE) AS confidence, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDERED}) AS seq FROM lineitem)
 SELECT card_id, hole, arg_min(value, seq) FILTER (WHERE value IS NOT NULL) AS value, MAX(confidence) AS confidence, COUNT(*) AS merged FROM s GROUP BY card_id, hole""")
def first_nonnull_merge(spark, sf_dir):
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[c.strip() for c in _ORDERED.split(",")])
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("hole"), F.when((F.col("l_partkey") + F.col("l_suppkey")) % 3 != 0, F.col("l_quantity").cast("int")).alias("value"), F.col("l_discount").cast("double").alias("confidence"), F.row_number().over(order).alias("seq"))
    return sequences.merge_first(s, ["card_id", "hole"])


@query("""WITH x AS (SELECT l_orderkey AS card_id, l_linenumber AS hole, CAST(MIN(l_quantity) AS INT) AS v, MIN(l_partkey) AS pk FROM lineitem GROUP BY 1, 2),
 y AS (SELECT x.*, CASE WHEN p.p_size % 4 <> 0 THEN p.p_size END AS t, CASE WHEN x.card_id % 9 = 0 THEN 'userEdited' ELSE 'ocr' END AS prov FROM x LEFT JOIN part p ON p.p_partkey = x.pk)
 SELECT card_id, hole, CASE WHEN t IS NOT NULL AND prov <> 'userEdited' THEN t ELSE v END AS value, CASE WHEN t IS NOT NULL AND prov <> 'userEdited' THEN 'verifiedCourseTemplate' ELSE prov END AS provenance, t IS NOT NULL AND prov <> 'userEdited' AND v IS DISTINCT FROM t AS changed FROM y""")
def overlay_repair(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("hole")).agg(F.min("l_quantity").cast("int").alias("value"), F.min("l_partkey").alias("p_partkey"))
    x = x.withColumn("provenance", F.when(F.col("card_id") % 9 == 0, "userEdited").otherwise("ocr")).withColumn("confidence", F.lit(0.5))
    t = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("template_value"))
    return sequences.overlay(x, t, ["p_partkey"]).select("card_id", "hole", "value", "provenance", "changed")


_AGREE = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} || {b} IN (" + ", ".join(f"'{p}'" for p in numeric._PAIRS) + ") THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def _digits_sql(o: str, e: str) -> str:
    agreed = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({e}) + 1), lambda i: {_AGREE.format(a=f'substr({o}, i, 1)', b=f'substr({e}, i, 1)')})), lambda a, b: a + b) / len({e})"
    return f"CASE WHEN len({o}) = len({e}) THEN {agreed} ELSE GREATEST(0.0::DOUBLE, 1 - CAST(levenshtein({o}, {e}) AS DOUBLE) / GREATEST(len({o}), len({e}))) * 0.5::DOUBLE END"


def _number_sql(o: str, e: str) -> str:
    return f"CASE WHEN {o} = {e} THEN 1.0::DOUBLE ELSE {_digits_sql(f'CAST({o} AS VARCHAR)', f'CAST({e} AS VARCHAR)')} END"


@query(CELLS + f""", p AS (SELECT card_id, hole, value, CAST(CASE WHEN card_id % 23 <> 0 OR hole < 3 THEN raw + CASE WHEN (card_id + hole) % 4 = 0 THEN 3 ELSE 0 END END AS INT) AS expected FROM cells),
 s AS (SELECT *, CASE WHEN value IS NOT NULL AND expected IS NOT NULL THEN {_number_sql('value', 'expected')} END AS sim FROM p)
 SELECT card_id, ROUND(SUM(sim) / COUNT(sim), 9) AS score, CAST(COUNT(sim) AS DOUBLE) / NULLIF(COUNT(expected), 0) AS coverage, COUNT(sim) AS compared FROM s GROUP BY card_id""")
def sequence_similarity(spark, sf_dir):
    known = (F.col("card_id") % 23 != 0) | (F.col("hole") < 3)
    p = cells(spark, sf_dir).select("card_id", "hole", "value", F.when(known, F.col("raw") + F.when((F.col("card_id") + F.col("hole")) % 4 == 0, 3).otherwise(0)).alias("expected"))
    out = sequences.compare(p, ["card_id"])
    return out.select("card_id", F.round("score", 9).alias("score"), "coverage", "compared")


@query(f"""WITH p AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS INT) % 600 + 60 AS o, CAST(floor(l_extendedprice) AS INT) % 600 + 60 + CAST(l_orderkey % 40 AS INT) AS e FROM lineitem),
 q AS (SELECT o, e, ABS(o - e) / CAST(e AS DOUBLE) AS r FROM p) SELECT o AS observed, e AS expected, GREATEST({_number_sql('o', 'e')}, CASE WHEN r < 0.04 THEN 0.9::DOUBLE WHEN r < 0.15 THEN (1 - (r - 0.04::DOUBLE) / 0.11::DOUBLE) * 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS similarity FROM q""")
def yardage_similarity(spark, sf_dir):
    o = F.floor("l_extendedprice").cast("int") % 600 + 60
    p = table(spark, sf_dir, "lineitem").select(o.alias("observed"), (o + (F.col("l_orderkey") % 40).cast("int")).alias("expected")).distinct()
    return p.select("observed", "expected", numeric.yardage_similarity(F.col("observed"), F.col("expected")).alias("similarity"))


@query(f"""WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS INT) % 9000 + 1000 AS o, CAST(floor(o_totalprice) AS INT) % 9000 + 1000 + CAST((o_orderkey % 50) * 10 AS INT) AS e FROM orders),
 q AS (SELECT *, ABS(o - e) / CAST(e AS DOUBLE) AS r FROM p) SELECT o_orderkey, CASE WHEN o = e THEN 1.0::DOUBLE ELSE GREATEST({_number_sql('o', 'e')}, CASE WHEN r < 0.03 THEN 0.8::DOUBLE ELSE GREATEST(0.0::DOUBLE, 1 - r * 8) END) END AS similarity FROM q""")
def total_similarity(spark, sf_dir):
    o = F.floor("o_totalprice").cast("int") % 9000 + 1000
    p = table(spark, sf_dir, "orders").select("o_orderkey", o.alias("o"), (o + ((F.col("o_orderkey") % 50) * 10).cast("int")).alias("e"))
    return p.select("o_orderkey", numeric.total_similarity(F.col("o"), F.col("e")).alias("similarity"))


@query("""WITH d AS (SELECT o_orderkey, translate(CAST(o_orderkey % 1000 AS VARCHAR), '810', 'BlO') AS t FROM orders),
 a AS (SELECT *, len(regexp_replace(t, '[0-9]', '', 'g')) AS subs, len(t) - len(replace(t, 'B', '')) AS bs, regexp_matches(t, '[0-9]') OR (len(t) = 1 AND t <> 'B') AS ok FROM d),
 c AS (SELECT *, [CAST(translate(replace(t, 'B', '8'), 'lO', '10') AS INT)] AS first FROM a),
 k AS (SELECT o_orderkey, t, CASE WHEN NOT ok THEN [] ELSE list_transform(range(0, CAST(power(2, bs) AS BIGINT)), lambda m: CAST(translate(
   CASE bs WHEN 0 THEN t WHEN 1 THEN replace(t, 'B', ['8', '3'][m + 1]) WHEN 2 THEN regexp_replace(regexp_replace(t, 'B', ['8', '3'][(m // 2) + 1]), 'B', ['8', '3'][m % 2 + 1]) ELSE regexp_replace(regexp_replace(regexp_replace(t, 'B', ['8', '3'][(m // 4) + 1]), 'B', ['8', '3'][(m // 2) % 2 + 1]), 'B', ['8', '3'][m % 2 + 1]) END, 'lO', '10') AS INT)) END AS c, subs FROM c),
 b AS (SELECT *, list_filter(c, lambda v: v BETWEEN 1 AND 400) AS fit FROM k)
 SELECT o_orderkey, t AS damaged, len(c) AS candidates, CASE WHEN len(fit) > 0 THEN fit[1] WHEN len(c) > 0 THEN c[1] END AS value, CASE WHEN len(fit) > 0 THEN LEAST(1.0::DOUBLE, subs * 0.25::DOUBLE + (list_position(c, fit[1]) - 1) * 0.1::DOUBLE) WHEN len(c) > 0 THEN 1.0::DOUBLE END AS penalty FROM b""")
def numeric_candidates(spark, sf_dir):
    t = F.translate((F.col("o_orderkey") % 1000).cast("string"), "810", "BlO")
    c = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("damaged"))
    best = numeric.best_integer(F.col("damaged"), 1, 400)
    return c.select("o_orderkey", "damaged", F.size(numeric.integer_candidates(F.col("damaged"))).cast("long").alias("candidates"), best["value"].alias("value"), best["penalty"].alias("penalty"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT p_partkey, translate(p_name, 'ei', 'cl') AS seen FROM part),
 c AS (SELECT s.seen, n.name, CASE WHEN s.seen = n.name THEN 1.0::DOUBLE ELSE 1 - CAST(levenshtein(lower(s.seen), lower(n.name)) AS DOUBLE) / GREATEST(len(s.seen), len(n.name)) END AS sim FROM (SELECT DISTINCT seen FROM b) s CROSS JOIN n),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY seen ORDER BY sim DESC, name) AS k FROM c) SELECT b.p_partkey, b.seen, r.name, r.sim AS similarity FROM b JOIN r ON r.seen = b.seen WHERE r.k = 1""")
def name_similarity_top1(spark, sf_dir):
    # distinct texts meet distinct names by an index of bigrams, once, whatever the rows that bear them
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("name")).distinct()
    seen = p.select("p_partkey", F.translate("p_name", "ei", "cl").alias("seen"))
    return seen.join(similar.closest(seen, "seen", names, "name", Matching().name_floor), "seen").select("p_partkey", "seen", "name", "similarity")


@query("""WITH e AS (SELECT c_nationkey AS tid, c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey AS tid, COUNT(*) AS all_n FROM customer GROUP BY 1),
 s AS (SELECT c.c_custkey, e.tid, ROUND(CAST(e.n AS DOUBLE) / t.all_n * 2.2::DOUBLE, 6) + CASE WHEN e.tid = c.c_nationkey THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score FROM customer c JOIN e ON e.seg = c.c_mktsegment JOIN t ON t.tid = e.tid),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY score DESC, tid) AS k FROM s WHERE score >= 0.34),
 b AS (SELECT c_custkey, MAX(CASE WHEN k = 1 THEN tid END) AS tid, MAX(CASE WHEN k = 1 THEN score END) AS s1, MAX(CASE WHEN k = 2 THEN score END) AS s2 FROM r GROUP BY 1)
 SELECT c.c_custkey AS card_id, CASE WHEN b.s1 IS NULL THEN 'noMatch' WHEN b.s1 >= 0.72 AND (b.s2 IS NULL OR b.s1 - b.s2 > 0.07) THEN 'confident' ELSE 'ambiguous' END AS resolution, b.tid AS template_id, b.s1 AS score FROM customer c LEFT JOIN b ON b.c_custkey = c.c_custkey""")
def template_match_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    dealt_cards = dealt(c.select("c_custkey", "c_nationkey", "c_mktsegment"), CARDS, "c_custkey")  # each becomes as many rows as there are templates, which are ranked where they are made
    every = c.groupBy(F.col("c_nationkey").alias("t")).agg(F.count("*").alias("all_n"))
    seg = c.groupBy(F.col("c_nationkey").alias("template_id"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n")).join(F.broadcast(every), F.col("template_id") == F.col("t"))
    # nations times segments: the product of two fixed dimensions
    scored = dealt_cards.join(F.broadcast(seg), F.col("c_mktsegment") == F.col("seg")).select(F.col("c_custkey").alias("card_id"), "template_id", (F.round(F.col("n") / F.col("all_n") * 2.2, 6) + F.when(F.col("template_id") == F.col("c_nationkey"), 0.3).otherwise(0.0)).alias("score"))
    best = sequences.resolve(scored)
    return dealt_cards.select(F.col("c_custkey").alias("card_id")).join(best, "card_id", "left").select("card_id", F.coalesce("resolution", F.lit("noMatch")).alias("resolution"), "template_id", "score")


@query("""WITH p AS (SELECT a.event_id, b.event_id AS next_id, b.value - a.value AS gap, ROW_NUMBER() OVER (PARTITION BY a.event_id ORDER BY b.value - a.value, b.event_id) AS k FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.value > a.value AND b.value - a.value <= 5)
 SELECT event_id, next_id, gap FROM p WHERE k = 1""")
def range_neighbour_top1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return sequences.next_within(e, ["user_id", "event_type"], "value", "event_id", 5.0)


@query("""WITH t AS (SELECT event_type, ROUND(AVG(value), 6) AS c, ROW_NUMBER() OVER (ORDER BY ROUND(AVG(value), 6), event_type) AS hole FROM events GROUP BY event_type),
 b AS (SELECT event_type, hole, c, COALESCE((LAG(c) OVER w + c) / 2, -1e308) AS lo, COALESCE((LEAD(c) OVER w + c) / 2, 1e308) AS hi FROM t WINDOW w AS (ORDER BY c, event_type))
 SELECT e.event_id, CAST(b.hole AS INT) AS hole FROM events e LEFT JOIN b ON e.value >= b.lo AND e.value < b.hi""")
def band_join_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    centres = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("centre"))  # one row per type
    return bands.located(e.select("event_id", "value"), sequences.bands(centres, "centre", "event_type"), "value", ["hole"]).select("event_id", "hole")


@query("""WITH g AS (SELECT user_id, value - LAG(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events) SELECT user_id, ROUND(COALESCE(MEDIAN(gap), 0.05), 9) AS pitch FROM g GROUP BY user_id""")
def median_pitch(spark, sf_dir):
    return sequences.pitch(table(spark, sf_dir, "events"), ["user_id"], "value", ["event_id"]).select("user_id", F.round("pitch", 9).alias("pitch"))


@query("SELECT l_orderkey AS card_id, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS centre FROM lineitem GROUP BY l_orderkey")
def upper_median(spark, sf_dir):
    return medians.upper_medians(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card_id"), "l_quantity"), ["card_id"], "l_quantity", "centre")


@query("""SELECT l_orderkey AS card_id, ROUND(CASE WHEN COUNT(CASE WHEN l_extendedprice > 0 THEN 1 END) <= 1 THEN 1.0::DOUBLE ELSE GREATEST(0.0::DOUBLE, 1 - LEAST(1.0::DOUBLE, stddev_pop(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END) / AVG(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END) * 2.5::DOUBLE)) END, 6) AS uniformity FROM lineitem GROUP BY 1""")
def height_uniformity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.round(fields.height_uniformity(F.col("l_extendedprice")), 6).alias("uniformity"))


_SIGNATURE = CELLS + """, v AS (SELECT card_id, CASE WHEN card_id % 5 = 0 THEN value * 12 WHEN card_id % 5 = 1 THEN value % 4 + 3 WHEN card_id % 5 = 2 THEN hole ELSE value % 18 + 1 END AS v FROM cells),
 a AS (SELECT card_id, COUNT(v) AS n, COUNT(CASE WHEN v BETWEEN 60 AND 750 THEN 1 END) AS y, COUNT(CASE WHEN v >= 100 THEN 1 END) AS big, COUNT(CASE WHEN v BETWEEN 3 AND 6 THEN 1 END) AS p, COUNT(CASE WHEN v NOT BETWEEN 3 AND 6 THEN 1 END) AS np, COUNT(CASE WHEN v BETWEEN 1 AND 18 THEN 1 END) AS h, COUNT(DISTINCT v) AS d, MIN(v) AS lo, MAX(v) AS hi, COUNT(CASE WHEN v BETWEEN 1 AND 15 THEN 1 END) AS s FROM v GROUP BY card_id),
 b AS (SELECT *, CAST(h AS DOUBLE) / NULLIF(n, 0) * (CAST(d AS DOUBLE) / NULLIF(n, 0)) * LEAST(1.0::DOUBLE, CAST(hi - lo AS DOUBLE) / GREATEST(1, n - 1)) AS i FROM a),
 g AS (SELECT card_id, n, ROUND(COALESCE(LEAST(1.0::DOUBLE, CAST(y AS DOUBLE) / NULLIF(n, 0) * CASE WHEN big = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END), 0), 9) AS yardage, ROUND(COALESCE(LEAST(1.0::DOUBLE, CAST(p AS DOUBLE) / NULLIF(n, 0) * CASE WHEN np > 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 0), 9) AS par,
  ROUND(COALESCE(CASE WHEN n >= 9 AND d = n AND lo >= 1 AND hi <= 18 THEN LEAST(1.0::DOUBLE, i + 0.25) ELSE LEAST(1.0::DOUBLE, i) END, 0), 9) AS handicap, ROUND(COALESCE(LEAST(1.0::DOUBLE, CAST(s AS DOUBLE) / NULLIF(n, 0) * CASE WHEN hi > 15 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END), 0), 9) AS score FROM b)"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, value = F.col("card_id") % 5, F.col("value")
    v = F.when(k == 0, value * 12).when(k == 1, value % 4 + 3).when(k == 2, F.col("hole")).otherwise(value % 18 + 1)
    made = rows.numeric_signature(F.col("v"))
    g = cells(spark, sf_dir).select("card_id", v.alias("v")).groupBy("card_id").agg(*[c.alias(n) for n, c in made.items()])
    return g.select("card_id", "n", *[F.round(c, 9).alias(c) for c in ("yardage", "par", "handicap", "score")])


@query(_SIGNATURE + " SELECT * FROM g")
def numeric_signature(spark, sf_dir):
    return _signatures(spark, sf_dir)


@query(_SIGNATURE + """, t AS (SELECT g.*, CASE card_id % 6 WHEN 0 THEN 'PAR' WHEN 1 THEN 'HCP' WHEN 2 THEN 'WHITE' WHEN 3 THEN 'OUT' WHEN 4 THEN 'SAM' ELSE '' END AS label, CASE WHEN card_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS conf, CASE WHEN card_id % 4 < 2 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS uni FROM g),
 r AS (SELECT *, CASE WHEN label = 'PAR' THEN 'par' WHEN label = 'HCP' THEN 'handicap' WHEN label = 'WHITE' AND (n = 0 OR yardage < 0.35) THEN 'metadata' WHEN label = 'WHITE' THEN 'yardage' WHEN label = 'OUT' THEN 'metadata' WHEN n = 0 THEN 'unknown' WHEN yardage >= 0.6 THEN 'yardage' WHEN handicap >= 0.85 AND n >= 9 THEN 'handicap'
  WHEN par >= 0.5 OR score >= 0.5 THEN CASE WHEN label = 'SAM' THEN 'player' WHEN CASE WHEN conf >= 0.72 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + uni * 0.5::DOUBLE >= 0.6 THEN 'par' ELSE 'player' END WHEN label <> 'SAM' THEN 'unknown' ELSE 'player' END AS role FROM t)
 SELECT card_id, role, CASE WHEN label = 'WHITE' AND role = 'yardage' THEN 'White' WHEN label = 'SAM' AND role = 'player' THEN 'SAM' END AS payload,
  ROUND(CASE WHEN label = 'PAR' THEN 0.7 + 0.28 * CASE WHEN n = 0 THEN GREATEST(par, 0.5) ELSE par END WHEN label = 'HCP' THEN 0.7 + 0.28 * CASE WHEN n = 0 THEN GREATEST(handicap, 0.5) ELSE handicap END WHEN label = 'WHITE' AND role = 'metadata' THEN 0.55 WHEN label = 'WHITE' THEN 0.7 + 0.28 * yardage WHEN label = 'OUT' THEN 0.4 WHEN n = 0 THEN 0 WHEN yardage >= 0.6 THEN 0.45 + 0.35 * yardage WHEN handicap >= 0.85 AND n >= 9 THEN 0.4 + 0.4 * handicap
   WHEN par >= 0.5 OR score >= 0.5 THEN CASE WHEN label = 'SAM' THEN 0.6 ELSE 0.32 END WHEN label <> 'SAM' THEN 0.1 ELSE 0.45 END::DOUBLE, 6) AS confidence FROM r""")
def classify_rows(spark, sf_dir):
    k = F.col("card_id")
    label = F.when(k % 6 == 0, "PAR").when(k % 6 == 1, "HCP").when(k % 6 == 2, "WHITE").when(k % 6 == 3, "OUT").when(k % 6 == 4, "SAM").otherwise("")
    tokens = F.when(label == "", F.array().cast("array<string>")).otherwise(F.array(label))
    g = _signatures(spark, sf_dir).withColumn("tokens", tokens).withColumn("label", rows.match_label(F.col("tokens")))
    role = rows.classify(F.col("label"), F.col("tokens"), F.col("n"), F.col("yardage"), F.col("par"), F.col("handicap"), F.col("score"), F.when(k % 2 == 0, 0.9).otherwise(0.6), F.when(k % 4 < 2, 0.9).otherwise(0.1))
    return g.withColumn("r", role).select("card_id", "r.role", "r.payload", F.round("r.confidence", 6).alias("confidence"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS card_id, l_linenumber AS v, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS k FROM lineitem),
 f AS (SELECT card_id, 0::BIGINT AS k, 1 AS expected, 0 AS hits, '' AS run FROM (SELECT DISTINCT card_id FROM o) UNION ALL
  SELECT f.card_id, o.k, CASE WHEN o.v = f.expected OR (o.v = f.expected + 1 AND f.hits > 0) THEN o.v + 1 ELSE f.expected END, CASE WHEN o.v = f.expected OR (o.v = f.expected + 1 AND f.hits > 0) THEN f.hits + 1 ELSE f.hits END,
   CASE WHEN o.v = f.expected OR (o.v = f.expected + 1 AND f.hits > 0) THEN f.run || o.v::VARCHAR ELSE f.run END FROM f JOIN o ON o.card_id = f.card_id AND o.k = f.k + 1)
 SELECT card_id, arg_max(hits, k)::INT AS hits, arg_max(run, k) AS run FROM f GROUP BY card_id""")
def header_run(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card_id"), "l_shipdate", "l_linenumber")  # noqa: E741
    g = folds.sorted_list(l, ["card_id"], at=F.col("l_shipdate"), v=F.col("l_linenumber"))
    hits = folds.ordered_run(F.col("items")["v"], 1)
    return g.withColumn("h", hits).select("card_id", F.size("h").alias("hits"), F.array_join(F.transform("h", lambda x: x["value"].cast("string")), "").alias("run"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value AS mid, value - 1.5::DOUBLE AS top, value + 1.5::DOUBLE AS bottom, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
 f AS (SELECT user_id, k, event_id, 0 AS row, mid AS s, 1 AS n, top, bottom FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, o.event_id, CASE WHEN j THEN row ELSE row + 1 END, CASE WHEN j THEN s + mid ELSE mid END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN LEAST(ftop, o.top) ELSE o.top END, CASE WHEN j THEN GREATEST(fbottom, o.bottom) ELSE o.bottom END
  FROM (SELECT o.*, f.row, f.s, f.n, f.top AS ftop, f.bottom AS fbottom, ABS(o.mid - f.s / f.n) <= 1.86::DOUBLE OR (LEAST(f.bottom, o.bottom) - GREATEST(f.top, o.top) > 0 AND (LEAST(f.bottom, o.bottom) - GREATEST(f.top, o.top)) / LEAST(f.bottom - f.top, o.bottom - o.top) >= 0.4::DOUBLE) AS j FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) o)
 SELECT event_id, CAST(row AS INT) AS row FROM f""")
def row_clusters(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return bands.clustered(e, ["user_id"], v, v - 1.5, v + 1.5, F.lit(1.86), ["event_id"]).select("event_id", "row")


@query("""WITH r AS (SELECT o_custkey AS course, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS total, o_orderkey FROM orders)
 SELECT COUNT(*) AS rounds, COUNT(DISTINCT course) AS courses, ROUND(SUM(total) / CAST(COUNT(total) AS DOUBLE), 6) AS average, MIN(total) AS best, arg_min(course, (total, o_orderkey)) FILTER (WHERE total IS NOT NULL) AS best_course FROM r""")
def history_summary(spark, sf_dir):
    return history.summary(_rounds(spark, sf_dir))


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("o_orderkey") % 6 != 0, F.floor("o_totalprice").cast("long"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("course_key"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("date_played"), total.alias("total"))


@query("""WITH r AS (SELECT o_orderkey AS round_id, o_orderdate AS d, date_trunc('month', o_orderdate) AS m FROM orders)
 SELECT round_id, strftime(m, '%Y-%m') AS month, CAST(DENSE_RANK() OVER (ORDER BY m DESC) AS INT) AS group_rank, CAST(ROW_NUMBER() OVER (PARTITION BY m ORDER BY d DESC, round_id) AS INT) AS position FROM r""")
def rounds_by_month(spark, sf_dir):
    return history.by_month(_rounds(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey AS round_id, o_orderdate AS d, CASE WHEN o_custkey % 10 <> 0 THEN 'course ' || o_custkey ELSE 'Unknown course' END AS title FROM orders), g AS (SELECT title, CAST(ROW_NUMBER() OVER (ORDER BY title) AS INT) AS group_rank FROM (SELECT DISTINCT title FROM r))
 SELECT r.round_id, r.title, g.group_rank, CAST(ROW_NUMBER() OVER (PARTITION BY r.title ORDER BY d DESC, round_id) AS INT) AS position FROM r JOIN g ON g.title = r.title""")
def rounds_by_course(spark, sf_dir):
    r = _rounds(spark, sf_dir).withColumn("course_name", F.when(F.col("course_key").isNotNull(), F.concat(F.lit("course "), F.col("course_key").cast("string"))))
    return history.by_course(r)


@query("""WITH r AS (SELECT o_orderkey, o_custkey, date_trunc('day', o_orderdate) AS d, CAST(floor(o_totalprice) AS BIGINT) AS t, ROW_NUMBER() OVER (PARTITION BY o_custkey, date_trunc('day', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS seq FROM orders),
 p AS (SELECT a.o_orderkey AS round_id, b.o_orderkey AS duplicate_of, ROW_NUMBER() OVER (PARTITION BY a.o_orderkey ORDER BY CASE WHEN a.t = b.t THEN 0 ELSE 1 END, b.seq) AS k FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.d = b.d AND a.o_orderkey <> b.o_orderkey)
 SELECT round_id, duplicate_of FROM p WHERE k = 1""")
def duplicate_rounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_id"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("date_played"), F.floor("o_totalprice").cast("long").alias("total"))
    return history.duplicates(o)


@query("""SELECT n.n_nationkey AS course_id, n.n_name AS name, (n.n_nationkey % 5 = 0) OR COUNT(o.o_orderkey) > 0 AS played, COUNT(o.o_orderkey) AS rounds, COUNT(DISTINCT o.o_custkey) AS players FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def played_state(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("course_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 == 0).alias("marked"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("course_id"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").select("course_id", F.col("o_orderkey").alias("round_id"), F.col("c_custkey").alias("player"))
    return history.played(n, r)


@query("""SELECT c.c_custkey AS file_id FROM customer c WHERE c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def orphans_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    refs = o.select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("original"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("normalized"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    from tallyframe.sources import store

    old = F.to_timestamp(F.lit("2000-01-01"))
    renamed = refs.select(F.col("original").alias("original_filename"), F.col("normalized").alias("normalized_filename"))
    return store.orphan_images(files.select(F.col("file_id").alias("filename"), old.alias("modified")), renamed, F.to_timestamp(F.lit("2025-01-01"))).select(F.col("filename").alias("file_id"))


@query("""WITH l AS (SELECT p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 1000000 ELSE 0 END AS id, 'learned ' || p_name AS name, p_size AS version FROM part WHERE p_partkey % 5 = 0)
 SELECT p.p_partkey AS id, COALESCE(l.name, p.p_name) AS name, l.id IS NOT NULL AS learned FROM part p LEFT JOIN l ON l.id = p.p_partkey UNION ALL SELECT l.id, l.name, TRUE FROM l WHERE l.id NOT IN (SELECT p_partkey FROM part)""")
def learned_over_seed(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    learned = p.where(k % 5 == 0).select((k + F.when(k % 10 == 0, 1000000).otherwise(0)).alias("id"), F.concat(F.lit("learned "), F.col("p_name")).alias("name"))
    return history.learned_over_seed(p.select(k.alias("id"), F.col("p_name").alias("name")), learned, "id")


@query("""WITH g AS (SELECT vec_id, label, 32.5 + CAST(embedding[1] AS DOUBLE) * 10 AS lat, -83.0 + CAST(embedding[2] AS DOUBLE) * 10 AS lon FROM embeddings), b AS (SELECT * FROM g WHERE lat BETWEEN 30.355 AND 35.001 AND lon BETWEEN -85.605 AND -80.751)
 SELECT label, MIN(vec_id) AS vec_id, COUNT(*) AS accepted FROM b GROUP BY label""")
def geo_box_accept(spark, sf_dir):
    e = F.col("embedding")
    g = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.get(e, F.lit(0)).cast("double") * 10 + 32.5).alias("lat"), (F.get(e, F.lit(1)).cast("double") * 10 - 83.0).alias("lon"))
    return g.where(fields.within_box(F.col("lat"), F.col("lon"))).groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("accepted"))


@query("""WITH k AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CASE WHEN k BETWEEN 1 AND 15 THEN k END AS score, LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, k / 50.0::DOUBLE)) AS confidence, CASE WHEN k BETWEEN 9 AND 135 THEN k END AS subtotal FROM k""")
def json_payload_sanitize(spark, sf_dir):
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).select("event_id", F.when(F.col("k").between(1, 15), F.col("k")).alias("score"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("k") / 50.0)).alias("confidence"), F.when(F.col("k").between(9, 135), F.col("k")).alias("subtotal"))


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'wid') OR contains(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), 'econ') OR contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'small b')""")
def catalog_search(spark, sf_dir):
    from tallyframe.sources import store

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    named, typed = p.withColumns({"name": F.col("p_name"), "city": F.lit("")}), p.withColumns({"name": F.lit(""), "city": F.col("p_type")})
    hits = [store.search(named, "wid"), store.search(typed, "econ"), store.search(named, "small b")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).select("p_partkey", "p_name", "p_type").distinct()


@query("""WITH t AS (SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS line FROM conversations), d AS (SELECT conv_id, line, MIN(turn) AS turn FROM t WHERE len(line) >= 3 GROUP BY 1, 2)
 SELECT conv_id, string_agg(line, ' ' ORDER BY turn) AS label, COUNT(*) AS fragments FROM d GROUP BY conv_id""")
def conversation_lines(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.get(F.split("text", "\n"), F.lit(0))).alias("line")).where(F.length("line") >= 3)
    d = t.groupBy("conv_id", "line").agg(F.min("turn").alias("turn"))
    g = folds.sorted_list(d, ["conv_id"], turn=F.col("turn"), line=F.col("line"))
    return g.select("conv_id", F.array_join(F.col("items")["line"], " ").alias("label"), F.size("items").cast("long").alias("fragments"))


@query("""WITH g AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) % 24 AS x, event_id % 16 AS y FROM events) SELECT user_id, CAST(COUNT(*) AS DOUBLE) / 384 AS coverage, CAST(COUNT(*) AS DOUBLE) / 384 >= 0.55 AS revealed FROM g GROUP BY user_id""")
def scratch_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.floor("value") % 24).alias("x"), (F.col("event_id") % 16).alias("y"))
    return history.scratched(e, ["user_id"], 24, 16)


def _card_scores(k: Column, hole: Column) -> Column:
    """The score that a generated card's player wrote."""
    return (F.lit(3) + (k * 7 + hole * 5) % 4).cast("int")


def generated_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one card for each supplier: the golden print, and a handwritten row whose scores follow from the key; some holes blank, some written totals wrong."""
    from tallyframe.sources import fixtures

    holes = [f"@{h}" for h in range(1, 19)]
    base = fixtures.frame(spark, {"": fixtures.golden_card(holes, "SAM PLAYER", totals=("@19", "@20", "@21"), confidence=0.60)})
    k = F.col("s_suppkey")
    # a supplier is a few bytes and becomes a card of some 150 observations: by their bytes all cards would be made, and read, in one task
    cards = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", k.cast("string").alias("card_id")), WHOLE_CARDS, "card_id")
    o = cards.crossJoin(F.broadcast(base.drop("card_id")))
    slot = F.regexp_extract("text", "^@([0-9]+)$", 1).try_cast("int")
    total = lambda a, b: sum((_card_scores(k, F.lit(h)) for h in range(a, b + 1)), F.lit(0))
    front = total(1, 9) + F.when(k % 5 == 0, 1).otherwise(0)
    blank = ((k % 3 == 0) & (slot == k % 9 + 1)) | ((k % 4 == 0) & slot.isin(12, 13))
    value = F.when(slot <= 18, F.when(~blank, _card_scores(k, slot))).when(slot == 19, front).when(slot == 20, total(10, 18)).otherwise(total(1, 18))
    o = o.withColumn("text", F.when(slot.isNotNull(), value.cast("string")).otherwise(F.col("text"))).where("text IS NOT NULL")
    return o.drop("s_suppkey")


@query("""WITH h AS (SELECT s_suppkey AS k, h, 3 + (s_suppkey * 7 + h * 5) % 4 AS v, (s_suppkey % 3 = 0 AND h = s_suppkey % 9 + 1) OR (s_suppkey % 4 = 0 AND h IN (12, 13)) AS blank FROM supplier CROSS JOIN (SELECT UNNEST(range(1, 19)) AS h)),
 s AS (SELECT k, h > 9 AS back, SUM(v) AS truth, SUM(CASE WHEN NOT blank THEN v END) AS seen, COUNT(CASE WHEN blank THEN 1 END) AS unknown, MIN(CASE WHEN blank THEN h END) AS hole FROM h GROUP BY 1, 2),
 w AS (SELECT *, truth + CASE WHEN NOT back AND k % 5 = 0 THEN 1 ELSE 0 END AS written FROM s),
 o AS (SELECT *, CASE WHEN unknown > 1 THEN 'underdetermined' WHEN unknown = 1 AND written - seen BETWEEN 1 AND 15 THEN 'solved' WHEN unknown = 1 THEN 'implausible' WHEN written = seen THEN 'verified' ELSE 'discrepancy' END AS outcome FROM w)
 SELECT CAST(k AS VARCHAR) AS card_id, 'ga-steel-canyon' AS template_id, CAST(1 AS INT) AS n_players, CAST(CASE WHEN bool_or(outcome IN ('underdetermined', 'implausible')) THEN NULL ELSE SUM(seen + CASE WHEN outcome = 'solved' THEN written - seen ELSE 0 END) END AS BIGINT) AS total,
 MIN(CASE WHEN outcome = 'solved' THEN hole END)::INT AS solved_hole, CASE WHEN bool_or(outcome IN ('discrepancy', 'implausible')) THEN 'contradicted' WHEN bool_or(outcome IN ('verified', 'solved')) THEN 'confirmed' ELSE 'unavailable' END AS support FROM o GROUP BY k""")
def cards_end_to_end(spark, sf_dir):
    """The whole card pipeline over a card for each supplier."""
    from tallyframe.plans import cards as pipeline
    from tallyframe.sources import catalog

    got = pipeline.parse(generated_cards(spark, sf_dir), catalog.seed(spark), keep=pipeline.cut)
    sums = got.holes.groupBy("card_id").agg(F.when(F.count("score.value") == 18, F.sum("score.value")).alias("total"), F.min(F.when(F.col("score.provenance") == "solvedFromSubtotal", F.col("hole"))).alias("solved_hole"))
    return got.cards.join(sums, "card_id").select("card_id", "template_id", F.col("n_players").cast("int").alias("n_players"), "total", "solved_hole", "support")


@query(CELLS + """, p AS (SELECT card_id, MAX(CASE WHEN hole = 1 THEN value END) AS h1, MAX(CASE WHEN hole = 2 THEN value END) AS h2, MAX(CASE WHEN hole = 3 THEN value END) AS h3, COUNT(value) AS played FROM cells GROUP BY card_id)
 SELECT *, CASE WHEN h1 IS NULL THEN '—' WHEN h1 - 4 = 0 THEN 'E' WHEN h1 - 4 > 0 THEN '+' || (h1 - 4) ELSE CAST(h1 - 4 AS VARCHAR) END AS relative FROM p""")
def pivot_holes(spark, sf_dir):
    p = cells(spark, sf_dir).groupBy("card_id").agg(*[F.max(F.when(F.col("hole") == h, F.col("value"))).alias(f"h{h}") for h in (1, 2, 3)], F.count("value").alias("played"))
    return p.withColumn("relative", fields.relative_text(F.col("h1") - 4))


@query("""WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)
 SELECT p_partkey, COALESCE(list_filter(w, lambda t: len(t) > 1 AND t NOT IN ('golf', 'club', 'course', 'links', 'the', 'at', 'of', 'and', 'cc', 'country', 'gc', 'g', 'c', 'national', 'resort'))[1], w[1]) AS first_token, len(w) + GREATEST(len(w) - 1, 0) + GREATEST(len(w) - 2, 0) AS fragments FROM p""")
def name_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.get(text.significant_tokens(F.col("p_name")), F.lit(0)).alias("first_token"), F.size(text.joined_fragments(F.split("p_name", " "))).cast("long").alias("fragments"))


@query("""WITH b AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 0.05 AS w, abs(CAST(embedding[4] AS DOUBLE)) + 0.05 AS h FROM embeddings),
 p AS (SELECT a.vec_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x x2, b.y y2, b.w w2, b.h h2 FROM b a JOIN b ON b.vec_id = a.vec_id + 1),
 q AS (SELECT *, GREATEST(0.0::DOUBLE, LEAST(ax + aw, x2 + w2) - GREATEST(ax, x2)) AS ow, GREATEST(0.0::DOUBLE, LEAST(ay + ah, y2 + h2) - GREATEST(ay, y2)) AS oh FROM p)
 SELECT vec_id, ROUND(ow * oh / (aw * ah + w2 * h2 - ow * oh), 9) AS iou, ROUND(CASE WHEN LEAST(ay + ah, y2 + h2) - GREATEST(ay, y2) > 0 THEN (LEAST(ay + ah, y2 + h2) - GREATEST(ay, y2)) / LEAST((ay + ah) - ay, (y2 + h2) - y2) ELSE 0.0 END, 9) AS vertical FROM q""")
def box_overlaps(spark, sf_dir):
    from tallyframe.functions import geometry
    from tallyframe.functions.geometry import Box

    part = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    b = table(spark, sf_dir, "embeddings").select("vec_id", part(0).alias("x"), part(1).alias("y"), (part(2) + 0.05).alias("w"), (part(3) + 0.05).alias("h"))
    n = b.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"n_{c}") for c in "xywh"])
    one, two = Box.of(), Box.of("n_")
    return b.join(n, "vec_id").select("vec_id", F.round(geometry.intersection_over_union(one, two), 9).alias("iou"), F.round(geometry.vertical_overlap(one, two), 9).alias("vertical"))


@query("""SELECT o_orderkey, o_orderpriority AS severity, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey)::INT AS position FROM orders""")
def warnings_by_severity(spark, sf_dir):
    from tallyframe.operators import confidence

    rank = F.when(F.col("o_orderpriority") == "1-URGENT", "blocking").when(F.col("o_orderpriority") == "2-HIGH", "warning").otherwise("info")
    one = F.struct("o_orderkey", F.col("o_orderpriority").alias("kind"), rank.alias("severity"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("w"))
    return g.select(F.posexplode(confidence.by_severity(F.col("w"))).alias("at", "x")).select("x.o_orderkey", F.col("x.kind").alias("severity"), (F.col("at") + 1).alias("position"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """The batch form of the streaming extension's windows."""
    from tallyframe.streaming import updates

    return updates.windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT o_custkey AS round_id, COUNT(CASE WHEN o_orderkey % 6 <> 0 THEN 1 END) AS scored, COUNT(CASE WHEN o_orderkey % 6 <> 0 AND o_orderstatus = 'F' THEN 1 END) AS edited, COUNT(CASE WHEN o_orderkey % 6 <> 0 AND o_orderstatus = 'O' THEN 1 END) AS "read" FROM orders GROUP BY 1""")
def provenance_breakdown(spark, sf_dir):
    from tallyframe.operators import report

    p = F.when(F.col("o_orderstatus") == "F", "userEdited").when(F.col("o_orderstatus") == "O", "ocr").otherwise("solvedFromSubtotal")
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("round_id"), F.when(F.col("o_orderkey") % 6 != 0, 4).alias("strokes"), p.alias("score_provenance"))
    return report.provenance_breakdown(h).select("round_id", "scored", "edited", "read")


@query("""WITH r AS (SELECT c_nationkey AS course_id, COUNT(*) AS n, MIN(CAST(floor(c_acctbal) AS BIGINT)) AS best FROM customer GROUP BY 1)
 SELECT n_nationkey AS course_id, COALESCE(n, 0) AS rounds, best, CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' round' ELSE ' rounds' END || ', best ' || best WHEN n_nationkey % 2 = 0 THEN 'marked 2020-01-01' END AS summary FROM nation LEFT JOIN r ON r.course_id = n_nationkey""")
def played_summary(spark, sf_dir):
    from tallyframe.operators import report

    courses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("course_id"), F.when(F.col("n_nationkey") % 2 == 0, F.to_timestamp(F.lit("2020-01-01"))).alias("marked_at"))
    rounds = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("course_id"), F.floor("c_acctbal").alias("total"))
    return report.played_summary(courses, rounds)


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(split_part(text, chr(10), 1)), '\\s+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT conv_id, turn, w, UNNEST(range(0, len(w))) AS place FROM t)
 SELECT conv_id, turn, CAST(place AS INT) AS place, w[place + 1] AS token, len(array_to_string(w[1:place], ' ')) + CASE WHEN place > 0 THEN 1 ELSE 0 END AS "offset" FROM u""")
def line_tokens(spark, sf_dir):
    from tallyframe.operators import report

    one = F.lit(1.0)
    line = F.get(F.split("text", "\n"), F.lit(0))
    lines = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("card_id"), F.lit(0).alias("line_seq"), line.alias("text"), F.lit(0.0).alias("x"), one.alias("y"), F.length(F.regexp_replace(F.trim(line), r"\s+", " ")).cast("double").alias("w"), one.alias("h"), one.alias("confidence"), F.lit("numeric").alias("pass"), F.array().cast("array<string>").alias("alternatives"))
    return report.split_tokens(lines).select("card_id.conv_id", "card_id.turn", "place", F.col("text").alias("token"), F.round("x").cast("long").alias("offset"))
