"""From cells to printed data (pars, stroke indexes, yardages, names) and to players' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields, numeric
from tallyframe.functions.text import is_name_like, normalize_label, trimmed
from tallyframe.model import INDEX_RANGE, PAR_RANGE, PAR_TOTAL_RANGE, SCORE_RANGE, YARDAGE_RANGE, Config
from tallyframe.operators import rows
from tallyframe.operators.layout import Layout
from tallyframe.operators.sequences import densify


def _best(low: int, high: int) -> Column:
    return numeric.best_of(F.col("candidates"), F.col("substitutions"), low, high)


def static_values(table: Layout, config: Config = Config()) -> DataFrame:
    """(card_id, signal, seq, tee, hole, value, confidence, raw_text): pars and stroke indexes with seq 0, yardages per printed tee in order."""
    reading = F.when(F.col("role") == "par", _best(*PAR_RANGE)).when(F.col("role") == "handicap", _best(*INDEX_RANGE)).when(F.col("role") == "yardage", _best(*YARDAGE_RANGE))
    roles = table.rows.where(F.col("role").isin("par", "handicap", "yardage")).select("card_id", "section", "row", "role", "payload")
    nameless = F.row_number().over(Window.partitionBy("card_id", "section", "role", F.col("payload").isNull()).orderBy("row")) - 1
    keyed = roles.withColumn("key", F.when(F.col("role") != "yardage", F.lit("")).when(F.col("payload").isNull(), F.concat(F.lit("__unnamed_"), nameless.cast("string"))).otherwise(normalize_label(F.col("payload"))))
    order = keyed.groupBy("card_id", "role", "key").agg(F.min(F.struct("section", "row")).alias("first"), F.min("payload").alias("tee"))
    order = order.withColumn("seq", F.row_number().over(Window.partitionBy("card_id", "role").orderBy("first")) - 1).drop("first")
    read = table.cells.join(keyed.drop("payload"), ["card_id", "section", "row"]).withColumn("r", reading).where(F.col("r.penalty") < 1)
    conf = F.col("confidence") * (1 - F.col("r.penalty") * config.reading.static_penalty)
    first = read.groupBy("card_id", "role", "key", "hole").agg(F.min(F.struct("section", "row", F.col("r.value").alias("value"), conf.alias("confidence"), F.col("text").alias("raw_text"))).alias("f"))
    return first.join(order, ["card_id", "role", "key"]).select("card_id", F.col("role").alias("signal"), "seq", "tee", "hole", "f.value", "f.confidence", "f.raw_text")


def yardage_rows(table: Layout) -> DataFrame:
    """(card_id, tee): printed tees with a row of their own, in order; for cards whose rows have no readable cell as well."""
    named = table.rows.where((F.col("role") == "yardage") & F.col("payload").isNotNull())
    first = named.groupBy("card_id", F.col("payload").alias("tee")).agg(F.min(F.struct("section", "row")).alias("at"))
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("card_id").orderBy("at")) - 1).drop("at")


def par_totals(table: Layout) -> DataFrame:
    """(card_id, out, back, total) as the par rows print them; the first of each."""
    par_rows = table.rows.where("role = 'par'").select("card_id", "section", "row")
    read = table.agg_cells.join(par_rows, ["card_id", "section", "row"]).withColumn("r", _best(*PAR_TOTAL_RANGE)).where(F.col("r.penalty") < 1)
    pick = lambda k: F.min(F.when(F.col("kind") == k, F.struct("section", "row", F.col("r.value").alias("v"))))["v"]
    return read.groupBy("card_id").agg(pick("out").alias("out"), pick("in").alias("back"), pick("total").alias("total"))


def name_fragments(table: Layout) -> DataFrame:
    """(card_id, fragments): name-like texts above the first header, single and whole lines, in order; of every line if there is no header."""
    top = table.sections.where("section = 0").select("card_id", F.col("header_row").alias("_top"))
    obs = table.observations.join(top, "card_id", "left").where(F.col("_top").isNull() | (F.col("row") < F.col("_top"))).withColumn("t", trimmed(F.col("text")))
    one = obs.select("card_id", "row", F.lit(0).alias("whole"), "place", F.col("t").alias("fragment"))
    lines = obs.where(F.col("_top").isNotNull()).groupBy("card_id", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "t")))["t"], " ").alias("fragment")).select("card_id", "row", F.lit(1).alias("whole"), F.lit(0).alias("place"), "fragment")
    named = one.unionByName(lines).where(is_name_like(F.col("fragment")))
    first = named.groupBy("card_id", "fragment").agg(F.min(F.struct("row", "whole", "place")).alias("at"))
    return first.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("at", "fragment")))["fragment"].alias("fragments"))


def read_score(config: Config = Config()) -> Column:
    """The score field of a cell with text, candidates, substitutions, confidence, interpolated and (repaired) par: an implausible or too doubtful number is refused, never altered."""
    c = config.reading
    best = _best(*SCORE_RANGE)
    value, penalty, raw = best["value"], best["penalty"], F.col("text")
    conf = F.col("confidence") * (1 - penalty * c.score_penalty) * F.when(F.col("interpolated"), c.interpolated).otherwise(1.0)
    refused = lambda x: fields.make_field(F.lit(None), x, "ocr", raw)
    par = F.col("par")
    late = F.when(value >= 10, conf * c.high_score).otherwise(conf)
    return (
        F.when(F.col("n").isNull() | (F.col("n") == 0), fields.empty_field())
        .when(best.isNull() | (penalty >= 1), refused(F.lit(0.0)))
        .when(par.isNotNull() & ~fields.plausible_score(value, par), refused(F.lit(0.0)))
        .when(late < c.reject, refused(late))
        .otherwise(fields.make_field(value, late, "ocr", raw))
    )


def read_subtotal(hole_count: Column, config: Config = Config()) -> Column:
    """A written total: from the number of holes to fifteen each; on a card of more than nine holes a half's must reach eighteen as well."""
    long = numeric.best_of(F.col("candidates"), F.col("substitutions"), 18, 270)
    short = numeric.best_of(F.col("candidates"), F.col("substitutions"), 9, 135)
    best = F.when(hole_count > 9, long).otherwise(short)
    ok = best["penalty"] < 1
    conf = F.col("confidence") * (1 - best["penalty"] * config.reading.score_penalty)
    return F.when(ok, fields.make_field(best["value"], conf, "ocr", F.col("text"))).otherwise(fields.make_field(F.lit(None), 0.0, "ocr", F.col("text")))


def players(table: Layout, holes: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(players, scores). holes: (card_id, hole, par). Rows of one name are one player, nameless rows by their place in the section; the first readable value of a hole wins.

    players: card_id, player_seq, name, label, source_row, row_confidence, written out, back and total fields.
    scores: card_id, player_seq, hole, field; dense over the card's holes.
    """
    rows_of = table.rows.where("role = 'player'").withColumn("name", rows.clean_player_name(F.col("payload")))
    nameless = F.row_number().over(Window.partitionBy("card_id", "section", F.col("name").isNull()).orderBy("row")) - 1
    keyed = rows_of.withColumn("key", F.when(F.col("name").isNull(), F.concat(F.lit("__row_"), nameless.cast("string"))).otherwise(normalize_label(F.col("name")))).select("card_id", "section", "row", "key", "name", F.col("confidence").alias("row_confidence"))
    entry = keyed.groupBy("card_id", "key").agg(F.min(F.struct("section", "row", "name")).alias("first"), F.max("row_confidence").alias("row_confidence"))
    count = table.cards.select("card_id", "hole_count")
    read = table.cells.join(keyed.select("card_id", "section", "row", "key"), ["card_id", "section", "row"]).join(holes.select("card_id", "hole", "par"), ["card_id", "hole"], "left")
    read = read.withColumn("field", read_score(config))
    # a readable value beats an earlier unreadable one; of unreadable ones the last stays
    v = F.col("field.value").isNotNull()
    at = F.struct("section", "row")
    merged = read.groupBy("card_id", "key", "hole").agg(F.min(F.when(v, F.struct(at.alias("at"), F.col("field").alias("field"))))["field"].alias("good"), F.max_by("field", F.when(~v, at)).alias("bad"), F.count_if(v).alias("_v"))
    merged = merged.select("card_id", "key", "hole", F.coalesce("good", "bad").alias("field"))
    sub = table.agg_cells.join(keyed.select("card_id", "section", "row", "key"), ["card_id", "section", "row"]).join(count, "card_id").withColumn("field", read_subtotal(F.col("hole_count"), config))
    pick = lambda k: F.min(F.when((F.col("kind") == k) & F.col("field.value").isNotNull(), F.struct("section", "row", F.col("field").alias("field"))))["field"]
    written = sub.groupBy("card_id", "key").agg(*[F.coalesce(pick(k), fields.empty_field()).alias(f"written_{n}") for k, n in (("out", "out"), ("in", "back"), ("total", "total"))])
    scored = merged.where("field.value IS NOT NULL").groupBy("card_id", "key").agg(F.count("*").alias("scored"))
    kept = entry.join(scored, ["card_id", "key"]).where(F.col("scored") >= config.reading.least_holes).join(written, ["card_id", "key"], "left")
    seq = F.row_number().over(Window.partitionBy("card_id").orderBy("first")) - 1
    who = kept.select("card_id", "key", seq.alias("player_seq"), F.col("first.name").alias("name"), F.col("first.row").alias("source_row"), "row_confidence", *[F.coalesce(f"written_{n}", fields.empty_field()).alias(f"written_{n}") for n in ("out", "back", "total")])
    who = who.withColumn("label", F.concat(F.lit("Player "), (F.col("player_seq") + 1).cast("string")))
    each = who.select("card_id", "key", "player_seq").join(count, "card_id").withColumn("hole", F.explode(F.sequence(F.lit(1), F.col("hole_count"))))
    scores = each.join(merged, ["card_id", "key", "hole"], "left").select("card_id", "player_seq", "hole", F.coalesce("field", fields.empty_field()).alias("field"))
    return who.drop("key"), scores


def build_holes(table: Layout, static: DataFrame, tee: DataFrame) -> DataFrame:
    """(card_id, hole, par, stroke_index, yardage): dense, as read. tee: (card_id, tee_seq): which printed yardage row to take."""
    pick = lambda s: F.when(F.count_if(F.col("signal") == s) > 0, F.first(F.when(F.col("signal") == s, fields.make_field(F.col("value"), F.coalesce("confidence", F.lit(0.5)), "ocr", F.col("raw_text"))), ignorenulls=True))
    chosen = static.join(tee, "card_id", "left").where((F.col("signal") != "yardage") | (F.col("seq") == F.coalesce("tee_seq", F.lit(0))))
    read = chosen.groupBy("card_id", "hole").agg(pick("par").alias("par"), pick("handicap").alias("stroke_index"), pick("yardage").alias("yardage"))
    dense = densify(table.cards.where(F.col("hole_count").isNotNull()).select("card_id", "hole_count"), read)
    return dense.select("card_id", "hole", *[F.coalesce(c, fields.empty_field()).alias(c) for c in ("par", "stroke_index", "yardage")])


#: How far beyond a cell a second look goes, as a share of its sides.
PADDING = 0.25


def reread_work(table: Layout, scores: DataFrame, players_of: DataFrame, padding: float = PADDING) -> DataFrame:
    """(card_id, row, hole, x, y, w, h) of unresolved score cells worth another look, for cards with any score: what an external reader is asked for."""
    open_holes = scores.where(F.col("field.value").isNull()).select("card_id", "player_seq", "hole")
    any_score = scores.where(F.col("field.value").isNotNull()).select("card_id").distinct()
    band = table.observations.groupBy("card_id", "row").agg(F.min("y").alias("top"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("height"))
    where = open_holes.join(any_score, "card_id", "left_semi").join(players_of.select("card_id", "player_seq", F.col("source_row").alias("row")), ["card_id", "player_seq"]).join(band, ["card_id", "row"]).join(table.hole_columns.select("card_id", "hole", "min_x", "max_x"), ["card_id", "hole"])
    w = F.col("max_x") - F.col("min_x")
    return where.select("card_id", "row", "hole", (F.col("min_x") - w * padding).alias("x"), (F.col("top") - F.col("height") * padding).alias("y"), (w * (1 + 2 * padding)).alias("w"), (F.col("height") * (1 + 2 * padding)).alias("h"))
