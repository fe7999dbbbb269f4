"""Positioned text to a table: skew, rows, header runs, columns, sections, cells and row roles, for all cards at once.

Every relation is keyed by card_id, then section and row. A card has some 150 observations, so what joins
or folds within a card is small; the only key that data is dealt by is the card.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields, geometry, numeric
from tallyframe.functions.geometry import Box
from tallyframe.functions.text import normalize_label, trimmed
from tallyframe.model import Config
from tallyframe.operators import bands, folds, rows


@dataclass(frozen=True)
class Layout:
    """cards (card_id, skew, pivot_x, pivot_y, median_height, n_sections, hole_count); observations with row and place; sections; hole_columns; agg_columns; rows with role; cells; totals."""

    cards: DataFrame
    observations: DataFrame
    sections: DataFrame
    hole_columns: DataFrame
    agg_columns: DataFrame
    rows: DataFrame
    cells: DataFrame
    agg_cells: DataFrame


def estimate_skew(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, skew): the median angle from each observation to its nearest neighbour on the right."""
    c = config.clustering
    left, right = Box.of(), Box.of("r_")
    # a neighbour starts between half a width before this one's right end and the largest gap after it: only such strips meet
    strip = lambda x: F.floor(x / c.neighbour_gap).cast("int")
    a = obs.withColumn("strip", F.explode(F.sequence(strip(left.max_x - left.w * 0.5), strip(left.max_x + c.neighbour_gap))))
    b = obs.select("card_id", strip(F.col("x")).alias("strip"), *[F.col(n).alias(f"r_{n}") for n in ("obs_seq", "x", "y", "w", "h")])
    gap = right.x - left.max_x
    later = (right.x > left.x) | ((right.x == left.x) & (F.col("r_obs_seq") > F.col("obs_seq")))
    near = a.join(b, ["card_id", "strip"]).where(later & (gap <= c.neighbour_gap) & (gap > left.w * -0.5) & (geometry.vertical_overlap(left, right) > c.neighbour_overlap))
    best = near.groupBy("card_id", "obs_seq").agg(F.min(F.struct(gap.alias("gap"), right.x.alias("x"), F.col("r_obs_seq").alias("seq"), geometry.angle_to(left, right, c.max_skew).alias("angle"))).alias("best"))
    angle = F.col("best.angle")
    counts = obs.groupBy("card_id").agg(F.count("*").alias("n"))
    angles = best.groupBy("card_id").agg(F.count(angle).alias("k"), F.median(angle).alias("m"))
    enough = (F.col("n") >= c.least_observations) & (F.col("k") >= c.least_angles)
    return counts.join(angles, "card_id", "left").select("card_id", F.when(enough, F.col("m")).otherwise(0.0).alias("skew"))


def deskewed(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """obs with boxes turned upright, and skew, pivot and the median height of the card."""
    c = config.clustering
    box = Box.of()
    frame = obs.groupBy("card_id").agg(F.avg(box.mid_x).alias("pivot_x"), F.avg(box.mid_y).alias("pivot_y"), F.median("h").alias("median_height"))
    skew = estimate_skew(obs, config).select("card_id", F.when(F.abs("skew") >= c.min_skew, F.col("skew")).otherwise(0.0).alias("skew"))
    both = obs.join(frame.join(skew, "card_id"), "card_id")
    turned = box.rotated(-F.col("skew"), F.col("pivot_x"), F.col("pivot_y"))
    tilted = F.col("skew") != 0
    return both.withColumn("_x", F.when(tilted, turned.x).otherwise(F.col("x"))).withColumn("y", F.when(tilted, turned.y).otherwise(F.col("y"))).withColumn("x", F.col("_x")).drop("_x")


def cluster_rows(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """obs (deskewed) with row (from the top) and place (from the left)."""
    c, box = config.clustering, Box.of()
    tolerance = F.greatest(F.coalesce("median_height", F.lit(c.default_height)) * c.row_tolerance, F.lit(c.floor))
    flat = bands.clustered(obs, ["card_id"], box.mid_y, F.col("y"), box.max_y, tolerance, ["x", "obs_seq"], c.overlap)
    place = Window.partitionBy("card_id", "row").orderBy("x", "obs_seq")
    return flat.withColumn("place", F.row_number().over(place) - 1)


def headers(obs: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, row, hole, centre): the numbers of each row's best run, for rows whose run is long enough."""
    read = obs.withColumn("t", trimmed(F.col("text"))).withColumn("candidates", numeric.integer_candidates(F.col("t"))).withColumn("n_sub", numeric.substitutions(F.col("t")))
    seen = read.withColumn("r", numeric.best_of(F.col("candidates"), F.col("n_sub"), 1, 18)).select("card_id", "row", "place", Box.of().mid_x.alias("centre"), F.when(F.col("r.penalty") < 1, F.col("r.value")).alias("v"))
    lines = folds.sorted_list(seen, ["card_id", "row"], place=F.col("place"), v=F.col("v"), centre=F.col("centre"))
    runs = lines.withColumn("hits", folds.best_run(F.col("items")["v"])).where(F.size("hits") >= config.grid.header_run)
    return runs.select("card_id", "row", F.size("hits").alias("run"), F.explode(F.transform("hits", lambda h: F.struct(h["value"].alias("hole"), F.get(F.col("items"), h["at"])["centre"].alias("centre")))).alias("h")).select("card_id", "row", "run", "h.hole", "h.centre")


def _bounds(columns: DataFrame, by: list[str], config: Config) -> DataFrame:
    """columns (..., hole, centre) with min_x and max_x: halfway to the neighbours, and a share of the pitch at the edges."""
    g = config.grid
    order = Window.partitionBy(*by).orderBy("centre", "hole")
    gaps = columns.withColumn("_before", F.lag("centre").over(order)).withColumn("_after", F.lead("centre").over(order))
    pitch = F.coalesce(F.median(F.col("centre") - F.col("_before")).over(Window.partitionBy(*by)), F.lit(g.default_pitch))
    return gaps.withColumn("pitch", pitch).withColumn("min_x", F.coalesce((F.col("_before") + F.col("centre")) / 2, F.col("centre") - F.col("pitch") * g.edge)).withColumn("max_x", F.coalesce((F.col("centre") + F.col("_after")) / 2, F.col("centre") + F.col("pitch") * g.edge)).drop("_before", "_after")


def make_columns(hits: DataFrame, config: Config = Config()) -> DataFrame:
    """Hole columns of each header; one or two numbers missing between two read ones are interpolated."""
    order = Window.partitionBy("card_id", "row").orderBy("centre", "hole")
    nxt = hits.withColumn("_h", F.lead("hole").over(order)).withColumn("_c", F.lead("centre").over(order))
    gap = F.col("_h") - F.col("hole")
    steps = F.when(gap.between(2, 3), F.sequence(F.lit(0), gap - 1)).otherwise(F.array(F.lit(0)))
    filled = nxt.select("card_id", "row", "run", F.explode(steps).alias("k"), "hole", "centre", "_c", gap.alias("gap"))
    out = filled.select("card_id", "row", "run", (F.col("hole") + F.col("k")).alias("hole"), F.when(F.col("k") > 0, F.col("centre") + (F.col("_c") - F.col("centre")) / F.col("gap") * F.col("k")).otherwise(F.col("centre")).alias("centre"), (F.col("k") > 0).alias("interpolated"))
    return _bounds(out, ["card_id", "row"], config)


def accepted_sections(columns: DataFrame) -> DataFrame:
    """(card_id, section, header_row, first_row, end_row): headers that don't mostly repeat others, with the rows that they own; end_row is exclusive, null for the last."""
    one = columns.groupBy("card_id", "row", "run").agg(F.array_sort(F.collect_set("hole")).alias("holes"))
    listed = folds.sorted_list(one, ["card_id"], order=-F.col("run"), row=F.col("row"), holes=F.col("holes"))
    kept = listed.select("card_id", F.explode(folds.accept_headers(F.col("items"))).alias("header_row"))
    order = Window.partitionBy("card_id").orderBy("header_row")
    numbered = kept.withColumn("section", F.row_number().over(order) - 1).withColumn("end_row", F.lead("header_row").over(order))
    return numbered.withColumn("first_row", F.when(F.col("section") == 0, 0).otherwise(F.col("header_row")))


def aggregate_columns(obs: DataFrame, columns: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, section, kind, centre, min_x, max_x) of OUT, IN and TOT, where the grid or its right names them."""
    grid = columns.groupBy("card_id", "section").agg(F.min("min_x").alias("grid_min"), F.first("pitch").alias("pitch"))
    token = normalize_label(F.col("text"))
    kind = F.when(token.isin(*rows.LABELS["out"]), "out").when(token.isin(*rows.LABELS["in"]), "in").when(token.isin(*rows.LABELS["total"]), "total")
    named = obs.withColumn("kind", kind).where("kind IS NOT NULL").join(grid, ["card_id", "section"]).where(Box.of().mid_x >= F.col("grid_min"))
    half = F.first("pitch") * config.grid.aggregate
    out = named.withColumn("_mid", Box.of().mid_x).groupBy("card_id", "section", "kind").agg(fields.upper_median("_mid").alias("centre"), F.greatest(half, F.max("w")).alias("width"))
    return out.select("card_id", "section", "kind", "centre", (F.col("centre") - F.col("width") / 2).alias("min_x"), (F.col("centre") + F.col("width") / 2).alias("max_x"))


def _within(x: Column, low: str, high: str) -> Column:
    return (x >= F.col(low)) & (x < F.col(high))


def _outside_aggregates(obs: DataFrame, aggs: DataFrame) -> DataFrame:
    a = aggs.select("card_id", "section", F.col("min_x").alias("_lo"), F.col("max_x").alias("_hi"))
    return obs.join(a, (obs["card_id"] == a["card_id"]) & (obs["section"] == a["section"]) & _within(Box.of().mid_x, "_lo", "_hi"), "left_anti")


def refine(columns: DataFrame, obs: DataFrame, aggs: DataFrame, config: Config = Config()) -> DataFrame:
    """Columns moved part of the way to the median of the numbers in them."""
    g = config.grid
    mid = Box.of().mid_x
    cols = columns.select("card_id", "section", "hole", F.col("centre").alias("_centre"), "min_x", "max_x")
    numbers = _outside_aggregates(obs.where(numeric.looks_numeric(trimmed(F.col("text")))), aggs).select("card_id", "section", "obs_seq", mid.alias("mid"))
    # a number counts for the nearest centre, if that column also holds it
    best = numbers.join(cols, ["card_id", "section"]).groupBy("card_id", "section", "obs_seq", "mid").agg(F.min(F.struct(F.abs(F.col("_centre") - F.col("mid")).alias("d"), F.col("hole").alias("hole"), F.col("min_x").alias("lo"), F.col("max_x").alias("hi"))).alias("c"))
    medians = best.where(_within(F.col("mid"), "c.lo", "c.hi")).groupBy("card_id", "section", F.col("c.hole").alias("hole")).agg(F.median("mid").alias("_m"), F.count("*").alias("_n"))
    size = F.count("*").over(Window.partitionBy("card_id", "section"))
    moved = columns.withColumn("_size", size).join(medians, ["card_id", "section", "hole"], "left")
    centre = F.when((F.col("_n") >= g.samples) & (F.col("_size") >= 2), F.col("centre") + (F.col("_m") - F.col("centre")) * g.refine).otherwise(F.col("centre"))
    again = moved.withColumn("centre", centre).select("card_id", "section", "hole", "centre", "interpolated")
    return _bounds(again, ["card_id", "section"], config)


def cells(obs: DataFrame, columns: DataFrame, aggs: DataFrame) -> DataFrame:
    """(card_id, section, row, hole, text, confidence, n, ...) of cells that hold anything."""
    free = _outside_aggregates(obs, aggs)
    known = columns.select("card_id", "section", "hole", "interpolated", F.col("min_x").alias("low"), F.col("max_x").alias("high"))
    hit = bands.located_by(free, known, ["card_id", "section"], Box.of().mid_x, ["hole", "interpolated"]).where("hole IS NOT NULL")
    return _read_cells(hit, ["card_id", "section", "row", "hole", "interpolated"])


def aggregate_cells(obs: DataFrame, aggs: DataFrame) -> DataFrame:
    hit = obs.join(aggs.select("card_id", "section", "kind", "min_x", "max_x"), ["card_id", "section"]).where(_within(Box.of().mid_x, "min_x", "max_x"))
    return _read_cells(hit, ["card_id", "section", "row", "kind"])


def _read_cells(hit: DataFrame, by: list[str]) -> DataFrame:
    box = Box.of()
    out = hit.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col("x"), F.col("obs_seq"), trimmed(F.col("text")).alias("t"))))["t"], "").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(box.max_x) - F.min("x")).alias("w"), (F.max(box.max_y) - F.min("y")).alias("h"),
    )
    return out.withColumn("candidates", numeric.integer_candidates(F.col("text"))).withColumn("substitutions", numeric.substitutions(F.col("text")))


def classify_rows(obs: DataFrame, cell: DataFrame, sections: DataFrame, columns: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, section, row, role, payload, confidence, mean_confidence, uniformity)."""
    grid = columns.groupBy("card_id", "section").agg(F.min("min_x").alias("grid_min"))
    box = Box.of()
    placed = obs.join(grid, ["card_id", "section"])
    is_label = box.max_x <= F.col("grid_min") + F.col("w") * config.grid.label_slack
    per_row = placed.groupBy("card_id", "section", "row").agg(
        F.array_sort(F.collect_list(F.when(is_label, F.struct("x", "obs_seq", trimmed(F.col("text")).alias("t")))))["t"].alias("tokens"), F.avg("confidence").alias("mean_confidence"), fields.height_uniformity(F.col("h")).alias("uniformity"),
    )
    best = numeric.best_of(F.col("candidates"), F.col("substitutions"), 1, 999)
    made = rows.numeric_signature(F.when(best["penalty"] < 1, best["value"]))
    signature = cell.groupBy("card_id", "section", "row").agg(*[c.alias(f"s_{n}") for n, c in made.items()])
    full = per_row.join(signature, ["card_id", "section", "row"], "left").na.fill(0, [f"s_{n}" for n in made]).join(sections.select("card_id", "section", "header_row"), ["card_id", "section"])
    full = full.withColumn("label", rows.match_label(F.col("tokens")))
    role = rows.classify(F.col("label"), F.col("tokens"), F.col("s_n"), F.col("s_yardage"), F.col("s_par"), F.col("s_handicap"), F.col("s_score"), F.col("mean_confidence"), F.col("uniformity"))
    header = F.col("row") == F.col("header_row")
    return full.withColumn("r", role).select(
        "card_id", "section", "row", F.when(header, "holeHeader").otherwise(F.col("r.role")).alias("role"), F.when(~header, F.col("r.payload")).alias("payload"), F.when(header, 0.95).otherwise(F.col("r.confidence")).alias("confidence"), "mean_confidence", "uniformity",
    )


def settle_par(classified: DataFrame) -> DataFrame:
    """Unsure rows of a section: with a sure par row all are players; without, the most print-like one is par if it is enough so."""
    by = Window.partitionBy("card_id", "section")
    sure = F.max(((F.col("role") == "par") & (F.col("confidence") >= 0.65)).cast("int")).over(by) == 1
    unsure = (F.col("confidence") < 0.5) & F.col("role").isin("player", "par")
    r = classified.withColumn("_sure", sure).withColumn("_unsure", unsure)
    group = Window.partitionBy("card_id", "section", "_unsure")
    place = F.row_number().over(group.orderBy("row")) - 1
    n = F.count("*").over(group)
    print_like = F.col("uniformity") * 0.5 + F.least(F.lit(1.0), F.col("mean_confidence")) * 0.5
    r = r.withColumn("_score", (1 - place / F.greatest(F.lit(1), n)) * 0.45 + print_like * 0.55)
    r = r.withColumn("_best", F.row_number().over(group.orderBy(F.desc("_score"), "row")) == 1)
    wins = F.col("_best") & (F.col("_score") >= 0.62)
    change = F.col("_unsure") & (~F.col("_sure") | (F.col("role") == "par"))
    par = F.col("_unsure") & ~F.col("_sure") & wins
    return r.select(
        "card_id", "section", "row", F.when(par, "par").when(change, "player").otherwise(F.col("role")).alias("role"), F.when(~change, F.col("payload")).alias("payload"),
        F.when(par, 0.45).when(change, 0.35).otherwise(F.col("confidence")).alias("confidence"), "mean_confidence", "uniformity",
    )


def detect(obs: DataFrame, config: Config = Config(), keep=lambda df: df) -> Layout:
    """The whole reconstruction. keep: applied to relations that are used again, to cut lineage or cache."""
    upright = deskewed(obs, config)
    lined = keep(cluster_rows(upright, config))
    found = make_columns(headers(lined, config), config)
    sections = keep(accepted_sections(found))
    s = sections.select("card_id", "section", "header_row", "first_row", "end_row")
    first = found.join(s.select("card_id", "section", F.col("header_row").alias("row")), ["card_id", "row"]).drop("row", "run")
    inside = (F.col("row") >= F.col("first_row")) & (F.col("end_row").isNull() | (F.col("row") < F.col("end_row")))
    placed = keep(lined.join(s, "card_id").where(inside).drop("header_row", "first_row", "end_row"))
    aggs = keep(aggregate_columns(placed, first, config))
    columns = keep(refine(first, placed, aggs, config))
    cell = keep(cells(placed, columns, aggs))
    agg_cell = aggregate_cells(placed, aggs)
    roles = keep(settle_par(classify_rows(placed, cell, sections, columns, config)))
    counts = columns.groupBy("card_id").agg(F.max("hole").alias("hole_count"), F.count_distinct("hole").alias("distinct_holes"))
    cards = lined.groupBy("card_id").agg(F.first("skew").alias("skew"), F.first("pivot_x").alias("pivot_x"), F.first("pivot_y").alias("pivot_y"), F.first("median_height").alias("median_height")).join(counts, "card_id", "left")
    return Layout(cards, lined, sections, columns, aggs, roles, cell, agg_cell)
