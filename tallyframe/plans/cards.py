"""The card pipelines: observations to scorecards, and a second reading merged into them."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields, numeric
from tallyframe.functions.geometry import Box
from tallyframe.lineage import cut  # noqa: F401  what parse() takes as keep
from tallyframe.model import SCORE_RANGE, Config
from tallyframe.operators import checksum, confidence, extract, layout, match, remote, report
from tallyframe.sources import catalog


@dataclass(frozen=True)
class Scorecards:
    """cards: one row per card; holes: par, stroke_index, yardage and score fields; players and their scores; halves: the checksum's findings; table: the reconstruction."""

    cards: DataFrame
    holes: DataFrame
    players: DataFrame
    scores: DataFrame
    halves: DataFrame
    table: layout.Layout | None = None
    ranking: DataFrame | None = None
    static: DataFrame | None = None


def apply_template(holes: DataFrame, chosen: DataFrame, templates: DataFrame) -> DataFrame:
    """holes with a usable template's values in place of what was read, unless a person set it; `corrected` counts a hole's changes. Scores are not among the columns that it can touch."""
    usable = templates.where(catalog.hole_data_usable())
    h = catalog.holes(usable).select("template_id", "hole", F.col("par").alias("t_par"), F.col("stroke_index").alias("t_index"))
    y = catalog.tees(usable).select("template_id", F.lower("tee").alias("_tee"), "hole", F.col("yards").alias("t_yards"))
    both = holes.join(chosen.select("card_id", "template_id", F.lower("tee").alias("_tee")), "card_id", "left").join(h, ["template_id", "hole"], "left").join(y, ["template_id", "_tee", "hole"], "left")

    def over(c: str, t: str):
        wins = F.col(t).isNotNull() & (F.col(f"{c}.provenance") != "userEdited")
        return F.when(wins, fields.template_field(F.col(t))).otherwise(F.col(c)), (wins & ~F.col(f"{c}.value").eqNullSafe(F.col(t))).cast("int")

    made = {c: over(c, t) for c, t in (("par", "t_par"), ("stroke_index", "t_index"), ("yardage", "t_yards"))}
    return both.select("card_id", "hole", *[v.alias(c) for c, (v, _) in made.items()], sum((n for _, n in made.values()), F.lit(0)).alias("corrected"))


def _solve(cards: DataFrame, holes: DataFrame, players: DataFrame, chosen: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """holes with solved scores, the halves, and the support per card, for cards with a selected player. Cards of up to nine holes have one half."""
    p = players.join(chosen, ["card_id", "player_seq"]).join(cards.select("card_id", "hole_count"), "card_id")
    w = p.select("card_id", "hole_count", F.col("written_out.value").alias("out"), F.col("written_back.value").alias("back"), F.col("written_total.value").alias("total"))
    short, long = checksum.infer_subtotals(w.where("hole_count <= 9"), 9), checksum.infer_subtotals(w.where("hole_count > 9"), 18)
    written = short.select("card_id", "out", "back").unionByName(long.select("card_id", "out", "back"))
    flat = holes.join(chosen.select("card_id"), "card_id", "left_semi").select("card_id", "hole", "score.value", "score.confidence", "score.provenance")
    halves = checksum.solve_halves(flat, written, known=config.checksum.known)
    fix = halves.where("outcome = 'solved'").select("card_id", "hole", F.col("missing").alias("_fix"))
    solved = holes.join(fix, ["card_id", "hole"], "left").withColumn("score", F.when(F.col("_fix").isNotNull(), fields.solved_field(F.col("_fix"))).otherwise(F.col("score"))).drop("_fix")
    return solved, halves, checksum.support(halves)


def solver_warnings(halves: DataFrame) -> DataFrame:
    """(card_id, solver_warnings): a half whose sum differs or whose one hole can't be what is missing is doubtful; several unread holes are missing; holes worked out from a written total deserve a glance."""
    o = F.col("outcome")
    no_holes = F.array().cast("array<int>")
    said = report.half_text(F.col("half"), o, F.col("computed"), F.col("expected"), F.col("unread"), F.col("hole"), F.col("missing"))
    one = F.coalesce(
        confidence.warning(o == "discrepancy", "someScoresLowConfidence", "warning", no_holes, said),
        confidence.warning(o == "implausible", "someScoresLowConfidence", "warning", F.array("hole"), said),
        confidence.warning(o == "underdetermined", "someScoresMissing", "warning", F.col("unread"), said),
    )
    listed = F.array_sort(F.collect_list(F.when(one.isNotNull(), F.struct((F.col("half") == "back").alias("back"), one.alias("w")))))
    solved = F.array_sort(F.collect_list(F.when(o == "solved", F.col("hole"))))
    lines = F.array_sort(F.collect_list(F.when(o == "solved", F.struct(F.col("hole"), said.alias("said")))))
    worked_out = confidence.listed(confidence.warning(F.size(solved) > 0, "someScoresLowConfidence", "info", solved, F.array_join(lines["said"], "; ")))
    return halves.groupBy("card_id").agg(F.concat(listed["w"], worked_out).alias("solver_warnings"))


def parse(obs: DataFrame, templates: DataFrame, overrides: DataFrame | None = None, requested: DataFrame | None = None, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df, detect: Callable[..., layout.Layout] = layout.detect, rank: Callable[..., DataFrame] = match.score_templates) -> Scorecards:
    """Every card of obs. requested (card_id): cards that must appear in the result even if they have no observation. detect and rank: other ways to find tables and to score templates, called like the usual ones."""
    table = detect(obs, config, keep)
    static = keep(extract.static_values(table, config))
    totals = extract.par_totals(table)
    fragments = keep(extract.name_fragments(table))
    gridded = table.cards.where(F.col("hole_count").isNotNull())
    ranking = keep(rank(gridded, static, totals, fragments, templates, config))
    resolved = match.force(match.resolve(ranking, config), overrides, templates)
    cards = keep(match.resolve_tees(resolved, static, extract.yardage_rows(table), templates))
    read = extract.build_holes(table, static, match.printed_row(cards, static))
    repaired = keep(apply_template(read, cards, templates))
    players, scores = extract.players(table, repaired.select("card_id", "hole", F.col("par.value").alias("par")), config)
    players, scores = keep(players), keep(scores)
    counts = players.groupBy("card_id").agg(F.count("*").alias("n_players"), F.min("player_seq").alias("player_seq"))
    chosen = counts.where("n_players = 1").select("card_id", "player_seq")
    mine = scores.join(chosen, ["card_id", "player_seq"]).select("card_id", "hole", F.col("field").alias("score"))
    holes = repaired.join(mine, ["card_id", "hole"], "left").withColumn("score", F.coalesce("score", fields.empty_field()))
    solved, halves, support = _solve(gridded, holes, players, chosen, config)
    solved, halves = keep(solved), keep(halves)
    corrected = repaired.groupBy("card_id").agg(F.sum("corrected").alias("corrected"))
    full = gridded.select("card_id", "hole_count", "skew").join(cards, "card_id").join(counts.select("card_id", "n_players"), "card_id", "left").join(chosen.withColumnRenamed("player_seq", "selected"), "card_id", "left").join(support, "card_id", "left").join(solver_warnings(halves), "card_id", "left").join(corrected, "card_id", "left").join(fragments, "card_id", "left")
    w = confidence.warning
    amb, none = F.col("resolution") == "ambiguous", F.col("resolution") == "noMatch"
    named = F.coalesce(F.size("fragments"), F.lit(0)) > 0
    made = confidence.listed(
        w(amb, F.when(F.size("alternates") > 1, "multipleCourseMatches").otherwise("courseMatchLowConfidence"), "warning"), w(none, F.when(named, "courseNotInCatalog").otherwise("courseNameUnreadable"), "warning"),
        w(F.col("tee_warning").isNotNull(), F.col("tee_warning"), "warning"), w(F.col("corrected") > 0, "templateFilledStaticData", "info"),
    )
    made = F.concat(made, F.coalesce("solver_warnings", F.array().cast(f"array<{confidence.WARNING}>")))
    ready = full.select(
        "card_id", "hole_count", "skew", "resolution", "template_id", F.col("score").alias("course_confidence"), "alternates", "tee", "tee_confidence", F.coalesce("n_players", F.lit(0)).alias("n_players"), "selected",
        F.col("template_id").isNotNull().alias("resolved"), F.coalesce("support", F.lit("unavailable")).alias("support"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"), F.coalesce("corrected", F.lit(0)).alias("corrected"), made.alias("warnings"),
    )
    done = confidence.evaluate(ready, solved, config).withColumn("status", F.lit("read"))
    none_found = F.array(w(F.lit(True), "noScorecardTableDetected", "blocking"))
    bare = table.cards.where(F.col("hole_count").isNull()).select("card_id", "skew", F.lit("failed").alias("quality"), F.lit(0.0).alias("overall"), none_found.alias("warnings"), F.lit("noTable").alias("status"))
    done = done.unionByName(bare, allowMissingColumns=True)
    if requested is not None:
        silent = requested.join(table.cards, "card_id", "left_anti").select("card_id", F.lit("failed").alias("quality"), F.lit(0.0).alias("overall"), F.lit("noTextRecognized").alias("status"))
        done = done.unionByName(silent, allowMissingColumns=True)
    return Scorecards(done, solved, players, scores, halves, table, ranking, static)


def select_player(cards: Scorecards, chosen: DataFrame) -> Scorecards:
    """chosen (card_id, player_seq): that row's scores become the card's; holes that it lacks are empty."""
    mine = cards.scores.join(chosen, ["card_id", "player_seq"]).select("card_id", "hole", F.col("field").alias("_score"))
    hit = chosen.select("card_id", F.lit(True).alias("_hit"))
    holes = cards.holes.join(hit, "card_id", "left").join(mine, ["card_id", "hole"], "left")
    holes = holes.withColumn("score", F.when(F.col("_hit"), F.coalesce("_score", fields.empty_field())).otherwise(F.col("score"))).drop("_hit", "_score")
    picked = cards.cards.join(chosen.withColumnRenamed("player_seq", "_seq"), "card_id", "left").withColumn("selected", F.coalesce("_seq", "selected")).drop("_seq")
    return replace(cards, cards=picked, holes=holes)


def apply_edits(cards: Scorecards, edits: DataFrame) -> Scorecards:
    """edits (card_id, hole, value): set by a person, on the hole and on the selected player's row; the last word in every later step, and carried over a new parse by hole number."""
    e = edits.select("card_id", "hole", fields.edited_field(F.col("value")).alias("_edit"))
    holes = cards.holes.join(e, ["card_id", "hole"], "left").withColumn("score", F.coalesce("_edit", "score")).drop("_edit")
    own = cards.cards.select("card_id", F.col("selected").alias("player_seq")).where("player_seq IS NOT NULL")
    scores = cards.scores.join(e.join(own, "card_id"), ["card_id", "player_seq", "hole"], "left").withColumn("field", F.coalesce("_edit", "field")).drop("_edit")
    return replace(cards, holes=holes, scores=scores)


def reidentify(old: Scorecards, new: Scorecards) -> Scorecards:
    """new with the row that was chosen in old, found again by its place; nobody where the place is gone or nobody was chosen."""
    place = old.cards.where("selected IS NOT NULL").select("card_id", F.col("selected").alias("player_seq"))
    there = new.players.select("card_id", "player_seq").join(place, ["card_id", "player_seq"], "left_semi")
    bare = replace(new, cards=new.cards.withColumn("selected", F.lit(None).cast("int")))
    return select_player(bare, there)


def reparse_with(obs: DataFrame, recovered: DataFrame, old: Scorecards, templates: DataFrame, overrides: DataFrame | None = None, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Scorecards, DataFrame]:
    """A second parse of the cards that targeted readings (rows like obs) were recovered for, with them appended; and (card_id, adopt)."""
    again = obs.join(recovered.select("card_id").distinct(), "card_id", "left_semi")
    last = again.groupBy("card_id").agg(F.max("obs_seq").alias("_last"))
    added = recovered.join(last, "card_id").withColumn("obs_seq", F.col("obs_seq") + F.col("_last") + 1).select(obs.columns)
    new = parse(keep(again.unionByName(added)), templates, overrides, config=config, keep=keep)
    return new, better_reparse(old, new)


#: A second look at a cell is believed no more than this.
REREAD = 0.78


def _readable() -> Column:
    """A reading that can be a score."""
    return numeric.best_of(numeric.integer_candidates(F.col("text")), numeric.substitutions(F.col("text")), *SCORE_RANGE)["value"].isNotNull() & F.col("confidence").isNotNull()


def recovered(table: layout.Layout, work: DataFrame, readings: DataFrame, padding: float = extract.PADDING) -> DataFrame:
    """readings (card_id, row, hole, text, confidence, alternatives) of cells of work as observations, one a cell: the surest that can be a score, in the middle of its cell, in the photograph's coordinates."""
    surest = readings.where(_readable()).groupBy("card_id", "row", "hole").agg(F.max(F.struct("confidence", "text", "alternatives")).alias("_r"))
    seq = (F.row_number().over(Window.partitionBy("card_id").orderBy("row", "hole")) - 1).alias("obs_seq")
    at = surest.join(work, ["card_id", "row", "hole"]).join(table.cards.select("card_id", "skew", "pivot_x", "pivot_y"), "card_id")
    w, h = F.col("w") / (1 + 2 * padding), F.col("h") / (1 + 2 * padding)
    upright = Box(F.col("x") + F.col("w") / 2 - w * 0.2, F.col("y") + F.col("h") / 2 - h * 0.3, w * 0.4, h * 0.6)
    box = report.in_original_image(upright, F.col("skew"), F.col("pivot_x"), F.col("pivot_y"))
    return at.select("card_id", seq, F.col("_r.text").alias("text"), box.x.alias("x"), box.y.alias("y"), box.w.alias("w"), box.h.alias("h"), F.least(F.col("_r.confidence"), F.lit(REREAD)).alias("confidence"), F.lit("targetedCell").alias("pass"), F.col("_r.alternatives").alias("alternatives"))


def reread(obs: DataFrame, old: Scorecards, readings: DataFrame, templates: DataFrame, overrides: DataFrame | None = None, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Scorecards, DataFrame]:
    """The second look as a whole: readings (as in recovered) of the cells of extract.reread_work, a new parse with them, taken for each card that it made better. Gives all cards, and (card_id, row, hole) of the cells read again in cards that were taken.

    A new reading joins what its cell already holds, which is read as one text: cells with nothing in them gain, a mark that wasn't a number may stay unread.
    """
    work = extract.reread_work(old.table, old.scores, old.players)
    found = keep(recovered(old.table, work, readings))
    new, better = reparse_with(obs, found, old, templates, overrides, config, keep)
    taken = keep(better.where("adopt").select("card_id"))

    def both(o: DataFrame | None, n: DataFrame | None) -> DataFrame | None:
        return None if o is None or n is None else o.join(taken, "card_id", "left_anti").unionByName(n.join(taken, "card_id", "left_semi"), allowMissingColumns=True)

    table = layout.Layout(**{f.name: both(getattr(old.table, f.name), getattr(new.table, f.name)) for f in dataclasses.fields(layout.Layout)})
    rest = {f.name: both(getattr(old, f.name), getattr(new, f.name)) for f in dataclasses.fields(Scorecards) if f.name != "table"}
    cells = readings.where(_readable()).select("card_id", "row", "hole").distinct().join(work.select("card_id", "row", "hole"), ["card_id", "row", "hole"], "left_semi").join(taken, "card_id", "left_semi")
    return Scorecards(table=table, **rest), cells


def better_reparse(old: Scorecards, new: Scorecards) -> DataFrame:
    """(card_id, adopt): a second parse is taken if it has more scores and as many holes."""
    o = old.cards.select("card_id", F.col("scored").alias("o"), F.col("hole_count").alias("oh"))
    return new.cards.join(o, "card_id").select("card_id", ((F.col("scored") > F.col("o")) & (F.col("hole_count") == F.col("oh"))).alias("adopt"))


#: Warnings that a second reading replaces.
_OWNED = ("someScoresMissing", "someScoresLowConfidence", "noPlayerRowsDetected", "incompleteRound", "playerCountNeedsConfirmation", "parRowNotFound", "handicapRowNotFound", "yardageRowNotFound", "nineHoleRoundDetected", "holeCountMismatch", "cardLikelyCropped", "remoteParserUnavailable", *report.VERDICT_KINDS.values())


def integrate(cards: Scorecards, payloads: DataFrame, config: Config = Config(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Scorecards, DataFrame]:
    """A second reading (card_id, payload JSON) audited and merged; also gives the audits. Cards without one, or without rows in it, stay as they are but for a warning."""
    head = cards.cards.select("card_id", "hole_count")
    players, scores = remote.sanitise(payloads.join(head, "card_id"))
    players, scores = keep(players), keep(scores)
    audits = keep(remote.audit(players, scores, cards.players, head, config))
    local = cards.players.select("card_id").distinct()
    touched = players.select("card_id").distinct()
    # cards without local rows adopt the remote ones
    new_players, new_scores = remote.adopt(players.join(local, "card_id", "left_anti"), scores.join(local, "card_id", "left_anti"), audits, config)
    own = cards.cards.where("selected IS NOT NULL").select("card_id", F.col("selected").alias("player_seq"))
    name = cards.players.join(own, ["card_id", "player_seq"]).select("card_id", "name")
    which = keep(remote.selected(players.join(local, "card_id", "left_semi"), name, config).join(audits.select("card_id", "remote_seq", "ceiling"), ["card_id", "remote_seq"]))
    filled = remote.fill_subtotals(cards.players, players, which.join(own, "card_id"), config)
    all_players = keep(filled.unionByName(new_players.select(filled.columns)))
    n = all_players.groupBy("card_id").agg(F.count("*").alias("n_players"), F.min("player_seq").alias("first"))
    chosen = cards.cards.select("card_id", "selected").join(n, "card_id", "left").join(local.withColumn("_local", F.lit(True)), "card_id", "left")
    chosen = chosen.select("card_id", F.coalesce("selected", F.when(F.col("_local").isNull() & (F.col("n_players") == 1), F.col("first"))).alias("player_seq"), F.coalesce("n_players", F.lit(0)).alias("n_players"))
    # cards with local rows merge the matching remote row into their holes
    merged = remote.merge(cards.holes.select("card_id", "hole", F.col("score").alias("field")), scores.join(which, ["card_id", "remote_seq"]), config)
    adopted = new_scores.join(chosen.where("player_seq IS NOT NULL").select("card_id", "player_seq"), ["card_id", "player_seq"]).select("card_id", "hole", F.col("field").alias("_new"))
    holes = cards.holes.drop("score").join(merged, ["card_id", "hole"]).join(adopted, ["card_id", "hole"], "left")
    holes = keep(holes.withColumn("score", F.when(F.col("field.provenance") == "userEdited", F.col("field")).otherwise(F.coalesce("_new", "field"))).drop("field", "_new", "updated"))
    picked = chosen.where("player_seq IS NOT NULL").select("card_id", "player_seq")
    solved, halves, support = _solve(cards.cards, holes, all_players, picked, config)
    solved = keep(solved)
    every = cards.scores.unionByName(new_scores.select(cards.scores.columns))
    back = solved.join(picked, "card_id").select("card_id", "player_seq", "hole", F.col("score").alias("_s"))
    every = every.join(back, ["card_id", "player_seq", "hole"], "left").withColumn("field", F.coalesce("_s", "field")).drop("_s")
    own = F.filter("warnings", lambda x: ~x["kind"].isin(*_OWNED))
    verdicts = report.audit_warnings(audits)
    base = cards.cards.drop("overall", "quality", "scored", "missing", "low", "support", "confirmed", "n_players", "selected").join(chosen.withColumnRenamed("player_seq", "selected"), "card_id", "left").join(support, "card_id", "left").join(verdicts, "card_id", "left").join(touched.withColumn("_hit", F.lit(True)), "card_id", "left")
    base = base.withColumn("support", F.coalesce("support", F.lit("unavailable"))).withColumn("confirmed", F.coalesce("confirmed", F.lit(0)))
    base = base.withColumn("warnings", F.concat(own, F.coalesce("audit_warnings", F.array().cast(f"array<{confidence.WARNING}>")))).drop("audit_warnings", "_hit")
    done = confidence.evaluate(base, solved, config)
    return replace(cards, cards=done, holes=solved, players=all_players, scores=every, halves=halves), audits
