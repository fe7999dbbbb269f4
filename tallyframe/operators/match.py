"""Which layout a card shows: evidence of names and sequences against every template, ranked and resolved; then which tee."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import numeric
from tallyframe.functions.text import joined_fragments, matchable_names, name_similarity, normalize_name
from tallyframe.model import Config
from tallyframe.operators import similar
from tallyframe.operators.sequences import compare
from tallyframe.sources import catalog


def name_scores(fragments: DataFrame, templates: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, template_id, name_score, fragment): the best similarity of any fragment, or run of up to three, with any of a template's names; absent below the floor."""
    telling = F.filter("fragments", lambda f: normalize_name(f) != "")
    pieces = fragments.select("card_id", F.explode(joined_fragments(telling)).alias("fragment")).distinct()
    names = templates.select("template_id", F.explode(matchable_names(F.col("name"), F.col("facility"), F.col("layout"), F.col("aliases"))).alias("printed"))
    # similarity is worked out once for each distinct pair of texts, not for each card
    sims = similar.by_name(pieces, "fragment", names, "printed", config.matching.name_floor).withColumnRenamed("similarity", "s")
    hit = pieces.join(sims, "fragment").join(names, "printed")
    return hit.groupBy("card_id", "template_id").agg(F.max("s").alias("name_score"), F.max_by("fragment", F.struct("s", "printed")).alias("fragment"))


def tee_matches(static: DataFrame, templates: DataFrame) -> DataFrame:
    """(card_id, seq, printed, template_id, tee_seq, tee, tee_total, score, coverage, compared): every printed yardage row against every tee."""
    t = catalog.tees(templates)
    seen = static.where("signal = 'yardage'").select("card_id", "seq", F.col("tee").alias("printed"), "hole", "value")
    known = t.where("yards IS NOT NULL").groupBy("template_id", "tee_seq").agg(F.count("*").alias("n_known"))
    pairs = seen.join(t, "hole").withColumn("expected", F.col("yards"))
    by = ["card_id", "seq", "printed", "template_id", "tee_seq", "tee", "tee_total"]
    c = compare(pairs, by, yardages=True).where("compared > 0").join(known, ["template_id", "tee_seq"])
    return c.withColumn("coverage", F.col("compared") / F.col("n_known"))


def score_templates(cards: DataFrame, static: DataFrame, totals: DataFrame, fragments: DataFrame, templates: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, template_id, template_seq, score, evidence, name_score, best_tee, ...): weighted over the signals that speak; cards times the bounded dimension of templates."""
    m = config.matching
    dim = templates.select("template_id", "template_seq", "hole_count", F.size("pars").alias("n_pars"), "pars")
    base = cards.select("card_id", F.col("distinct_holes").alias("detected")).crossJoin(dim)
    h = catalog.holes(templates)
    known = h.groupBy("template_id").agg(F.count("par").alias("known_par"), F.count("stroke_index").alias("known_index"))
    long = static.where(F.col("signal").isin("par", "handicap")).select("card_id", "signal", "hole", "value").join(h, "hole")
    long = long.withColumn("expected", F.when(F.col("signal") == "par", F.col("par")).otherwise(F.col("stroke_index")))
    c = compare(long, ["card_id", "template_id", "signal"]).join(known, "template_id").withColumn("weighted", F.col("score") * F.col("compared") / F.when(F.col("signal") == "par", F.col("known_par")).otherwise(F.col("known_index")))
    seqs = c.where(F.col("compared") >= m.least_compared).groupBy("card_id", "template_id").agg(F.max(F.when(F.col("signal") == "par", F.col("weighted"))).alias("par_score"), F.max(F.when(F.col("signal") == "handicap", F.col("weighted"))).alias("index_score"))
    tee = tee_matches(static, templates).where(F.col("compared") >= m.least_yards)
    bonus = F.coalesce(name_similarity(F.col("printed"), F.col("tee")) >= 0.7, F.lit(False))
    adjusted = F.when(bonus, F.least(F.lit(1.0), F.col("score") + m.tee_bonus)).otherwise(F.col("score")) * F.col("coverage")
    best = tee.withColumn("a", adjusted).where("a > 0").groupBy("card_id", "template_id").agg(F.max("a").alias("yard_score"), F.min_by("tee", F.struct(-F.col("a"), F.col("seq"), F.col("tee_seq"))).alias("best_tee"))
    names = name_scores(fragments, templates, config)
    full = base.join(names, ["card_id", "template_id"], "left").join(seqs, ["card_id", "template_id"], "left").join(best, ["card_id", "template_id"], "left").join(totals.select("card_id", F.col("total").alias("printed_total")), "card_id", "left")
    signals = (("name_score", m.name), ("par_score", m.par), ("index_score", m.index), ("yard_score", m.yards))
    used = sum((F.when(F.col(s).isNotNull(), w).otherwise(0.0) for s, w in signals), F.lit(0.0))
    got = sum((F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    raw = F.when(used > 0, got / F.when(used > 0, used)).otherwise(0.0)
    mismatch = (F.col("hole_count") > 0) & F.col("detected").isNotNull() & (F.col("detected") != F.col("hole_count"))
    raw = F.when(mismatch, raw * m.hole_mismatch).otherwise(raw)
    expected = F.when((F.col("n_pars") > 0) & F.forall("pars", lambda p: p.isNotNull()), F.aggregate("pars", F.lit(0), lambda a, p: a + p))
    total = F.when(F.col("printed_total").isNotNull() & (expected > 0), numeric.total_similarity(F.col("printed_total"), expected))
    score = F.when(total.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + (total - 0.5) * m.total_par))).otherwise(raw)
    return full.select("card_id", "template_id", "template_seq", score.alias("score"), (used / (m.name + m.par + m.yards + m.index)).alias("evidence"), F.coalesce("name_score", F.lit(0.0)).alias("name_score"), "fragment", "par_score", "index_score", "yard_score", "best_tee", (~mismatch).alias("hole_count_matches"))


def resolve(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, resolution, template_id, score, best_tee, alternates): confident, ambiguous or noMatch, for every card scored."""
    m = config.matching
    rank = Window.partitionBy("card_id").orderBy(F.desc("score"), "template_seq")
    top = scored.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= m.kept)
    plausible = F.col("score") >= m.plausible
    at = lambda n, c: F.max(F.when((F.col("k") == n) & plausible, F.col(c)))
    first, second = at(1, "score"), at(2, "score")
    strong = (first >= m.confident) & (second.isNull() | (first - second > m.margin)) & ((at(1, "evidence") >= m.evidence) | (at(1, "name_score") >= m.strong_name))
    listed = F.transform(F.array_sort(F.collect_list(F.when(plausible, F.struct("k", "template_id")))), lambda s: s["template_id"])
    out = top.groupBy("card_id").agg(F.when(first.isNull(), "noMatch").when(strong, "confident").otherwise("ambiguous").alias("resolution"), at(1, "template_id").alias("template_id"), F.coalesce(first, F.lit(0.0)).alias("score"), at(1, "best_tee").alias("best_tee"), listed.alias("candidates"))
    sure = F.col("resolution") == "confident"
    return out.select("card_id", "resolution", F.when(sure, F.col("template_id")).alias("template_id"), "score", F.when(sure, F.col("best_tee")).alias("best_tee"), F.when(~sure, F.col("candidates")).otherwise(F.array().cast("array<string>")).alias("alternates"))


def force(resolved: DataFrame, overrides: DataFrame | None, templates: DataFrame) -> DataFrame:
    """A forced template (card_id, forced_template_id, forced_tee_name) of the dimension takes the place of the match, with confidence 1."""
    if overrides is None:
        return resolved.withColumn("forced_tee", F.lit(None).cast("string"))
    ids = templates.select(F.col("template_id").alias("_id"))
    f = overrides.join(ids, F.col("forced_template_id") == F.col("_id"), "left").select("card_id", "_id", F.col("forced_tee_name").alias("forced_tee"))
    hit = F.col("_id").isNotNull()
    both = resolved.join(f, "card_id", "left")
    return both.select("card_id", F.when(hit, "forced").otherwise(F.col("resolution")).alias("resolution"), F.coalesce("_id", "template_id").alias("template_id"), F.when(hit, 1.0).otherwise(F.col("score")).alias("score"), F.when(~hit, F.col("best_tee")).alias("best_tee"), F.when(hit, F.array().cast("array<string>")).otherwise(F.col("alternates")).alias("alternates"), "forced_tee")


def resolve_tees(resolved: DataFrame, static: DataFrame, printed: DataFrame, templates: DataFrame, least: float = 0.55, least_compared: int = 3) -> DataFrame:
    """resolved with tee, tee_confidence and tee_warning."""
    tees = catalog.tees(templates).select("template_id", "tee_seq", "tee", "tee_total").distinct()
    has = tees.select("template_id").distinct().withColumn("has_tees", F.lit(True))
    base = resolved.join(has, "template_id", "left").join(printed.where("seq = 0").select("card_id", F.col("tee").alias("first_printed")), "card_id", "left")
    m = tee_matches(static, templates).where(F.col("compared") >= least_compared).withColumn("w", F.col("score") * F.col("coverage"))
    good = m.join(resolved.select("card_id", "template_id"), ["card_id", "template_id"]).groupBy("card_id", "tee", "tee_seq", "tee_total").agg(F.max("w").alias("w")).where(F.col("w") >= least)
    middle = good.groupBy("card_id").agg(F.count("*").alias("n_good"), F.array_sort(F.collect_list(F.struct(F.coalesce("tee_total", F.lit(0)).alias("t"), "tee_seq", "tee"))).alias("by_length"))
    named = printed.join(resolved.select("card_id", "template_id"), "card_id").join(tees.select("template_id", "tee_seq", F.col("tee").alias("t_tee")), "template_id").where(name_similarity(F.col("tee"), F.col("t_tee")) >= 0.7)
    by_name = named.groupBy("card_id").agg(F.min(F.struct("seq", "tee_seq", "t_tee"))["t_tee"].alias("named_tee"))
    full = base.join(middle, "card_id", "left").join(by_name, "card_id", "left")
    n, forced = F.coalesce("n_good", F.lit(0)), F.col("forced_tee")
    applied, has_tees = F.col("template_id").isNotNull(), F.coalesce("has_tees", F.lit(False))
    mid = F.get(F.col("by_length"), F.floor(F.size("by_length") / 2).cast("int"))["tee"]
    make = lambda tee, conf, warn=None: F.struct((tee if not isinstance(tee, str) else F.col(tee)).alias("tee"), (conf if not isinstance(conf, float) else F.lit(conf)).alias("tee_confidence"), F.lit(warn).cast("string").alias("tee_warning"))
    none = F.lit(None).cast("string")
    suggestion = make("best_tee", F.when(F.col("best_tee").isNotNull(), 0.3).otherwise(0.0), "teeNotIdentified")
    choice = (
        F.when(forced.isNotNull(), make(forced, 1.0))
        .when(~applied | ~has_tees, F.when(F.col("first_printed").isNotNull(), make("first_printed", 0.7)).otherwise(make(none, 0.0)))
        .when((n == 0) & F.col("named_tee").isNotNull(), make("named_tee", 0.55)).when(n == 0, suggestion)
        .when(n == 1, make(mid, 0.90)).otherwise(make(mid, 0.30, "multipleTeeMatches"))
    )
    return full.withColumn("t", choice).select(*resolved.columns, "t.tee", "t.tee_confidence", "t.tee_warning")


def printed_row(cards: DataFrame, static: DataFrame) -> DataFrame:
    """(card_id, tee_seq): the printed yardage row that bears the chosen tee's name, else the first."""
    rows = static.where("signal = 'yardage'").select("card_id", "seq", F.col("tee").alias("printed")).distinct()
    like = F.coalesce(name_similarity(F.col("printed"), F.col("tee")) >= 0.7, F.lit(False))
    return rows.join(cards.select("card_id", "tee"), "card_id").groupBy("card_id").agg(F.min(F.struct((~like).alias("other"), "seq"))["seq"].alias("tee_seq"))
