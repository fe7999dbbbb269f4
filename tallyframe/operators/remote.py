"""A second reading of the same card, as JSON: made safe, audited against written totals, and merged without overruling people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fields
from tallyframe.model import Config
from tallyframe.operators import checksum, similar

PAYLOAD = "struct<courseName:string,teeName:string,players:array<struct<name:string,holes:array<struct<holeNumber:int,playerScore:int,confidence:double>>,writtenOut:int,writtenIn:int,writtenTotal:int>>>"
MOST_PLAYERS = 8


def second_readings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (filename <card_id>.json, content, error) to payloads (card_id string, payload) and what can't be used (filename, reason): files that can't be read, that aren't UTF-8, or that aren't a JSON object with a list of players."""
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "utf-8"))
    f = found.select("filename", "error", F.col("content").isNotNull().alias("read"), text.alias("payload"))
    # a kind of value other than expected becomes null, as does what is no JSON
    players = F.from_json("payload", "struct<players:array<string>>")["players"]
    why = (
        F.when(F.col("error").isNotNull() | ~F.col("read"), F.coalesce("error", F.lit("no content")))
        .when(F.col("payload").isNull(), "not UTF-8").when(players.isNull(), "not a reading")
    )
    f = f.withColumn("reason", why)
    good = f.where("reason IS NULL").select(F.regexp_replace("filename", r"\.json$", "").alias("card_id"), "payload")
    return good, f.where("reason IS NOT NULL").select("filename", "reason")


def sanitise(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads (card_id, hole_count, payload JSON) to (players, scores).

    At most eight players of a payload; holes out of range or repeated go; scores out of range are null;
    confidences are held within 0 and 1; subtotals must lie between one and fifteen a hole.
    """
    p = payloads.withColumn("p", F.from_json("payload", PAYLOAD)).where(F.col("p").isNotNull())
    who = p.select("card_id", "hole_count", F.posexplode(F.slice("p.players", 1, MOST_PLAYERS)).alias("remote_seq", "r"))
    n, nine = F.col("hole_count"), F.least(F.lit(9), F.col("hole_count"))
    within = lambda c, k: F.when(F.col(c).between(k, k * 15), F.col(c))
    players = who.select("card_id", "remote_seq", F.nullif(F.trim("r.name"), F.lit("")).alias("name"), within("r.writtenOut", nine).alias("out"), F.when(n > 9, within("r.writtenIn", n - 9)).alias("back"), within("r.writtenTotal", n).alias("total"))
    each = who.select("card_id", "remote_seq", "hole_count", F.posexplode("r.holes").alias("at", "h")).where(F.col("h.holeNumber").between(1, F.col("hole_count")))
    first = Window.partitionBy("card_id", "remote_seq", "h.holeNumber").orderBy("at")
    one = each.withColumn("k", F.row_number().over(first)).where("k = 1")
    scores = one.select("card_id", "remote_seq", F.col("h.holeNumber").alias("hole"), F.when(F.col("h.playerScore").between(1, 15), F.col("h.playerScore")).alias("value"), F.when(F.col("h.confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h.confidence")))).alias("confidence"))
    return players, scores


def pair(remote: DataFrame, local: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, remote_seq, player_seq): a card's only local player, else the most similar name if similar enough, never by position."""
    n = local.groupBy("card_id").agg(F.count("*").alias("n"), F.min("player_seq").alias("only"))
    met = remote.select("card_id", "remote_seq", "name").join(local.select("card_id", "player_seq", F.col("name").alias("l_name")), "card_id").where("name IS NOT NULL AND l_name IS NOT NULL")
    # many rows bear the same names, and likeness is what costs: each pair of names is compared once
    sims = met.join(similar.alike(met, "name", "l_name", config.remote.name), ["name", "l_name"])
    best = sims.groupBy("card_id", "remote_seq").agg(F.min_by("player_seq", F.struct(-F.col("s"), F.col("player_seq"))).alias("named"))
    return remote.select("card_id", "remote_seq").join(n, "card_id", "left").join(best, ["card_id", "remote_seq"], "left").select("card_id", "remote_seq", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("named")).alias("player_seq"))


def audit(players: DataFrame, scores: DataFrame, local: DataFrame, cards: DataFrame, config: Config = Config(), nine: int = 9) -> DataFrame:
    """(card_id, remote_seq, player_seq, name, verdict, checks, failures, ceiling, checked, failed) of every remote row.

    Strict sums of its scores are held against its own written totals and, where they were read surely enough, those of the local row it is
    paired with. checked: the sums compared; failed: the first that differs, as struct(label, sum, written). Without a name a row is called by its place.
    """
    r = config.remote
    paired = pair(players, local, config)
    n = cards.select("card_id", "hole_count")
    s = scores.join(n, "card_id")
    strict = lambda inside, k: F.when(F.count(F.when(inside, F.col("value"))) == k, F.sum(F.when(inside, F.col("value"))))
    hole, count = F.col("hole"), F.first("hole_count")
    sums = s.groupBy("card_id", "remote_seq").agg(strict(hole <= F.least(F.lit(nine), F.col("hole_count")), F.least(F.lit(nine), count)).alias("front"), F.when(count > nine, strict(hole > nine, count - nine)).alias("back"), strict(F.lit(True), count).alias("total"))
    side = lambda c: F.when(F.col(f"written_{c}.confidence") >= r.local_subtotal, F.col(f"written_{c}.value")).alias(f"l_{c}")
    own = local.select("card_id", "player_seq", side("out"), side("back"), side("total"))
    called = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("Player "), (F.col("remote_seq") + 1).cast("string")))
    both = players.select("card_id", "remote_seq", called.alias("name"), F.col("out").alias("r_out"), F.col("back").alias("r_back"), F.col("total").alias("r_total")).join(sums, ["card_id", "remote_seq"], "left").join(paired, ["card_id", "remote_seq"], "left").join(own, ["card_id", "player_seq"], "left")
    parts = (("front", "out", "front nine"), ("back", "back", "back nine"), ("total", "total", "18-hole total"))
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(a).cast("long").alias("sum"), F.col(f"{src}_{b}").cast("long").alias("written")) for a, b, label in parts for src in ("r", "l")])
    both = both.withColumn("_made", F.filter(each, lambda c: c["sum"].isNotNull() & c["written"].isNotNull()))
    both = both.withColumn("_bad", F.filter("_made", lambda c: c["sum"] != c["written"]))
    verdict = F.when(F.size("_bad") > 0, "contradicted").when(F.size("_made") > 0, "corroborated").when(F.col("total").isNull(), "rowIncomplete").otherwise("noSubtotals")
    return both.select("card_id", "remote_seq", "player_seq", "name", verdict.alias("verdict"), F.size("_made").alias("checks"), F.size("_bad").alias("failures"), checksum.ceiling(verdict, r).alias("ceiling"), F.array_distinct(F.col("_made")["label"]).alias("checked"), F.get("_bad", F.lit(0)).alias("failed"))


def merge(scores: DataFrame, remote: DataFrame, config: Config = Config()) -> DataFrame:
    """scores (card_id, hole, field) with remote (card_id, hole, value, confidence, ceiling): replaced only by a sure enough value that beats the old one by a margin; what a person set stays. `updated` where replaced."""
    r = config.remote
    conf = F.least(F.coalesce("r_conf", F.lit(r.default)), F.col("ceiling"))
    both = scores.join(remote.select("card_id", "hole", F.col("value").alias("r_value"), F.col("confidence").alias("r_conf"), "ceiling"), ["card_id", "hole"], "left")
    wins = (F.col("field.provenance") != "userEdited") & F.col("r_value").between(1, 15) & (conf >= r.least) & (F.col("field.value").isNull() | (conf >= F.col("field.confidence") + r.margin))
    wins = F.coalesce(wins, F.lit(False))
    return both.select("card_id", "hole", F.when(wins, fields.make_field(F.col("r_value"), conf, "multimodalFallback", F.col("field.raw_text"))).otherwise(F.col("field")).alias("field"), wins.alias("updated"))


def adopt(players: DataFrame, scores: DataFrame, audits: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """For cards without local rows: remote rows with any score become players, confidences under the row's ceiling."""
    r = config.remote
    useful = scores.where("value IS NOT NULL").select("card_id", "remote_seq").distinct()
    kept = players.join(useful, ["card_id", "remote_seq"], "left_semi").join(audits.select("card_id", "remote_seq", "ceiling"), ["card_id", "remote_seq"])
    seq = F.row_number().over(Window.partitionBy("card_id").orderBy("remote_seq")) - 1
    ranked = kept.withColumn("player_seq", seq)
    sub = lambda c: F.when(F.col(c).isNotNull(), fields.make_field(F.col(c), F.least(F.lit(r.subtotal), F.col("ceiling")), "multimodalFallback")).otherwise(fields.empty_field()).alias(f"written_{c}")
    who = ranked.select("card_id", "player_seq", "name", F.lit(None).cast("int").alias("source_row"), F.least(F.col("ceiling"), F.lit(r.row)).alias("row_confidence"), sub("out"), sub("back"), sub("total"), F.concat(F.lit("Player "), (F.col("player_seq") + 1).cast("string")).alias("label"))
    read = scores.join(ranked.select("card_id", "remote_seq", "player_seq", "ceiling"), ["card_id", "remote_seq"])
    field = F.when(F.col("value").isNotNull(), fields.make_field(F.col("value"), F.least(F.coalesce("confidence", F.lit(r.default)), F.col("ceiling")), "multimodalFallback")).otherwise(fields.empty_field())
    return who, read.select("card_id", "player_seq", "hole", field.alias("field"))


def fill_subtotals(local: DataFrame, players: DataFrame, pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """Written totals that the selected local row lacks, from its remote row. pairs: card_id, remote_seq, player_seq, ceiling."""
    r = config.remote
    p = players.join(pairs.where("player_seq IS NOT NULL").select("card_id", "remote_seq", "player_seq", "ceiling"), ["card_id", "remote_seq"])
    one = p.withColumn("k", F.row_number().over(Window.partitionBy("card_id", "player_seq").orderBy("remote_seq"))).where("k = 1").select("card_id", "player_seq", "ceiling", *[F.col(c).alias(f"_{c}") for c in ("out", "back", "total")])
    fill = lambda c: F.when(F.col(f"written_{c}.value").isNull() & F.col(f"_{c}").isNotNull(), fields.make_field(F.col(f"_{c}"), F.least(F.lit(r.subtotal), F.col("ceiling")), "multimodalFallback")).otherwise(F.col(f"written_{c}")).alias(f"written_{c}")
    return local.join(one, ["card_id", "player_seq"], "left").select(*[c for c in local.columns if not c.startswith("written_")], fill("out"), fill("back"), fill("total"))


def selected(players: DataFrame, local_selected: DataFrame, config: Config = Config()) -> DataFrame:
    """(card_id, remote_seq): of each card with local rows, the remote row most like the selected one by name, else the first."""
    both = players.join(local_selected.select("card_id", F.col("name").alias("l_name")), "card_id", "left")
    both = both.join(similar.alike(both, "name", "l_name", config.remote.name), ["name", "l_name"], "left")
    return both.groupBy("card_id").agg(F.coalesce(F.min(F.when(F.col("s").isNotNull(), F.struct((-F.col("s")).alias("s"), "remote_seq")))["remote_seq"], F.min("remote_seq")).alias("remote_seq"))


def merge_passes(first: DataFrame, second: DataFrame, least: float = 0.35) -> DataFrame:
    """Two recognitions of one card: pairs overlapping enough are one observation; the rest of both stays.

    Of a pair, what alone reads as a number wins; of two numbers the numeric pass's, unless it is much less sure; of two words the surer.
    Pairs are taken greedily in the first pass's order, each side once.
    """
    from tallyframe.functions import numeric
    from tallyframe.operators import overlaps

    b = second.select("card_id", *[F.col(c).alias(f"n_{c}") for c in second.columns if c != "card_id"])
    taken = overlaps.matched(overlaps.overlapping(first, second, least)).select("card_id", F.col("l").alias("obs_seq"), F.col("r").alias("n_obs_seq"))
    both = first.join(taken, ["card_id", "obs_seq"], "left").join(b, ["card_id", "n_obs_seq"], "left")
    mine, theirs = numeric.looks_numeric(F.col("text")), numeric.looks_numeric(F.col("n_text"))
    sure = F.when(mine, F.col("n_confidence") >= F.col("confidence") * 0.85).otherwise(True)
    use = F.col("n_text").isNotNull() & F.when(theirs, sure).otherwise(~mine & (F.col("n_confidence") > F.col("confidence")))
    merged = both.select("card_id", "obs_seq", *[F.when(use, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c not in ("card_id", "obs_seq")])
    left = second.join(taken.select("card_id", F.col("n_obs_seq").alias("obs_seq")), ["card_id", "obs_seq"], "left_anti").withColumn("obs_seq", F.col("obs_seq") + 1_000_000)
    return merged.unionByName(left)
