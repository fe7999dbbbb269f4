"""What a row of numbers is: its numeric signature, its label, and the role that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import normalize_label

# Labels as printed, in normal form, in order of precedence.
LABELS = {
    "hole": ("HOLE", "HOLES", "HOLENO", "HOLENUMBER", "HOLE1", "H"),
    "par": ("PAR", "PARS", "MENSPAR", "PARMEN", "MENPAR", "LADIESPAR", "WOMENSPAR", "PARWOMEN"),
    "handicap": ("HCP", "HDCP", "HDP", "HCAP", "HANDICAP", "HANDICAPS", "SI", "STROKEINDEX", "STROKE", "INDEX", "MENSHCP", "HCPMEN", "MENHCP", "HANDICAPMEN"),
    "out": ("OUT", "FRONT", "FRONT9", "FRONTNINE", "FRONT9TOTAL", "OUT9", "FRONTTOTAL"),
    "in": ("IN", "BACK", "BACK9", "BACKNINE", "BACK9TOTAL", "IN9", "BACKTOTAL"),
    "total": ("TOT", "TOTAL", "TOTALS", "TTL", "GROSS", "GROSSSCORE", "TOTALSCORE", "GRANDTOTAL"),
}
# Tee names, coloured ones first.
TEE_COLOURS = ("BLACK", "BLUE", "WHITE", "RED", "GOLD", "GREEN", "SILVER", "BRONZE", "COPPER", "ORANGE", "YELLOW", "PURPLE", "MAROON")
TEE_WORDS = ("CHAMPIONSHIP", "CHAMP", "TIPS", "TOURNAMENT", "PRO", "MENS", "MEN", "REGULAR", "MIDDLE", "SENIOR", "SENIORS", "LADIES", "LADY", "WOMENS", "WOMEN", "FORWARD", "JUNIOR", "EXECUTIVE")
# Words that decorate a tee's name.
DECORATIONS = ("TEE", "TEES", "YARDS", "YARDAGE", "YDS", "YD", "YARD")


def match_token(token: Column) -> Column:
    """The kind of one normalised token: a label's, `tee`, or null."""
    out = F.when(token.isin(*TEE_COLOURS, *TEE_WORDS), "tee")
    for kind, names in reversed(LABELS.items()):
        out = F.when(token.isin(*names), kind).otherwise(out)
    return out


def match_label(tokens: Column) -> Column:
    """struct(kind, tee) of a row's label tokens: the first label that is no tee, else the first tee, else what they spell together."""
    normal = F.filter(F.transform(tokens, normalize_label), lambda t: (t != "") & ~t.isin(*DECORATIONS))
    kinds = F.filter(F.transform(normal, lambda t: F.struct(match_token(t).alias("kind"), t.alias("token"))), lambda s: s["kind"].isNotNull())
    plain = F.get(F.filter(kinds, lambda s: s["kind"] != "tee"), F.lit(0))
    tee = F.get(kinds, F.lit(0))
    joined = F.array_join(normal, "")
    best = F.coalesce(plain, tee, F.when(match_token(joined).isNotNull(), F.struct(match_token(joined).alias("kind"), joined.alias("token"))))
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), F.when(best["kind"] == "tee", F.initcap(F.lower(best["token"]))).alias("tee")))


def looks_like_player(tokens: Column) -> Column:
    normal = F.filter(F.transform(tokens, normalize_label), lambda t: t != "")
    none_known = F.forall(normal, lambda t: match_token(t).isNull() & ~t.isin(*DECORATIONS))
    return (F.size(normal) > 0) & none_known & F.exists(normal, lambda t: (F.length(t) >= 2) & t.rlike(r"^\p{L}+$"))


def clean_player_name(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    fits = (F.length(t) >= 2) & match_token(normalize_label(t)).isNull() & (F.regexp_count(t, F.lit(r"\p{L}")) >= 2)
    return F.when(fits, t)


def numeric_signature(v: Column) -> dict[str, Column]:
    """Aggregates over a row's readable values: how much they look like yardages, pars, stroke indexes, scores."""
    n = F.count(v)
    share = lambda c: F.count(F.when(c, F.lit(1))) / F.when(n > 0, n)
    distinct = F.count_distinct(v)
    spread = F.least(F.lit(1.0), (F.max(v) - F.min(v)) / F.greatest(F.lit(1), n - 1))
    yardage = share(v.between(60, 750)) * F.when(F.count(F.when(v >= 100, F.lit(1))) == 0, 0.25).otherwise(1.0)
    par = share(v.between(3, 6)) * F.when(F.count(F.when(~v.between(3, 6), F.lit(1))) > 0, 0.6).otherwise(1.0)
    index = share(v.between(1, 18)) * (distinct / F.when(n > 0, n)) * spread
    permuted = (n >= 9) & (distinct == n) & (F.min(v) >= 1) & (F.max(v) <= 18)
    score = share(v.between(1, 15)) * F.when(F.max(v) > 15, 0.3).otherwise(1.0)
    whole = lambda c: F.coalesce(F.least(F.lit(1.0), c), F.lit(0.0))
    return {"n": n, "yardage": whole(yardage), "par": whole(par), "handicap": whole(F.when(permuted, F.least(F.lit(1.0), index + 0.25)).otherwise(index)), "score": whole(score)}


def classify(label: Column, tokens: Column, n: Column, yardage: Column, par: Column, handicap: Column, score: Column, confidence: Column, uniformity: Column) -> Column:
    """struct(role, payload, confidence): the label first, unless there is none; then the most conclusive signature."""
    make = lambda role, conf, payload=None: F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), (F.lit(None).cast("string") if payload is None else payload).alias("payload"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"))
    kind, bare = label["kind"], n == 0
    agrees = lambda x: F.when(bare, F.greatest(x, F.lit(0.5))).otherwise(x) * 0.28 + 0.70
    player = F.when(looks_like_player(tokens), F.array_join(tokens, " "))
    printed = F.when(confidence >= 0.72, 0.5).otherwise(0.0) + uniformity * 0.5
    named = F.when(player.isNotNull(), make("player", 0.6, player)).when(printed >= 0.6, make("par", 0.32)).otherwise(make("player", 0.32))
    return (
        F.when(kind == "hole", make("holeHeader", 0.95))
        .when(kind == "par", make("par", agrees(par)))
        .when(kind == "handicap", make("handicap", agrees(handicap)))
        .when((kind == "tee") & (bare | (yardage < 0.35)), make("metadata", 0.55))
        .when(kind == "tee", make("yardage", yardage * 0.28 + 0.70, label["tee"]))
        .when(kind.isNotNull(), make("metadata", 0.4))
        .when(bare, make("unknown", 0.0))
        .when(yardage >= 0.6, make("yardage", yardage * 0.35 + 0.45))
        .when((handicap >= 0.85) & (n >= 9), make("handicap", handicap * 0.40 + 0.40))
        .when((par >= 0.5) | (score >= 0.5), named)
        .when(player.isNull(), make("unknown", 0.1))
        .otherwise(make("player", 0.45, player))
    )
