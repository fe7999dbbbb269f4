"""Names met by similarity, without meeting every name: an inverted index of bigrams that loses no pair above a floor.

A pair with edit share 1 - d / n >= floor (n: the longer length) is at most k(n) = (1 - floor) n edits apart, and
each edit touches two of the n + 1 bigrams of the padded text. So such a pair

- differs in length by k(n) at most (texts meet in bands of geometric length, own and neighbouring ones),
- shares n + 1 - 2 k(n) bigrams at least, counting repeats (count filter), and therefore
- shares one of the rarest 2 k(n) + 1 bigrams of either (prefix filter): only those are posted in the index.

Repeats of a bigram are told apart by their number, so counts are exact; places aren't compared, because equal
numbers may stand further apart than the edits. A pair is taken where the index meets it first, so nothing is made
distinct afterwards. The token part of a name's similarity needs one token pair above the floor: the same index
over distinct tokens, then the names that bear them, kept where the bound of the whole score still reaches the floor.

Texts are worked on once for each distinct normal form. Empty normal forms have no similarity and meet nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import edit_share, name_similarity, normalize_name, token_share, tokens_of
from tallyframe.lineage import cut

#: Below this floor the count filter lets everything through.
LEAST_FLOOR = 0.52
#: Distinct names that are sent to all texts; an index serves more.
FEW = 256
#: Floors that the closest names are looked for under before the given one. Near the top few pairs meet, even among names that are all alike.
FLOORS = (0.9, 0.8, 0.7)


def once(value: Column) -> Column:
    """The value as a generator of one row: it is worked out once a row, where it stands. A filter on a plain column would carry its whole expression below the distinct or the join before it, onto every row there."""
    return F.explode(F.array(value))


def alike(pairs: DataFrame, left: str, right: str, floor: float) -> DataFrame:
    """(left, right, s): of the pairs of texts in the rows, each compared once, those whose name similarity s is floor or more."""
    return pairs.select(left, right).distinct().select(left, right, once(name_similarity(F.col(left), F.col(right))).alias("s")).where(F.col("s") >= floor)


def _edits(n: Column, floor: float) -> Column:
    """Edits that a pair may differ by; n: the longer length."""
    return F.floor(n * (1 - floor) + 1e-9).cast("int")


def _grams(form: Column) -> Column:
    """Hashes of the bigrams of the padded form, each with its number among equal ones."""
    padded = F.concat(F.lit("\u0002"), form, F.lit("\u0003"))
    two = F.transform(F.sequence(F.lit(1), F.length(form) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(two, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(two, F.lit(1), i), lambda h: h == g))))


def _posted(n: Column, floor: float) -> Column:
    """Rarest bigrams to post for a form of length n: enough for a partner of any length it may have."""
    partners = F.sequence(n, F.floor(n / floor + 1e-9).cast("int"))
    return F.greatest(F.lit(1), F.least(n + 1, F.array_max(F.transform(partners, lambda m: n - m + 2 * _edits(m, floor) + 1))))


def _band(n: Column, floor: float) -> Column:
    return F.floor(F.log(n) / (math.log(1 / floor) + 1e-6)).cast("int")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as can run: rows are small and their work is not, so sizes would put them in too few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """left, right: (form), distinct and not empty. The pairs (l, r) that pass the filters: all within the floor, and some others."""
    if floor < LEAST_FLOOR:
        raise ValueError(f"the index works from a floor of {LEAST_FLOOR}")
    sides = left.select("form", F.lit(0).alias("side")).unionByName(right.select("form", F.lit(1).alias("side")))
    one = sides.groupBy("form").agg(F.collect_set("side").alias("sides")).withColumn("n", F.length("form")).withColumn("grams", _grams(F.col("form")))
    often = one.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))  # a row for each pair of characters and its number
    ranked = one.select("form", F.explode("grams").alias("gram")).join(often, "gram").groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "gram"))), lambda x: x["gram"]).alias("grams"))
    posted = ranked.join(one.select("form", "sides", "n"), "form").withColumn("prefix", F.slice("grams", F.lit(1), _posted(F.col("n"), floor))).withColumn("band", _band(F.col("n"), floor))
    row = lambda side, bands, c: posted.where(F.array_contains("sides", side)).select(F.col("form").alias(c), F.col("n").alias(f"{c}_n"), F.col("grams").alias(f"{c}_grams"), F.col("prefix").alias(f"{c}_prefix"), F.explode(bands).alias("band")).select("*", F.explode(f"{c}_prefix").alias("gram"))
    near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    met = _spread(row(0, near, "l"), "gram", "band").join(_spread(row(1, F.array("band"), "r"), "gram", "band"), ["gram", "band"])
    longer = F.greatest("l_n", "r_n")
    k = _edits(longer, floor)
    first = F.get(F.array_intersect("l_prefix", "r_prefix"), F.lit(0)) == F.col("gram")
    return met.where((F.abs(F.col("l_n") - F.col("r_n")) <= k) & first).where(F.size(F.array_intersect("l_grams", "r_grams")) >= longer + 1 - 2 * k).select("l", "r")


def close_forms(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(l, r, share): the pairs of forms with an edit share of floor or more."""
    return candidates(left, right, floor).withColumn("share", F.when(F.col("l") == F.col("r"), 1.0).otherwise(edit_share(F.col("l"), F.col("r")))).where(F.col("share") >= floor)


def _forms(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(text, form) of distinct texts, and their distinct forms; forms that are empty go."""
    texts = df.select(F.col(text).alias("text")).distinct().select("text", once(normalize_name(F.col("text"))).alias("form")).where("form <> ''")
    return texts, texts.select("form").distinct()


def _named(scored: DataFrame, texts: DataFrame, names: DataFrame, left: str, right: str) -> DataFrame:
    found = scored.join(texts.select(F.col("text").alias(left), F.col("form").alias("l")), "l").join(names.select(F.col("text").alias(right), F.col("form").alias("r")), "r")
    return found.select(left, right, "similarity")


def by_characters(texts: DataFrame, left: str, names: DataFrame, right: str, floor: float) -> DataFrame:
    """(left, right, similarity): distinct texts and names whose character similarity is floor or more."""
    (t, tf), (n, nf) = _forms(texts, left), _forms(names, right)
    return _named(close_forms(tf, nf, floor).withColumnRenamed("share", "similarity"), t, n, left, right)


def token_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs (l, r) of forms with similar tokens, as far as the bound of the whole score reaches the floor."""
    side = lambda df, c: df.select(F.col("form").alias(c), F.length("form").alias(f"{c}_n"), tokens_of(F.col("form")).alias("tokens")).select(c, f"{c}_n", F.size("tokens").alias(f"{c}_size"), F.posexplode("tokens").alias(f"{c}_at", f"{c}_token"))
    a, b = side(left, "l"), side(right, "r")
    alike = close_forms(a.select(F.col("l_token").alias("form")).distinct(), b.select(F.col("r_token").alias("form")).distinct(), floor)
    met = a.join(alike.select(F.col("l").alias("l_token"), F.col("r").alias("r_token")), "l_token").join(b, "r_token")
    pairs = met.groupBy("l", "r", "l_n", "r_n", "l_size", "r_size").agg(F.size(F.collect_set("l_at")).alias("l_met"), F.size(F.collect_set("r_at")).alias("r_met"))
    most = lambda c: (F.col(f"{c}_met") + (F.col(f"{c}_size") - F.col(f"{c}_met")) * floor) / F.col(f"{c}_size")
    tokens, characters = (most("l") + most("r")) / 2, F.least("l_n", "r_n") / F.greatest("l_n", "r_n")
    # where characters are more alike than tokens, the character index has the pair
    return pairs.where(tokens * 0.7 + F.least(tokens, characters) * 0.3 >= floor - 1e-9).select("l", "r")


def _scored(pairs: DataFrame, floor: float) -> DataFrame:
    """Name similarity of pairs (l, r) of forms, as far as it reaches the floor. Tokens are cut once for each pair."""
    x, y = F.col("l"), F.col("r")
    cut = pairs.select("l", "r", once(F.struct(F.when(x == y, 1.0).otherwise(edit_share(x, y)).alias("c"), tokens_of(x).alias("lt"), tokens_of(y).alias("rt"))).alias("_p"))
    each = cut.select("l", "r", "_p.c", once(token_share(F.col("_p.lt"), F.col("_p.rt"))).alias("t"))
    return each.withColumn("similarity", F.greatest("c", "t") * 0.7 + F.least("c", "t") * 0.3).where(F.col("similarity") >= floor)


def by_name(texts: DataFrame, left: str, names: DataFrame, right: str, floor: float, few: int = FEW) -> DataFrame:
    """(left, right, similarity): distinct texts and names whose name similarity is floor or more.

    Up to `few` forms of names are counted and sent to the texts, each of which meets them all; more go through the index.
    """
    (t, tf), (n, nf) = _forms(texts, left), _forms(names, right)
    if nf.limit(few + 1).count() <= few:
        met = tf.withColumnRenamed("form", "l").join(F.broadcast(nf.withColumnRenamed("form", "r")))
    else:
        met = _spread(candidates(tf, nf, floor).unionByName(token_candidates(tf, nf, floor)), "l", "r").distinct()
    return _named(_scored(met, floor), t, n, left, right)


def closest(texts: DataFrame, left: str, names: DataFrame, right: str, floor: float, few: int = FEW) -> DataFrame:
    """(left, right, similarity): for each distinct text the name of the highest character similarity, the first by name of equals. Null texts and names take no part.

    Up to `few` forms of names are counted and sent to the texts. More are met by the index under floors that fall to the given one: where a floor finds
    anything, it has the best, so only texts without a name above it go on to the next. Those without any meet all names.
    """
    formed = lambda df, c, form: df.select(c).where(F.col(c).isNotNull()).distinct().select(c, once(normalize_name(F.col(c))).alias(form))
    t, n = cut(formed(texts, left, "l")), cut(formed(names, right, "r").groupBy("r").agg(F.min(right).alias("name")))
    best = lambda pairs: pairs.groupBy("l").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("b")).select("l", F.col("b.name").alias(right), (-F.col("b.s")).alias("similarity"))
    share = F.when((F.length("l") == 0) | (F.length("r") == 0), 0.0).when(F.col("l") == F.col("r"), 1.0).otherwise(edit_share(F.col("l"), F.col("r")))
    rest = t.select("l").distinct()
    if n.limit(few + 1).count() <= few:
        found = best(_spread(rest, "l").join(F.broadcast(n)).withColumn("similarity", share))
    else:
        forms = n.where("r <> ''").select(F.col("r").alias("form"))
        found = cut(best(rest.where("l <> ''").join(n, F.col("l") == F.col("r")).withColumn("similarity", F.lit(1.0))))
        left_over = lambda: cut(rest.join(found, "l", "left_anti"))
        rest = left_over()
        for f in (*[f for f in FLOORS if f > floor], floor):
            if rest.isEmpty():
                break
            near = close_forms(rest.where("l <> ''").select(F.col("l").alias("form")), forms, f)
            found = cut(found.unionByName(best(near.join(n, "r").withColumnRenamed("share", "similarity"))))
            rest = left_over()
        if not rest.isEmpty():
            found = found.unionByName(best(rest.join(n).withColumn("similarity", share)))
    return t.join(found, "l").select(left, right, "similarity")
