import functools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import similar

SYLLABLES = "an bel cor dun el far gle hol in jor kin lo mar nor ost pel qui ram sol tor ul ver wil xan yor zel bra cre dri fle".split()


def made(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add(" ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))))
    return sorted(out)


def damaged(name, seed):
    r = random.Random(seed)
    s = list(name)
    for _ in range(r.randint(0, 1 + len(s) // 4)):
        at, what = r.randrange(len(s)), r.random()
        s[at : at + 1] = [] if what < 0.3 else [r.choice("aeiorst ")] if what < 0.7 else [s[at], r.choice("aeiorst")]
        s = s or ["a"]
    return "".join(s)


@pytest.fixture(scope="module")
def sides(spark):
    names = made(150, 1) + ["Steel Canyon Golf Club", "The Golf Club", "Château Élan", "a", "ab", "aaaaaaaaaa", "aaaaaabaaa", "Bear's Best", "!!", "North", "x y z", "golf"]
    texts = [damaged(n, i) for i, n in enumerate(names)] + made(60, 2) + ["STEE CANYQN GOLE CLUB", "canyon steel", "Chateau elan golf", "", None, "?", "aaaaaaaaab", "best bear", "golf club", "b"]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    return frame(texts * 2, "seen"), frame(names, "name")


def rows(frame):
    return sorted((r.seen, r.name, round(r.similarity, 9)) for r in frame.collect())


@pytest.mark.parametrize("floor", [0.62, 0.9])
@pytest.mark.parametrize("how, measure", [(similar.by_characters, text.character_similarity), (similar.by_name, text.name_similarity)])
def test_same_rows_as_all_pairs(sides, how, measure, floor):
    texts, names = sides
    every = texts.distinct().crossJoin(names).withColumn("similarity", measure(F.col("seen"), F.col("name")))
    want = rows(every.where((F.col("similarity") >= floor) & (text.normalize_name(F.col("seen")) != "")))
    if how is similar.by_name:
        assert rows(how(texts, "seen", names, "name", floor, few=1000)) == want  # all names sent to the texts
        how = functools.partial(how, few=0)
    assert rows(how(texts, "seen", names, "name", floor)) == want and len(want) > (100 if floor < 0.8 else 10)


def test_closest_is_the_best_of_all(sides):
    texts, names = sides
    every = texts.distinct().where("seen IS NOT NULL").crossJoin(names).withColumn("similarity", text.character_similarity(F.col("seen"), F.col("name")))
    want = every.groupBy("seen").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("b")).select("seen", "b.name", (-F.col("b.s")).alias("similarity"))
    assert rows(similar.closest(texts.where("seen IS NOT NULL"), "seen", names, "name", 0.62)) == rows(want)


@pytest.mark.parametrize("few", [0, 1000])
def test_closest_by_index_and_by_all_names(sides, few):
    """Null texts and names take no part, by either way."""
    texts, names = sides
    names = names.unionByName(names.sparkSession.createDataFrame([(None,)], "name string"))
    every = texts.distinct().where("seen IS NOT NULL").crossJoin(names.where("name IS NOT NULL")).withColumn("similarity", text.character_similarity(F.col("seen"), F.col("name")))
    want = every.groupBy("seen").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("b")).select("seen", "b.name", (-F.col("b.s")).alias("similarity"))
    assert rows(similar.closest(texts, "seen", names, "name", 0.62, few=few)) == rows(want)


def test_closest_goes_down_only_for_the_rest(spark, monkeypatch):
    """Equal texts need no index, few names neither, and a floor is tried only for texts that the floors above it left."""
    asked, real = [], similar.candidates

    def counted(left, right, floor):
        asked.append((floor, left.count()))
        return real(left, right, floor)

    monkeypatch.setattr(similar, "candidates", counted)
    frame = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    names = [f"blue anvil {i}" for i in range(300)]
    texts = names[:200] + [f"bluc anvll {i}" for i in range(200, 300)]
    found = similar.closest(frame(texts, "seen"), "seen", frame(names, "name"), "name", 0.62)
    assert {r.seen.replace("bluc", "blue").replace("anvll", "anvil"): r.name for r in found.collect()} == {n: n for n in names}
    assert asked == [(0.9, 100), (0.8, 100)]
    asked.clear()
    similar.closest(frame(texts, "seen"), "seen", frame(names[:200], "name"), "name", 0.62)
    assert not asked


def test_few_candidates_among_many_names(spark):
    names = made(10_000, 5)
    left = spark.createDataFrame([(damaged(n, i),) for i, n in enumerate(names)], "form string").select(text.normalize_name(F.col("form")).alias("form")).distinct().where("form <> ''")
    right = spark.createDataFrame([(n,) for n in names], "form string")
    pairs = left.count() * right.count()
    met = similar.candidates(left, right, 0.62)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert met.count() < 0.05 * pairs


def test_a_floor_too_low_is_refused(spark):
    with pytest.raises(ValueError):
        similar.candidates(spark.createDataFrame([("a",)], "form string"), spark.createDataFrame([("a",)], "form string"), 0.4)


def test_likeness_is_worked_out_above_the_distinct(spark):
    """A filter on it isn't carried onto the rows that bear the same texts."""
    from tallyframe.operators import remote
    from tallyframe.sources import store

    text = lambda c: F.concat(F.lit("name "), (F.col("id") % 3).cast("string")).alias(c)
    remotes = spark.range(90).select((F.col("id") % 9).alias("card_id"), F.col("id").alias("remote_seq"), text("name"))
    locals_ = spark.range(90).select((F.col("id") % 9).alias("card_id"), F.col("id").alias("player_seq"), text("name"))
    results = spark.range(90).select((F.col("id") % 9).alias("catalog_id"), F.col("id").alias("rank"), text("name"), text("city"), text("found_name"), text("found_city"), F.lit(33.0).alias("lat"), F.lit(-84.0).alias("lon"))
    texts, names = remotes.select(F.col("name").alias("seen")), remotes.select(F.concat("name", F.lit(" x")).alias("n"))
    for out in (remote.pair(remotes, locals_), store.accept_places(results), similar.by_name(texts, "seen", names, "n", 0.62, few=0)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        costly = [line for line in plan.split("\n") if "levenshtein" in line and "aggregate(" in line]
        assert costly and not any("Filter" in line or "Join" in line for line in costly), plan
