import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fields
from tallyframe.operators import bands, history, medians
from tallyframe.operators.ranks import ranked


def plain_rows(items, tolerance, overlap):
    """items (key, mid, top, bottom) in order: the row of each, one after the other."""
    out, row, total, n, top, bottom = {}, -1, 0.0, 0, 0.0, 0.0
    for key, mid, t, b in items:
        shared, smaller = min(bottom, b) - max(top, t), min(bottom - top, b - t)
        joins = n and (abs(mid - total / n) <= tolerance or (shared > 0 and smaller > 0 and shared / smaller >= overlap))
        if joins:
            total, n, top, bottom = total + mid, n + 1, min(top, t), max(bottom, b)
        else:
            row, total, n, top, bottom = row + 1, mid, 1, t, b
        out[key] = row
    return out


@pytest.mark.parametrize("spread, height", [(3.0, 0.1), (40.0, 2.0), (400.0, 60.0), (0.0, 1.0)])
def test_rows_as_one_scan_finds_them(spark, spread, height):
    r = random.Random(7)
    data = []
    for card in range(12):
        for i in range(r.choice([1, 2, 40, 90])):
            mid = round(r.uniform(0, spread), 3)
            h = round(r.choice([0.0, height * 0.2, height, height * 3]), 3)
            data.append((card, i, mid, mid - h / 2, mid + h / 2, "kept"))
    frame = spark.createDataFrame(data, "card long, seq long, mid double, top double, bottom double, row_text string")
    got = {(x.card, x.seq): (x.row, x.row_text) for x in bands.clustered(frame, ["card"], F.col("mid"), F.col("top"), F.col("bottom"), F.lit(0.8), ["seq"], 0.4).collect()}
    assert len(got) == len(data)
    for card in range(12):
        mine = sorted((m, s, t, b) for c, s, m, t, b, _ in data if c == card)
        assert {s: got[card, s] for _, s, _, _ in mine} == {s: (row, "kept") for s, row in plain_rows([(s, m, t, b) for m, s, t, b in mine], 0.8, 0.4).items()}


def test_one_user_with_many_events(spark):
    n = 200_000
    frame = spark.range(n).select(F.lit(1).alias("user"), "id", ((F.col("id") * 7919) % n / 200.0).alias("mid"))
    v = F.col("mid")
    out = bands.clustered(frame, ["user"], v, v - 0.001, v + 0.001, F.lit(0.004), ["id"])
    assert out.agg(F.max("row"), F.count("*")).first() == (n - 1, n)  # every gap parts
    packed = bands.clustered(frame, ["user"], v, v - 1.5, v + 1.5, F.lit(1.86), ["id"])
    rows = packed.groupBy("row").agg(F.min("mid").alias("low"), F.max("mid").alias("high"), F.count("*").alias("n")).orderBy("row").collect()
    mids = sorted((i * 7919) % n / 200.0 for i in range(n))
    want = plain_rows([(i, m, m - 1.5, m + 1.5) for i, m in enumerate(mids)], 1.86, 0.4)
    assert len(rows) == want[n - 1] + 1 and sum(r.n for r in rows) == n
    assert [r.low for r in rows] == [mids[i] for i in range(n) if i == 0 or want[i] != want[i - 1]]


@pytest.mark.parametrize("few", [1000, 7, 1])
def test_bands_against_all_pairs(spark, few):
    r = random.Random(3)
    edges = sorted({round(r.uniform(0, 100), 1) for _ in range(60)})
    made = [(a, b if r.random() < 0.7 else (a + b) / 2, f"b{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))] + [(-1e308, edges[0], "first"), (edges[-1], 1e308, "last")]
    values = [round(r.uniform(-10, 110), 1) for _ in range(500)] + edges + [None]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {x.id: x.name for x in bands.located(frame, spark.createDataFrame(made, "low double, high double, name string"), "v", ["name"], few).collect()}
    assert got == {i: next((n for lo, hi, n in made if v is not None and lo <= v < hi), None) for i, v in enumerate(values)}


def test_fifty_thousand_bands_without_a_nested_loop(spark):
    n = 50_000
    made = spark.range(n).select(F.col("id").cast("double").alias("low"), (F.col("id") + 0.5).alias("high"), F.col("id").alias("name"))
    frame = spark.range(100_000).select("id", ((F.col("id") * 7919) % (2 * n) / 2).alias("v"))
    out = bands.located(frame, made, "v", ["name"])
    assert out.where(~F.col("name").eqNullSafe(F.when(F.col("v") % 1 == 0, F.col("v").cast("long")))).count() == 0 and out.count() == 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "_lows" not in plan and "collect_list" not in plan  # bands stay rows: none carries an array of them


def test_equal_values_and_equal_lower_ends(spark):
    bands_ = [(0.0, 0.0, "empty"), (0.0, 2.0, "a"), (2.0, 2.5, "b"), (2.5, 90.0, "wide"), (90.0, 91.0, "end"), (None, 5.0, "no low")]
    values = [0.0, -0.0, 2.0, 2.0, 2.49, 2.5, 50.0, 50.0, 90.5, 91.0, float("nan"), float("inf"), None]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    made = spark.createDataFrame(bands_, "low double, high double, name string")
    want = ["a", "a", "b", "b", "b", "wide", "wide", "wide", "end", None, None, None, None]
    for few in (1000, 2, 1):
        got = {x.id: x.name for x in bands.located(frame, made, "v", ["name"], few).collect()}
        assert [got[i] for i in range(len(values))] == want and len(got) == len(values), few


def test_no_bands(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    assert [x.name for x in bands.located(frame, spark.createDataFrame([], "low double, high double, name string"), "v", ["name"]).collect()] == [None, None]


def test_ranks_without_one_task(spark):
    frame = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("k"), F.lit("x").alias("kept"))
    got = ranked(frame, F.desc("k"))
    assert got.where("rank <> 10000 - k").count() == 0 and got.columns == ["k", "kept", "rank"]
    assert ranked(frame.limit(0), "k").count() == 0
    rounds = spark.range(500).select(F.col("id").alias("round_id"), F.expr("timestamp'2020-01-01' + make_interval(0, cast(id % 7 as int))").alias("date_played"), (F.col("id") % 90).cast("string").alias("course_name"))
    for out in (history.by_month(rounds), history.by_course(rounds)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window " in line]
        assert windows and all("], [" in line for line in windows)  # each has keys


def test_median_of_a_large_group(spark):
    n = 5_000_000
    frame = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    assert medians.upper_medians(frame, ["k"], "v").first().median == n // 2


@pytest.mark.parametrize("margin", [5, 0, -2000])
def test_medians_against_sorting(spark, monkeypatch, margin):
    monkeypatch.setattr(medians, "MARGIN", margin)  # without a margin, brackets can miss the middle
    r = random.Random(2)
    data = [(k, r.choice([None, 1.0, 2.0, r.random()])) for k in [1] * 400 + [2] * 7 + [3, 4, 4, None, None, None] for _ in range(1)] + [(5, None), (6, 7.0), (6, 7.0), (7, 1.0), (7, 2.0)]
    want = {}
    for k, v in data:
        want.setdefault(k, []).extend([] if v is None else [v])
    want = {k: sorted(v)[len(v) // 2] if v else None for k, v in want.items()}
    frame = spark.createDataFrame(data, "k int, v double")
    assert {x.k: x.median for x in medians.upper_medians(frame, ["k"], "v").collect()} == want
    small = frame.groupBy("k").agg(fields.upper_median("v").alias("m")).collect()
    assert {x.k: x.m for x in small} == want
