"""Rows of items that lie side by side, and the band that a value falls in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.model import Clustering
from tallyframe.operators.similar import once

#: Bands that one array holds for all values; more stay rows, in chunks. Chunks at most, whose edges stand in the plan.
FEW, CHUNKS = 1000, 512


def row_starts(items: Column, tolerance: Column, overlap: float) -> Column:
    """Of items in order of their middles (structs with mid, top, bottom), the places where a row begins.

    An item joins the current row if its middle is near the row's running mean, or if it overlaps the row's
    growing envelope by a share of the smaller height; else it opens a row. What is carried is the row and the places so far.
    """
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), none.alias("top"), none.alias("bottom"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        shared = F.least(a["bottom"], x["bottom"]) - F.greatest(a["top"], x["top"])
        smaller = F.least(a["bottom"] - a["top"], x["bottom"] - x["top"])
        near = F.abs(x["mid"] - a["sum"] / F.when(a["n"] > 0, a["n"])) <= tolerance
        strong = (shared > 0) & (smaller > 0) & (shared / F.when(smaller > 0, smaller) >= overlap)
        joins = (a["n"] > 0) & (F.coalesce(near, F.lit(False)) | F.coalesce(strong, F.lit(False)))
        at = (a["at"] + 1).alias("at")
        stays = F.struct(at, (a["sum"] + x["mid"]).alias("sum"), (a["n"] + 1).alias("n"), F.least(a["top"], x["top"]).alias("top"), F.greatest(a["bottom"], x["bottom"]).alias("bottom"), a["starts"].alias("starts"))
        opens = F.struct(at, x["mid"].alias("sum"), F.lit(1).alias("n"), x["top"].alias("top"), x["bottom"].alias("bottom"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
        return F.when(joins, stays).otherwise(opens)

    return F.aggregate(items, start, step, lambda a: a["starts"])


def clustered(df: DataFrame, by: list[str], mid: Column, top: Column, bottom: Column, tolerance: Column, ties: list[str], overlap: float = Clustering().overlap) -> DataFrame:
    """df with `row`, the number of the row that each item lies in, from the top, within its group.

    A group falls into islands where the next middle is further than the tolerance below the last and no item before
    reaches down to it: no row can bridge that. Each island is folded for itself, so an array never holds more than one.
    """
    slack = 1 + 1e-9  # a mean of equal middles may differ from them in the last bit
    item = F.struct(mid.alias("mid"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], top.alias("top"), bottom.alias("bottom"), F.struct(*[F.col(c) for c in df.columns]).alias("o"))
    marked = df.select(*by, item.alias("_i"), tolerance.alias("_tolerance"))
    order = Window.partitionBy(*by).orderBy("_i.mid", *[f"_i.t{i}" for i in range(len(ties))])
    reach, last = F.max("_i.bottom").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lag("_i.mid").over(order)
    parted = last.isNull() | ((F.col("_i.mid") - last > F.col("_tolerance") * slack) & (F.col("_i.top") >= reach))
    islands = marked.withColumn("_parted", parted.cast("int")).withColumn("_island", F.sum("_parted").over(order))
    whole = islands.groupBy(*by, "_island").agg(F.array_sort(F.collect_list("_i"), _in_order(len(ties))).alias("_items"), F.first("_tolerance").alias("_tolerance"))
    folded = whole.withColumn("_starts", row_starts(F.col("_items"), F.col("_tolerance"), overlap))
    before = Window.partitionBy(*by).orderBy("_island").rowsBetween(Window.unboundedPreceding, -1)
    based = folded.withColumn("_base", F.coalesce(F.sum(F.size("_starts")).over(before), F.lit(0)))
    ends = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_items"))
    rows = F.transform("_starts", lambda s, k: F.struct(k.alias("k"), F.slice("_items", s + 1, ends(k) - s).alias("items")))
    one = based.select("_base", F.explode(rows).alias("_r"))
    return one.select(F.explode("_r.items").alias("_i"), (F.col("_base") + F.col("_r.k")).cast("int").alias("row")).select("_i.o.*", "row")


def _in_order(ties: int):
    """Items by middle and ties alone: what they carry isn't compared."""

    def compare(a: Column, b: Column) -> Column:
        out = None
        for name in ("mid", *[f"t{i}" for i in range(ties)]):
            out = (F if out is None else out).when(a[name] < b[name], -1).when(a[name] > b[name], 1)
        return out.otherwise(0)

    return compare


def bisected(lows: Column, value: Column) -> Column:
    """How many of the ascending lows don't exceed the value."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(lows).alias("hi"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(lows) + 1)).cast("int") + 1))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(lows, middle) <= value
        return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(steps, begin, step, lambda s: s["lo"])


def _band(value: Column, lows: str, bands: str) -> Column:
    hit = F.get(bands, bisected(F.col(lows), value) - 1)
    return F.when(value < hit["high"], hit)


def _packed(columns: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """One row a key: its bands in order, and their lower ends."""
    out = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("low", "high", *fields))).alias("_bands"))
    return out.withColumn("_lows", F.transform("_bands", lambda b: b["low"]))


def located_by(df: DataFrame, columns: DataFrame, by: list[str], value: Column, fields: list[str]) -> DataFrame:
    """df with the fields of the band that its value falls in, among the bands (by, low, high, fields) of its key; null where there is none. A key's bands don't overlap, and one row holds them."""
    hit = df.withColumn("_value", value).join(_packed(columns, by, fields), by, "left").withColumn("_hit", _band(F.col("_value"), "_lows", "_bands"))
    return hit.select(*df.columns, *[F.col(f"_hit.{f}").alias(f) for f in fields])


def located(df: DataFrame, columns: DataFrame, value: str, fields: list[str], few: int = FEW) -> DataFrame:
    """df with the fields of the band (low, high, fields) that its value falls in; null where there is none. Bands don't overlap.

    Up to `few` bands lie in one array, which every row bisects. More stay rows: distinct values and bands are cut into chunks at
    quantiles of the bands' lower ends, and within a chunk each value takes, in order, the last band that began before it. No array
    of bands travels with a row. A band that reaches over edges lies in each of its chunks.
    """
    n = columns.count()
    if n <= few:
        hit = df.join(F.broadcast(_packed(columns.where("low IS NOT NULL AND high IS NOT NULL").withColumn("_chunk", F.lit(0)), ["_chunk"], fields).drop("_chunk")), how="left").withColumn("_hit", _band(F.col(value), "_lows", "_bands"))
        return hit.select(*df.columns, *[F.col(f"_hit.{f}").alias(f) for f in fields])
    chunks = min(CHUNKS, math.ceil(n / few))
    edges = sorted(set(columns.approxQuantile("low", [i / chunks for i in range(1, chunks)], 1 / (4 * chunks))))
    listed = F.array(*[F.lit(e) for e in edges]).cast("array<double>")
    chunk = lambda v: bisected(listed, v) if edges else F.lit(0)
    # bisecting is what costs: once for each end and each distinct value
    ends = columns.where("low IS NOT NULL AND high IS NOT NULL").select("low", "high", F.struct(*fields).alias("_band"), once(F.struct(chunk(F.col("low")).alias("low"), chunk(F.col("high")).alias("high"))).alias("_in"))
    reached = ends.select("low", "high", "_band", F.explode(F.sequence("_in.low", "_in.high")).alias("_chunk"))
    values = df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").distinct().select("_v", once(chunk(F.col("_v"))).alias("_chunk"))
    bands = reached.select("_chunk", F.col("low").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("high").alias("high"), F.col("_band").alias("band")).alias("_b"))
    mixed = bands.unionByName(values.select("_chunk", F.col("_v").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(bands.schema["_b"].dataType).alias("_b")))
    # of bands that begin where the value lies, those stand before it
    so_far = Window.partitionBy("_chunk").orderBy("_at", "_kind", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = mixed.withColumn("_last", F.last("_b", ignorenulls=True).over(so_far)).where("_kind = 1 AND _at < _last.high").select(F.col("_at").alias("_v"), F.col("_last.band").alias("_hit"))
    hit = df.join(last, F.col(value).cast("double") == F.col("_v"), "left")
    return hit.select(*[hit[c] for c in df.columns], *[F.col(f"_hit.{f}").alias(f) for f in fields])
