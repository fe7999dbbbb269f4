"""Greedy scans that depend on all that came before: ordered folds over one card's or one row's array.

Each is one aggregate() over a sorted array of one group, some 150 items for a card; the group is gathered
by the shuffle on its key and nothing crosses groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_run(values: Column, start: int, span: int = 17) -> Column:
    """Of values in order (null: unreadable), the run start, start + 1, ...; once it has begun, one number may be missing. Structs (at, value)."""
    begin = F.struct(F.lit(start).alias("expected"), F.array().cast("array<struct<at:int,value:int>>").alias("hits"), F.lit(0).alias("at"))

    def step(a: Column, v: Column) -> Column:
        hit = (a["expected"] <= start + span) & ((v == a["expected"]) | ((v == a["expected"] + 1) & (F.size(a["hits"]) > 0)))
        hit = F.coalesce(hit, F.lit(False))
        return F.struct(F.when(hit, v + 1).otherwise(a["expected"]).alias("expected"), F.when(hit, F.concat(a["hits"], F.array(F.struct(a["at"].alias("at"), v.alias("value"))))).otherwise(a["hits"]).alias("hits"), (a["at"] + 1).alias("at"))

    return F.aggregate(values, begin, step, lambda a: a["hits"])


def best_run(values: Column, starts: tuple[int, ...] = (1, 10)) -> Column:
    """The longest of the runs; the first of equals."""
    out = ordered_run(values, starts[0])
    for s in starts[1:]:
        other = ordered_run(values, s)
        out = F.when(F.size(other) > F.size(out), other).otherwise(out)
    return out


def accept_headers(headers: Column, most: float = 0.5) -> Column:
    """Of headers in order (structs row, holes), those that don't mostly repeat holes already claimed."""
    start = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, h: Column) -> Column:
        takes = F.size(F.array_intersect(h["holes"], a["claimed"])) / F.greatest(F.lit(1), F.size(F.array_distinct(h["holes"]))) < most
        return F.when(takes, F.struct(F.array_union(a["claimed"], h["holes"]).alias("claimed"), F.concat(a["rows"], F.array(h["row"])).alias("rows"))).otherwise(a)

    return F.aggregate(headers, start, step, lambda a: a["rows"])


def one_to_one(pairs: Column) -> Column:
    """Of pairs in order (structs l, r), each left and right at most once: the greedy matching."""
    start = F.struct(F.array().cast("array<int>").alias("ls"), F.array().cast("array<int>").alias("rs"), F.array().cast("array<struct<l:int,r:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        free = ~F.array_contains(a["ls"], p["l"]) & ~F.array_contains(a["rs"], p["r"])
        return F.when(free, F.struct(F.concat(a["ls"], F.array(p["l"])).alias("ls"), F.concat(a["rs"], F.array(p["r"])).alias("rs"), F.concat(a["out"], F.array(F.struct(p["l"].alias("l"), p["r"].alias("r")))).alias("out"))).otherwise(a)

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def sorted_list(df: DataFrame, by: list[str], **fields: Column) -> DataFrame:
    """One row per key with `items`, its structs in order of their fields."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("items"))
