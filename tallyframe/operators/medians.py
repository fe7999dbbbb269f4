"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a sketched percentile are wrong by one part in so many at most; the bracket is taken so many such parts wide on either side.
ACCURACY, MARGIN = 10_000, 5


def _like(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a and b by equal keys, nulls included; b's keys go."""
    named = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in b.columns if c not in by])
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return a.join(named, on, how).drop(*[f"_k{i}" for i in range(len(by))])


def upper_medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): each group's middle value, the upper of two; null where it has none.

    First pass: a count and a sketch of each group bracket its middle. Second pass: what lies below the bracket is counted, and
    only the bracket's values, with their counts, are put in order. A bracket that misses the middle is made the whole group.
    """
    v = F.col(value)
    share = MARGIN / ACCURACY
    bounds = F.percentile_approx(v, [0.5 - share, 0.5 + share], ACCURACY)
    known = df.where(v.isNotNull())
    sketched = known.groupBy(*by).agg(F.count("*").alias("_n"), bounds.alias("_q")).select(*by, "_n", F.get("_q", F.lit(0)).alias("_low"), F.get("_q", F.lit(1)).alias("_high"))
    split = _like(known, sketched, by).groupBy(*by).agg(F.first("_n").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.count_if(v < F.col("_low")).alias("_below"), F.count_if(v <= F.col("_high")).alias("_upto"))
    middle = F.floor(F.col("_n") / 2)
    holds = (F.col("_below") <= middle) & (middle < F.col("_upto"))
    split = split.select(*by, middle.alias("_at"), F.when(holds, F.col("_low")).alias("_low"), F.when(holds, F.col("_high")).alias("_high"), F.when(holds, F.col("_below")).otherwise(0).alias("_below"))
    inside = F.coalesce((v >= F.col("_low")) & (v <= F.col("_high")), F.lit(True))
    near = _like(known, split, by).where(inside).groupBy(*by, value, "_at", "_below").agg(F.count("*").alias("_times"))
    upto = F.sum("_times").over(Window.partitionBy(*by).orderBy(value)) + F.col("_below")
    found = near.withColumn("_upto", upto).where("_upto > _at").groupBy(*by).agg(F.min(value).alias(name))
    return _like(df.select(*by).distinct(), found, by, "left")
