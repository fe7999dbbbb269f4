"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts into which the rows of one key are dealt where they meet its least value.
SPREAD = 16


def with_least(df: DataFrame, key: str, value: str) -> DataFrame:
    """df (key, value) with m, the least value of the key. A hub's rows meet it in SPREAD parts; the minimum itself is combined before it is shuffled."""
    dealt = df.withColumn("part", F.pmod(F.xxhash64(value), F.lit(SPREAD)))
    least = dealt.groupBy(key).agg(F.min(value).alias("m"), F.collect_set("part").alias("parts"))
    return dealt.join(least.select(key, "m", F.explode("parts").alias("part")), [key, "part"]).select(key, value, "m")


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs: a > b. Large: every larger neighbour of a node is tied to its least neighbour; small: every smaller one, and the node."""
    both = pairs if small else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = with_least(both, "a", "b").select("a", "b", F.least("a", "m").alias("m"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if small:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where(F.col("a") != F.col("b"))
    return out.distinct() if small else out


def _settled(pairs: DataFrame) -> bool:
    """Every node has one parent, and no parent has one: stars."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    moving = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return moving.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of edges (a, b) of any one orderable type."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        pairs = stored(_stars(_stars(pairs, small=False), small=True))
        if _settled(pairs):
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
