"""Mixing sources to target weights: repetition rates per source, and hash-seeded copies per document.

A source's rate is target / words. A document is emitted floor(rate) times, and once more with
probability equal to the fraction, decided by a hash of its id and the seed; reruns agree. Targets are
found by water-filling: each source has a weight and a ceiling (`most` times its own words); Newton's
steps on the common level replace the rounds of resharing, each one sum over the table of sources.

Cases: a null source is a source of its own, last in order; a null or blank text has no words and is
still emitted or not by the rate of its source; a source without any word has rate 0. Rows that share a
doc_id share the decision. Empty tables give no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fraction, fresh, stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20


def ranked(names: DataFrame) -> DataFrame:
    """names (source) with `k`, their place in order, nulls last, from 0: a range-partitioned sort, then one offset for each partition."""
    low = (1 << 33) - 1  # monotonically_increasing_id() holds the place in the partition here, the partition above
    placed = cut(names.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of partitions, not of sources
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return placed.join(offsets, part == F.col("part")).select("source", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit(low))).alias("k"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows with source and size. One row per source after partial sums; no task holds all sources.

    The common level L solves sum(min(top, L * w)) = total. That sum is concave in L and made of straight
    pieces, so Newton's steps from below end exactly, after a few sums over the table of sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    table = cut(ranked(totals).select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("top")))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, capped = 0.0, None
    while True:
        over = F.col("top") <= F.lit(level) * F.col("w")
        n, tops, rest = table.agg(F.count_if(over), F.sum(F.when(over, F.col("top"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - (tops or 0.0)) / rest
    level = F.lit(level) if rest else F.lit(None).cast("double")
    return table.select("source", "source_size", F.least(F.col("top"), F.coalesce(level * F.col("w"), F.col("top"))).alias("target"))


def _drawn(df: DataFrame, text: str, source: str, doc_id: str, seed: int, size: str | None = None, **rule) -> tuple[DataFrame, list[str]]:
    """df with the size, its source's size and target, and the number of copies of each row, under names of their own."""
    names = fresh(df, "size", "source_size", "target", "copies", "source")
    own, source_size, target, copies, name = names
    sized = df.withColumn(own, word_count(F.col(text)) if size is None else F.col(size))
    targets = cut(source_targets(sized.select(F.col(source).alias("source"), F.col(own).alias("size")), **rule))
    targets = targets.select(F.col("source").alias(name), F.col("source_size").alias(source_size), F.col("target").alias(target))
    # left to the runtime plan: it broadcasts the table of sources if it is small, and splits a hot source otherwise
    out = sized.join(targets, sized[source].eqNullSafe(targets[name])).drop(name)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    whole = F.floor(rate)
    return out.withColumn(copies, (whole + F.when(fraction(seed, F.col(doc_id)) < rate - whole, 1).otherwise(0)).cast("int")), names[:4]


def copies(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, **rule) -> DataFrame:
    """df with _size, _source_size, _target and _copies, the number of times that each row is emitted; they replace columns of these names."""
    made = ["_size", "_source_size", "_target", "_copies"]
    out, names = _drawn(df.drop(*[c for c in df.columns if c.lower() in made and c not in (text, source, doc_id)]), text, source, doc_id, seed, **rule)
    return out.withColumnsRenamed(dict(zip(names, made, strict=True)))


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, **rule) -> DataFrame:
    """The mixed corpus: df's rows, each as often as it is drawn, next to each other."""
    out, (_, _, _, n) = _drawn(df, text, source, doc_id, seed, **rule)
    (copy,) = fresh(out, "copy")
    return out.where(F.col(n) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(df.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted once; only ids, sources and sizes go on
    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    out = copies(sized, size="size")
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
t AS (SELECT source, SUM(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS top, 1.5::DOUBLE * SUM(source_size) OVER () AS total FROM t),
l AS (SELECT *, (total - COALESCE(SUM(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT level FROM l x WHERE x.top > x.level * x.w ORDER BY x.top / x.w LIMIT 1) AS fixed FROM l),
g AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, LEAST(top, COALESCE(fixed * w, top)) AS target FROM f),
r AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(md5('20:' || COALESCE(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INT) AS copies FROM r
"""
