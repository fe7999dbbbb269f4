"""Exact top-k by vector-approximation files (Weber, Schek and Blott, 1998).

1. The approximation file holds one byte for each component, the number of its cell. Each dimension has marks of its
   own, quantiles of a sample of MARKED rows, and its outer cells end at the true extremes of all rows, so outlying values
   widen only the cells that they lie in. Only the bytes and the queries travel to the tiles of the scan. A tile bounds each inner product from both sides and keeps,
   for each query, what can still be among its k best there.
2. Over all tiles, the k-th best lower bound of a query leaves few candidates.
3. Exact vectors are then read by id, for each query in order of its candidates' bounds, best first: READ of
   them, and, for queries whose k-th result an unread bound can still reach, four times as many in the next
   round, until all are certain. Vectors that no query needs are never read whole.

Cases: vectors that are null or hold null or non-finite components take no part, nor do null ids, nor rows whose
scaled vector has a squared norm of 2^62 or more (products would not fit in a long). Vectors
of other lengths than the query's are no candidates of it. Ties go to the smaller vec_id. A query's own
row, and any other row with its id, is no candidate; if rows repeat an id, each is a candidate and the
smallest vector of them is the query; rows that repeat id and vector are scored once and listed each.
Fewer than k candidates: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import ids, matrix, ranked, tiles, usable

#: Rows whose components place the marks; squared norms of scaled vectors stay below.
MARKED, NORM = 4096, 2.0**62
#: Bits of a cell number, which travels as one signed byte.
BITS = 8
#: Exact vectors read for a query in the first round, and by how much each round reads more than the one before.
READ, MORE = 16, 4
_BOUNDS = "query_id long, vec_id long, h long, under long, over long"


def extremes(batches):
    """The least and greatest component of each dimension in a task's rows."""
    low, high = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        ints = batch.column(0)
        sizes = pc.list_value_length(ints).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            x = ints.take(pa.array(np.flatnonzero(sizes == dim))).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            grow = max(0, dim - len(low))
            low, high = np.append(low, np.full(grow, np.iinfo(np.int64).max)), np.append(high, np.full(grow, np.iinfo(np.int64).min))
            low[:dim], high[:dim] = np.minimum(low[:dim], x.min(axis=0)), np.maximum(high[:dim], x.max(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["place", "low", "high"])


def edges(vectors: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each dimension and cell the least and greatest component that it can hold: (dimensions, cells) each."""
    ends = vectors.select("ints").mapInArrow(extremes, "place int, low long, high long").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect()  # a row for each dimension
    sample = [np.array(r[0]) for r in vectors.select("ints", F.xxhash64("ints", "id").alias("_o")).orderBy("_o").limit(MARKED).select("ints").collect()]
    cells = 1 << bits
    least, most = np.empty((len(ends), cells), np.int64), np.empty((len(ends), cells), np.int64)
    for d, (_, low, high) in enumerate(ends):
        values = np.sort(np.array([x[d] for x in sample if len(x) > d] or [low]))
        marks = values[np.arange(1, cells) * len(values) // cells]  # cell c holds components from mark c - 1 to before mark c
        least[d], most[d] = np.append(low, marks), np.append(marks - 1, high)
    return least, most


def approximate(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The approximation file (id, dim, h, cells), and what each cell of each dimension can hold."""
    least, most = edges(vectors, bits)

    def number(ints: pa.Array) -> pa.Array:
        sizes, flat = pc.list_value_length(ints).to_numpy(zero_copy_only=False), ints.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.empty(len(flat), np.int64)
        for d in range(int(sizes.max(initial=0))):
            at = np.flatnonzero(place == d)
            out[at] = np.searchsorted(least[d, 1:], flat[at], side="right")
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array((out - 128).astype(np.int8), pa.int8()))

    return vectors.select("id", "dim", "h", F.arrow_udf(number, "array<tinyint>")("ints").alias("cells")), least, most


def scanner(lowest: np.ndarray, highest: np.ndarray, k: int):
    """For each query of a tile, the candidates whose upper bound reaches the tile's k-th best lower bound."""

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts: list[tuple] = [(np.empty(0, np.int64),) * 5]
        if queries.num_rows and candidates.num_rows:
            vec, h = ids(candidates), candidates.column("h").to_numpy()
            cells = matrix(candidates, "cells", np.int64) + 128
            place = np.arange(cells.shape[1])
            least, most = lowest[place, cells].astype(np.float64), highest[place, cells].astype(np.float64)
            largest = max(np.abs(least).max(initial=0), np.abs(most).max(initial=0))
            query, q = ids(queries), matrix(queries, "ints", np.float64)
            for at in range(0, len(query), 256):
                plus, minus = np.maximum(q[at : at + 256], 0), np.minimum(q[at : at + 256], 0)
                over, under = plus @ most.T + minus @ least.T, plus @ least.T + minus @ most.T
                slack = np.abs(q[at : at + 256]).sum(axis=1) * largest * 2.0**-40  # rounding of the sums; 0 in effect for small numbers
                under[query[at : at + 256, None] == vec] = -np.inf
                kth = np.partition(under, len(vec) - k, axis=1)[:, len(vec) - k] if len(vec) > k else np.full(len(under), -np.inf)
                i, j = np.nonzero((over + 2 * slack[:, None] >= kth[:, None]) & (under > -np.inf))
                parts.append((query[at + i], vec[j], h[j], np.floor(under[i, j] - slack[i]).astype(np.int64), np.ceil(over[i, j] + slack[i]).astype(np.int64)))
        return pa.table(dict(zip(("query_id", "vec_id", "h", "under", "over"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return tile


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = BITS, read: int = READ) -> DataFrame:
    """vectors: (id, ints array<bigint>). (query_id, rank, vec_id, score) for the rows where is_query holds."""
    exact = stored(vectors.groupBy("id", "ints").agg(F.count("*").alias("times")).withColumn("dim", F.size("ints")).withColumn("h", F.xxhash64("ints")))
    filed, lowest, highest = approximate(exact, bits)
    queries = exact.where(is_query).groupBy("id").agg(F.min("ints").alias("ints")).withColumn("dim", F.size("ints"))
    of_query = Window.partitionBy("query_id")
    by_bound = of_query.orderBy(F.desc("over"), "vec_id", "h")
    bounds = tiles(queries, filed, scanner(lowest, highest, k), _BOUNDS).withColumn("n", F.row_number().over(of_query.orderBy(F.desc("under"))))
    bounds = bounds.withColumn("least", F.max(F.when(F.col("n") == k, F.col("under"))).over(of_query)).where(F.col("least").isNull() | (F.col("over") >= F.col("least")))
    bounds = stored(bounds.select("query_id", "vec_id", "h", "over", F.row_number().over(by_bound).alias("place")))
    named = queries.select(F.col("id").alias("query_id"), F.col("ints").alias("q"))
    wanted = exact.select(F.col("id").alias("vec_id"), "h", "ints", "times")
    score = F.aggregate(F.zip_with("ints", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    best, asked, done, upto = None, bounds, 0, read
    while True:
        now = asked.where((F.col("place") > done) & (F.col("place") <= upto)).select("query_id", "vec_id", "h")
        found = now.join(wanted, ["vec_id", "h"]).join(named, "query_id").select("query_id", "vec_id", score.alias("score"), "times")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        open_queries = bounds.where(F.col("place") == upto + 1).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("over") >= F.col("kth"))).select("query_id")
        if open_queries.isEmpty():
            break
        asked, done, upto = bounds.join(open_queries, "query_id", "left_semi"), upto, upto * MORE
    return ranked(best.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.col("times"), F.lit(k)).cast("int")))), k)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * 256).cast("double") * F.floor(x.cast("double") * 256).cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.when(usable(F.col("embedding")), squares < NORM).otherwise(False))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).try_cast("long")).alias("ints"))
    return top_k(vectors, F.pmod(F.col("id"), F.lit(50)) == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
