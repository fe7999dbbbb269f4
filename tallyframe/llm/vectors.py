"""Block grids for searches of a stated query set against all vectors.

Candidates are dealt into C blocks and queries into R blocks by a hash of the id, both of bounded size;
each cell (query block, candidate block) is one Arrow group, so no task ever holds more than one block of
each side. Cells keep a short list for each query, and the lists are merged by rank per query, where
Spark prunes each task's rows before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block. Each cell emits k rows for each of its queries, so large candidate blocks keep the lists few.
CANDIDATES, QUERIES = 16384, 8192
#: Candidate blocks at least, so that small inputs are spread as well.
SPREAD = 8


def usable(vec: Column, zero: bool = True) -> Column:
    """Vectors that take part: not null, every component finite; zero=False leaves out all-zero vectors as well."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vec.isNotNull() & finite
    return ok if zero else ok & F.exists(vec, lambda x: x != 0)


def tiles(queries: DataFrame, candidates: DataFrame, tile: Callable, schema: str) -> DataFrame:
    """Both sides have (id, dim, ...); only equal dims meet. tile(queries, candidates) maps Arrow tables of one cell to rows of the schema."""
    n = candidates.count()
    m = queries.count()
    c, r = max(SPREAD, math.ceil(n / CANDIDATES)), max(1, math.ceil(m / QUERIES))
    block = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.withColumn("qb", block(r)).withColumn("cb", each(c)).groupBy("dim", "qb", "cb")
    right = candidates.withColumn("cb", block(c)).withColumn("qb", each(r)).groupBy("dim", "qb", "cb")
    return left.cogroup(right).applyInArrow(tile, schema)


def ranked(lists: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(t: pa.Table, name: str, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = t.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)


def ids(t: pa.Table) -> np.ndarray:
    return t.column("id").to_numpy().astype(np.int64)


def answer(query: list[np.ndarray], vec: list[np.ndarray], score: list[np.ndarray], kind: type) -> pa.Table:
    join = lambda parts, dtype: np.concatenate(parts) if parts else np.empty(0, dtype)
    return pa.table({"query_id": join(query, np.int64).astype(np.int64), "vec_id": join(vec, np.int64).astype(np.int64), "score": join(score, kind).astype(kind)})
