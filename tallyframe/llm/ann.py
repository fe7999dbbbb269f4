"""Nearest neighbours by inner product: a block matrix join in int8 with error bounds, finished in double.

Each vector is rounded to int8 with a scale of its own. A tile of products of int8 vectors gives every
pair's inner product up to an error that the vectors' norms and rounding residues bound (Cauchy-Schwarz):
|q.v - q^.v^| <= |q - q^| |v| + |q^| |v - v^|. Within a tile a pair survives if its highest possible
product reaches the k-th highest certain one, or what the heap of the query's best already holds;
survivors are recomputed from the original vectors in double precision, left to right, and merged by a
heap per query. Every pair's bound is examined, so nothing is lost: recall is 1.

Cases: vectors that are null, all zero, or hold null or non-finite components take no part, nor do null
ids. Vectors of other lengths than the query's are no candidates of it. Ties go to the smaller vec_id. A
query's own row, and any other row with its id, is no candidate; if rows repeat an id, each is a candidate
and the smallest vector of them is the query. Fewer than k candidates: all. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import answer, ids, matrix, ranked, tiles, usable

#: Columns of one tile of products, queries of one strip.
TILE, STRIP = 256, 256


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the rounded vectors, norms of what rounding left."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of int8, exact: float32 holds each of them while there are fewer than 1040 components."""
    kind = np.float32 if a.shape[1] < 1040 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def joiner(k: int):
    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return answer([], [], [], np.float64)
        order = np.argsort(ids(candidates), kind="stable")
        vec, v = ids(candidates)[order], matrix(candidates, "vec", np.float64)[order]
        query, q = ids(queries), matrix(queries, "vec", np.float64)
        v_code, v_scale, v_norm, v_left = rounded(v)
        q_code, q_scale, q_norm, q_left = rounded(q)
        v_full = np.linalg.norm(v, axis=1)
        by_part, q_part = np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)
        out: list[list] = [[], [], []]
        for at in range(0, len(query), STRIP):
            heaps: list[list[tuple[float, int]]] = [[] for _ in query[at : at + STRIP]]
            mine = slice(at, at + STRIP)
            for c in range(0, len(vec), TILE):
                other = slice(c, c + TILE)
                near = products(q_code[mine], v_code[other]) * (q_scale[mine, None] * v_scale[None, other])
                wrong = q_left[mine, None] * v_full[None, other] + q_norm[mine, None] * v_left[None, other]
                wrong = wrong * (1 + 1e-9) + 1e-9 * (np.abs(near) + 1e-300)  # room for the rounding of these sums themselves
                own = query[mine, None] == vec[None, other]
                sure = np.where(own, -np.inf, near - wrong)
                n = sure.shape[1]
                least = np.partition(sure, n - k, axis=1)[:, n - k] if n > k else np.full(len(sure), -np.inf)
                held = np.array([h[0][0] if len(h) >= k else -np.inf for h in heaps])
                i, j = np.nonzero(~own & (near + wrong >= np.maximum(least, held)[:, None]))
                for p in range(0, len(i), 1 << 16):
                    a, b = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                    exact = np.add.reduce(q_part.take(a + at, axis=1) * by_part.take(b + c, axis=1), axis=0)  # a plain running sum, the same for equal vectors
                    for x, y, s in zip(a.tolist(), b.tolist(), exact.tolist(), strict=True):
                        entry, heap = (s, -int(vec[y + c])), heaps[x]
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
            for name, heap in zip(query[mine].tolist(), heaps, strict=True):
                out[0] += [name] * len(heap)
                out[1] += [-x for _, x in heap]
                out[2] += [s for s, _ in heap]
        return answer(*([np.array(x)] if x else [] for x in out), np.float64)

    return tile


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors: (id, vec array<double>). (query_id, rank, vec_id, score) for the rows where is_query holds."""
    sized = vectors.withColumn("dim", F.size("vec"))
    queries = sized.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    return ranked(tiles(queries, sized, joiner(k), "query_id long, vec_id long, score double"), k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), zero=False))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return nearest(vectors, F.pmod(F.col("id"), F.lit(20)) == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
