"""Hard-negative mining over rotated one-bit codes.

1. Each vector is rotated (random signs and Walsh-Hadamard transforms) and coded in LEVELS rounds: one bit a
   component, the sign of what the rounds before left, with the code-vector alignment, the length of that rest along
   the code. Codes, alignments and the norm of the last rest are stored beside the integer vector.
2. Anchors meet blocks of rows. In a tile, an anchor's rotated vector is cut into bit planes; popcounts of planes and
   codes, weighted by the alignments, estimate the inner product, and Cauchy-Schwarz bounds what the rest and the
   planes leave out. That interval is certain, whatever the vectors.
3. Pairs whose interval can't reach what is wanted are dropped: for positives, the k-th best score so far; for
   negatives, the bands of the anchor's positives and each band's third best so far. The others are scored in integers
   from the stored vectors, and every tile returns its k best for each anchor and band; ranks merge them.

Positives are searched in the blocks of the anchor's own label, negatives in all blocks.

Cases: rows with a null id or label, a null vector, or null or non-finite components take no part, nor do rows whose
scaled vector has a squared norm of 2^62 or more (an inner product would not fit in a long). Rows of other lengths
than the anchor's are no candidates of it. Ties go to the smaller vec_id. Other rows with the anchor's id are no
candidates; if rows repeat an id, each is a candidate, and the smallest (vector, label) of them is the anchor. An
anchor without positives, and a positive without negatives in its band, give no rows. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import ids, matrix, usable

#: Rounds of one-bit codes, and bit planes of an anchor's rotated vector.
LEVELS, PLANES = 4, 6
#: Rows of a block of candidates and of anchors; of a strip of pairs.
CANDIDATES, ANCHORS, STRIP, CHUNK = 1 << 15, 1 << 11, 64, 2048
#: Squared norms of scaled vectors stay below.
NORM = 2.0**62
_CODED = "code binary, align array<double>, rest double, span double"
_FOUND = "anchor_id long, place int, vec_id long, score long"


def rotated(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows turned by two rounds of seeded signs and a Walsh-Hadamard transform; lengths stay, dimensions grow to a power of two, 64 at least."""
    n = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed)
    for _ in range(2):
        out *= signs.integers(0, 2, n) * 2 - 1
        h = 1
        while h < n:
            a = out.reshape(len(x), n // (2 * h), 2, h)
            out = np.stack((a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]), axis=2).reshape(len(x), n)
            h *= 2
        out /= math.sqrt(n)
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Bits, a multiple of 64 a row, as words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def coded(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments (rows, levels), norms of the rest, norms of what is coded."""
    rest = rotated(x)
    n = rest.shape[1]
    codes, align, whole = [], [], np.zeros_like(rest)
    for _ in range(levels):
        bits = rest >= 0
        along = np.abs(rest).sum(axis=1) / math.sqrt(n)
        step = np.where(bits, 1.0, -1.0) * (along / math.sqrt(n))[:, None]
        whole += step
        rest = rest - step
        codes.append(words(bits))
        align.append(along)
    return np.stack(codes, axis=1), np.stack(align, axis=1), np.linalg.norm(rest, axis=1), np.linalg.norm(whole, axis=1)


def coder(levels: int):
    """Arrow batches of (ints, ...) with their codes."""

    def code_batches(batches):
        for batch in batches:
            ints, out = batch.column(0), [[], [], [], []]
            sizes = pc.list_value_length(ints).to_numpy(zero_copy_only=False)
            rows = [None] * batch.num_rows
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = ints.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                code, align, rest, span = coded(x, levels)
                for n, row in enumerate(at.tolist()):
                    rows[row] = (code[n].tobytes(), align[n].tolist(), float(rest[n]), float(span[n]))
            for row in rows:
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "code", "align", "rest", "span"])

    return code_batches


class Planes:
    """Anchors' rotated vectors as bit planes."""

    def __init__(self, x: np.ndarray, planes: int) -> None:
        turned = rotated(x)
        self.n = turned.shape[1]
        self.low = turned.min(axis=1)
        top = (1 << planes) - 1
        self.step = (turned.max(axis=1) - self.low) / top
        self.step[self.step == 0] = 1
        u = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        self.planes = np.stack([words((u >> p & 1).astype(bool)) for p in range(planes)], axis=1)
        self.total = u.sum(axis=1)
        self.wrong = np.linalg.norm(turned - (self.low[:, None] + u * self.step[:, None]), axis=1)
        self.norm = np.linalg.norm(turned, axis=1)

    def bounds(self, mine: slice, code: np.ndarray, align: np.ndarray, rest: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Certain lower and upper bounds of inner products of these anchors with coded rows."""
        low, step, total = self.low[mine, None], self.step[mine, None], self.total[mine, None]
        near = np.zeros((len(low), len(code)))
        for level in range(code.shape[1]):
            c = code[:, level]
            ones = np.bitwise_count(c).sum(axis=1, dtype=np.int64)
            under = np.zeros(near.shape, np.int32)
            for p in range(self.planes.shape[1]):
                both = np.zeros(near.shape, np.int32)
                for w in range(c.shape[1]):
                    both += np.bitwise_count(self.planes[mine, p, w][:, None] & c[None, :, w])
                under += both << p
            near += (low * (2 * ones - self.n) + step * (2 * under - total)) * (align[:, level] / math.sqrt(self.n))
        wrong = self.wrong[mine, None] * span + self.norm[mine, None] * rest
        wrong = wrong * (1 + 1e-9) + 1e-9 * self.norm[mine, None] * (span + rest) + 1  # room for rounding of these sums themselves
        return near - wrong, near + wrong


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of paired integer rows; in double where its 53 bits hold every sum."""
    if exact:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return (a * b).sum(axis=1)


def firsts(group: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((vec, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def finder(k: int, same: bool):
    """For every anchor and band, the k best rows of a block with a score in the band: of the anchor's own label, or of others."""

    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.empty((0, 4), np.int64)]
        if anchors.num_rows and rows.num_rows:
            name, q, q_label = ids(anchors), matrix(anchors, "ints", np.int64), anchors.column("label").to_numpy().astype(np.int64)
            vec, v, label = ids(rows), matrix(rows, "ints", np.int64), rows.column("label").to_numpy().astype(np.int64)
            align = matrix(rows, "align", np.float64)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(*align.shape, -1)
            rest, span = rows.column("rest").to_numpy(), rows.column("span").to_numpy()
            exact = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**53
            planes = Planes(q.astype(np.float64), PLANES)
            bands = anchors.column("bands").combine_chunks()
            n_bands = np.diff(bands.offsets.to_numpy())
            flat = bands.flatten()
            low_all, high_all = flat.field("low").to_numpy().astype(np.int64), flat.field("high").to_numpy().astype(np.int64)
            first_band = bands.offsets.to_numpy() - bands.offsets[0].as_py()
            width = int(n_bands.max())
            for at in range(0, len(name), STRIP):
                mine = slice(at, min(at + STRIP, len(name)))
                size = mine.stop - at
                low, high = np.full((size, width), np.iinfo(np.int64).max), np.full((size, width), np.iinfo(np.int64).min)
                for a in range(size):
                    b, e = first_band[at + a], first_band[at + a] + n_bands[at + a]
                    low[a, : e - b], high[a, : e - b] = low_all[b:e], high_all[b:e]
                best = np.empty((0, 4), np.int64)  # anchor's place in the strip * width + band, score, id, -
                for c in range(0, len(vec), CHUNK):
                    other = slice(c, c + CHUNK)
                    under, over = planes.bounds(mine, code[other], align[other], rest[other], span[other])
                    fits = (label[None, other] == q_label[mine, None]) == same
                    fits &= vec[None, other] != name[mine, None]
                    fits &= (over >= low.min(axis=1)[:, None]) & (under <= high.max(axis=1)[:, None])
                    i, j = np.nonzero(fits)
                    for p in range(0, len(i), 1 << 15):
                        a, b = i[p : p + (1 << 15)], j[p : p + (1 << 15)]
                        reach = ((over[a, b, None] >= low[a]) & (under[a, b, None] <= high[a])).any(axis=1)
                        a, b = a[reach], b[reach] + c
                        score = products(q[at + a], v[b], exact)
                        x, band = np.nonzero((score[:, None] >= low[a]) & (score[:, None] <= high[a]))
                        new = np.stack((a[x] * width + band, score[x], vec[b[x]], np.zeros(len(x), np.int64)), axis=1)
                        best = np.concatenate((best, new))
                        best = best[firsts(best[:, 0], best[:, 1], best[:, 2], k)]
                        count = np.bincount(best[:, 0], minlength=size * width)
                        full = np.flatnonzero(count == k)
                        least = np.full(size * width, np.iinfo(np.int64).max)
                        np.minimum.at(least, best[:, 0], best[:, 1])
                        low.reshape(-1)[full] = least[full]  # equal scores stay: a smaller id may come
                out = best.copy()
                out[:, 0], out[:, 3] = name[at + best[:, 0] // width], best[:, 0] % width
                found.append(out)
        all_found = np.concatenate(found)
        return pa.table({"anchor_id": all_found[:, 0], "place": all_found[:, 3].astype(np.int32), "vec_id": all_found[:, 2], "score": all_found[:, 1]})

    return tile


def grid(anchors: DataFrame, rows: DataFrame, keys: list[str], tile) -> DataFrame:
    """Anchors and rows of equal keys meet in tiles (block of anchors, block of rows) of bounded size."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("c"))
    sizes = sizes.join(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("r")), keys)  # a row for each key
    block = lambda parts: F.pmod(F.xxhash64("id", "ints", "copy"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = anchors.withColumn("copy", F.lit(0)).join(sizes, keys).withColumn("rb", block("r")).withColumn("cb", each("c")).drop("r", "c", "copy")
    right = rows.join(sizes, keys).withColumn("cb", block("c")).withColumn("rb", each("r")).drop("r", "c")
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))  # both come from the same table: columns of their own
    by = [*keys, "rb", "cb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, _FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """vectors: (id long, ints array<long>, label). For each anchor and each of its `positives` best rows of the same label, the `negatives` best rows of other labels with low % to high % of the positive's score.

    Equal rows (id, vector, label) are coded once and stand in as many copies as can be listed.
    """
    k = max(positives, negatives)
    rows = vectors.groupBy("id", "ints", "label").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("ints", "id", "label", "times").schema.fields)
    rows = stored(rows.select("ints", "id", "label", "times").mapInArrow(coder(LEVELS), f"{schema}, {_CODED}").withColumn("dim", F.size("ints")))
    all_rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    anchor = F.min(F.struct("ints", "label")).alias("a")
    anchors = rows.where(is_anchor).groupBy("id").agg(anchor).select("id", "a.ints", "a.label", F.size("a.ints").alias("dim"))
    band = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    everything = F.array(band(F.lit(-(2**63) + 1), F.lit(2**63 - 1)))
    of_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    first = grid(anchors.withColumn("bands", everything), all_rows, ["dim", "label"], finder(positives, True))
    first = stored(first.withColumn("n", F.row_number().over(of_anchor)).where(F.col("n") <= positives).select("anchor_id", "n", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # lowest and highest score s with low * p <= 100 * s <= high * p
    hundredths = lambda by: F.col("positive_score").cast("decimal(38,0)") * by
    edge = band(F.ceil(hundredths(low) / 100), F.floor(hundredths(high) / 100))
    bands = first.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n", edge.alias("band")))).alias("bands"))
    banded = anchors.join(bands.select("id", F.transform("bands", lambda b: b.band).alias("bands")), "id")
    second = grid(banded, all_rows, ["dim"], finder(negatives, False))
    of_band = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    second = second.withColumn("rank", F.row_number().over(of_band)).where(F.col("rank") <= negatives)
    named = first.withColumn("place", F.col("n") - 1)
    return second.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * 256).cast("double") * F.floor(x.cast("double") * 256).cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), F.when(squares < NORM, ints).alias("ints"), label.cast("long").alias("label")).where("ints IS NOT NULL AND size(ints) > 0")
    return hard_negatives(vectors, F.pmod(F.col("id"), F.lit(50)) == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT pos.*, p.vec_id AS negative_id, p.score AS negative_score, CAST(ROW_NUMBER() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) AS INT) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT same AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
