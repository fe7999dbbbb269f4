"""Vector codes of several small codebooks (product quantisation), trained by member-resident Lloyd rounds.

1. Vectors are cut into equal parts. Parts travel once, in blocks, to the partition of their owner (position,
   entry, salt); the salt splits an entry's members, so no owner grows with an entry's share.
2. Owners add up their resident members, the salts' sums meet in (position, entry), and each entry becomes its
   members' componentwise mean, rounded down. The codebooks, a fixed number of integers, go through the driver.
3. Each resident is assigned anew where it lies. Only the parts that change entry go through the next shuffle;
   the others stay in their partition, as the union of both keeps the owners' partitioning. DataFrames lose theirs
   in Python, and native expressions took 22 microseconds for an assignment, NumPy 1.3; so the residents are an RDD of
   blocks. They are kept on memory and disk, and every CUT rounds checkpointed, so a lost executor costs a few rounds.
4. After the last round vectors are encoded row by row with the final codebooks.

All arithmetic is in integers and so doesn't depend on partitions, order or reruns.

Cases: rows whose vector is null or holds null or non-finite components take no part, nor do rows with a scaled
component beyond +-2^25 (sums of squares would not fit) or a length that isn't the least kept id's, or isn't a
multiple of the number of parts. Null ids take part and come last among the seeds; rows with equal ids seed in
the order of their vectors. Fewer rows than entries: as many entries as rows. Repeated rows get equal codes.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, stored, table, with_totals
from .vectors import usable

#: Parts of a partition, an owner and a block, about.
PARTITION_ROWS, OWNER_ROWS, BLOCK_ROWS = 1 << 20, 1 << 17, 1 << 14
#: Rows of a label, about, that meet its sum in one task.
LABEL_ROWS = 1 << 16
#: Rounds between checkpoints of the residents.
CUT = 3
#: Scaled components are at most this far from zero.
LIMIT = 1 << 25


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The book's nearest entry (the first, if several) and the squared distance, in integers."""
    entry, far = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    step = max(1, (1 << 21) // max(1, book.size))
    for at in range(0, len(parts), step):
        d = ((parts[at : at + step, None, :] - book[None]) ** 2).sum(axis=2)
        entry[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1)
    return entry, far


def blocks(position: int, salt: int, parts: np.ndarray, entry: np.ndarray):
    """((position, entry, salt), parts of that entry)."""
    order = np.argsort(entry, kind="stable")
    where = np.flatnonzero(np.diff(entry[order], prepend=-1))
    for at, members in zip(where.tolist(), np.split(parts[order], where[1:]), strict=True):
        yield (position, int(entry[order[at]]), salt), members.astype(np.int32)


def first_blocks(books: np.ndarray):
    """Arrow batches of (ints, salt) as blocks by owner."""

    def deal(batches):
        for batch in batches:
            x, salt, out = matrix(batch.column(0)), batch.column(1).to_numpy(), []
            for s in np.unique(salt):
                for p, part in enumerate(np.split(x[salt == s], len(books), axis=1)):
                    out += [(*owner, members.tobytes()) for owner, members in blocks(p, int(s), part, nearest(part, books[p])[0])]
            names = ("position", "entry", "salt", "members")
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    return deal


def home(owner: tuple[int, int, int]) -> int:
    """The owner's partition, modulo their number."""
    position, entry, salt = owner
    return (salt * 31 + position) * 31 + entry


def joined(residents):
    """Blocks of one owner put together, up to BLOCK_ROWS."""
    held: dict[tuple, list] = {}
    for owner, members in residents:
        mine = held.setdefault(owner, [])
        mine.append(members)
        if sum(map(len, mine)) >= BLOCK_ROWS:
            yield owner, np.concatenate(held.pop(owner))
    for owner, mine in held.items():
        yield owner, np.concatenate(mine)


def assigned(books: np.ndarray):
    """Each owner's residents as (the entry they have, (their owner, members))."""

    def move(residents):
        for owner, members in joined(residents):
            entry, _ = nearest(members.astype(np.int64), books[owner[0]])
            for to, some in blocks(owner[0], owner[2], members, entry):
                yield owner, (to, some)

    return move


def sums(residents):
    """((position, entry), (members, their sum)) of a partition's owners."""
    total: dict[tuple, list] = {}
    for (position, entry, _), members in residents:
        t = total.setdefault((position, entry), [0, 0])
        t[0] += len(members)
        t[1] = t[1] + members.sum(axis=0, dtype=np.int64).astype(object)
    return ((k, (n, s)) for k, (n, s) in total.items())


def encoder(books: np.ndarray):
    """A column of a vector's entries and the sum of their squared distances."""

    def encode(ints: pa.Array) -> pa.Array:
        x = matrix(ints)
        found = [nearest(part, book) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)] if len(x) else []
        codes = np.stack([e for e, _ in found], axis=1) if found else np.empty((0, len(books)), np.int32)
        error = sum(far for _, far in found) if found else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * len(books), pa.int32()), pa.array(codes.ravel(), pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(error, pa.int64())], ["code", "error"])

    return F.arrow_udf(encode, "struct<code: array<int>, error: bigint>")


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    return np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)


def codebook_table(spark: SparkSession, books: np.ndarray) -> DataFrame:
    """(position, entry, components): the codebooks as a table."""
    rows = [(p, e, [int(x) for x in entry]) for p, book in enumerate(books) for e, entry in enumerate(book)]
    return spark.createDataFrame(rows, "position int, entry int, components array<bigint>")


def scaled(vector: str, scale: int):
    """floor(scale * component) of usable vectors, else null."""
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) <= LIMIT)
    return F.when(usable(F.col(vector)) & (F.size(vector) > 0) & small, ints)


def updated(residents, books: np.ndarray) -> np.ndarray:
    """Each entry's mean over its owners' residents, rounded down; entries without any stay."""
    new = books.copy()
    for (position, entry), (n, s) in residents.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), books.shape[0]).collect():  # one row an entry
        new[position, entry] = [int(x) // n for x in s]
    return new


def train(vectors: DataFrame, seeds: np.ndarray, parts: int, rounds: int, rows: int) -> np.ndarray:
    """vectors: (row, ints). seeds (entries, dimensions) are the first codebooks. Returns (parts, entries, width)."""
    sc = vectors.sparkSession.sparkContext
    books = np.stack(np.split(seeds, parts, axis=1))
    width = books.shape[2]
    salts = max(1, -(-rows // OWNER_ROWS))
    tasks = max(sc.defaultParallelism, -(-rows * parts // PARTITION_ROWS))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(vectors.sparkSession))
    dealt = vectors.select("ints", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).mapInArrow(first_blocks(books), "position int, entry int, salt int, members binary")
    residents = dealt.rdd.map(lambda r: ((r[0], r[1], r[2]), np.frombuffer(r[3], np.int32).reshape(-1, width))).partitionBy(tasks, home)
    kept = []
    for r in range(1, rounds + 1):
        residents = residents.persist(StorageLevel.MEMORY_AND_DISK)
        if r % CUT == 0 and r < rounds:
            residents.checkpoint()
        books = updated(residents, books)
        if r < rounds:
            moved = residents.mapPartitions(assigned(books), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            leave = moved.filter(lambda x: x[1][0] != x[0]).values().partitionBy(tasks, home)
            stay = moved.filter(lambda x: x[1][0] == x[0]).mapPartitions(lambda it: (x[1] for x in it), preservesPartitioning=True)
            residents_next = stay.union(leave)
        for old in kept:
            old.unpersist()
        kept = [residents, moved] if r < rounds else [residents]
        residents = residents_next if r < rounds else residents
    for old in kept:
        old.unpersist()
    return books


def compress(vectors: DataFrame, ints: str = "ints", ident: str = "id", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """The rows that take part with `code` (array of entries) and `error` (long), and the codebooks (parts, entries, width).

    vectors has integer vectors in `ints`, null for rows that take no part. Other columns stay; code and error replace columns of these names.
    """
    (row,) = fresh(vectors, "row")
    whole = stored(vectors.where(F.col(ints).isNotNull() & (F.size(ints) > 0) & (F.size(ints) % parts == 0)).withColumn(row, F.monotonically_increasing_id()))
    order = [F.asc_nulls_last(ident), F.col(ints)]
    first = whole.orderBy(*order).select(F.size(ints)).first()
    same = whole.where(F.size(ints) == (first[0] if first else 0))
    rows = same.count()
    if not rows:
        taken = [c for c in same.columns if c.lower() not in (row, "code", "error")]
        return same.select(*taken, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")), np.empty((parts, 0, 0), np.int64)
    seeds = np.array([r[0] for r in same.orderBy(*order).limit(entries).select(ints).collect()], np.int64)
    books = train(same.select(F.col(row).alias("row"), F.col(ints).alias("ints")), seeds, parts, rounds, rows)
    (got,) = fresh(same, "got")
    taken = [c for c in same.columns if c.lower() not in (row, "code", "error")]
    return same.withColumn(got, encoder(books)(F.col(ints))).select(*taken, F.col(f"{got}.code").alias("code"), F.col(f"{got}.error").alias("error")), books


def op13_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", scaled("embedding", 4096).alias("ints"))
    coded, books = compress(rows, ident="vec_id")
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    parts = max(1, -(-coded.count() // LABEL_ROWS))
    out = with_totals(coded.select("vec_id", "label", code.alias("code"), "error"), ["label"], [F.try_sum("error").alias("label_error")], parts)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, list_slice(e, CAST(p * len(e) / 8 AS BIGINT) + 1, CAST((p + 1) * len(e) / 8 AS BIGINT)) AS x FROM v, range(8) t(p)),
books AS (
  SELECT 0 AS round, p, r - 1 AS k, x AS c FROM parts WHERE r <= 16
  UNION ALL
  SELECT round, p, k, c FROM (
    WITH near AS (SELECT b.round, parts.p, r, arg_min(k, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k)) AS k, any_value(x) AS x FROM parts JOIN books b ON b.p = parts.p GROUP BY b.round, parts.p, r),
    comps AS (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM near) GROUP BY p, k, i),
    new AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM comps GROUP BY p, k)
    SELECT b.round + 1 AS round, b.p, b.k, coalesce(new.c, b.c) AS c FROM books b LEFT JOIN new ON new.p = b.p AND new.k = b.k WHERE b.round < 6)
),
final AS (SELECT p, k, c FROM books WHERE round = 6),
near AS (SELECT r, parts.p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN final ON final.p = parts.p),
best AS (SELECT r, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM near GROUP BY r, p),
coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM best GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM final) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""
