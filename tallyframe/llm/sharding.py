"""Shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The key alone and the number of shards decide the shard; going from n to n+1 shards moves rows only
into the new one. Hashing needs the 64-bit product key * A + 1 with wrap-around, which ANSI arithmetic
refuses; the state is therefore kept as two 32-bit halves, and no product exceeds 49 bits.

Cases: a null key hashes as 0; rows that share a key share a shard (hot keys too, by the law itself),
but slots are counted in buckets salted by the text's checksum, so one key's rows are numbered in many
tasks. A null text has size 1 and a null checksum. Whole repeated rows get one slot each. Empty tables
give no rows. Extra columns pass through unless they bear a name that the result uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF
#: Slots are counted within (shard, bucket); the table of counts has shards * BUCKETS rows at most.
BUCKETS = 256


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2**32, for x below 2**32."""
    high = F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x * F.lit(c & 0xFFFF) + high).bitwiseAND(F.lit(_LOW))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    t0 = lo * F.lit(a_lo & 0xFFFF) + F.lit(1)
    t1 = lo * F.lit(a_lo >> 16)
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
    return (carry + _times(lo, a_hi) + _times(hi, a_lo)).bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the shard of a long key among `shards`, and among one more."""
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        long(0).alias("j"), long(0).alias("shard"), long(0).alias("grown"),
    )

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next(acc.hi, acc.lo)
        j = F.floor((acc.j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), j.alias("j"), F.when(acc.j < shards, acc.j).otherwise(acc.shard).alias("shard"), acc.j.alias("grown"))
        return F.when(acc.j <= shards, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda a: F.struct(a.shard.cast("int").alias("shard"), a.grown.cast("int").alias("grown_shard")))


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with size, text_crc32, shard, slot and grown_shard. Only ids and digests are shuffled unless df keeps more columns."""
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        number = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    else:
        number = F.xxhash64(F.col(key))
    made = ("size", "text_crc32", "law", "shard", "grown_shard", "slot")
    df = df.drop(*[c for c in df.columns if c.lower() in made and c not in (key, text)])
    state, bucket, before_it, nth = fresh(df, "jump", "bucket", "before", "n")
    rows = (
        df.withColumn("size", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1)
        .withColumn("text_crc32", F.crc32(F.col(text).cast("binary")))
        .withColumn(state, jump(number, shards))
        .withColumn(bucket, F.pmod(F.coalesce(F.col("text_crc32"), F.lit(0)) + F.pmod(number, F.lit(BUCKETS)), F.lit(BUCKETS)).cast("int"))
        .select("*", f"{state}.shard", f"{state}.grown_shard").drop(state)
    )
    counts = rows.groupBy("shard", bucket).count()
    so_far = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", bucket, F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias(before_it))
    within = Window.partitionBy("shard", bucket).orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn(nth, F.row_number().over(within)).join(F.broadcast(before), ["shard", bucket])
        .withColumn("slot", F.col(before_it) + F.col(nth) - 1).drop(bucket, before_it, nth).withColumn("law", F.lit("key"))
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP2_SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents),
c AS (SELECT doc_id, COALESCE(len(x) // 2, 0) + 1 AS size, CASE WHEN text IS NULL THEN NULL WHEN x = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) END AS text_crc32 FROM d, t),
j AS (SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE COALESCE(doc_id, 0)::HUGEINT END AS key, 0::BIGINT AS shard, 0::BIGINT AS grown, 0::BIGINT AS j FROM documents
  UNION ALL SELECT doc_id, k, CASE WHEN j < 16 THEN j ELSE shard END, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j WHERE j <= 16)),
s AS (SELECT doc_id, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard FROM j WHERE j > 16),
b AS (SELECT c.doc_id, c.size, c.text_crc32, s.shard, s.grown_shard, (COALESCE(c.text_crc32, 0) + ((COALESCE(c.doc_id, 0) % 256) + 256) % 256) % 256 AS bucket FROM c JOIN s ON s.doc_id IS NOT DISTINCT FROM c.doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, CAST(ROW_NUMBER() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM b
"""
