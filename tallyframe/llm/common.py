"""What the operators share: table reads, lineage cuts, and the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests), one of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir() and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Small intermediate results: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Larger intermediate results: a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, with as many underscores before them as it takes to clash with none of df's."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fraction(seed: int, *cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values: the first 52 bits of an MD5. SQL engines agree on it."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def with_totals(df: DataFrame, keys: list[str], totals: list[Column], parts: int) -> DataFrame:
    """df with the totals of its groups; nulls of a key are together. A group's rows meet the totals in up to `parts` parts, by the hash of the row; the totals themselves are combined before they are shuffled."""
    part, *names = fresh(df, "part", *[f"k{i}" for i in range(len(keys))])
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    sums = dealt.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)]).agg(*totals, F.collect_set(part).alias(f"{part}s"))
    apart = sums.withColumn(f"{part}s", F.explode(f"{part}s"))
    on = F.col(f"{part}s") == F.col(part)
    for k, name in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(name))
    return dealt.join(apart, on, "left").drop(part, f"{part}s", *names)
