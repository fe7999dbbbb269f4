"""From raw documents to sampled token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import jaccard, langid, line_dedup, mixing, sentencepiece_codec
from tallyframe.llm.common import stored, table

#: The last stage samples, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text or no letter) go; those without a label get the predicted one. Where no row has a label, nothing is learned: labels stay empty, and only what has no letter goes."""
    model = langid.fit(docs, F.lit(True))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of windows of lines and sentences go; documents that lose every one go with them."""
    out = line_dedup.dedup_lines(docs, sentences=True).where(F.coalesce((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")), F.lit(True)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links, one row stays: that with the least id. Rows are told by id and text; those without words all stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws them, decided by their id; null sources are a source, null texts have no words. Repeated rows are drawn alike."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every copy; copies, which lie next to each other, draw each for itself. A null text has null ids."""
    return sentencepiece_codec.encode(docs, keep=["doc_id", "lang", "source"], copies=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
