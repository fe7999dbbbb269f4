"""Language ID by multilingual mixture inference (after Lui, Lau and Baldwin, 2014).

Each language is a distribution over hashed byte trigrams of the lower-cased text, with additive
smoothing. A document is a mixture of languages: expectation-maximisation estimates its proportions from
the trigrams' likelihoods; then languages enter its set one by one, in order of proportion, as long as the
likelihood refitted to the set gains more than a penalty that grows with the logarithm of its length. The
prediction is the largest share of the chosen set, the score its share in the mixture of all languages.

Learning takes whole texts of at most SAMPLE labelled documents of each language: ids are dealt into
BUCKETS by their hash, and of each bucket those with the least hashes are taken, so no task ranks all ids
of a language. Every label is learned. The model has one row of BINS numbers for each language; more than
LANGUAGES of them, which are labels of another kind, end in an error instead of a model that a worker can't hold.

Cases: text that is null or has no letter is `und`, score 0, without languages; so is everything if no
labelled document was learned from. A null or empty label isn't learned. Text of one or two characters is
padded with blanks. Ties go to the language first by name. Equal texts get equal answers. Empty tables
give no rows. Extra columns pass through unless named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table

BINS_LOG, SAMPLE, BUCKETS = 15, 2048, 64
#: More labels than these are refused (512 KB of the model each).
LANGUAGES = 512
BINS = 1 << BINS_LOG
SMOOTHING, ROUNDS, PENALTY = 0.5, 12, 3.0
UNDETERMINED = "und"


def trigrams(text: str) -> np.ndarray:
    """Bins of the byte trigrams of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BINS_LOG)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=1, keepdims=True)
        self.log = np.log(self.p)

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, [], []
        count = np.bincount(trigrams(text), minlength=BINS)
        seen = np.flatnonzero(count)
        count = count[seen].astype(np.float64)
        p, n = self.p[:, seen], count.sum()
        everything, _ = self.fit(p, count, n)
        order = np.argsort(-everything, kind="stable")
        fee = PENALTY * np.log(n + 1)
        chosen, share, best = order[:1], np.ones(1), float(self.log[order[0], seen] @ count)
        for size in range(2, len(order) + 1):
            part = order[:size]
            if everything[part[-1]] * n < 1:
                break
            fitted, likelihood = self.fit(p[part], count, n)
            if likelihood - best <= fee:
                break
            chosen, share, best = part, fitted, likelihood
        top = int(chosen[np.argmax(share)])
        return self.langs[top], float(min(1.0, everything[top])), [self.langs[i] for i in chosen], share.tolist()

    @staticmethod
    def fit(p: np.ndarray, count: np.ndarray, n: float) -> tuple[np.ndarray, float]:
        """Mixture proportions and the log likelihood."""
        share = np.full(len(p), 1 / len(p))
        for _ in range(ROUNDS):
            share = share * (p @ (count / (share @ p))) / n
        return share, float(np.log(share @ p) @ count)


def fit(df: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of all languages in df where `labelled` holds."""
    known = df.where(labelled & F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull())
    if known.select(lang).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels in {lang}")
    few = Window.partitionBy("_lang", "_bucket").orderBy(F.xxhash64("_id"), "_id")
    dealt = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)))
    ids = dealt.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= max(1, sample // BUCKETS)).select("_id", "_lang").distinct()
    texts = known.join(F.broadcast(ids), (known[doc_id] == ids["_id"]) & (known[lang] == ids["_lang"]), "left_semi").select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(one):
                    sums[name] = sums.get(name, 0) + np.bincount(trigrams(one), minlength=BINS)
        for name, c in sums.items():
            bins = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(c[bins].astype(np.int64))], names=["lang", "bin", "n"])

    rows = texts.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages * BINS
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[np.searchsorted(langs, rows["lang"]) if len(langs) else [], rows["bin"]] = rows["n"]
    return Model(langs, counts)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all, if not given) with lang_pred, score, and the document's set of languages with their shares."""
    made = ["lang_pred", "score", "langs", "shares"]
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in made]
    schema = df.select(*names).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("langs", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType()))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            got = [own.predict(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, *made])

    return df.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])
