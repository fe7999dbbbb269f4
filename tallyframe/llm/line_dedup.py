"""Removal of repeated passages by overlapping windows of three lines, over all documents.

Every run of three consecutive lines is hashed; of the windows with one hash, the first (by doc_id, then
position) stays and the lines covered by any later one are removed, so overlapping later windows merge
into one cut. Windows without any visible character don't count.

With `sentences`, units are smaller: a sentence's end ends a unit as well as a newline does. Units are then
compared without the white space around them, and one or two units of over 50 words are a window, too, so
that a passage inside one line is found. Kept units give back their text as it was, a line goes when all
its units go, and `n_lines` and `n_removed` count units. The query cuts by lines, as its SQL does.

Cases: a text of fewer than three lines has no window and stays as it is, as does a null or empty text.
Later windows within one document count like those of others. Rows that share doc_id and text are one
document and get one result, each. Equal windows are told by 96 bits of hash. Empty tables give no rows.
Extra columns pass through, whatever their names; `n_lines` and `n_removed` are replaced where they exist.

Scale: only (96-bit hash, key, position) is shuffled for the search, with partial minimums before the
shuffle, so a window that a third of all lines hold is one row per task; the join back is a sort-merge
join whose hot partitions the runtime splits. Texts move once, to meet their cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, word_count

WINDOW = 3
#: Where a sentence ends inside a line.
SENTENCE = r"(?<=[.!?])(?=\s+\S)|(?<=[\u3002\uFF01\uFF1F])(?=.)"
#: Fewer units than a window's width count with more words than this.
LONG = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _units(text: Column) -> Column:
    """Sentences of all lines, each with the number of its line."""
    return F.flatten(F.transform(_lines(text), lambda line, i: F.transform(F.split(line, SENTENCE, -1), lambda s: F.struct(i.alias("line"), s.alias("text")))))


def _windows(lines: Column, width: int, long: int | None = None) -> Column:
    def one(part: Column, i: Column, n: int) -> Column:
        return F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(part).alias("h"), F.hash(part).alias("g"), F.exists(part, lambda x: x.rlike(r"\S")).alias("seen"))

    def part(i: Column, n: int) -> Column:
        return F.array(*[F.get(lines, i + k) for k in range(n)])  # slice() would copy the whole array for each window

    def runs(n: int) -> Column:
        return F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(0), F.size(lines) - n), lambda i: one(part(i, n), i, n)))

    def long_runs(n: int) -> Column:
        def many_words(w: Column) -> Column:
            joined = F.array_join(part(w.pos, n), " ")
            return (F.length(joined) > 2 * long) & (word_count(joined) > long)

        return F.filter(runs(n), many_words)

    full = F.filter(runs(width), lambda w: w.seen)
    if long is None:
        return full
    none = F.array().cast("array<struct<pos:int,n:int,h:bigint,g:int,seen:boolean>>")
    return F.concat(*[F.coalesce(x, none) for x in (full, *map(long_runs, range(1, width)))])


def later_windows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW, sentences: bool = False) -> DataFrame:
    """(_id, _text, positions): where each document's later windows start, and how many units they have."""
    lines = df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), (_units if sentences else _lines)(F.col(text)).alias("_lines"))  # split once, not in each lambda
    if sentences:
        lines = lines.withColumn("_lines", F.transform("_lines", lambda u: F.regexp_replace(u["text"], r"^\s+|\s+$", "")))
    rows = lines.select("_id", "_text", F.explode(_windows(F.col("_lines"), width, LONG if sentences else None)).alias("w")).select("_id", "_text", "w.pos", "w.n", "w.h", "w.g")
    place = F.struct("_id", "_text", "pos")
    first = rows.groupBy("h", "g", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return rows.join(first, ["h", "g", "n"]).where(place > F.col("first")).groupBy("_id", "_text").agg(F.collect_set(F.struct("pos", "n")).alias("positions"))


def _restored(kept: Column) -> Column:
    """Text of units: a newline where the line changes, nothing in between."""
    return F.array_join(F.transform(kept, lambda u, i: F.concat(F.when((i > 0) & (F.get(kept, i - 1)["line"] < u["line"]), "\n").otherwise(""), u["text"])), "")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW, sentences: bool = False) -> DataFrame:
    """df with the text cut, and n_lines and n_removed."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_lines", "n_removed") and c not in (text, doc_id)])
    key, of_id, of_text, units, stay, rest, cuts = fresh(df, "key", "id", "text", "lines", "kept", "rest", "positions")
    found = later_windows(df, text, doc_id, width, sentences).select(F.col("_id").alias(of_id), F.col("_text").alias(of_text), F.col("positions").alias(cuts))
    keyed = df.withColumn(key, F.xxhash64(text))
    both = keyed.join(found, (keyed[key] == found[of_text]) & keyed[doc_id].eqNullSafe(found[of_id]), "left")
    both = both.withColumn(units, (_units if sentences else _lines)(F.col(text)))
    lines, at, kept = F.col(units), F.col(cuts), F.col(stay)
    covered = F.flatten(F.transform(at, lambda p: F.sequence(p["pos"], p["pos"] + p["n"] - 1)))
    return (
        both.withColumn(stay, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
        .withColumn("n_lines", F.when(F.col(text).isNotNull(), F.size(lines)))
        .withColumn("n_removed", F.when(F.col(text).isNotNull(), F.when(at.isNull(), 0).otherwise(F.size(lines) - F.size(kept))))
        .withColumn(rest, F.when(at.isNotNull(), F.transform(kept, lambda i: F.get(lines, i))))
        .withColumn(text, F.when(at.isNull(), F.col(text)).otherwise(_restored(F.col(rest)) if sentences else F.array_join(rest, "\n")))
        .select(*df.columns, "n_lines", "n_removed")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, array_to_string(lines[pos + 1:pos + 3], chr(10)) AS part FROM (SELECT doc_id, lines, UNNEST(range(0, len(lines) - 2)) AS pos FROM l WHERE text IS NOT NULL)),
v AS (SELECT * FROM w WHERE regexp_matches(part, '\S')),
r AS (SELECT doc_id, pos, ROW_NUMBER() OVER (PARTITION BY part ORDER BY doc_id, pos) AS n FROM v),
c AS (SELECT DISTINCT doc_id, UNNEST([pos, pos + 1, pos + 2]) AS nth FROM r WHERE n > 1),
k AS (SELECT doc_id, nth, line FROM (SELECT doc_id, UNNEST(lines) AS line, UNNEST(range(0, len(lines))) AS nth FROM l WHERE text IS NOT NULL)),
j AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY k.nth) FILTER (WHERE c.nth IS NULL) AS text, CAST(COUNT(*) AS INT) AS n_lines, CAST(COUNT(c.nth) AS INT) AS n_removed FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.nth = c.nth GROUP BY k.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE COALESCE(j.text, '') END AS text, j.n_lines, j.n_removed FROM l LEFT JOIN j ON l.doc_id = j.doc_id
"""
