"""Incremental forms of batch rules: the latest edit wins, round totals stay current as edits arrive, and learned layouts are merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators import history
from tallyframe.sources import store

#: Holes that a round's state has room for.
MOST_HOLES = 18

#: Every so many batches the table of live totals is written whole, and what came before goes.
WHOLE_EVERY = 32


def latest_edits(edits: DataFrame, late: str = "1 day") -> DataFrame:
    """edits (card_id, hole, value, at timestamp) as a stream: the latest value of each hole so far."""
    seen = edits.withWatermark("at", late) if edits.isStreaming else edits
    return seen.groupBy("card_id", "hole").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def live_holes(edits: DataFrame) -> DataFrame:
    """edits (round_id, hole_count, hole_number, strokes, par, at, edit_id), streamed in update mode or not: every round touched, with the latest edit of each of its holes as an array.

    One aggregation holds a round's state, so a batch gives each round that it touches as a whole. Of two edits of a hole the later `at` wins,
    then the greater edit_id, then the greater par and strokes: edits that come late or twice change nothing that a later one said. An edit
    without strokes clears the hole. hole_count is the latest edit's. Edits of holes that are null or not in 1 to MOST_HOLES, and those without
    a time, count for nothing, but their round appears.
    """
    told = F.col("at").isNotNull()
    order = [F.col("at"), F.col("edit_id")]
    last = lambda h: F.max(F.when(told & (F.col("hole_number") == h), F.struct(*order, F.col("par"), F.col("strokes")))).alias(f"_{h}")
    rounds = edits.groupBy("round_id").agg(F.max(F.when(told & F.col("hole_count").isNotNull(), F.struct(*order, F.col("hole_count"))))["hole_count"].alias("hole_count"), *[last(h) for h in range(1, MOST_HOLES + 1)])
    each = [F.when(F.col(f"_{h}").isNotNull(), F.struct(F.lit(h).alias("hole_number"), F.col(f"_{h}.strokes").alias("strokes"), F.col(f"_{h}.par").alias("par"))) for h in range(1, MOST_HOLES + 1)]
    return rounds.select("round_id", "hole_count", F.filter(F.array(*each), lambda e: e.isNotNull()).alias("edited"))


def live_totals(rounds: DataFrame) -> DataFrame:
    """Totals of the rounds of live_holes, by the rule for saved rounds. A null round_id is no round."""
    holes = rounds.where("round_id IS NOT NULL").select("round_id", "hole_count", F.explode_outer("edited").alias("e"))
    return store.round_totals(holes.select("round_id", "hole_count", "e.hole_number", "e.strokes", "e.par"))


def keep_live(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Totals of all rounds in the table at path, brought up to date by each batch of edits.

    A batch writes only the rounds it touched, into a folder of its number, so one that comes twice writes the same again. Every
    WHOLE_EVERY-th writes the whole table; folders before it go a batch later, when it can't come again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        totals = live_totals(batch)
        if number and number % WHOLE_EVERY == 0:
            before = _live(spark, path, number)
            totals = totals if before is None else before.join(totals.select("round_id"), "round_id", "left_anti").unionByName(totals)
        totals.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _forget(spark, path, (number - 1) // WHOLE_EVERY * WHOLE_EVERY)

    return live_holes(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, path: str) -> DataFrame:
    """The totals as of the last batch written: of each round what its last batch says."""
    return _live(spark, path, None)


def _batches(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    numbered = {int(p.getName()[6:]): p for p in found if p.getName().startswith("batch=")}
    # a folder without its mark is of a batch that broke off
    return fs, {n: p for n, p in numbered.items() if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _live(spark: SparkSession, path: str, before: int | None) -> DataFrame | None:
    numbers = [n for n in _batches(spark, path)[1] if before is None or n < before]
    if not numbers:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in sorted(numbers)])
    made = [c for c in rows.columns if c not in ("round_id", "batch")]
    return rows.groupBy("round_id").agg(F.max_by(F.struct(*made), "batch").alias("_l")).select("round_id", "_l.*")


def _forget(spark: SparkSession, path: str, base: int) -> None:
    fs, numbered = _batches(spark, path)
    if base in numbered:
        for n in [n for n in numbered if n < base]:
            fs.delete(numbered[n], True)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means per event type and tumbling window; timestamps without zone are read as UTC, which watermarks need."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "event_type", "n", "mean")


def merge_learned(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of learned layouts (template_id, version, payload) is merged into the table at path, the highest version winning; a batch that comes twice changes nothing.

    The new table is written whole beside the old one, and then takes its name; whatever fails in between, one of both is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        merged = history.upsert(read(batch.sparkSession, path, batch), batch, "template_id", "version")
        merged.write.mode("overwrite").parquet(f"{path}/next")
        swap(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = {n: jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in ("current", "previous", "next")}
    return at["current"].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def swap(spark: SparkSession, path: str) -> None:
    """`next` becomes `current`, and `current` becomes `previous`. Where a swap broke off without `current`, `previous` is the last whole table and stays."""
    fs, at = _files(spark, path)
    if fs.exists(at["current"]):
        fs.delete(at["previous"], True)
        fs.rename(at["current"], at["previous"])
    fs.rename(at["next"], at["current"])


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The merged table so far; empty before the first batch."""
    fs, at = _files(spark, path)
    for name in ("current", "previous"):
        if fs.exists(at[name]):
            return spark.read.parquet(f"{path}/{name}")
    return like.limit(0)
