"""Ranks over a whole table without one task that orders it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.lineage import cut


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its rows' numbers from 1 in that order, which must tell all rows apart for a defined result.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's number is its place in its partition
    after all rows of the partitions before. The sorted rows are checkpointed, as another run could draw other ranges.
    """
    here = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*df.columns, *here))
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # one row a partition
        offsets.append((part, before))
        before += n
    sizes = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).cast("int").alias(name))
