"""Where long plans are cut: reliable checkpoints in the folder that all executors share; and how many tasks a table is dealt to."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that all executors see: that of spark.checkpoint.dir. Where the setting is missing, one machine takes a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        return given
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: relations that many steps read are worked out once, and plans stay short."""
    folder = shared(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as give each about `each` rows, so that what a task holds doesn't grow with the table. The rows are counted: for stored tables a look at their footers."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(df.count() / each)), *keys)
