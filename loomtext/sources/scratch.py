"""Intermediate tables in the folder that all executors share, and join sides whose size is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted to have at most this many rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Unset in a local session: a temporary folder is set once."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its rows and their values stay what they were, whatever executor is lost."""
    path, schema = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A table as a join side: broadcast if it has at most ``BROADCAST_ROWS`` rows, else left to the planner.

    It is written first, so that what makes it runs once.
    """
    df = written(df, "side")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
