"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it, a folder on this machine, for a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows up to which a table is read as one partition
SMALL = 50_000


def kept(df: DataFrame, label: str, small: int = SMALL) -> DataFrame:
    """df written once and read again: a report of many parts starts from this table, not from the transactions each time.

    A table of at most `small` rows (counted) is read as one partition, so that windows and groups over it need no shuffle; a larger one
    is read and shuffled as any other.
    """
    table = written(df, label)
    return table.coalesce(1) if table.count() <= small else table


class Expiring:
    """Tables by key that are built anew when older than `seconds`; the driver holds their paths and times alone."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        if key not in self.held or now - self.held[key][0] >= self.seconds:
            self.held[key] = (now, kept(build(), key))
        return self.held[key][1]
