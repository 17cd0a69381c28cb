"""Signals of a stream: each new price against the last ones of its symbol, which are all the state there is."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.series import BLOCK, blocked, placed
from ..sources.tables import shared_folder
from .bars import event_stream, run_stream

SCORED = "symbol string, time timestamp, event_id long, price double, held int, mean double, std double, z double, signal string"
STATE = "symbol string, time timestamp, event_id long, price double, nth long, seen double"


def scores(rows: DataFrame, n: int, entry: float, size: int) -> DataFrame:
    """Rows with their places: each with mean, deviation, z and signal of the last n prices of its symbol; a z beyond `entry` is a signal against it."""

    def score(blocks: DataFrame, *keys: str) -> DataFrame:
        last = Window.partitionBy(*keys).orderBy("place").rowsBetween(1 - n, 0)
        out = blocks.withColumn("held", F.least(F.col("place") + 1, F.lit(n)).cast("int"))
        out = out.withColumn("mean", F.avg("price").over(last)).withColumn("std", F.coalesce(F.stddev_samp("price").over(last), F.lit(0.0)))
        return out.withColumn("z", F.when(F.col("std") == 0, 0.0).otherwise((F.col("price") - F.col("mean")) / F.col("std")))

    signal = F.when(F.col("z") > entry, "short").when(F.col("z") < -entry, "long").otherwise("none")
    return blocked(rows, score, n - 1, "symbol", size=max(size, n)).withColumn("signal", signal)


def scores_table(spark: SparkSession, folder: str, name: str, n: int = 48, entry: float = 1.8, idle_ms: int | None = None, interval: str | None = None, seconds: float | None = None, pattern: str = "events*.parquet", files_per_batch: int = 8, size: int = BLOCK) -> DataFrame:
    """Run the stream of events (event_id, ts, event_type, value) from where the query `name` stopped last and read all its rows: each event with mean, deviation, z and signal of the last n values of its type.

    Without `interval` it takes what has arrived and ends; with one ('15 seconds') it looks for new files that often, for `seconds` or until stopped.

    Events of a micro-batch are put in order of ts and event_id; one that comes in a later batch than its successors stands after them. Values of zero have
    no price. A micro-batch's rows follow the n last ones of each symbol that the batch before left, in blocks of `size` rows with n - 1 rows before each, so no task holds a symbol.
    It writes its rows, and the n last ones of each symbol, to folders of its own, so a batch that runs twice leaves one version. With `idle_ms` a symbol
    that was silent so long is forgotten. Rows, state and progress are in the shared folder.
    """
    if idle_ms and not interval:
        raise ValueError("idle_ms goes with an interval")
    root = f"{shared_folder(spark)}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        now = time.time()
        at = lambda new, nth: F.struct(F.lit(new).alias("new"), nth.cast("long").alias("nth"), "time", "event_id").alias("at")
        rows = batch.where(F.col("value") > 0).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), "event_id", F.col("value").alias("price"))
        rows = rows.select("*", F.lit(now).alias("seen"), at(1, F.lit(0)))
        if number:
            state = batch.sparkSession.read.schema(STATE).parquet(f"{root}/state/batch={number - 1}")
            state = state.where(F.col("seen") >= now - idle_ms / 1000) if idle_ms else state
            rows = rows.unionByName(state.select("symbol", "time", "event_id", "price", "seen", at(0, F.col("nth"))))
        table = placed(rows, order="at")
        scores(table, n, entry, size).where("at.new = 1").select(*[c.split()[0] for c in SCORED.split(", ")]).write.mode("overwrite").parquet(f"{root}/scores/batch={number}")
        last = table.where(F.col("place") >= F.col("n") - n)
        last.select("symbol", "time", "event_id", "price", F.col("place").alias("nth"), F.max("seen").over(Window.partitionBy("symbol")).alias("seen")).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    writer = event_stream(spark, folder, pattern, files_per_batch).writeStream.outputMode("append").option("checkpointLocation", f"{root}/progress").foreachBatch(write)
    run_stream(writer, interval, seconds)
    return spark.read.schema(f"{SCORED}, batch int").parquet(f"{root}/scores").drop("batch")
