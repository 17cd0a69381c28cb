"""Bars of an event stream with bounded lateness and bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.tables import shared_folder

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 8) -> DataFrame:
    """Events of the files that arrive in a folder."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_bars(events: DataFrame, unit: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars by event type and window, each updated as its events arrive; events later than `late` behind the newest are dropped, and the
    state of windows that old is let go. Values of zero have no price."""
    at = F.struct("ts", "event_id")
    rows = events.where(F.col("value") > 0).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    bars = rows.groupBy(F.col("event_type").alias("symbol"), F.window("at", unit).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")


def run_stream(writer: DataStreamWriter, interval: str | None, seconds: float | None) -> None:
    """Start a stream: over what has arrived, or every `interval` for `seconds` and one batch at least (or until it is stopped from elsewhere)."""
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    if interval and seconds:
        query.awaitTermination(seconds)
        while query.isActive and query.lastProgress is None:
            query.awaitTermination(1)
        query.stop()
    else:
        query.awaitTermination()


def bars_table(spark: SparkSession, folder: str, name: str, unit: str = "1 hour", late: str = "2 hours", pattern: str = "events*.parquet", files_per_batch: int = 8, interval: str | None = None, seconds: float | None = None) -> DataFrame:
    """Run the stream over what has arrived, from where the query `name` stopped last, and read the bars: the newest version of each.

    With an `interval` ('15 seconds') it looks for new files that often, for `seconds` or until stopped.

    Each micro-batch writes the windows it changed to its own folder, so a batch that runs twice leaves one version.
    """
    root = f"{shared_folder(spark)}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/bars/batch={number}")

    query = stream_bars(event_stream(spark, folder, pattern, files_per_batch), unit, late).writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").foreachBatch(write)
    run_stream(query, interval, seconds)
    versions = spark.read.parquet(f"{root}/bars")
    columns = ["open", "high", "low", "close", "volume"]
    return versions.groupBy("symbol", "time").agg(F.max_by(F.struct(*columns), "batch").alias("b")).select("symbol", "time", "b.*")


RING = "symbol string, time timestamp, close double, held int, mean double, z double"


def live_tail(bars: DataFrame, n: int = 48) -> DataFrame:
    """For a stream of bars (symbol, time: timestamp, close): each new bar with the mean and z of the last n closes, which are all the state a symbol has."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closes = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values("time").itertuples():
            closes = [*closes, float(r.close)][-n:]
            s = pd.Series(closes)
            sd = s.std() if len(s) > 1 else 0.0
            out.append((key[0], r.time, float(r.close), len(closes), float(s.mean()), float((r.close - s.mean()) / sd) if sd else 0.0))
        state.update((closes,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RING.split(", ")])

    return bars.groupBy("symbol").applyInPandasWithState(step, RING, "closes array<double>", "append", "NoTimeout")
