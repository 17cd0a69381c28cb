"""Bars (open, high, low, close, volume by symbol and time) out of transaction and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("time", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
REGIMES = ("trend", "revert", "highvol", "calm")

# Symbols with base price, daily volatility, half spread, pip size, chart symbol.
SYMBOLS = (
    ("EUR/USD", 1.085, 0.006, 0.00005, 0.0001, "FX:EURUSD"),
    ("XAU/USD", 2330.0, 0.012, 0.3, 0.1, "OANDA:XAU_USD"),
)
CONFIG = T.StructType([T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("base_price", "daily_vol", "spread", "pip_size")], T.StructField("tv_symbol", T.StringType())])

# The chance to go from a regime (row) to trend, revert, highvol, calm.
TRANSITIONS = {
    "trend": (0.96, 0.02, 0.01, 0.01),
    "revert": (0.02, 0.96, 0.01, 0.01),
    "highvol": (0.08, 0.05, 0.82, 0.05),
    "calm": (0.06, 0.06, 0.03, 0.85),
}


def symbol_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, CONFIG)


def transition_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, p) for a, row in TRANSITIONS.items() for b, p in zip(REGIMES, row)], "regime string, next string, p double")


def bars_of(rows: DataFrame, symbol: Column, time: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """One bar per symbol and time: first, highest, lowest and last price in `order` (which must be total), volume summed.

    First and last are min_by and max_by, so the aggregate is partial: a row per bar and task is shuffled, not the transactions.
    """
    at = F.struct(*order)
    return rows.groupBy(symbol.alias("symbol"), time.alias("time")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).cast("double").alias("volume"))


def daily_bars(spark: SparkSession, sf_dir: str, last: int | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """lineitem by return flag and ship date: price per unit, quantity as volume; with `last` the last so many bars of each symbol, or of the times that both symbols of a pair have.

    For a look back the dates come first: the earliest one needed is found from two columns, and is a filter of the scan that builds the bars.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") > 0)
    if last:
        days = rows.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("time")).distinct()
        days = tail(side_by_side(days, F.lit(0), pairs), last, *PAIR) if pairs else tail(days, last)
        since = days.agg(F.min("time")).first()[0]
        bars = daily_bars_of(rows.where(F.col("l_shipdate") >= F.lit(since)) if since is not None else rows)
        return bars if pairs else tail(bars, last)
    return daily_bars_of(rows)


def daily_bars_of(rows: DataFrame) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return bars_of(rows, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), order)


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """events by type and hour (or minute, day): value as price, number of events as volume; values of zero have no price."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("value") > 0)
    return bars_of(rows, F.col("event_type"), F.date_trunc(unit, "ts").cast("timestamp_ntz"), F.col("value"), F.lit(1), ["ts", "event_id"])


def numbered(bars: DataFrame, *keys: str) -> DataFrame:
    """Bars with rn (0 for the first of a symbol) and prev (the close before)."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy("time")
    return bars.withColumn("rn", F.row_number().over(w) - 1).withColumn("prev", F.lag("close").over(w))


def tail(bars: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last n bars of each symbol; Spark keeps n rows a task before the shuffle."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy(F.col("time").desc())
    return bars.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") <= n).drop("_rd")


#: the key of a pair of symbols
PAIR = ("x_symbol", "y_symbol")


def side_by_side(rows: DataFrame, value: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """x_symbol, y_symbol, time, x, y: a value of both symbols of each pair at the times that both have. One aggregate serves all pairs."""
    named = F.array(*[F.struct(F.lit(x).alias("x_symbol"), F.lit(y).alias("y_symbol")) for x, y in pairs])
    of = F.filter(named, lambda p: (p["x_symbol"] == F.col("symbol")) | (p["y_symbol"] == F.col("symbol")))
    rows = rows.select("symbol", "time", value.alias("v"), F.explode(of).alias("p")).select("symbol", "time", "v", "p.*")
    both = rows.groupBy(*PAIR, "time").agg(*[F.max(F.when(F.col("symbol") == F.col(s), F.col("v"))).alias(c) for s, c in zip(PAIR, "xy")])
    return both.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def in_pair_order(rows: DataFrame) -> DataFrame:
    """Rows of pairs with rn (0 for the first of a pair) and n, the pair's rows."""
    own = Window.partitionBy(*PAIR)
    return rows.withColumn("rn", F.row_number().over(own.orderBy("time")) - 1).withColumn("n", F.count(F.lit(1)).over(own))


def returns(bars: DataFrame, *keys: str) -> DataFrame:
    """Bars from the second of each symbol, with r = ln(close / prev), rn from 0, and n, the number of returns."""
    rows = numbered(bars, *keys).where(F.col("prev").isNotNull()).withColumn("r", F.ln(F.col("close") / F.col("prev"))).withColumn("rn", F.col("rn") - 1)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*(keys or ("symbol",)))))


def resample(bars: DataFrame, factor: int) -> DataFrame:
    """Blocks of `factor` bars from a symbol's start, the last one perhaps shorter."""
    return numbered(bars).groupBy("symbol", F.floor(F.col("rn") / factor).alias("block")).agg(F.min("time").alias("time"), F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))
