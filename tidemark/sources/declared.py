"""Declared tables: strategies, signals, trades and backtest runs, filled from what the operators compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The declared columns.
TABLES = {
    "strategy": "id string, code string, name string, type string, description string, params string, enabled boolean, created_at timestamp, updated_at timestamp",
    "signal": "id string, strategy_id string, symbol string, direction string, confidence double, price double, rationale string, created_at timestamp",
    "trade": "id string, strategy_id string, symbol string, side string, entry_time timestamp, exit_time timestamp, entry_price double, exit_price double, bars int, pnl double, pnl_pct double, exit_reason string, created_at timestamp",
    "backtest_run": "id string, strategy_id string, symbol string, start_year int, end_year int, trades int, sharpe double, sortino double, max_drawdown double, hit_rate double, profit_factor double, p_value double, expectancy double, stats string, created_at timestamp",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def filled(rows: DataFrame, table: str, *key: str) -> DataFrame:
    """rows as a declared table: columns that they lack are null, id is a hash of `key`, created_at is now."""
    spark = rows.sparkSession
    rows = rows.withColumn("id", F.sha1(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in key]))).withColumn("created_at", F.current_timestamp())
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty(spark, table).schema])


def strategies(catalogue: DataFrame) -> DataFrame:
    return filled(catalogue.withColumn("type", F.col("kind")).withColumn("params", F.lit("{}")).withColumn("enabled", F.lit(True)).withColumn("updated_at", F.current_timestamp()).withColumn("description", F.col("name")), "strategy", "code")


def signals(found: DataFrame) -> DataFrame:
    return filled(found.withColumn("strategy_id", F.sha1("strategy")).withColumn("rationale", F.col("status_note")), "signal", "strategy", "symbol", "time")


def trades(book: DataFrame) -> DataFrame:
    rows = book.where("kind = 'trade'").withColumn("strategy_id", F.sha1("strategy")).withColumn("exit_time", F.col("time")).withColumn("exit_reason", F.col("reason"))
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    return filled(rows.withColumn("pnl_pct", side * (F.col("exit_price") / F.col("entry_price") - 1)), "trade", "strategy", "symbol", "entry_time", "exit_time")


def runs(stats: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per strategy and symbol, with all figures as JSON."""
    years = bars.groupBy("symbol").agg(F.year(F.min("time")).alias("start_year"), F.year(F.max("time")).alias("end_year"))
    return filled(stats.withColumn("stats", F.to_json(F.struct("*"))).join(years, "symbol").withColumn("strategy_id", F.sha1("strategy")), "backtest_run", "strategy", "symbol")
