"""Backtests: indicators in Catalyst, the position as a state machine over Arrow groups, statistics as aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import columns as C
from ..sources.bars import numbered
from ..sources.tables import kept
from .rolling import max_drawdown
from .strategies import STRATEGIES, Position, signals, strategy


@dataclass(frozen=True)
class Config:
    """Capital, costs and limits (fixed values, as the results need them); spread (half) and pip are by symbol, with a default for the rest."""

    capital: float = 100_000.0
    risk: float = 0.01
    slippage_pips: float = 1.0
    per_year: float = 252 * 6.5
    max_bars: int | None = None
    pip: float = 0.0001
    spread: float = 0.00005
    by_symbol: dict[str, tuple[float, float]] = field(default_factory=dict)  # symbol: (pip, spread)
    min_trades: int = 1000
    max_p: float = 0.05
    min_sharpe: float = 0.5


LEDGER = "strategy string, symbol string, kind string, time timestamp_ntz, entry_time timestamp_ntz, side string, entry_price double, exit_price double, bars int, pnl double, reason string, equity double, drawdown double"


def run(pdf: pd.DataFrame, code: str, cfg: Config) -> pd.DataFrame:
    """Trades (kind 'trade') and the equity after each bar (kind 'equity') of one strategy on one symbol.

    A decision taken on a bar's close is executed at the next open, at the price plus slippage and half spread; a decision on the last bar is not.
    An open position is closed at the last close, at the half spread alone, without a new equity point.
    """
    pdf = pdf.sort_values("time")
    if cfg.max_bars:
        pdf = pdf.head(cfg.max_bars)
    rule, symbol = strategy(code), pdf["symbol"].iloc[0]
    pip, spread = cfg.by_symbol.get(symbol, (cfg.pip, cfg.spread))
    cost = cfg.slippage_pips * pip + spread
    times, opens, closes = pdf["time"].to_numpy(), pdf["open"].tolist(), pdf["close"].tolist()
    names = ("close", "action", "strength", "stop", *rule.columns)
    values = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in names}
    equity, position, size, opened, pending = cfg.capital, None, 0.0, 0, None
    trades, curve = [], np.empty(len(pdf))

    def close(at: int, price: float, reason: str) -> None:
        nonlocal equity, position
        pnl = (price - position.price if position.long else position.price - price) * size
        equity += pnl
        trades.append((times[at], times[opened], "long" if position.long else "short", position.price, price, at - opened, pnl, reason))
        position = None

    for i in range(len(closes)):
        if pending:
            action, _, stop, reason = pending
            if action == "exit" and position:
                close(i, opens[i] - cost if position.long else opens[i] + cost, reason)
            elif action.startswith("enter") and not position:
                long = action == "enter-long"
                price = opens[i] + cost if long else opens[i] - cost
                size = min(equity * cfg.risk / max(price * 0.01 if stop is None else stop, pip * 5), equity * 20 / price)
                position, opened = Position(long, price, 0), i
        curve[i] = equity + ((closes[i] - position.price if position.long else position.price - closes[i]) * size if position else 0.0)
        if position:
            position.held = i - opened
        decided = rule.decide({c: v[i] for c, v in values.items()}, position)
        pending = decided if decided[0] != "hold" else None
    if position:
        close(len(closes) - 1, closes[-1] - spread if position.long else closes[-1] + spread, "end of data")
    peak = np.maximum.accumulate(np.maximum(curve, cfg.capital)) if len(curve) else curve
    done, n, m = list(zip(*trades)) or [()] * 8, len(trades), len(times)
    whole = lambda head, tail, kind: pd.array([*head, *tail], dtype=kind)
    columns = {
        "strategy": [code] * (n + m), "symbol": [symbol] * (n + m), "kind": ["trade"] * n + ["equity"] * m,
        "time": whole(done[0], times, "datetime64[us]"), "entry_time": whole(done[1], [None] * m, "datetime64[us]"), "side": [*done[2], *[None] * m],
        "entry_price": whole(done[3], [None] * m, "Float64"), "exit_price": whole(done[4], [None] * m, "Float64"), "bars": whole(done[5], [None] * m, "Int32"), "pnl": whole(done[6], [None] * m, "Float64"), "reason": [*done[7], *[None] * m],
        "equity": whole([None] * n, curve, "Float64"), "drawdown": whole([None] * n, np.where(peak > 0, (peak - curve) / np.where(peak > 0, peak, 1), 0.0), "Float64"),
    }
    return pd.DataFrame(columns)


def runner(cfg: Config) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: run(pdf, pdf["strategy"].iloc[0], cfg)


def ledger(bars: DataFrame, codes: list[str] | None = None, cfg: Config = Config()) -> DataFrame:
    """Trades and equity of every strategy on every symbol; each pair is a group of its own, with the columns its rule reads and no others.

    All indicators are windows over one sort of the bars; one grouped stage runs all pairs. Symbols without bars have no rows.
    """
    codes = list(STRATEGIES) if codes is None else codes
    names = sorted({c for code in codes for c in strategy(code).columns})
    base, rows, packed = ["symbol", "time", "open", "high", "low", "close", "volume"], bars, []
    for k, code in enumerate(codes):
        rows = signals(rows, code)
        values = [(F.col(c).cast("double") if c in strategy(code).columns else F.lit(None).cast("double")).alias(c) for c in names]
        rows = rows.select(*base, *packed, F.struct(F.lit(code).alias("strategy"), "action", F.col("strength").cast("double").alias("strength"), F.col("stop").cast("double").alias("stop"), *values).alias(f"_s{k}"))
        packed.append(f"_s{k}")
    rows = rows.select("symbol", "time", "open", "close", F.explode(F.array(*packed)).alias("s")).select("symbol", "time", "open", "close", "s.*")
    # a number of partitions of its own: by size alone all pairs would be merged into few tasks, but the loops over bars take the time
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "strategy", "symbol").groupBy("strategy", "symbol").applyInPandas(runner(cfg), LEDGER)


def trade_stats(trades: DataFrame, cfg: Config = Config()) -> DataFrame:
    """By strategy and symbol from rows (pnl, bars): the figures of trades alone."""
    r, pnl = F.col("pnl") / cfg.capital, F.col("pnl")
    won, lost = F.when(pnl > 0, r), F.when(pnl <= 0, r)
    return trades.groupBy("strategy", "symbol").agg(F.count(pnl).alias("trades"), A.sharpe(r, cfg.per_year).alias("sharpe"), A.sortino(r, cfg.per_year).alias("sortino"), F.avg((pnl > 0).cast("double")).alias("hit_rate"), A.profit_factor(pnl).alias("profit_factor"), A.t_stat(r).alias("t_stat"), A.t_p_value(r).alias("p_value"), F.avg(r).alias("expectancy"), A.mean0(won).alias("avg_win"), A.mean0(lost).alias("avg_loss"), F.avg("bars").alias("avg_bars"))


def verdict(cfg: Config) -> tuple[Column, Column]:
    """(valid, first reason against). The wording of the reasons."""
    reason = (
        F.when(F.col("trades") < cfg.min_trades, F.concat(F.lit("insufficient trades ("), F.col("trades").cast("string"), F.lit(f" < {cfg.min_trades})")))
        .when(F.col("p_value") >= cfg.max_p, F.concat(F.lit("p-value "), C.fixed(F.col("p_value"), 4), F.lit(f" >= {cfg.max_p}")))
        .when(F.col("sharpe") < cfg.min_sharpe, F.concat(F.lit("sharpe "), C.fixed(F.col("sharpe")), F.lit(f" < {cfg.min_sharpe}")))
    )
    return reason.isNull(), reason


def stats(bars: DataFrame, book: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The full row of figures by strategy and symbol, with validity and the first reason against it."""
    curve = book.where("kind = 'equity'")
    ends = curve.groupBy("strategy", "symbol").agg(F.max_by("equity", "time").alias("_last"))
    fall = max_drawdown(curve.select(F.concat_ws("\u0001", "strategy", "symbol").alias("symbol"), "time", "equity"), "equity").select(F.split("symbol", "\u0001")[0].alias("strategy"), F.split("symbol", "\u0001")[1].alias("symbol"), "max_drawdown")
    series = numbered(bars).groupBy("symbol").agg(A.half_life(F.col("close"), F.col("prev")).alias("half_life"), F.count(F.lit(1)).alias("_n"))
    out = ends.join(trade_stats(book.where("kind = 'trade'"), cfg), ["strategy", "symbol"], "left").join(fall, ["strategy", "symbol"], "left").join(series, "symbol", "left")
    out = out.fillna(0.0, ["sharpe", "sortino", "hit_rate", "profit_factor", "t_stat", "expectancy", "avg_win", "avg_loss", "avg_bars", "max_drawdown"]).fillna(1.0, ["p_value"]).fillna(0, ["trades"])
    out = out.withColumn("total_return", (F.col("_last") - cfg.capital) / cfg.capital)
    years = F.col("_n") / cfg.per_year
    out = out.withColumn("cagr", F.when((years > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(0.0))
    valid, reason = verdict(cfg)
    return out.withColumn("valid", valid).withColumn("reason", reason).drop("_last", "_n")


def suite(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All strategies on all symbols: the ledger is used four times, so it becomes a table."""
    return stats(bars, kept(ledger(bars, None, cfg), "ledger"), cfg)


def recent_trades(book: DataFrame, n: int = 200) -> DataFrame:
    """The last n trades of each strategy and symbol, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("strategy", "symbol").orderBy(F.col("time").desc(), F.col("entry_time").desc())
    return book.where("kind = 'trade'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def regime_counts(bars: DataFrame) -> DataFrame:
    """Bars per regime (a column of the bars) by symbol, a column each."""
    return bars.groupBy("symbol").pivot("regime", ["trend", "revert", "highvol", "calm"]).count().fillna(0)
