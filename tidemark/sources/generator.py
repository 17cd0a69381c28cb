"""Seeded bars with regimes: a 32-bit counter generator, normal draws, and prices that follow Markov regimes, a symbol at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import REGIMES, SYMBOLS, TRANSITIONS

# The generator's constants and each symbol's seed.
STEP, WORD = 0x6D2B79F5, 1 << 32
SEEDS = {"EUR/USD": 0xA11CE, "XAU/USD": 0xB0B}
#: regime: volatility as a multiple of the base, volume added
SHAPE = {"trend": (1.0, 800), "revert": (0.85, 0), "highvol": (2.3, 1500), "calm": (0.6, 0)}
DAY_MS = 24 * 60 * 60 * 1000
GENERATED = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double, regime string"


def uniforms(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first to first + n - 1 of a seed, in [0, 1): each follows from its number alone."""
    with np.errstate(over="ignore"):
        a = np.uint32(seed & (WORD - 1)) + np.arange(first + 1, first + n + 1, dtype=np.uint64).astype(np.uint32) * np.uint32(STEP)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t = (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))) ^ t
        return (t ^ (t >> np.uint32(14))) / WORD


def uniform(seed: Column, number: Column) -> Column:
    """The same as an expression: draw `number` (from 0) of `seed`."""
    low = lambda x: x.bitwiseAND(F.lit(WORD - 1))
    right = lambda x, k: F.shiftrightunsigned(x, k)

    def times(x: Column, y: Column) -> Column:
        """Product modulo 2**32 without leaving a long."""
        return low(x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(low(x * right(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16))

    a = low(seed.cast("long") + times(low(number.cast("long") + 1), F.lit(STEP).cast("long")))
    t = times(a.bitwiseXOR(right(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = low(t + times(t.bitwiseXOR(right(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseXOR(t)
    return t.bitwiseXOR(right(t, 14)) / F.lit(float(WORD))


def normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


class Draws:
    """Uniform and normal draws of a seed one after the other."""

    def __init__(self, seed: int, block: int = 1 << 16):
        self.seed, self.block, self.at, self.held = seed, block, 0, []

    def uniform(self) -> float:
        if self.at % self.block == 0:
            self.held = uniforms(self.seed, self.at, self.block).tolist()
        self.at += 1
        return self.held[(self.at - 1) % self.block]

    def normal(self) -> float:
        u = v = 0.0
        while u == 0:
            u = self.uniform()
        while v == 0:
            v = self.uniform()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def next_regime(draws: Draws, now: str) -> str:
    r, reach = draws.uniform(), 0.0
    for regime, p in zip(REGIMES, TRANSITIONS[now]):
        reach += p
        if r <= reach:
            return regime
    return now


def bar_after(draws: Draws, price: float, drift: float, vol: float, tick: float, more: float = 0) -> tuple[float, float, float, float]:
    """(high, low, close, volume) of the bar that opens at price."""
    close = max(price * (1 + drift + vol * draws.normal()), tick)
    wick = abs(draws.normal()) * vol * 0.4
    return max(price, close) * (1 + wick), min(price, close) * (1 - wick), close, float(math.floor(800 + abs(draws.normal()) * 400 + more + 0.5))


def walk(base: float, daily_vol: float, tick: float, n: int, interval_ms: int, seed: int, switch_every: int | None = None) -> Iterator[tuple[float, float, float, float, float, str]]:
    """(open, high, low, close, volume, regime) of n bars. Each bar opens at the close before, so the walk is one loop."""
    draws, price, regime, trend, anchor = Draws(seed), base, "calm", 0.0, base
    sigma = daily_vol * math.sqrt(interval_ms / DAY_MS)
    every = switch_every or max(1, math.floor(DAY_MS / interval_ms + 0.5))
    for i in range(n):
        if i and i % every == 0 and (new := next_regime(draws, regime)) != regime:
            regime = new
            if regime == "trend":
                sign = 1 if draws.uniform() > 0.5 else -1
                trend = sign * sigma * (0.15 + draws.uniform() * 0.2)
            elif regime == "revert":
                anchor = price
        pull = -0.002 * max(-0.3, min(0.3, math.log(max(price, tick) / base)))
        drift = pull + (trend if regime == "trend" else (anchor - price) / price * 0.03 if regime == "revert" else 0.0)
        factor, more = SHAPE[regime]
        high, low, close, volume = bar_after(draws, price, drift, sigma * factor, tick, more)
        yield price, high, low, close, volume, regime
        price = close


def generated_bars(spark: SparkSession, bars: int = 96_000, interval_ms: int = 3_600_000, start: datetime | None = None, seeds: dict[str, int] | None = None) -> DataFrame:
    """Bars with regimes of each symbol of `seeds` (its config from SYMBOLS), the last one before now, or from `start` on. Symbols are walked side by side."""
    begin = start or datetime.now().replace(microsecond=0) - timedelta(milliseconds=bars * interval_ms)
    config = {s[0]: s for s in SYMBOLS}
    seeds = SEEDS if seeds is None else seeds
    rows = [(s, config[s][1], config[s][2], config[s][4], seed) for s, seed in seeds.items()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        out = pd.DataFrame(list(walk(r["base"], r["vol"], r["tick"], bars, interval_ms, int(r["seed"]))), columns=["open", "high", "low", "close", "volume", "regime"])
        out["symbol"], out["time"] = r["symbol"], pd.to_datetime(begin) + pd.to_timedelta(np.arange(bars) * interval_ms, unit="ms")
        return out[["symbol", "time", "open", "high", "low", "close", "volume", "regime"]]

    return spark.createDataFrame(rows, "symbol string, base double, vol double, tick double, seed long").groupBy("symbol").applyInPandas(run, GENERATED)


def live_ticks(last: DataFrame, interval_ms: int = 3_600_000, seed: int = 1) -> DataFrame:
    """The bar after each symbol's last one (symbol, time, close): no drift, the base volatility, the seed's draws 0 to 5; all expressions."""
    config = last.sparkSession.createDataFrame([(s[0], s[2] * math.sqrt(interval_ms / DAY_MS), s[4]) for s in SYMBOLS], "symbol string, _s double, _t double")
    own = F.xxhash64("symbol").bitwiseAND(F.lit(0xFFFF)) + F.lit(seed)
    draw = lambda k: F.greatest(uniform(own, F.lit(k)), F.lit(1 / WORD))
    rows = last.join(F.broadcast(config), "symbol").withColumn("open", F.col("close"))
    rows = rows.withColumn("close", F.greatest(F.col("open") * (1 + F.col("_s") * normal(draw(0), draw(1))), F.col("_t"))).withColumn("_w", F.abs(normal(draw(2), draw(3))) * F.col("_s") * 0.4)
    time = (F.col("time") + F.make_dt_interval(secs=F.lit(interval_ms / 1000))).alias("time")
    return rows.select("symbol", time, "open", (F.greatest("open", "close") * (1 + F.col("_w"))).alias("high"), (F.least("open", "close") * (1 - F.col("_w"))).alias("low"), "close", F.floor(800.5 + F.abs(normal(draw(4), draw(5))) * 400).cast("double").alias("volume"))
