"""Rule strategies: indicators as window columns, and the decision of a bar without a position as a ladder over them.

A strategy is open to users: a class with code, name, kind, indicators(bars) and the decide(row, position) rule of the backtest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import columns as C
from ..sources.bars import numbered
from .rolling import true_range


@dataclass
class Position:
    """An open position, as decide() sees it."""

    long: bool
    price: float
    held: int


class Strategy(Protocol):
    code: str
    name: str
    kind: str
    #: the columns that decide() reads, besides close
    columns: tuple[str, ...]

    def indicators(self, bars: DataFrame) -> DataFrame: ...

    def entry(self) -> tuple[Column, Column, Column]: ...

    def decide(self, row: dict[str, Any], position: Position | None) -> tuple[str, float, float | None, str]: ...


def _flat(row: dict[str, Any]) -> tuple[str, float, float | None, str]:
    """What entry() has put on the bar."""
    return row["action"], row["strength"], row["stop"], "signal"


HOLD = ("hold", 0.0, None, "")


def ready(rn: Column, at: int, *needed: Column) -> Column:
    ok = rn >= at
    for c in needed:
        ok = ok & c.isNotNull() & (c != 0)
    return ok


class ZScoreReversion:
    """Against closes over 1.8 deviations off their mean of 48 bars, where the window reverts within 60 bars."""

    code, name, kind = "zscore-mr", "Z-score reversion", "mean-reversion"
    columns = ("z",)

    def indicators(self, bars: DataFrame) -> DataFrame:
        w, wl = C.last_rows(48), C.last_rows(47)
        rows = numbered(bars).withColumn("mean", F.avg("close").over(w)).withColumn("sd", F.stddev_samp("close").over(w))
        rows = rows.withColumn("_slope", F.coalesce(F.regr_slope(F.col("close") - F.col("prev"), F.col("prev")).over(wl), F.lit(0.0)))
        ok = ready(F.col("rn"), 58, F.col("sd"))
        return rows.withColumn("half_life", A.life_of_slope(F.col("_slope"), F.lit(48))).withColumn("z", F.when(ok, F.try_divide(F.col("close") - F.col("mean"), F.col("sd")))).drop("_slope")

    def entry(self) -> tuple[Column, Column, Column]:
        z = F.when((F.col("half_life") > 0) & (F.col("half_life") < 60), F.col("z"))
        action = F.when(z > 1.8, "enter-short").when(z < -1.8, "enter-long").otherwise("hold")
        return action, F.when(F.abs(z) > 1.8, F.least(F.lit(1.0), (F.abs(z) - 1.8) / 1.5)).otherwise(0.0), 3.5 * F.col("sd")

    def decide(self, row, position):
        z = row["z"]
        if position is None or z is None:
            return HOLD if z is None else _flat(row)
        toward = z if position.long else -z
        if toward < -3.5:
            return "exit", 1.0, None, "stop"
        if position.held >= 24:
            return "exit", 1.0, None, "time stop"
        return ("exit", min(1.0, abs(z) / 2), None, "reverted") if toward > -0.3 else HOLD


class DecayMomentum:
    """With the decay-weighted mean of 24 returns where it exceeds 0.7 of their deviation."""

    code, name, kind = "decay-mom", "Decay-weighted momentum", "momentum"
    columns = ("signal",)

    def indicators(self, bars: DataFrame) -> DataFrame:
        w = C.last_rows(24)
        rows = numbered(bars).withColumn("_s", F.col("close") / F.col("prev") - 1)
        rows = rows.withColumn("_r", F.collect_list("_s").over(w)).withColumn("rv", F.stddev_samp("_s").over(w))
        return rows.withColumn("weighted", C.ewma(F.col("_r"), 0.18)).withColumn("signal", F.when(ready(F.col("rn"), 34, F.col("rv")), F.try_divide(F.col("weighted"), F.col("rv")))).drop("_s", "_r")

    def entry(self) -> tuple[Column, Column, Column]:
        s = F.col("signal")
        action = F.when(s > 0.7, "enter-long").when(s < -0.7, "enter-short").otherwise("hold")
        return action, F.when(F.abs(s) > 0.7, F.least(F.lit(1.0), (F.abs(s) - 0.7) / 1.3)).otherwise(0.0), F.col("rv") * 2.5

    def decide(self, row, position):
        s = row["signal"]
        if position is None or s is None:
            return HOLD if s is None else _flat(row)
        return ("exit", min(1.0, abs(s)), None, "faded") if (s if position.long else -s) < 0.05 else HOLD


class VolBreakout:
    """With moves over 1.4 mean true ranges (14 bars) on volume above the 60th percentile of 50."""

    code, name, kind = "vol-breakout", "Volatility breakout", "breakout"
    columns = ("atr",)

    def indicators(self, bars: DataFrame) -> DataFrame:
        rows = numbered(bars).withColumn("_tr", true_range()).withColumn("atr", F.when(F.col("rn") >= 55, F.nullif(F.avg("_tr").over(C.last_rows(14)), F.lit(0.0))))
        rows = rows.withColumn("move", (F.col("close") - F.col("prev")) / F.col("atr")).withColumn("_v", F.collect_list("volume").over(C.last_rows(50)))
        return rows.withColumn("vol_pct", C.share_at_most(F.col("_v"), F.col("volume"))).drop("_tr", "_v")

    def entry(self) -> tuple[Column, Column, Column]:
        hit = (F.abs("move") > 1.4) & (F.col("vol_pct") > 0.6)
        return F.when(hit & (F.col("move") > 0), "enter-long").when(hit, "enter-short").otherwise("hold"), F.when(hit, F.least(F.lit(1.0), F.abs("move") / 3)).otherwise(0.0), 1.8 * F.col("atr")

    def decide(self, row, position):
        a = row["atr"]
        if position is None or a is None:
            return HOLD if a is None else _flat(row)
        off = row["close"] - position.price
        return ("exit", 1.0, None, "stop") if (off if position.long else -off) < -1.8 * a or position.held >= 18 else HOLD


class CarryProxy:
    """Against extremes of the slope between fast (8) and slow (34) means of log returns."""

    code, name, kind = "carry-proxy", "Carry proxy", "carry"
    columns = ("slow", "ups", "downs")

    def indicators(self, bars: DataFrame) -> DataFrame:
        w3 = C.last_rows(3)
        rows = numbered(bars).withColumn("_l", F.ln(F.col("close") / F.col("prev"))).withColumn("_r", F.collect_list("_l").over(C.last_rows(34)))
        ok = F.col("rn") >= 44
        rows = rows.withColumn("fast", F.when(ok, C.ewma(F.slice("_r", -8, 8), 2 / 9))).withColumn("slow", F.when(ok, C.ewma(F.col("_r"), 2 / 35)))
        rows = rows.withColumn("slope", F.col("fast") - F.col("slow")).withColumn("slope_pct", F.when(ok, C.share_at_most(F.col("_r"), F.col("slope"))))
        return rows.withColumn("ups", F.sum((F.col("_l") > 0).cast("int")).over(w3)).withColumn("downs", F.sum((F.col("_l") < 0).cast("int")).over(w3)).drop("_l", "_r")

    def entry(self) -> tuple[Column, Column, Column]:
        short, long = (F.col("slope") > 0) & (F.col("slope_pct") > 0.8), (F.col("slope") < 0) & (F.col("slope_pct") < 0.2)
        stop = F.greatest(F.abs("slow") * 6 * F.col("close"), F.col("close") * 0.004)
        return F.when(short, "enter-short").when(long, "enter-long").otherwise("hold"), F.when(short, F.least(F.lit(1.0), F.col("slope_pct"))).when(long, F.least(F.lit(1.0), 1 - F.col("slope_pct"))).otherwise(0.0), stop

    def decide(self, row, position):
        slow = row["slow"]
        if position is None or slow is None:
            return HOLD if slow is None else _flat(row)
        moved = math.log(row["close"] / position.price)
        if (moved if position.long else -moved) < -6 * abs(slow):
            return "exit", 1.0, None, "adverse move"
        if (row["downs"] if position.long else row["ups"]) >= 3:
            return "exit", 1.0, None, "slope flipped"
        return ("exit", 1.0, None, "time stop") if position.held >= 30 else HOLD


STRATEGIES: dict[str, Strategy] = {s.code: s for s in (ZScoreReversion(), DecayMomentum(), VolBreakout(), CarryProxy())}
FAMILY = {"mean-reversion": "mean-reversion", "momentum": "momentum", "breakout": "breakout-prep", "carry": "always"}


def strategy(code: str) -> Strategy:
    """KeyError for an unknown code."""
    return STRATEGIES[code]


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(s.code, s.name, s.kind, FAMILY.get(s.kind, "always")) for s in STRATEGIES.values()], "code string, name string, kind string, family string")


def signals(bars: DataFrame, code: str) -> DataFrame:
    """Every bar with the strategy's indicators and its decision without a position: action, strength, stop (distance)."""
    s = strategy(code)
    action, strength, stop = s.entry()
    rows = s.indicators(bars).withColumn("action", action).withColumn("strength", F.coalesce(strength, F.lit(0.0)))
    return rows.withColumn("stop", F.when(F.col("action") != "hold", stop)).withColumn("strategy", F.lit(s.code))
