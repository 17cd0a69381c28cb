"""Long memory: rescaled range, detrended fluctuation, multifractal spectrum, curve length dimension, and the gate they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import columns as C
from ..sources.bars import numbered, returns

Q_VALUES = (-4.0, -2.0, -1.0, 0.0, 1.0, 2.0, 4.0)


def scales(top: int, first: int = 8, growth: float = 1.4) -> list[int]:
    """Block sizes from `first`, each 1.4 times the one before, up to top."""
    out = []
    while first <= top:
        out.append(first)
        first = int(first * growth)
    return out


#: for series of any length; those above half a series are left out by row
SCALES = scales(1 << 62)


def blocks(rets: DataFrame, *keys: str) -> DataFrame:
    """Returns (rn, r, n) with tau and block for each block size up to n / 2; rows after the last whole block are left out."""
    fit = lambda top: F.filter(F.array(*[F.lit(t).cast("long") for t in SCALES if t <= top]), lambda t: t <= F.floor(F.col("n") / 2))
    tau = F.explode(F.when(F.col("n") <= 1 << 20, fit(1 << 19)).otherwise(fit(1 << 62)))  # a short list for most
    return rets.select(*keys, "rn", "r", "n", tau.alias("tau")).withColumn("block", F.floor(F.col("rn") / F.col("tau"))).where((F.col("block") + 1) * F.col("tau") <= F.col("n"))


def _exponent(points: DataFrame, y: str, counts: DataFrame, *keys: str, least: int = 32) -> DataFrame:
    """Slope and r2 of ln y on ln tau by key, clamped to 0..1; 0.5 for fewer than three points or fewer returns than `least`."""
    good = F.when(F.col(y) > 0, F.col(y))
    slope, r2 = A.log_fit(good, F.when(F.col(y) > 0, F.col("tau")))
    fit = points.groupBy(*keys).agg(slope.alias("_s"), r2.alias("_r"), F.count(F.col(y)).alias("_m"))
    ok = (F.col("_m") >= 3) & (F.col("n") >= least)
    out = counts.join(fit, list(keys), "left")
    return out.select(*keys, F.when(ok, C.clamp01(F.col("_s"))).otherwise(0.5).alias("h"), F.when(ok, F.col("_r")).otherwise(0.0).alias("r2"))


def _counts(rets: DataFrame, *keys: str) -> DataFrame:
    return rets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rescaled_range(rets: DataFrame, *keys: str) -> DataFrame:
    """Hurst exponent from the range of cumulated deviations over the deviation, block by block."""
    keys = keys or ("symbol",)
    cell = [*keys, "tau", "block"]
    rows = blocks(rets, *keys).withColumn("_dev", F.col("r") - F.avg("r").over(Window.partitionBy(*cell)))
    rows = rows.withColumn("_cum", F.sum("_dev").over(Window.partitionBy(*cell).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy(*cell).agg((F.max("_cum") - F.min("_cum")).alias("_range"), F.sqrt(F.sum(F.col("_dev") * F.col("_dev")) / F.col("tau")).alias("_std"))
    points = each.where(F.col("_std") > 0).groupBy(*keys, "tau").agg(F.avg(F.col("_range") / F.col("_std")).alias("rs"))
    return _exponent(points, "rs", _counts(rets, *keys), *keys)


def fluctuations(rets: DataFrame, *keys: str) -> DataFrame:
    """f2 by key, tau and block: mean squared residual of the cumulated, demeaned returns about each block's own line."""
    keys = keys or ("symbol",)
    w = Window.partitionBy(*keys)
    profile = rets.withColumn("r", F.col("r") - F.avg("r").over(w)).withColumn("r", F.sum("r").over(w.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    line = F.regr_syy("r", "rn") - F.coalesce(F.try_divide(F.regr_sxy("r", "rn") * F.regr_sxy("r", "rn"), F.regr_sxx("r", "rn")), F.lit(0.0))
    return blocks(profile, *keys).groupBy(*keys, "tau", "block").agg((F.greatest(line, F.lit(0.0)) / F.col("tau")).alias("f2"))


def detrended(rets: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("symbol",)
    points = fluctuations(rets, *keys).groupBy(*keys, "tau").agg(F.avg(F.sqrt("f2")).alias("f"))
    return _exponent(points, "f", _counts(rets, *keys), *keys)


def spectrum(rets: DataFrame, *keys: str) -> DataFrame:
    """Generalised exponents h by q: power means of f2 (the geometric one for q = 0) against tau."""
    keys = keys or ("symbol",)
    rows = fluctuations(rets, *keys).where(F.col("f2") > 0).withColumn("q", F.explode(F.array(*map(F.lit, Q_VALUES))))
    q = F.col("q")
    power = F.avg(F.when(q != 0, F.pow("f2", q / 2)).otherwise(F.ln("f2") / 2))
    points = rows.groupBy(*keys, "tau", "q").agg(power.alias("_m")).withColumn("f", F.when(q != 0, F.pow("_m", F.try_divide(F.lit(1.0), q))).otherwise(F.exp("_m")))
    counts = _counts(rets, *keys).withColumn("q", F.explode(F.array(*map(F.lit, Q_VALUES))))
    return _exponent(points, "f", counts, *keys, "q", least=64).select(*keys, "q", "h")


def complexity(rets: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("symbol",)
    out = spectrum(rets, *keys).groupBy(*keys).agg((F.max("h") - F.min("h")).alias("delta_h"), F.max(F.when(F.col("q") == 2, F.col("h"))).alias("h2"))
    return out.withColumn("complexity", F.when(F.col("delta_h") < 0.15, "simple").when(F.col("delta_h") > 0.4, "complex").otherwise("moderate"))


def curve_dimension(bars: DataFrame, *keys: str, k_max: int = 8, by_step: bool = False) -> DataFrame:
    """Dimension of the closes from curve lengths at steps 1 to k_max, clamped to 1..2; 1.5 for fewer than 32 closes.

    Lengths are divided by the number of steps, as the results to match are; with by_step by k, which is the usual definition.
    """
    keys = keys or ("symbol",)
    rows = numbered(bars, *keys).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    ahead = [F.abs(F.lead("close", k).over(C.by_time(*keys)) - F.col("close")) for k in range(1, k_max + 1)]
    rows = rows.select(*keys, "rn", "_n", F.array(*ahead).alias("_d"))
    rows = rows.select(*keys, "rn", "_n", F.posexplode("_d").alias("_k", "d")).withColumn("k", F.col("_k") + 1).where(F.col("k") <= F.floor(F.col("_n") / 4))
    rows = rows.withColumn("m", F.col("rn") % F.col("k"))
    n, k, m = F.col("_n"), F.col("k"), F.col("m")
    count = F.floor((n - m - 1) / k)
    norm = (n - 1) / (F.floor((n - m) / k) * k) / (k if by_step else count)
    curves = rows.groupBy(*keys, "_n", "k", "m").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("l")).withColumn("l", F.when(count > 0, F.col("l") * norm).otherwise(F.col("l")))
    lengths = curves.groupBy(*keys, "_n", "k").agg((F.sum("l") / F.col("k")).alias("l"))
    good = F.col("l") > 0
    slope, r2 = A.log_fit(F.when(good, F.col("l")), F.when(good, 1 / F.col("k")))
    fit = lengths.groupBy(*keys).agg(slope.alias("_s"), r2.alias("_r"), F.count(F.when(good, 1)).alias("_m"))
    out = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(fit, list(keys), "left")
    ok = (F.col("_m") >= 3) & (F.col("n") >= 32)
    out = out.select(*keys, F.when(ok, C.clamp(F.col("_s"), 1.0, 2.0)).otherwise(1.5).alias("dimension"), F.when(ok, F.col("_r")).otherwise(0.0).alias("r2"))
    return out.withColumn("quality", F.when(F.col("dimension") < 1.4, "high").when(F.col("dimension") > 1.7, "low").otherwise("medium"))


TIMEFRAMES = (("1H", 1), ("4H", 4), ("1D", 24))


def timeframes(bars: DataFrame, *keys: str) -> DataFrame:
    """Both Hurst exponents by key and timeframe (those with 32 returns or more), their mean and distance from the first timeframe's.

    A bar goes to a block of each timeframe at once; a block's bar is its aggregate.
    """
    keys = keys or ("symbol",)
    frames = F.array(*[F.struct(F.lit(name).alias("timeframe"), F.lit(place).alias("place"), F.lit(factor).alias("factor")) for place, (name, factor) in enumerate(TIMEFRAMES)])
    rows = numbered(bars, *keys).select(*keys, "rn", "time", "close", F.explode(frames).alias("f"))
    each = (*keys, "timeframe", "place")
    blocks_ = rows.groupBy(*keys, F.col("f.timeframe").alias("timeframe"), F.col("f.place").alias("place"), F.floor(F.col("rn") / F.col("f.factor")).alias("block")).agg(F.min("time").alias("time"), F.max_by("close", "time").alias("close"))
    own = returns(blocks_, *each).select(*each, "rn", "r", "n").where(F.col("n") >= 32)
    both = rescaled_range(own, *each).select(*each, F.col("h").alias("rs")).join(detrended(own, *each).select(*each, F.col("h").alias("dfa")), list(each))
    both = both.withColumn("h", (F.col("rs") + F.col("dfa")) / 2).withColumn("regime", C.regime_of_hurst(F.col("h")))
    base = F.min_by("h", "place").over(Window.partitionBy(*keys))
    return both.withColumn("dislocation", F.abs(F.col("h") - base))


def gate(mean_h: Column, dimension: Column, quality: Column, delta_h: Column) -> tuple[Column, Column]:
    """(what the exponents endorse, whether trades may pass)."""
    dispatch = F.when(mean_h > 0.55, "momentum").when(mean_h < 0.45, "mean-reversion").otherwise("reduce-exposure")
    confirmed = ((mean_h > 0.55) & (dimension < 1.4)) | ((mean_h < 0.45) & (dimension > 1.7))
    plain = F.when(dispatch == "reduce-exposure", "closed").when(quality == "medium", "caution").when(confirmed, "open").otherwise("closed")
    return dispatch, F.when(delta_h > 0.5, "closed").when((delta_h > 0.4) & (plain == "open"), "caution").otherwise(plain)


def report(bars: DataFrame) -> DataFrame:
    """Per symbol: mean Hurst exponent, largest distance between timeframes and which, spectrum width, dimension, dispatch and gate."""
    frames = timeframes(bars)
    a, b = frames.alias("a"), frames.alias("b")
    pairs = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.place") < F.col("b.place")), "inner")
    far = F.abs(F.col("a.h") - F.col("b.h"))
    label = F.concat(F.col("a.timeframe"), F.lit(" vs "), F.col("b.timeframe"))
    widest = pairs.groupBy(F.col("a.symbol").alias("symbol")).agg(F.max_by(F.struct(far.alias("d"), label.alias("label")), F.struct(far, -F.col("a.place"), -F.col("b.place"))).alias("w"))
    means = frames.groupBy("symbol").agg(F.avg("h").alias("mean_h"))
    out = bars.groupBy("symbol").agg(F.max("time").alias("time")).join(means, "symbol", "left").join(widest, "symbol", "left").join(complexity(returns(bars)), "symbol", "left").join(curve_dimension(bars), "symbol", "left")
    out = out.withColumn("mean_h", F.coalesce("mean_h", F.lit(0.5))).withColumn("delta_h", F.coalesce("delta_h", F.lit(0.0)))
    dispatch, allowed = gate(F.col("mean_h"), F.col("dimension"), F.col("quality"), F.col("delta_h"))
    return out.select("symbol", "time", "mean_h", F.coalesce(F.col("w.d"), F.lit(0.0)).alias("max_dislocation"), F.when(F.coalesce(F.col("w.d"), F.lit(0.0)) > 0, F.col("w.label")).otherwise("-").alias("dislocated"), "delta_h", "h2", "complexity", "dimension", "quality", dispatch.alias("dispatch"), allowed.alias("gate"))
