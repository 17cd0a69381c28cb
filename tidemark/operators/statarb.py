"""Statistical arbitrage of a pair: Ornstein-Uhlenbeck fit, Kalman hedge ratio, cointegration, and the signal they agree on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.bars import PAIR, in_pair_order, side_by_side, tail
from ..sources.series import FOLD, blocks_of, placed, pooled, scanned
from ..sources.tables import written

INF = float("inf")


def log_pair(bars: DataFrame, pairs: list[tuple[str, str]], n: int | None = None) -> DataFrame:
    """Log closes of the symbols of each pair at all their common times, or the last n: x_symbol, y_symbol, time, rn, x, y, n. All of them are numbered without a window over a pair."""
    both = side_by_side(bars, F.ln("close"), pairs)
    return in_pair_order(tail(both, n, *PAIR)) if n else placed(both, *PAIR).withColumnRenamed("place", "rn")


def kalman(pair: DataFrame, q: float = 1e-4, r: float = 1e-3, warmup: int = 30, size: int = FOLD, most: int | None = None, entry: float = 2.0) -> DataFrame:
    """A row a pair: hedge ratio of y on x after the last bar, its variance, last innovation with mean, deviation and z, signal (where z is beyond `entry`).

    Both series are demeaned; the ratio starts at the least-squares slope of the first `warmup` bars and then walks. Fewer than 40 bars
    give the slope alone. A pair is cut into blocks of `size` bars (by rn): a bar takes the variance p to (r p + r q) / (x^2 p + x^2 q + r), so a
    block is a product of 2 x 2 matrices, and a scan gives the variance before each; then the gains are known, a bar takes the ratio b to (1 - gain x) b +
    gain y, and a second scan gives the ratio before each block. Innovations are folded side by side. `most`: bars of the longest pair, counted if not given.
    """
    key = list(PAIR)
    whole = pair.groupBy(*PAIR).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_slope(F.when(F.col("rn") < warmup, F.col("y")), F.when(F.col("rn") < warmup, F.col("x"))), F.lit(0.0)).alias("b0"))
    if most is None:
        most = blocks_of(pair, "rn", size) * size
    d = pair.select(*PAIR, "rn", "x", "y").join(whole.select(*PAIR, "mx", "my"), key)
    bar = F.when(F.col("rn") >= warmup, F.struct("rn", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y")))
    blocks = d.groupBy(*PAIR, F.floor(F.col("rn") / size).alias("block")).agg(F.array_sort(F.collect_list(bar)).alias("rows"))
    several = most > size
    if several:
        blocks = written(blocks, "pairs")
    blocks = blocks.join(whole.select(*PAIR, "b0", (F.greatest(F.col("b0") * 0.01, F.lit(0.01)) + 0.01).alias("p")), key)
    if several:
        blocks = _with_variance(blocks, q, r, -(-most // size))
        blocks = _with_ratio(blocks, q, r, -(-most // size))
    start = F.struct(F.col("b0").alias("b"), "p", *[F.lit(0.0).alias(c) for c in ("e", "k", "m", "ss")])

    def step(acc: Column, s: Column) -> Column:
        p, gain = _gain(acc["p"], s["x"], q, r)
        err = s["y"] - s["x"] * acc["b"]
        k = acc["k"] + 1
        mean = acc["m"] + (err - acc["m"]) / k
        return F.struct((acc["b"] + gain * err).alias("b"), F.greatest((1 - gain * s["x"]) * p, F.lit(0.0)).alias("p"), err.alias("e"), k.alias("k"), mean.alias("m"), (acc["ss"] + (err - acc["m"]) * (err - mean)).alias("ss"))

    # the last block may be one of warmup bars alone: it hands on what it got
    ends = blocks.select(*PAIR, "block", F.aggregate("rows", start, step).alias("w"))
    k = ends.groupBy(*PAIR).agg(F.max_by(F.struct("w.b", "w.p", "w.e"), "block").alias("l"), *pooled("w")).join(whole.select(*PAIR, "n", "slope"), key).select(*PAIR, "n", "slope", "l.*", "k", "mean", "ss")
    k = k.withColumn("std", F.greatest(F.coalesce(F.sqrt(F.try_divide(F.greatest(F.col("ss"), F.lit(0.0)), F.col("k") - 1)), F.lit(0.0)), F.lit(1e-9)))
    last = F.col("e")
    enough = F.col("n") >= 40
    z = F.when(enough, (last - F.col("mean")) / F.col("std")).otherwise(0.0)
    return k.select(*PAIR, F.when(enough, F.col("b")).otherwise(F.col("slope")).alias("hedge_ratio"), F.when(enough, F.col("p")).otherwise(0.0).alias("variance"), F.when(enough, last).otherwise(0.0).alias("residual"), z.alias("kalman_z"), F.when(z > entry, "short-residual").when(z < -entry, "long-residual").otherwise("none").alias("kalman_signal"))


def _gain(p: Column, x: Column, q: float, r: float) -> tuple[Column, Column]:
    """The variance before a bar, and the gain at it."""
    p = p + q
    return p, p * x / (x * x * p + r)


def _times(m: Column, k: Column) -> Column:
    """Product k m of 2 x 2 matrices (a b / c d), scaled to a largest entry of 1: the map it stands for stays."""
    cells = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    raw = cells(k["a"] * m["a"] + k["b"] * m["c"], k["a"] * m["b"] + k["b"] * m["d"], k["c"] * m["a"] + k["d"] * m["c"], k["c"] * m["b"] + k["d"] * m["d"])
    return F.transform(F.array(raw), lambda t: F.transform(F.array(F.greatest(F.abs(t["a"]), F.abs(t["b"]), F.abs(t["c"]), F.abs(t["d"]))), lambda s: cells(t["a"] / s, t["b"] / s, t["c"] / s, t["d"] / s))[0])[0]


def _with_variance(blocks: DataFrame, q: float, r: float, most: int) -> DataFrame:
    """Blocks with p, the variance before each."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"))
    bar = lambda x: F.struct(F.lit(r).alias("a"), F.lit(r * q).alias("b"), (x * x).alias("c"), (x * x * q + r).alias("d"))
    maps = blocks.select(*PAIR, "block", F.aggregate("rows", one, lambda m, s: _times(m, bar(s["x"]))).alias("map"))
    known = scanned(maps, "map", _times, most, *PAIR).drop("map")
    m, p = F.col("before"), F.col("p")
    return blocks.join(known, [*PAIR, "block"]).withColumn("p", F.when(m.isNull(), p).otherwise((m["a"] * p + m["b"]) / (m["c"] * p + m["d"]))).drop("before")


def _with_ratio(blocks: DataFrame, q: float, r: float, most: int) -> DataFrame:
    """Blocks with b0, the ratio before each, their p being known."""
    start = F.struct("p", F.lit(1.0).alias("f"), F.lit(0.0).alias("g"))

    def step(acc: Column, s: Column) -> Column:
        p, gain = _gain(acc["p"], s["x"], q, r)
        keep = 1 - gain * s["x"]
        return F.struct(F.greatest(keep * p, F.lit(0.0)).alias("p"), (keep * acc["f"]).alias("f"), (keep * acc["g"] + gain * s["y"]).alias("g"))

    maps = blocks.select(*PAIR, "block", F.aggregate("rows", start, step, lambda acc: F.struct(acc["f"].alias("f"), acc["g"].alias("g"))).alias("map"))
    both = lambda e, l: F.struct((l["f"] * e["f"]).alias("f"), (l["f"] * e["g"] + l["g"]).alias("g"))  # noqa: E731, E741
    known = scanned(maps, "map", both, most, *PAIR).drop("map")
    return blocks.join(known, [*PAIR, "block"]).withColumn("b0", F.when(F.col("before").isNull(), F.col("b0")).otherwise(F.col("before.f") * F.col("b0") + F.col("before.g"))).drop("before")


def ou(spread: DataFrame, max_holding: int = 48, entry: float = 2.0, shortest: float = 1.0) -> DataFrame:
    """A row a pair from rows (x_symbol, y_symbol, rn, s): theta, mu, sigma, half_life, z of the last value, whether the half-life suits the holding, signal."""
    rows = spread.withColumn("p", F.lag("s").over(Window.partitionBy(*PAIR).orderBy("rn")))
    fit = rows.groupBy(*PAIR).agg(F.coalesce(F.regr_slope("s", "p"), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept("s", "p"), F.avg("s")).alias("a"), F.count(F.lit(1)).alias("n"), F.avg("s").alias("m"), C.std0(F.col("s")).alias("sd"), F.max_by("s", "rn").alias("last"), F.regr_syy("s", "p").alias("syy"), F.regr_sxy("s", "p").alias("sxy"))
    # the residuals of a line with intercept have mean zero: their squares sum to syy - b * sxy
    enough, reverts = F.col("n") >= 30, (F.col("b") > 0) & (F.col("b") < 1)
    b_in = F.when(reverts, F.col("b"))
    theta = F.when(enough & reverts, -F.ln(b_in)).otherwise(0.0)
    life = F.when(enough & reverts, -math.log(2) / F.ln(b_in)).otherwise(F.lit(INF))
    mu = F.when(enough & (F.col("b") != 1), F.try_divide(F.col("a"), 1 - F.col("b"))).otherwise(F.col("m"))
    resid = F.greatest(F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))), F.lit(1e-9))
    out = fit.select(*PAIR, theta.alias("theta"), mu.alias("mu"), F.when(enough, resid).otherwise(F.col("sd")).alias("sigma"), life.alias("half_life"), "last", enough.alias("_ok"))
    out = out.withColumn("z", F.when(F.col("_ok"), (F.col("last") - F.col("mu")) / F.col("sigma")).otherwise(0.0)).withColumn("half_life_valid", F.col("_ok") & (F.col("theta") > 0) & (F.col("half_life") >= shortest) & (F.col("half_life") <= max_holding))
    return out.withColumn("signal", F.when(F.col("half_life_valid") & (F.col("z") > entry), "short-spread").when(F.col("half_life_valid") & (F.col("z") < -entry), "long-spread").otherwise("none")).drop("_ok")


def cointegration(pair: DataFrame) -> DataFrame:
    """A row a pair: slope and intercept of y on x, t of the residuals' own reversion, trace (-3 t), p, verdict; none for fewer than 50 bars."""
    every = Window.partitionBy(*PAIR)
    rows = pair.withColumn("b", F.regr_slope("y", "x").over(every)).withColumn("a", F.regr_intercept("y", "x").over(every))
    rows = rows.withColumn("e", F.col("y") - (F.col("a") + F.col("b") * F.col("x"))).withColumn("ep", F.lag("e").over(every.orderBy("rn")))
    d = rows.withColumn("de", F.col("e") - F.col("ep")).where(F.col("ep").isNotNull())
    fit = d.groupBy(*PAIR).agg(F.max("a").alias("alpha"), F.max("b").alias("beta"), F.count(F.lit(1)).alias("m"), F.coalesce(F.regr_slope("de", "ep"), F.lit(0.0)).alias("g"), F.regr_syy("de", "ep").alias("syy"), F.regr_sxy("de", "ep").alias("sxy"), F.sum(F.col("ep") * F.col("ep")).alias("sxx"))
    resid = C.or_tiny(F.sqrt(F.greatest(F.col("syy") - F.col("g") * F.col("sxy"), F.lit(0.0)) / (F.col("m") - 1)))
    t = C.over(F.col("g"), resid / F.sqrt(F.col("sxx")))
    out = fit.select(*PAIR, "alpha", "beta", F.when(F.col("m") + 1 < 50, F.lit(None)).otherwise(t).alias("t"))
    return out.select(*PAIR, "alpha", "beta", F.coalesce("t", F.lit(0.0)).alias("t"), F.greatest(F.lit(0.0), F.coalesce(-F.col("t") * 3, F.lit(0.0))).alias("trace"), F.coalesce(C.normal_cdf(F.col("t")), F.lit(1.0)).alias("p"), F.coalesce((-F.col("t") * 3 > 12.25) & (F.col("t") < -2.86), F.lit(False)).alias("cointegrated"))


def report(bars: DataFrame, pairs: list[tuple[str, str]], n: int = 500, max_holding: int = 48, entry: float = 2.0, shortest: float = 1.0) -> DataFrame:
    """A row a pair: hedge ratio, spread fit, cointegration, the signal that spread and residual agree on, and whether it may trade.

    The spread takes the intercept of the least-squares line and the Kalman ratio.
    """
    pair, key = log_pair(bars, pairs, n), list(PAIR)
    params = kalman(pair, most=n, entry=entry).join(cointegration(pair), key)
    spread = pair.join(params.select(*key, "alpha", "hedge_ratio"), key).select(*key, "rn", (F.col("y") - (F.col("alpha") + F.col("hedge_ratio") * F.col("x"))).alias("s"))
    out = params.join(ou(spread, max_holding, entry, shortest), key)
    agree = (F.col("signal") != "none") & (F.col("kalman_signal") != "none") & ((F.col("signal") == "long-spread") == (F.col("kalman_signal") == "long-residual"))
    return out.withColumn("composite", F.when(agree, F.col("signal")).otherwise("none")).withColumn("gate", F.when(F.col("half_life_valid") & F.col("cointegrated"), "open").otherwise("closed")).withColumnRenamed("p", "p_value")
