"""Rolling indicators and summary statistics of a bar series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import columns as C
from ..sources.bars import numbered, returns, tail
from ..sources.series import BLOCK, FOLD, in_blocks, placed


#: rows before a bar that each rolling operator needs, by its own number n
HALO = {"sma": -1, "rolling_std": -1, "atr": 0, "zscore": -1, "rolling_half_life": -1, "ewma_momentum": 0, "volume_rank": -1}


def whole(f: Callable[..., DataFrame], n: int, size: int = BLOCK) -> Callable[[DataFrame], DataFrame]:
    """A rolling operator over series of any length: in blocks of a symbol, each with the bars before it that the operator looks back over."""
    apply = (lambda rows, *keys: f(rows, n, *keys)) if f in (sma, rolling_std) else (lambda rows, *keys: f(rows, *keys, n=n))
    return lambda bars: in_blocks(bars, apply, n + HALO[f.__name__], "symbol", size=size)


def sma(bars: DataFrame, n: int, *keys: str) -> DataFrame:
    """Mean of the last n closes, null before there are n."""
    return numbered(bars, *keys).withColumn("sma", F.when(F.col("rn") >= n - 1, F.avg("close").over(C.last_rows(n, *keys))))


def rolling_std(bars: DataFrame, n: int, *keys: str) -> DataFrame:
    return numbered(bars, *keys).withColumn("std", F.when(F.col("rn") >= n - 1, F.stddev_samp("close").over(C.last_rows(n, *keys))))


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))


def atr(bars: DataFrame, *keys: str, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars, null before bar n."""
    return numbered(bars, *keys).withColumn("atr", F.when(F.col("rn") >= n, F.avg(F.when(F.col("prev").isNotNull(), true_range())).over(C.last_rows(n, *keys))))


def zscore(bars: DataFrame, *keys: str, n: int = 48) -> DataFrame:
    w = C.last_rows(n, *keys)
    rows = numbered(bars, *keys).withColumn("mean", F.avg("close").over(w)).withColumn("std", F.coalesce(F.stddev_samp("close").over(w), F.lit(0.0)))
    return rows.withColumn("z", C.over(F.col("close") - F.col("mean"), F.col("std")))


def rolling_half_life(bars: DataFrame, *keys: str, n: int = 48) -> DataFrame:
    """Half-life of the last n closes: n - 1 pairs of a close and the one before, all inside the window."""
    w = C.last_rows(n - 1, *keys)
    slope = F.coalesce(F.regr_slope(F.col("close") - F.col("prev"), F.col("prev")).over(w), F.lit(0.0))
    rows = numbered(bars, *keys).withColumn("slope", slope)
    return rows.withColumn("half_life", F.when(F.col("rn") >= n - 1, A.life_of_slope(F.col("slope"), F.lit(n))))


def ewma_momentum(bars: DataFrame, *keys: str, n: int = 24, alpha: float = 0.18) -> DataFrame:
    """Decay-weighted mean of the last n simple returns, over their deviation."""
    rows = numbered(bars, *keys).withColumn("simple", F.col("close") / F.col("prev") - 1)
    w = C.last_rows(n, *keys)
    rows = rows.withColumn("_r", F.collect_list("simple").over(w)).withColumn("rv", F.coalesce(F.stddev_samp("simple").over(w), F.lit(0.0)))
    return rows.withColumn("weighted", F.when(F.col("rn") >= n, C.ewma(F.col("_r"), alpha))).withColumn("momentum", C.over(F.col("weighted"), F.col("rv"), None)).drop("_r")


def volume_rank(bars: DataFrame, *keys: str, n: int = 50) -> DataFrame:
    rows = numbered(bars, *keys).withColumn("_v", F.collect_list("volume").over(C.last_rows(n, *keys)))
    return rows.withColumn("rank", F.when(F.col("rn") >= n - 1, C.share_at_most(F.col("_v"), F.col("volume")))).drop("_v")


def return_stats(bars: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Per symbol: number, mean, deviation, t, p, Sharpe and Sortino of the log returns."""
    r = F.col("r")
    return returns(bars).groupBy("symbol").agg(F.count(r).alias("n"), A.mean0(r).alias("mean"), C.std0(r).alias("std"), A.t_stat(r).alias("t"), A.t_p_value(r).alias("p"), A.sharpe(r, per_year).alias("sharpe"), A.sortino(r, per_year).alias("sortino"))


def half_life(bars: DataFrame) -> DataFrame:
    return numbered(bars).groupBy("symbol").agg(A.half_life(F.col("close"), F.col("prev")).alias("half_life"))


def max_drawdown(rows: DataFrame, value: str = "close", size: int = FOLD) -> DataFrame:
    """Per symbol the largest fall from a running peak, as a share of the peak, with the places (rn) of peak and trough; the first one of equal falls.

    A block of rows is (peak, lowest value, largest fall, and their places), two blocks in order combine to one: the largest fall is one of
    theirs or that from the earlier peak to the later low. Blocks are folded side by side, a symbol's few results at the end.
    """
    item = F.struct("place", F.col(value).alias("v"))
    blocks = placed(rows.select("symbol", "time", value), "symbol").groupBy("symbol", F.floor(F.col("place") / size).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    one = F.transform("rows", lambda s: F.struct(s["v"].alias("peak"), s["place"].alias("peak_at"), s["v"].alias("low"), s["place"].alias("low_at"), F.lit(0.0).alias("fall"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to")))

    def fold(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], joined_falls)

    folded = blocks.select("symbol", F.struct("block", fold(one).alias("f")).alias("b")).groupBy("symbol").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    out = folded.select("symbol", fold(F.transform("bs", lambda b: b["f"])).alias("f"))
    return out.select("symbol", F.col("f.fall").alias("max_drawdown"), F.col("f.from").alias("peak_at"), F.col("f.to").alias("trough_at"))


def joined_falls(a: Column, b: Column) -> Column:
    """Two neighbouring blocks as one; the earlier of equal peaks, lows and falls stays."""
    drop = F.when(a["peak"] > 0, (a["peak"] - b["low"]) / F.when(a["peak"] > 0, a["peak"])).otherwise(0.0)
    fall = F.greatest(a["fall"], drop, b["fall"])
    mine, across = a["fall"] >= fall, drop >= fall
    # of equal falls the one whose trough comes first
    theirs = (b["fall"] >= fall) & (~across | (b["to"] < b["low_at"]))
    pick = lambda x, y, z: F.when(mine, x).when(theirs, z).otherwise(y)
    return F.struct(
        F.greatest(a["peak"], b["peak"]).alias("peak"), F.when(b["peak"] > a["peak"], b["peak_at"]).otherwise(a["peak_at"]).alias("peak_at"),
        F.least(a["low"], b["low"]).alias("low"), F.when(b["low"] < a["low"], b["low_at"]).otherwise(a["low_at"]).alias("low_at"),
        fall.alias("fall"), pick(a["from"], a["peak_at"], b["from"]).alias("from"), pick(a["to"], b["low_at"], b["to"]).alias("to"),
    )


def price_change(bars: DataFrame) -> DataFrame:
    """The last two closes of each symbol: change, and in percent (0 without one before)."""
    rows = numbered(tail(bars, 2)).where((F.col("prev").isNotNull()) | (F.col("rn") == 0))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("time", "close", "prev"), "time").alias("l")).select("symbol", "l.*")
    change = F.coalesce(F.col("close") - F.col("prev"), F.lit(0.0))
    return last.select("symbol", "time", "close", change.alias("change"), C.over(change * 100, F.coalesce("prev", F.lit(0.0))).alias("change_pct"))


def market_data(bars: DataFrame, symbol: str, n: int = 100) -> DataFrame:
    """The last n bars of a symbol (10 to 1000, whatever is asked) with change and change_pct of its last close; KeyError for a symbol without bars."""
    mine = bars.where(F.col("symbol") == symbol)
    if mine.limit(1).count() == 0:
        raise KeyError(symbol)
    n = max(10, min(1000, n))
    return tail(mine, n).join(price_change(mine).select("symbol", "change", "change_pct"), "symbol")


def downsample(bars: DataFrame, points: int = 300) -> DataFrame:
    """Every k-th bar of a symbol, k = max(1, floor(n / points))."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return numbered(bars).withColumn("_k", F.greatest(F.lit(1), F.floor(n / points))).where(F.col("rn") % F.col("_k") == 0).drop("_k")


def fit_close_on_time(bars: DataFrame) -> DataFrame:
    """Least-squares line of close on bar number, per symbol."""
    return numbered(bars).groupBy("symbol").agg(A.slope0(F.col("close"), F.col("rn")).alias("slope"), F.coalesce(F.regr_intercept("close", "rn"), F.avg("close")).alias("intercept"), F.coalesce(F.regr_r2("close", "rn"), F.lit(0.0)).alias("r2"))
