"""Order flow: bulk volume classification, VPIN, price impact, illiquidity, delta divergence, and their blend."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.bars import numbered
from ..sources.series import BLOCK, placed
from ..sources.tables import written


def classify_volume(bars: DataFrame, *keys: str, n: int = 20) -> DataFrame:
    """Bars with buy, sell and delta: volume split by the normal probability of the price change over its recent deviation; the first bar in half."""
    rows = numbered(bars, *keys).withColumn("dp", F.col("close") - F.col("prev"))
    sigma = F.greatest(F.coalesce(F.stddev_samp("dp").over(C.last_rows(n, *keys)), F.lit(0.0)), F.lit(1e-9))
    up = F.when(F.col("rn") == 0, 0.5).otherwise(C.normal_cdf(F.col("dp") / sigma))
    rows = rows.withColumn("_up", up).withColumn("buy", F.col("volume") * F.col("_up")).withColumn("sell", F.col("volume") * (1 - F.col("_up")))
    return rows.withColumn("delta", F.when(F.col("rn") == 0, 0.0).otherwise(F.col("buy") - F.col("sell"))).drop("_up")


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, size: the value at place floor(n / 2) of each key's sorted values; 1000 where that is zero. Values are counted before they are ordered."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    own = Window.partitionBy(*keys)
    upto = F.sum("_k").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_k").over(own)).where(F.col("_upto") > F.floor(F.col("_n") / 2))
    return found.groupBy(*keys).agg(F.min(value).alias("size")).withColumn("size", F.when(F.col("size") == 0, 1000.0).otherwise(F.col("size")))


def bucket_ends(rows: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """rows (keys, place, block, cum, size: cum the volume up to each bar, size the bucket's) with `to`: the bar after the one that closes a bucket begun here; null if none does.

    A bucket begun at a bar closes at the first bar whose cum is at least the cum before it plus size. Bars and these targets are put in one order by value, dealt by
    ranges: the answer is the next bar in that order, in the same part of it or at the start of a later one.
    """
    struct = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("kind"), F.col("place").alias("place"))
    both = rows.select(*keys, F.explode(F.array(struct(F.col("cum") - F.col("vol") + F.col("size"), 0), struct(F.col("cum"), 1))).alias("o"))
    laid = placed(both, *keys, order="o").withColumnRenamed("place", "_at").select(*keys, "_at", F.floor(F.col("_at") / size).alias("_part"), F.col("o.kind").alias("kind"), F.col("o.place").alias("place"))
    bar = F.when(F.col("kind") == 1, F.col("place"))
    down = Window.partitionBy(*keys, "_part").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    firsts = laid.groupBy(*keys, "_part").agg(F.min(bar).alias("_lead"))
    later = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_later", F.min("_lead").over(later)).drop("_lead")
    near = laid.withColumn("_near", F.min(bar).over(down)).where("kind = 0").join(firsts, [*keys, "_part"])
    return rows.join(near.select(*keys, "place", (F.coalesce("_near", "_later") + 1).alias("to")), [*keys, "place"])


#: bars up to which a look back's buckets are filled in one group
ONE_GROUP = 50_000


def _buckets_in_groups(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Buckets of rows (keys, time, buy, sell, vol) by one pass over each key's bars."""
    types = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", ignore_index=True)
        size = float(np.sort(pdf["vol"].to_numpy())[len(pdf) // 2]) or 1000.0
        starts, held = [0], 0.0
        for i, v in enumerate(pdf["vol"].tolist()):
            held += v
            if held >= size:
                starts.append(i + 1)
                held = 0.0
        # what follows the last full bucket is one only where it has volume
        stop = len(pdf) if held > 0 else starts.pop()
        sums = {c: np.add.reduceat(pdf[c].to_numpy(float)[:stop], starts) if starts else [] for c in ("buy", "sell", "vol")}
        opened = pdf["time"].iloc[np.maximum(np.array(starts, int) - 1, 0)].to_numpy()
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "bucket": np.arange(len(starts), dtype=np.int32), "time": opened, **sums})

    return rows.groupBy(*keys).applyInPandas(fill, f"{types}, bucket int, time timestamp_ntz, buy double, sell double, vol double")


def volume_buckets(classified: DataFrame, *keys: str, size: int = BLOCK, most: int | None = None) -> DataFrame:
    """Buckets of at least a symbol's (upper) median bar volume each: place, time (of the bar that closed the one before), buy, sell, vol.

    A closing bar keeps its overshoot, so where a bucket ends follows from where the one before ended: a chain from bar to bar. Every bar gets
    the bar after the bucket it would begin (bucket_ends). A block of `size` bars then tells for each of its bars at which bar of a later block
    the chain from there goes on. Chains that begin at different bars soon meet, so a block has few such exits; from exit to exit a symbol's
    chain is walked over these alone, and each block marks its own part of it. Volumes are added up from a symbol's first bar: they are exact where sums
    of volumes are (whole numbers to 2^53). Negative or null volumes count as zero. The last bucket may be short. A look back of at most
    ONE_GROUP bars a key (`most`, if the caller knows it) is filled a key at a time, with the same result.
    """
    keys = keys or ("symbol",)
    rows = classified.select(*keys, "time", "buy", "sell", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).alias("vol"))
    if most is not None and most <= ONE_GROUP:
        return _buckets_in_groups(rows, keys)
    rows = placed(rows, *keys).drop("n").withColumn("block", F.floor(F.col("place") / size))
    sums = rows.groupBy(*keys, "block").agg(F.sum("vol").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = Window.partitionBy(*keys, "block").orderBy("place")
    rows = rows.join(sums.withColumn("_earlier", earlier).drop("_sum"), [*keys, "block"]).join(upper_median(rows, "vol", *keys), list(keys))
    rows = rows.withColumn("cum", F.col("_earlier") + F.sum("vol").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("opened", F.lag("time").over(inside)).drop("_earlier")
    rows = written(bucket_ends(rows, keys, size), "bucket-ends")
    types = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each bar that may be entered (all, but chains meet): where the chain leaves the block."""
        pdf = pdf.sort_values("place", ignore_index=True)
        first, to = int(pdf["place"].iloc[0]), pdf["to"].fillna(-1).to_numpy(np.int64)
        out = to.copy()
        for i in range(len(to) - 1, -1, -1):
            if 0 <= to[i] - first < len(to):
                out[i] = out[to[i] - first]
        return pdf[[*keys, "block", "place"]].assign(leaves=out)

    left = written(rows.select(*keys, "block", "place", "to").groupBy(*keys, "block").applyInPandas(exits, f"{types}, block long, place long, leaves long"), "exits")
    # bars at which some chain enters a block, and a symbol's first bar
    doors = left.where("leaves >= 0").select(*keys, F.col("leaves").alias("place")).distinct().unionByName(left.where("place = 0").select(*keys, "place")).distinct()
    doors = doors.join(left, [*keys, "place"])

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        onward = dict(zip(pdf["place"].tolist(), pdf["leaves"].tolist()))
        path, at = [], 0
        while at in onward:
            path.append(at)
            at = onward[at]
        return pdf[pdf["place"].isin(path)][[*keys, "block", "place"]]

    entered = doors.groupBy(*keys).applyInPandas(walked, f"{types}, block long, place long").select(*keys, "block", F.col("place").alias("door"))
    chain = rows.select(*keys, "block", "place", "to").join(entered, [*keys, "block"], "left")

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        first, to, begins = int(pdf["place"].iloc[0]), pdf["to"].fillna(-1).to_numpy(np.int64), np.zeros(len(pdf), np.int64)
        at = pdf["door"].iloc[0]
        at = -1 if pd.isna(at) else int(at) - first
        while 0 <= at < len(to):
            begins[at] = 1
            at = to[at] - first if to[at] >= 0 else -1
        return pdf[[*keys, "block", "place"]].assign(begins=begins, upto=np.cumsum(begins))

    marks = written(chain.groupBy(*keys, "block").applyInPandas(marked, f"{types}, block long, place long, begins long, upto long"), "begins")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = marks.groupBy(*keys, "block").agg(F.sum("begins").alias("_n")).withColumn("_before", before).drop("_n")
    numbered_ = rows.join(marks.drop("block"), [*keys, "place"]).join(offsets, [*keys, "block"]).withColumn("bucket", (F.col("upto") + F.col("_before") - 1).cast("int"))
    # the bar before a block's first is in the block before
    last = rows.groupBy(*keys, (F.col("block") + 1).alias("block")).agg(F.max("time").alias("_last"))
    numbered_ = numbered_.join(last, [*keys, "block"], "left")
    opened = F.min(F.when(F.col("begins") == 1, F.coalesce("opened", "_last", "time"))).alias("time")
    return numbered_.groupBy(*keys, "bucket").agg(opened, F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.sum("vol").alias("vol")).where("vol > 0")


def vpin_series(classified: DataFrame, *keys: str, n: int = 50, most: int | None = None) -> DataFrame:
    keys = keys or ("symbol",)
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-(n - 1), 0)
    total = F.sum("vol").over(w)
    return volume_buckets(classified, *keys, most=most).withColumn("vpin", F.when(total > 0, F.sum(F.abs(F.col("buy") - F.col("sell"))).over(w) / total).otherwise(0.0))


def latest(rows: DataFrame, value: str, order: str, n: int, *keys: str) -> DataFrame:
    """Over the last n rows of each key: the last value, mean, deviation (never 0), z, share of values at most the last, and mean of either half."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    recent = rows.withColumn("_d", F.row_number().over(w)).where(F.col("_d") <= n)
    every = Window.partitionBy(*keys)
    recent = recent.withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_last", F.max(F.when(F.col("_d") == 1, F.col(value))).over(every))
    first = F.col("_n") - F.col("_d") < F.floor(F.col("_n") / 2)
    out = recent.groupBy(*keys).agg(F.max("_last").alias("value"), F.avg(value).alias("mean"), C.or_tiny(C.std0(F.col(value))).alias("std"), F.avg((F.col(value) <= F.col("_last")).cast("double")).alias("percentile"), F.coalesce(F.avg(F.when(first, F.col(value))), F.lit(0.0)).alias("first_half"), F.coalesce(F.avg(F.when(~first, F.col(value))), F.lit(0.0)).alias("second_half"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def vpin(classified: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    keys = keys or ("symbol",)
    return latest(vpin_series(classified, *keys, most=most), "vpin", "bucket", 100, *keys).select(*keys, F.col("value").alias("vpin"), "mean", "std", "z", (F.col("z") > 2).alias("toxic"))


def kyle_series(classified: DataFrame, *keys: str, n: int = 100) -> DataFrame:
    """Price impact: the size of the slope of price change on delta over n + 1 bars, from bar n on; the first change of each frame counts as 0."""
    w = C.last_rows(n + 1, *keys)
    x, y = F.col("delta"), F.coalesce(F.col("dp"), F.lit(0.0))
    # sums about the frame's means, as sums of squares of large volumes lose digits; the first row's share with its price change is taken off
    m, rows = n + 1, classified.withColumn("_y", y)
    sxx = m * F.var_pop(x).over(w)
    sxy = m * F.covar_pop(x, F.col("_y")).over(w) - (F.first(x).over(w) - F.avg(x).over(w)) * F.first("_y").over(w)
    rows = rows.withColumn("impact", F.abs(C.over(sxy, sxx)))
    return rows.where(F.col("rn") >= n).drop("_y")


def trend_of(first: Column, second: Column) -> Column:
    return F.when(second > first * 1.15, "rising").when(second < first * 0.85, "falling").otherwise("stable")


def kyle(classified: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("symbol",)
    return latest(kyle_series(classified, *keys), "impact", "time", 50, *keys).select(*keys, F.col("value").alias("impact"), "mean", "std", "z", trend_of(F.col("first_half"), F.col("second_half")).alias("trend"))


def amihud_series(bars: DataFrame, *keys: str) -> DataFrame:
    return numbered(bars, *keys).where(F.col("prev").isNotNull()).withColumn("illiq", F.abs(F.col("close") / F.col("prev") - 1) / F.greatest(F.col("volume"), F.lit(1.0)))


def amihud(bars: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("symbol",)
    return latest(amihud_series(bars, *keys), "illiq", "time", 100, *keys).select(*keys, F.col("value").alias("illiq"), "mean", "std", "z", "percentile")


def divergence(classified: DataFrame, *keys: str, n: int = 100) -> DataFrame:
    """Price against cumulative delta over the last n bars, half against half: divergence, its strength, both trends."""
    keys = keys or ("symbol",)
    down = Window.partitionBy(*keys).orderBy(F.col("time").desc())
    recent = classified.withColumn("_d", F.row_number().over(down)).where(F.col("_d") <= n)
    recent = recent.withColumn("cum", F.sum("delta").over(C.by_time(*keys).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.col("_n") - F.col("_d") < F.floor(F.col("_n") / 2)
    half = lambda c, when: F.avg(F.when(when, F.col(c)))
    sums = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("cum", "time").alias("cum_delta"), half("close", first).alias("p1"), half("close", ~first).alias("p2"), half("cum", first).alias("d1"), half("cum", ~first).alias("d2"))
    enough = F.col("n") >= 10
    price = F.when(enough & (F.col("p2") > F.col("p1") * 1.0005), "up").when(enough & (F.col("p2") < F.col("p1") * 0.9995), "down").otherwise("flat")
    delta = F.when(enough & (F.col("d2") > F.col("d1")), "up").when(enough & (F.col("d2") < F.col("d1")), "down").otherwise("flat")
    out = sums.withColumn("price_trend", price).withColumn("delta_trend", delta)
    kind = F.when((F.col("price_trend") == "up") & (F.col("delta_trend") == "down"), "bearish").when((F.col("price_trend") == "down") & (F.col("delta_trend") == "up"), "bullish").otherwise("none")
    strength = F.least(F.lit(1.0), (F.abs(F.col("p2") - F.col("p1")) / F.col("p1") * 100 + F.abs(F.col("d2") - F.col("d1")) / (F.abs("d1") + 1)) / 2)
    return out.withColumn("divergence", kind).withColumn("strength", F.when(F.col("divergence") == "none", 0.0).otherwise(strength)).select(*keys, "cum_delta", "price_trend", "delta_trend", "divergence", "strength")


def report(bars: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Toxicity and liquidity of each symbol's (bounded) look back, with labels and a sentence."""
    keys = keys or ("symbol",)
    flow = classify_volume(bars, *keys)
    pick = lambda df, name, *cs: df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in cs])
    joined = bars.groupBy(*keys).agg(F.max("time").alias("time"))
    for part in (pick(vpin(flow, *keys, most=most), "vpin", "vpin", "z", "toxic"), pick(kyle(flow, *keys), "kyle", "impact", "z", "trend"), pick(amihud(bars, *keys), "amihud", "illiq", "percentile"), pick(divergence(flow, *keys), "flow", "divergence", "strength", "cum_delta")):
        joined = joined.join(part, list(keys), "left")
    joined = joined.fillna(0.0, ["vpin_vpin", "vpin_z", "kyle_impact", "kyle_z", "amihud_illiq", "amihud_percentile", "flow_strength"]).fillna("stable", ["kyle_trend"]).fillna("none", ["flow_divergence"])
    score = lambda z: C.clamp01((F.col(z) + 2) / 4)
    out = joined.withColumn("toxicity", C.clamp01(0.35 * score("vpin_z") + 0.25 * score("kyle_z") + 0.2 * F.col("amihud_percentile") + 0.2 * F.col("flow_strength")))
    out = out.withColumn("toxicity_label", F.when(F.col("toxicity") > 0.75, "extreme").when(F.col("toxicity") > 0.6, "toxic").when(F.col("toxicity") > 0.4, "elevated").otherwise("calm"))
    out = out.withColumn("liquidity", C.clamp01(0.6 * (1 - F.col("amihud_percentile")) + 0.4 * (1 - score("kyle_z"))))
    out = out.withColumn("liquidity_label", F.when(F.col("liquidity") > 0.66, "deep").when(F.col("liquidity") > 0.33, "normal").otherwise("thin"))
    parts = F.array_compact(F.array(
        F.when(F.col("vpin_toxic"), F.concat(F.lit("one-sided volume "), C.fixed(F.col("vpin_z")), F.lit(" deviations above its norm"))),
        F.when(F.col("kyle_trend") == "rising", "each unit of flow moves the price more than before").when(F.col("kyle_trend") == "falling", "each unit of flow moves the price less than before"),
        F.when(F.col("amihud_percentile") > 0.8, F.concat(F.lit("less liquid than in "), C.fixed(F.col("amihud_percentile") * 100, 0), F.lit(" of 100 recent bars"))),
        F.when(F.col("flow_divergence") == "bearish", "sellers behind a rising price").when(F.col("flow_divergence") == "bullish", "buyers behind a falling price"),
    ))
    none = F.concat(F.lit("nothing unusual: toxicity "), F.col("toxicity_label"), F.lit(", liquidity "), F.col("liquidity_label"))
    return out.withColumn("interpretation", F.when(F.size(parts) == 0, none).otherwise(F.array_join(parts, "; ")))
