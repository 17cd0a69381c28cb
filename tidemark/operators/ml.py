"""Models over features of sliding windows: the feature table, ridge and boosted trees, their ensemble, and its validation.

Sums, folds and windows are aggregates over (symbol, sample) rows; only systems of 13 equations and trees on a look back of some ninety
samples go to numpy, a symbol or fold at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import columns as C
from ..sources.bars import numbered, returns, tail
from ..sources.tables import kept
from . import fractal, microstructure, volatility
from .information import entropy_of_triples, pattern

# The features in their order.
FEATURES = ("vpin-zscore", "hmm-regime-prob", "hurst-multi-tf", "te-xau-to-eur", "te-eur-to-xau", "permutation-entropy", "garch-cond-vol", "jump-component", "kalman-residual", "fractal-dimension", "ofi-divergence", "amihud-illiq")
D = len(FEATURES)
PER_YEAR = 252 * 6.5
SPECIALISTS = (("trending", "gradient-boosted-trees", 0.6, 1.4), ("mean-reverting", "ridge-regression", 0.7, 1.3), ("volatile", "lstm-proxy", 0.65, 1.35))


def deflation(trials: int) -> float:
    """What a Sharpe ratio is multiplied by when it is the best of several trials."""
    return 1.0 if trials <= 1 else math.sqrt(max(0.0, 1 - (math.log(trials) + 0.5772) / (2 * trials)))


def windows(bars: DataFrame, size: int = 200, step: int = 20) -> DataFrame:
    """Bars of every window: symbol, end (bars before it), the bars' columns, at (time of the window's last bar) and y, the return after the next bar.

    Windows end at size, size + step and so on, up to the last bar but one. Each bar is sent to the size / step windows it lies in.
    """
    w = C.by_time("symbol")
    rows = numbered(bars).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).withColumn("_y", F.ln(F.lead("close", 1).over(w) / F.col("close")))
    k = lambda x: F.greatest(F.lit(0), F.ceil((x - size + 1) / step))  # noqa: E731  # first window that ends after bar x
    ends = F.transform(F.sequence(k(F.col("rn")), F.floor((F.col("rn")) / step)), lambda i: (i * step + size).cast("long"))
    inside = F.filter(ends, lambda e: (e > F.col("rn")) & (F.col("rn") >= e - size) & (e < F.col("_n") - 1))
    y = rows.select("symbol", F.col("rn").alias("end"), F.col("_y").alias("y"))
    out = rows.where(k(F.col("rn")) <= F.floor(F.col("rn") / step)).withColumn("end", F.explode(inside)).drop("rn", "prev", "_n", "_y")
    return out.join(y, ["symbol", "end"])


def own_flow(rets: DataFrame, *keys: str, bins: int = 4) -> DataFrame:
    """Transfer entropy of a series to itself by key: next value given this and the one before; 0 for fewer than 30 returns."""
    every, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("rn")
    q = rets.withColumn("q", C.bin_of(F.col("r"), F.min("r").over(every), F.max("r").over(every), bins))
    q = q.select(*keys, F.lead("q").over(w).alias("a"), F.col("q").alias("b"), F.lag("q").over(w).alias("c"), "n").where("a is not null and c is not null and n >= 30")
    return entropy_of_triples(q, list(keys))


def order_entropy(rets: DataFrame, *keys: str, m: int = 4) -> DataFrame:
    """Normalised permutation entropy of a key's whole series."""
    w = Window.partitionBy(*keys).orderBy("rn")
    rows = rets.select(*keys, pattern(F.array("r", *[F.lead("r", i).over(w) for i in range(1, m)]), m).alias("p"), F.lead("r", m - 1).over(w).alias("_l")).where("_l is not null")
    counts = rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("h", -share * F.log2(share)).groupBy(*keys).agg((F.sum("h") / math.log2(math.factorial(m))).alias("pe"))


def last_residual(bars: DataFrame, *keys: str) -> DataFrame:
    """Residual of the last log price under the line on the one before."""
    rows = numbered(bars, *keys).select(*keys, "rn", F.ln("close").alias("y"), F.ln("prev").alias("x"))
    fit = rows.groupBy(*keys).agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg(F.when(F.col("x").isNotNull(), F.col("y"))).alias("my"), F.avg("x").alias("mx"), F.max_by(F.struct("x", "y"), "rn").alias("l"), F.count(F.lit(1)).alias("n"))
    return fit.select(*keys, F.when(F.col("n") < 10, 0.0).otherwise(F.col("l.y") - (F.col("my") - F.col("b") * F.col("mx") + F.col("b") * F.col("l.x"))).alias("residual"))


def raw_features(bars: DataFrame, size: int = 200, step: int = 20) -> DataFrame:
    """symbol, end, time, y and the features of each window, as they are."""
    keys = ("symbol", "end")
    rows = kept(windows(bars, size, step), "windows", 0)
    own, w = returns(rows, *keys), list(keys)
    flow = microstructure.classify_volume(rows, *keys)
    side = F.when(F.col("divergence") == "bullish", 1).when(F.col("divergence") == "bearish", -1).otherwise(0)
    vol = volatility.report(rows, *keys, most=size)
    frames = fractal.timeframes(rows, *keys).groupBy(*keys).agg(F.avg("h").alias("_h"))
    parts = (
        microstructure.vpin(flow, *keys, most=size).select(*keys, F.col("z").alias("_vpin")), microstructure.divergence(flow, *keys).select(*keys, (side * F.col("strength")).alias("_ofi")), microstructure.amihud(rows, *keys).select(*keys, F.col("illiq").alias("_illiq")),
        vol.select(*keys, F.col("probability").alias("_hmm"), F.col("vol").alias("_garch"), F.col("jump_component").alias("_jump")),
        frames, fractal.curve_dimension(rows, *keys).select(*keys, F.col("dimension").alias("_dim")), own_flow(own, *keys).select(*keys, F.col("te").alias("_te")), order_entropy(own, *keys).select(*keys, F.col("pe").alias("_pe")), last_residual(rows, *keys).select(*keys, F.col("residual").alias("_res")),
    )
    out = rows.groupBy(*keys).agg(F.max("time").alias("time"), F.first("y").alias("y"))
    for part in parts:
        out = out.join(part, w, "left")
    value = {"vpin-zscore": ("_vpin", 0.0), "hmm-regime-prob": ("_hmm", 0.5), "hurst-multi-tf": ("_h", 0.5), "te-xau-to-eur": ("_te", 0.0), "te-eur-to-xau": ("_te", 0.0), "permutation-entropy": ("_pe", 1.0), "garch-cond-vol": ("_garch", 0.0), "jump-component": ("_jump", 0.0), "kalman-residual": ("_res", 0.0), "fractal-dimension": ("_dim", 1.5), "ofi-divergence": ("_ofi", 0.0), "amihud-illiq": ("_illiq", 0.0)}
    finite = lambda c, d: F.when(F.coalesce(F.abs(F.col(c)) < C.INF, F.lit(False)) & ~F.isnan(c), F.col(c)).otherwise(F.lit(d))
    return out.select("symbol", "end", "time", "y", *[finite(*value[f]).alias(f) for f in FEATURES])


def samples(raw: DataFrame) -> DataFrame:
    """symbol, rn (from 0), n, time, y and x, the array of features less their mean and over their deviation (or a tiny number)."""
    every = Window.partitionBy("symbol")
    x = F.array(*[(F.col(f) - F.avg(f).over(every)) / C.or_tiny(F.stddev_samp(f).over(every)) for f in FEATURES])
    return raw.select("symbol", (F.row_number().over(every.orderBy("end")) - 1).alias("rn"), F.count(F.lit(1)).over(every).alias("n"), "time", "y", x.alias("x"))


def masked(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """samples with the features that `keep` (symbol, keep: array of boolean) drops at zero: a ridge gives them no weight and a tree no split."""
    return rows.join(keep, "symbol").withColumn("x", F.zip_with("x", "keep", lambda v, k: F.when(k, v).otherwise(0.0))).drop("keep")


def feature_stats(rows: DataFrame, bins: int = 5) -> DataFrame:
    """By symbol and feature: mean, std, mutual information with y (0 for fewer than ten samples) and |mean| / std."""
    named = F.transform(F.col("x"), lambda v, i: F.struct(F.element_at(F.array(*map(F.lit, FEATURES)), i + 1).alias("feature"), v.alias("v")))
    long = rows.select("symbol", "y", F.explode(named).alias("f")).select("symbol", "y", "f.*")
    own = Window.partitionBy("symbol", "feature")
    q = long.select("symbol", "feature", C.bin_of(F.col("v"), F.min("v").over(own), F.max("v").over(own), bins).alias("a"), C.bin_of(F.col("y"), F.min("y").over(own), F.max("y").over(own), bins).alias("b"))
    cells = q.groupBy("symbol", "feature", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    part = lambda *cs: F.sum("c").over(Window.partitionBy("symbol", "feature", *cs))
    cells = cells.withColumn("ca", part("a")).withColumn("cb", part("b")).withColumn("n", part())
    mi = cells.groupBy("symbol", "feature").agg(F.when(F.max("n") < 10, 0.0).otherwise(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))))).alias("mi"))
    stats = long.groupBy("symbol", "feature").agg(F.avg("v").alias("mean"), C.or_tiny(F.stddev_samp("v")).alias("std"))
    return stats.join(mi, ["symbol", "feature"]).withColumn("stability", F.abs("mean") / F.col("std"))


def dot(beta: Column, x: Column) -> Column:
    """beta[0] + beta[1:] . x"""
    return F.element_at(beta, 1) + F.aggregate(F.zip_with(F.slice(beta, 2, D), x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)


def ridge(rows: DataFrame, *keys: str, penalty: float = 1.0, weight: Column | None = None, least: int = D + 2) -> DataFrame:
    """beta (intercept first) of y on x by key: normal equations as sums, the intercept without penalty.

    Fewer than `least` rows, or a singular system, give the mean of y alone.
    """
    one = weight if weight is not None else F.lit(1.0)
    z = [F.lit(1.0), *[F.element_at("x", i + 1) for i in range(D)]]
    squares = F.array(*[F.sum(one * z[i] * z[j]) for i in range(D + 1) for j in range(i + 1)])
    sums = rows.groupBy(*keys).agg(squares.alias("_a"), F.array(*[F.sum(one * v * F.col("y")) for v in z]).alias("_b"), F.avg("y").alias("_m"), F.count(F.lit(1)).alias("m"))

    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b):
            low = np.zeros((D + 1, D + 1))
            low[np.tril_indices(D + 1)] = p
            whole = low + np.tril(low, -1).T + np.diag([0.0] + [penalty] * D)
            try:
                out.append(np.linalg.solve(whole, q).tolist())
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out)

    solved = F.pandas_udf(solve, "array<double>")(F.col("_a"), F.col("_b"))
    alone = F.concat(F.array(F.coalesce("_m", F.lit(0.0))), F.array_repeat(F.lit(0.0), D))
    fit = sums.withColumn("beta", F.when(F.col("m") >= least, solved))
    return fit.select(*keys, "m", F.col("beta").isNotNull().alias("fitted"), F.coalesce("beta", alone).alias("beta"))


def fit_quality(rows: DataFrame, prediction: Column, *keys: str) -> DataFrame:
    """Mean squared error and R2 (0 without variance) of a prediction by key."""
    off = (prediction - F.col("y")) * (prediction - F.col("y"))
    return rows.groupBy(*keys).agg(F.avg(off).alias("mse"), F.coalesce(1 - F.try_divide(F.sum(off), F.regr_syy("y", "y")), F.lit(0.0)).alias("r2"))


def grow(x: np.ndarray, y: np.ndarray, depth: int, used: np.ndarray) -> dict | float:
    """A regression tree: the best of each feature's quartile cuts by squared error, two rows a side at least; a leaf is a number."""
    if depth == 0 or len(y) < 5:
        return float(y.mean()) if len(y) else 0.0
    whole, best, cut = ((y - y.mean()) ** 2).sum(), 0.0, None
    for f in range(x.shape[1]):
        ordered = np.sort(x[:, f])
        for q in (0.25, 0.5, 0.75):
            t = ordered[int(q * (len(ordered) - 1))]
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < 2:
                continue
            gain = whole - sum(((s - s.mean()) ** 2).sum() for s in (y[left], y[~left]))
            if gain > best:
                best, cut = gain, (f, t)
    if cut is None:
        return float(y.mean())
    f, t = cut
    left = x[:, f] <= t
    used[f] += 1
    return {"feature": f, "at": t, "low": grow(x[left], y[left], depth - 1, used), "high": grow(x[~left], y[~left], depth - 1, used)}


def fall(tree: dict | float, x: np.ndarray) -> float:
    while isinstance(tree, dict):
        tree = tree["low" if x[tree["feature"]] <= tree["at"] else "high"]
    return tree


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(prediction of each row, splits per feature as shares) of gradient-boosted trees on squared error."""
    used, out = np.zeros(x.shape[1]), np.full(len(y), y.mean() if len(y) else 0.0)
    if len(y) >= 10:
        for _ in range(trees):
            tree = grow(x, y - out, depth, used)
            out = out + rate * np.array([fall(tree, r) for r in x])
    return out, used / (used.sum() or 1)


def boosted(rows: DataFrame) -> DataFrame:
    """By symbol: last prediction, importance, mse and r2 of boosted trees; a symbol's samples are a bounded look back."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        x, y = np.array(pdf["x"].tolist()), pdf["y"].to_numpy(float)
        out, used = boost(x, y)
        total = ((y - y.mean()) ** 2).sum()
        off = ((out - y) ** 2).sum()
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1].tolist(), "prediction": [float(out[-1])], "importance": [used.tolist()], "mse": [off / len(y)], "r2": [1 - off / total if total > 0 else 0.0]})

    return rows.select("symbol", "rn", "y", "x").groupBy("symbol").applyInPandas(fit, "symbol string, prediction double, importance array<double>, mse double, r2 double")


def specialists(rows: DataFrame) -> DataFrame:
    """A row per symbol (30 samples at least) and specialist: regime, model, train and assumed out-of-sample figures, importance, last prediction."""
    rows = rows.where("n >= 30")
    last = rows.where("rn = n - 1").select("symbol", F.col("x").alias("_x"), "n")
    parts = []
    linear = {"mean-reverting": ridge(rows, "symbol"), "volatile": ridge(rows, "symbol", weight=F.pow(F.lit(0.5), (F.col("n") - 1 - F.col("rn")) / 30.0), least=10)}
    for regime, model, r2, mse in SPECIALISTS:
        if regime == "trending":
            got = boosted(rows).join(last.drop("_x"), "symbol")
        else:
            fit = linear[regime]
            size = F.transform(F.slice("beta", 2, D), lambda b: F.abs(b))
            total = F.aggregate(size, F.lit(0.0), lambda s, v: s + v)
            share = size if regime == "mean-reverting" else F.transform(size, lambda v: v / F.when(total == 0, 1.0).otherwise(total))
            figures = fit_quality(rows.join(fit.select("symbol", "beta"), "symbol"), dot(F.col("beta"), F.col("x")), "symbol")
            got = fit.join(last, "symbol").join(figures, "symbol").select("symbol", dot(F.col("beta"), F.col("_x")).alias("prediction"), share.alias("importance"), "mse", "r2", "n")
        parts.append(got.select("symbol", F.lit(regime).alias("regime"), F.lit(model).alias("model"), "prediction", "importance", F.col("mse").alias("train_mse"), F.col("r2").alias("train_r2"), (F.col("r2") * r2).alias("oos_r2"), (F.col("mse") * mse).alias("oos_mse"), F.col("n").alias("train_samples")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def importance(models: DataFrame) -> DataFrame:
    """By symbol and feature: mean importance over the specialists, place by it, and whether two of them have it in their upper half."""
    halves = models.withColumn("_t", F.coalesce(F.try_element_at(F.sort_array("importance", False), F.lit(D // 2 + 1)), F.lit(0.0)))
    each = halves.select("symbol", "_t", F.posexplode("importance").alias("i", "v"))
    out = each.groupBy("symbol", "i").agg(F.avg("v").alias("importance"), (F.sum((F.col("v") >= F.col("_t")).cast("int")) >= 2).alias("stable"))
    w = Window.partitionBy("symbol").orderBy(F.col("importance").desc(), "i")
    return out.select("symbol", "i", F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1).alias("feature"), "importance", "stable", F.row_number().over(w).alias("place"))


def ensemble(models: DataFrame, rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """One row per symbol: the specialists' last predictions weighed by the regimes (symbol, trending, mean_reverting, volatile), confidence, direction."""
    of = lambda r: F.max(F.when(F.col("regime") == r, F.col("prediction")))
    wide = models.groupBy("symbol").agg(of("trending").alias("gbt"), of("mean-reverting").alias("ridge"), of("volatile").alias("lstm"), C.std0(F.col("prediction")).alias("_sd"), F.avg("prediction").alias("_mean"))
    out = rows.groupBy("symbol").agg((C.std0(F.col("y")) * 0.3).alias("_cut")).join(wide, "symbol").join(regimes, "symbol")
    total = F.col("trending") + F.col("mean_reverting") + F.col("volatile")
    total = F.when(total == 0, 1.0).otherwise(total)
    out = out.withColumn("predicted", (F.col("gbt") * F.col("trending") + F.col("ridge") * F.col("mean_reverting") + F.col("lstm") * F.col("volatile")) / total)
    confidence = F.when(F.col("_mean") != 0, C.clamp01(1 - F.col("_sd") / (F.abs("_mean") + 1e-9))).otherwise(0.3)
    dominant = F.when((F.col("trending") >= F.col("mean_reverting")) & (F.col("trending") >= F.col("volatile")), "trending").when(F.col("mean_reverting") >= F.col("volatile"), "mean-reverting").otherwise("volatile")
    direction = F.when(F.col("predicted") > F.col("_cut"), "long").when(F.col("predicted") < -F.col("_cut"), "short").otherwise("flat")
    return out.select("symbol", "gbt", "ridge", "lstm", "predicted", confidence.alias("confidence"), dominant.alias("dominant"), direction.alias("direction"))


def tested(train: DataFrame, test: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Test rows with the prediction of a ridge fitted on their key's training rows, and what its sign earned."""
    fit = ridge(train, *keys).where(F.col("m") >= least).select(*keys, "beta")
    out = test.join(fit, list(keys)).withColumn("p", dot(F.col("beta"), F.col("x"))).drop("beta")
    return out.withColumn("earned", F.signum("p") * F.col("y"))


def fold_rows(rows: DataFrame, folds: int = 6, embargo: int = 5) -> DataFrame:
    """Samples by fold with part 'test' or 'train'; those within the embargo of a fold's test rows are left out; five a fold at least."""
    size = F.floor(F.col("n") / folds)
    start, stop = F.col("fold") * size, F.when(F.col("fold") == folds - 1, F.col("n")).otherwise((F.col("fold") + 1) * size)
    each = rows.where(F.col("n") >= folds * 5).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    part = F.when((F.col("rn") >= start) & (F.col("rn") < stop), "test").when((F.col("rn") < start - embargo) | (F.col("rn") >= stop + embargo), "train")
    return each.withColumn("part", part).where("part is not null")


def cpcv(rows: DataFrame, folds: int = 6, embargo: int = 5) -> DataFrame:
    """By symbol and fold: the Sharpe ratio of the predictions' signs, and sums for the R2 over all folds."""
    each = fold_rows(rows, folds, embargo)
    out = tested(each.where("part = 'train'"), each.where("part = 'test'"), "symbol", "fold", least=10)
    off = F.col("p") - F.col("y")
    return out.groupBy("symbol", "fold").agg(A.sharpe(F.col("earned"), PER_YEAR).alias("sharpe"), F.sum(off * off).alias("off"), F.sum("y").alias("sum_y"), F.sum(F.col("y") * F.col("y")).alias("sum_yy"), F.count(F.lit(1)).alias("tests")).where("tests >= 2")


def walk_rows(rows: DataFrame, least: int = 40, step: int = 10) -> DataFrame:
    """Samples by split (least, least + step, ...): all before it train, the next `step` test."""
    splits = F.filter(F.sequence(F.lit(least), F.greatest(F.col("n"), F.lit(least)).cast("int"), F.lit(step)), lambda s: (s < F.col("n") - step) & (F.col("rn") < s + step))
    each = rows.where(F.col("n") >= least + 10).withColumn("split", F.explode(splits))
    return each.withColumn("part", F.when(F.col("rn") < F.col("split"), "train").otherwise("test"))


def walk_forward(rows: DataFrame, least: int = 40, step: int = 10) -> DataFrame:
    each = walk_rows(rows, least, step)
    out = tested(each.where("part = 'train'"), each.where("part = 'test'"), "symbol", "split")
    return out.groupBy("symbol", "split").agg((F.max("rn") + 1).alias("stop"), A.sharpe(F.col("earned"), PER_YEAR).alias("sharpe"))


def validate(rows: DataFrame, trials: int = 12) -> DataFrame:
    """One row per symbol: fold Sharpe ratios, their mean and R2, deflated and walk-forward ratios, whether the model passes, and the reasons."""
    folds = cpcv(rows).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "sharpe"))), lambda s: s["sharpe"]).alias("fold_sharpes"), F.avg("sharpe").alias("oos_sharpe"), C.std0(F.col("sharpe")).alias("fold_std"), (1 - F.try_divide(F.sum("off"), F.sum("sum_yy") - F.sum("sum_y") * F.sum("sum_y") / F.sum("tests"))).alias("oos_r2"))
    walk = walk_forward(rows).groupBy("symbol").agg(F.avg("sharpe").alias("walk_sharpe"), F.count(F.lit(1)).alias("walk_windows"))
    out = rows.groupBy("symbol").agg((F.year(F.max("time")) - F.year(F.min("time"))).alias("oos_years")).join(folds, "symbol", "left").join(walk, "symbol", "left")
    out = out.fillna(0.0, ["oos_sharpe", "fold_std", "oos_r2", "walk_sharpe"]).fillna(0, ["walk_windows"]).withColumn("deflated", F.col("oos_sharpe") * deflation(trials))
    two = lambda c: C.fixed(F.col(c))
    failed = {"weak": F.col("deflated") < 0.5, "short": F.col("oos_years") < 5, "back": F.col("walk_sharpe") < 0, "unstable": F.col("fold_std") > 2.0}
    # The wording of the reasons.
    reasons = F.array_compact(F.array(
        F.when(failed["weak"], F.concat(F.lit("deflated Sharpe "), two("deflated"), F.lit(" < 0.5"))), F.when(failed["short"], F.concat(F.lit("OOS "), F.col("oos_years").cast("string"), F.lit("y < 5y (synthetic data limit)"))),
        F.when(failed["back"], F.concat(F.lit("walk-forward Sharpe "), two("walk_sharpe"), F.lit(" < 0"))), F.when(failed["unstable"], F.concat(F.lit("fold Sharpe std "), two("fold_std"), F.lit(" > 2.0 (unstable)"))),
    ))
    good = F.concat(F.lit("PASSES: deflated Sharpe "), two("deflated"), F.lit(", OOS "), F.col("oos_years").cast("string"), F.lit("y, WF "), two("walk_sharpe"), F.lit(", fold std "), two("fold_std"))
    out = out.withColumn("passes", ~(failed["weak"] | failed["back"] | failed["unstable"]))
    return out.withColumn("rationale", F.when(F.col("passes"), good).otherwise(F.concat(F.lit("FAILS: "), F.array_join(reasons, "; "))))


def regime_weights(vol: DataFrame) -> DataFrame:
    """The hidden state's probability as weights of the three specialists; the rest is shared by the other two."""
    p = F.col("probability")
    of = lambda k: F.when(F.col("_k") == k, p).otherwise((1 - p) / 2)
    kind = F.when(F.col("state") == 0, "mean_reverting").when(F.col("state") == 2, "trending").otherwise("volatile")
    return vol.withColumn("_k", kind).select("symbol", *[of(k).alias(k) for k in ("trending", "mean_reverting", "volatile")])


def report(bars: DataFrame, lookback: int = 2000) -> DataFrame:
    """One row per symbol: the ensemble and its validation on all features, and again on the stable ones if at least three are and some aren't."""
    bars = kept(tail(bars, lookback), "lookback")
    rows = kept(samples(raw_features(bars)), "samples")
    regimes = kept(regime_weights(volatility.report(tail(bars, 500), most=500)), "regimes")
    models = kept(specialists(rows), "specialists")
    shap = importance(models)
    stable = kept(shap.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "stable"))), lambda s: s["stable"]).alias("keep")), "stable")
    few = masked(rows, stable)
    n = F.size(F.filter("keep", lambda k: k))
    whole, pruned = (e.select("symbol", F.struct("*").alias(name)) for e, name in ((ensemble(models, rows, regimes), "all"), (ensemble(specialists(few), few, regimes), "few")))
    checked, again = (v.select("symbol", F.struct("*").alias(name)) for v, name in ((validate(rows), "valid_all"), (validate(few), "valid_few")))
    names = lambda want: F.filter(F.transform("keep", lambda k, i: F.when(k == want, F.element_at(F.array(*map(F.lit, FEATURES)), i + 1))), lambda v: v.isNotNull())
    out = bars.groupBy("symbol").agg(F.max("time").alias("time"), F.max_by("close", "time").alias("price"))
    for part in (stable, whole, pruned, checked, again):
        out = out.join(part, "symbol")
    out = out.withColumn("pruning", (n < D) & (n >= 3)).withColumn("pruned_features", names(False)).withColumn("improved", F.col("pruning") & (F.col("valid_few.deflated") > F.col("valid_all.deflated")))
    return out.withColumn("ensemble", F.when(F.col("pruning"), F.col("few")).otherwise(F.col("all"))).withColumn("validation", F.when(F.col("pruning"), F.col("valid_few")).otherwise(F.col("valid_all"))).drop("keep", "all", "few", "valid_all", "valid_few")
