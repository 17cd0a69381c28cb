"""Volatility: GARCH by grid, jumps by bipower variation, hidden Markov states, and the regime they give."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.bars import numbered, returns
from ..sources.series import FOLD, blocks_of, pooled, scanned
from ..sources.tables import written
from .hidden import fit_in_blocks
from .microstructure import latest


def _steps(start: float, stop: float, step: float) -> list[float]:
    """Repeated addition, as its rounding decides whether the end belongs to the grid."""
    out = []
    while start <= stop:
        out.append(start)
        start += step
    return out


# The grid's bounds and steps, and ln(2 pi) as the results need it.
GRID = [(a, b) for a in _steps(0.02, 0.3, 0.04) for b in _steps(0.7, 0.97, 0.03) if a + b < 0.995]
LOG_2PI = 1.8378770664


BETAS = sorted({b for _, b in GRID})


def _garch_blocks(rets: DataFrame, keys: tuple[str, ...], size: int, most: int | None) -> DataFrame:
    """Blocks of squared returns x with var, n (the key's) and before: for each of BETAS what all blocks before make of the variance.

    A block turns a variance s into w * s + a * q + omega * (1 - w) / (1 - b) with w = b^n and q its squares weighted by powers of b: maps that compose,
    and that hold for every alpha and omega at once.
    """
    square = F.col("r") * F.col("r")
    sizes = rets.groupBy(*keys).agg(F.greatest(F.avg(square), F.lit(1e-12)).alias("var"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 30)
    if most is None:
        most = blocks_of(rets, "rn", size) * size
    x = F.transform(F.array_sort(F.collect_list(F.struct("rn", square.alias("v")))), lambda s: s["v"])
    cut = rets.groupBy(*keys, F.floor(F.col("rn") / size).alias("block")).agg(x.alias("x"))
    if most <= size:
        return cut.join(sizes, list(keys)).withColumn("before", F.lit(None).cast("array<struct<w:double,q:double>>"))
    betas = F.array(*map(F.lit, BETAS))
    maps = cut.withColumn("map", F.transform(betas, lambda b: F.struct(F.pow(b, F.size("x")).alias("w"), F.aggregate("x", F.lit(0.0), lambda q, v: q * b + v).alias("q"))))
    both = lambda e, l: F.zip_with(e, l, lambda m, k: F.struct((m["w"] * k["w"]).alias("w"), (m["q"] * k["w"] + k["q"]).alias("q")))  # noqa: E731, E741
    known = scanned(maps.select(*keys, "block", "map"), "map", both, -(-most // size), *keys).drop("map")
    return written(cut, "squares").join(known, [*keys, "block"]).join(sizes, list(keys))


def garch(rets: DataFrame, *keys: str, size: int = FOLD, most: int | None = None) -> DataFrame:
    """GARCH(1,1) with targeted variance by key, the best of GRID by likelihood (the first of equal ones); null for fewer than 30 returns.

    Columns: omega, alpha, beta, log_lik, persistence, long_run_vol, var0 (the variance before the first return), vol, mean_vol, std_vol (the last
    conditional deviation, mean and deviation of all). The variance of a return uses its own square. A series is cut into blocks of `size`
    returns; the variance before each block follows from a scan over the blocks' maps, so all blocks fold side by side. `most`
    is the number of returns of the longest key, if the caller knows it; it is counted otherwise.
    """
    keys = keys or ("symbol",)
    return _garch_walk(rets, keys, size, most)[0]


def _start(g: Column, beta: Column) -> Column:
    """The variance before a block at a grid point, from `before` at the place of its beta."""
    m = F.col("before")[beta]
    return F.when(F.col("before").isNull(), F.col("var")).otherwise(m["w"] * F.col("var") + g["a"] * m["q"] + g["omega"] * (1 - m["w"]) / (1 - g["b"]))


def _garch_walk(rets: DataFrame, keys: tuple[str, ...], size: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(a row a key as garch() gives, the blocks of each key with the fitted numbers and `s2`, the variance before the block)."""
    blocks = _garch_blocks(rets, keys, size, most)
    omega = lambda a, b: F.greatest((1 - a - b) * F.col("var"), F.lit(1e-8))
    point = lambda i, a, b: F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), omega(F.lit(a), F.lit(b)).alias("omega"), F.lit(BETAS.index(b)).alias("place"))
    grid = F.array(*[point(i, a, b) for i, (a, b) in enumerate(GRID)])

    def tried(g: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s2 = g["omega"] + g["a"] * x + g["b"] * acc["s2"]
            return F.struct(s2.alias("s2"), (acc["ll"] - 0.5 * (LOG_2PI + F.ln(s2) + x / s2)).alias("ll"))

        return F.struct(g["i"].alias("i"), g["a"].alias("alpha"), g["b"].alias("beta"), g["omega"].alias("omega"), g["place"].alias("place"), F.aggregate("x", F.struct(_start(g, g["place"]).alias("s2"), F.lit(0.0).alias("ll")), step, lambda acc: acc["ll"]).alias("ll"))

    each = blocks.select(*keys, F.inline(F.transform(grid, tried)))
    sums = each.groupBy(*keys, "i", "alpha", "beta", "place").agg(F.max("omega").alias("omega"), F.sum("ll").alias("log_lik"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("omega", "alpha", "beta", "log_lik", "place"), F.struct("log_lik", -F.col("i"))).alias("g")).select(*keys, "g.*")
    fitted = blocks.join(best, list(keys))
    fitted = fitted.withColumn("s2", _start(F.struct(F.col("alpha").alias("a"), F.col("beta").alias("b"), "omega"), F.col("place")))

    def walk(acc: Column, x: Column) -> Column:
        s2, k = F.col("omega") + F.col("alpha") * x + F.col("beta") * acc["s2"], acc["k"] + 1
        vol = F.sqrt(F.greatest(s2, F.lit(1e-12)))
        m = acc["m"] + (vol - acc["m"]) / k
        return F.struct(s2.alias("s2"), k.alias("k"), vol.alias("vol"), m.alias("m"), (acc["ss"] + (vol - acc["m"]) * (vol - m)).alias("ss"))

    begin = F.struct(F.col("s2").alias("s2"), F.lit(0.0).alias("k"), F.lit(0.0).alias("vol"), F.lit(0.0).alias("m"), F.lit(0.0).alias("ss"))
    walked = fitted.select(*keys, "block", "omega", "alpha", "beta", "log_lik", "var", F.aggregate("x", begin, walk).alias("w"))
    parts = walked.groupBy(*keys, "omega", "alpha", "beta", "log_lik", F.col("var").alias("var0")).agg(F.max_by("w.vol", "block").alias("vol"), *pooled("w"))
    out = parts.withColumn("persistence", F.col("alpha") + F.col("beta")).withColumn("mean_vol", F.col("mean"))
    out = out.withColumn("long_run_vol", F.sqrt(F.col("omega") / F.greatest(1 - F.col("persistence"), F.lit(1e-4)))).withColumn("std_vol", F.sqrt(F.col("ss") / (F.col("k") - 1)))
    return out.drop("mean", "ss", "k"), fitted.join(out.select(*keys, "long_run_vol"), list(keys))


def garch_series(rets: DataFrame, *keys: str, size: int = FOLD, most: int | None = None) -> DataFrame:
    """time, rn, vol and regime of each return under its key's GARCH fit; none for keys that have no fit. Blocks are walked side by side, each from the variance before it, in Arrow batches."""
    keys = keys or ("symbol",)
    starts = _garch_walk(rets, keys, size, most)[1].select(*keys, "block", "omega", "alpha", "beta", "s2", "long_run_vol")
    rows = rets.select(*keys, "time", "rn", "r", F.floor(F.col("rn") / size).alias("block")).join(starts, [*keys, "block"])
    types = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in (*keys, "time", "rn"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        omega, alpha, beta, s2 = (float(pdf[c].iloc[0]) for c in ("omega", "alpha", "beta", "s2"))
        out = []
        for r in pdf["r"].tolist():
            s2 = omega + alpha * (r * r) + beta * s2
            out.append(s2)
        return pdf[[*keys, "time", "rn"]].assign(vol=np.sqrt(np.maximum(out, 1e-12)), long_run_vol=pdf["long_run_vol"])

    walked = rows.groupBy(*keys, "block").applyInPandas(walk, f"{types}, vol double, long_run_vol double")
    return walked.withColumn("regime", vol_regime(F.col("vol"), F.col("long_run_vol")))


def vol_regime(vol: Column, long_run: Column) -> Column:
    ratio = vol / F.greatest(long_run, F.lit(1e-9))
    return F.when(ratio < 0.7, "low-vol").when(ratio > 1.4, "high-vol").otherwise("transitional")


def garch_report(rets: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Current and long-run volatility with regime and its probability; series too short for a fit use their own deviation."""
    keys = keys or ("symbol",)
    fit = garch(rets, *keys, most=most)
    plain = rets.groupBy(*keys).agg(C.std0(F.col("r")).alias("_sd"))
    fit = fit.withColumn("_m", F.col("mean_vol")).withColumn("_s", C.or_tiny(F.col("std_vol")))
    out = plain.join(fit, list(keys), "left").withColumn("vol", F.coalesce("vol", "_sd")).withColumn("long_run_vol", F.coalesce("long_run_vol", "_sd"))
    out = out.withColumn("regime", vol_regime(F.col("vol"), F.col("long_run_vol")))
    z = (F.col("vol") - F.coalesce("_m", "_sd")) / F.coalesce("_s", F.lit(1e-9))
    off = F.abs(F.col("vol") / F.greatest("long_run_vol", F.lit(1e-9)) - 1)
    p = F.when(F.col("regime") == "high-vol", 1 - C.normal_cdf(z)).when(F.col("regime") == "low-vol", C.normal_cdf(z)).otherwise(C.normal_cdf(F.when(off < 0.001, 0.0).otherwise((1 - off) * 2)))
    return out.withColumn("probability", C.clamp(p, 0.05, 0.98)).select(*keys, "omega", "alpha", "beta", "log_lik", "persistence", "vol", "long_run_vol", "regime", "probability")


def jump_series(rets: DataFrame, *keys: str, window: int = 50, corrected: bool = False) -> DataFrame:
    """rv, bv, jump and its share of rv over the last max(10, window / 2) returns, from that many returns on.

    bv is a mean while rv is a sum, as the results to match are; with `corrected` bv is scaled to a sum as well.
    """
    keys = keys or ("symbol",)
    n = max(10, window // 2)
    w = Window.partitionBy(*keys).orderBy("rn")
    rows = rets.withColumn("_p", F.abs("r") * F.abs(F.lag("r").over(w)))
    rows = rows.withColumn("rv", F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(-(n - 1), 0))).withColumn("bv", math.pi / 2 * F.sum("_p").over(w.rowsBetween(-(n - 2), 0)) / (1 if corrected else n - 1))
    rows = rows.withColumn("jump", F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))
    return rows.withColumn("ratio", F.when(F.col("rv") > 0, F.col("jump") / F.col("rv")).otherwise(0.0)).where(F.col("rn") >= n).drop("_p")


def jumps(rets: DataFrame, *keys: str, window: int = 50, corrected: bool = False) -> DataFrame:
    keys = keys or ("symbol",)
    rows = jump_series(rets, *keys, window=window, corrected=corrected)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("rv", "bv", "jump"), "rn").alias("l")).select(*keys, "l.*")
    out = latest(rows, "ratio", "rn", window, *keys).select(*keys, F.col("value").alias("ratio"), "z").join(last, list(keys))
    return out.withColumn("detected", (F.col("z") > 1.645) & (F.col("ratio") > 0.3))


# The features' names.
HMM_FEATURES = ("log-return", "realized-vol", "vol-skew", "spread-proxy")


def hmm_features(bars: DataFrame, *keys: str, rv: int = 20, skew: int = 50) -> DataFrame:
    """rn and f0..f3 of each bar: return, root mean squared return of the last 20, skewness of the last 50 volumes (0 before), range over close;
    each less its mean and over its deviation from bar 50 on."""
    keys = keys or ("symbol",)
    w, wv = C.last_rows(rv, *keys), C.last_rows(skew, *keys)
    rows = numbered(bars, *keys).withColumn("_r", F.when(F.col("prev").isNotNull(), F.ln(F.col("close") / F.col("prev"))))
    rows = rows.withColumn("g0", F.coalesce("_r", F.lit(0.0))).withColumn("g1", F.sqrt(F.coalesce(F.avg(F.col("_r") * F.col("_r")).over(w), F.lit(0.0))))
    # a window of equal volumes has no skewness
    rows = rows.withColumn("g2", F.when(F.col("rn") >= skew, F.coalesce(F.nanvl(F.skewness("volume").over(wv), F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("g3", F.when(F.col("rn") > 0, (F.col("high") - F.col("low")) / F.col("close")).otherwise(0.0))
    every = Window.partitionBy(*keys)
    for d in range(4):
        late = F.when(F.col("rn") >= skew, F.col(f"g{d}"))
        m, s, n = F.avg(late).over(every), F.stddev_samp(late).over(every), F.count(late).over(every)
        rows = rows.withColumn(f"f{d}", F.when(n < 2, F.col(f"g{d}")).otherwise((F.col(f"g{d}") - m) / C.or_tiny(s)))
    return rows.drop("_r", *[f"g{d}" for d in range(4)])


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 30) -> dict | None:
    """Gaussian hidden Markov model with diagonal covariance on rows x, by expectation and maximisation; states in order of their second mean.

    None for fewer than ten rows a state. Starts at quantiles of the second column; stops when the likelihood gains under 1e-4.
    """
    t, d = x.shape
    if t < states * 10:
        return None
    ranked = x[np.argsort(x[:, 1], kind="stable")]
    mu = ranked[[int((k + 0.5) / states * t) for k in range(states)]].copy()
    sd = np.tile(np.maximum(x.std(axis=0, ddof=1), 1e-3), (states, 1))
    pi, a = np.full(states, 1 / states), np.where(np.eye(states) == 1, 0.85, 0.15 / (states - 1))

    def emit(mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
        s = np.maximum(sd, 1e-9)
        return np.exp(-0.5 * (((x[:, None, :] - mu) / s) ** 2).sum(axis=2)) / np.prod(math.sqrt(2 * math.pi) * s, axis=1)

    def filtered(pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.empty((t, states)), np.empty(t)
        for k in range(t):
            p = (pi if k == 0 else alpha[k - 1] @ a) * b[k]
            scale[k] = p.sum() or 1.0
            alpha[k] = p / scale[k]
        return alpha, scale

    before, done = -math.inf, 0
    for done in range(1, rounds + 1):
        b = emit(mu, sd)
        alpha, scale = filtered(pi, a, b)
        log_lik = float(np.log(scale).sum())
        beta = np.empty((t, states))
        beta[-1] = 1 / scale[-1]
        for k in range(t - 2, -1, -1):
            beta[k] = a @ (b[k + 1] * beta[k + 1]) / scale[k]
        gamma = alpha * beta
        total = gamma.sum(axis=1, keepdims=True)
        gamma = np.divide(gamma, total, out=gamma, where=total > 0)
        moves = a * (alpha[:-1].T @ (b[1:] * beta[1:]))
        rows = moves.sum(axis=1, keepdims=True)
        a = np.where(rows > 0, moves / np.where(rows > 0, rows, 1), 1 / states)
        weight = gamma.sum(axis=0)
        mu = np.where(weight[:, None] > 0, gamma.T @ x / np.where(weight > 0, weight, 1)[:, None], mu)
        var = np.stack([(gamma[:, [i]] * (x - mu[i]) ** 2).sum(axis=0) for i in range(states)])
        sd = np.sqrt(np.maximum(var / np.maximum(weight, 1e-9)[:, None], 1e-6))
        pi = np.maximum(gamma[0], 1e-6)
        pi = pi / pi.sum()
        if abs(log_lik - before) < 1e-4:
            break
        before = log_lik
    order = np.argsort(mu[:, 1], kind="stable")
    pi, a, mu, sd = pi[order], a[order][:, order], mu[order], sd[order]
    b = emit(mu, sd)
    alpha, scale = filtered(pi, a, b)
    logs, step = np.log(np.maximum(b, 1e-12)), np.log(np.maximum(a, 1e-12))
    score, came = np.log(np.maximum(pi, 1e-12)) + logs[0], np.zeros((t, states), int)
    for k in range(1, t):
        reach = score[:, None] + step
        came[k] = reach.argmax(axis=0)
        score = reach.max(axis=0) + logs[k]
    path = np.empty(t, int)
    path[-1] = score.argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = came[k, path[k]]
    posterior = alpha / np.where(alpha.sum(axis=1, keepdims=True) > 0, alpha.sum(axis=1, keepdims=True), 1)
    return {"pi": pi, "a": a, "mu": mu, "sd": sd, "path": path, "posterior": posterior, "log_lik": float(np.log(scale).sum()), "rounds": done}


# The states' labels, by volatility.
LABELS = ("Low-Vol Compression", "Transitional", "High-Vol Trending")


#: bars up to which a key's model is fitted in one group
ONE_GROUP = 50_000


def hmm(bars: DataFrame, *keys: str, states: int = 3, rounds: int = 25, warmup: int = 50, most: int | None = None, size: int | None = None) -> DataFrame:
    """Last state by key with its probability, likelihood, rounds and the means and deviations of all states' features.

    The features are window columns; only they go to Python, as the fit is iterative: a key at a time where the longest has at most ONE_GROUP bars (`most`,
    counted if not given), else, or where a block `size` is given, all keys in blocks (hidden.fit_in_blocks), with the same result.
    Keys with fewer than ten usable bars a state have no row.
    """
    keys = keys or ("symbol",)
    if size is None and most is None:
        most = blocks_of(bars.groupBy(*keys).count(), "count", 1)
    if size is not None or most > ONE_GROUP:
        feats = written(hmm_features(bars, *keys).select(*keys, "rn", "f0", "f1", "f2", "f3"), "hmm-features")
        return fit_in_blocks(feats.where(F.col("rn") >= warmup), *keys, states=states, rounds=rounds, size=size or FOLD)
    feats = hmm_features(bars, *keys).select(*keys, "rn", "f0", "f1", "f2", "f3")
    types = ", ".join(f"{k} {t}" for k, t in feats.dtypes if k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        x = pdf[["f0", "f1", "f2", "f3"]].to_numpy(float)
        got = fit_hmm(x[min(warmup, len(x) - 1) :], states, rounds)
        if got is None:
            return pd.DataFrame(columns=[*keys, "state", "probability", "log_lik", "rounds", "means", "deviations"])
        last = int(got["path"][-1])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "state": [last], "probability": [float(got["posterior"][-1, last])], "log_lik": [got["log_lik"]], "rounds": [got["rounds"]], "means": [got["mu"].tolist()], "deviations": [got["sd"].tolist()]})

    return feats.groupBy(*keys).applyInPandas(fit, f"{types}, state int, probability double, log_lik double, rounds int, means array<array<double>>, deviations array<array<double>>")


def report(bars: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """GARCH, jumps and hidden state of each key's look back, with the family of strategies they call for; the GARCH regime stands in where no state could be fitted."""
    keys = keys or ("symbol",)
    rets = returns(bars, *keys)
    g = garch_report(rets, *keys, most=most).withColumnRenamed("regime", "vol_regime").withColumnRenamed("probability", "vol_probability").drop("log_lik")
    j = jumps(rets, *keys).select(*keys, F.col("jump").alias("jump_component"), F.col("ratio").alias("jump_ratio"), F.col("z").alias("jump_z"), F.col("detected").alias("jump_detected"))
    out = bars.groupBy(*keys).agg(F.max("time").alias("time")).join(g, list(keys), "left").join(j, list(keys), "left").join(hmm(bars, *keys, most=most), list(keys), "left")
    stand_in = F.when(F.col("vol_regime") == "low-vol", 0).when(F.col("vol_regime") == "high-vol", 2).otherwise(1)
    out = out.withColumn("state", F.coalesce("state", stand_in)).withColumn("probability", F.coalesce("probability", "vol_probability")).withColumn("label", F.element_at(F.array(*map(F.lit, LABELS)), F.col("state") + 1))
    return out.withColumn("dispatch", F.when(F.col("state") == 0, "mean-reversion").when(F.col("state") == 2, "momentum").otherwise("breakout-prep")).fillna(0.0, ["jump_component", "jump_ratio", "jump_z"]).fillna(False, ["jump_detected"])
