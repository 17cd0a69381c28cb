"""Hidden Markov training of long series: blocks are matrix products, joined in order; a round of training is one pass over the blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import FOLD, placed
from ..sources.tables import written

#: rows whose products are taken one after the other, for all such runs of a block at once
RUN = 64
FLOOR = 1e-12


def emissions(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    s = np.maximum(sd, 1e-9)
    return np.exp(-0.5 * (((x[:, None, :] - mu) / s) ** 2).sum(axis=2)) / np.prod(math.sqrt(2 * math.pi) * s, axis=1)


def steps(x: np.ndarray, model: dict, first: bool) -> np.ndarray:
    """A matrix a row: from each state to each, times what the row says of it; the very first row comes from `pi` whatever is before."""
    b = emissions(x, model["mu"], model["sd"])
    m = model["a"][None] * b[:, None, :]
    if first and len(m):
        m[0] = model["pi"] * b[0]
    return m


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arrays with their last two or one axes scaled to a sum of 1, logs of the sums); zeros stay."""
    total = v.sum(axis=(-2, -1) if v.ndim > 2 else -1, keepdims=True)
    total = np.where(total > 0, total, 1.0)
    return v / total, np.log(total).reshape(len(v))


def runs_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products from the start of each run of RUN rows up to each row, logs of their scales); what is missing in the last run are identities."""
    n, s = len(m), m.shape[1]
    runs = -(-n // RUN)
    m = np.concatenate([m, np.broadcast_to(np.eye(s), (runs * RUN - n, s, s))]).reshape(runs, RUN, s, s)
    out, logs = np.empty_like(m), np.zeros((runs, RUN))
    out[:, 0], logs[:, 0] = scaled(m[:, 0])
    for k in range(1, RUN):
        out[:, k], more = scaled(out[:, k - 1] @ m[:, k])
        logs[:, k] = logs[:, k - 1] + more
    return out, logs


def product(m: np.ndarray) -> tuple[np.ndarray, float]:
    """(product of all matrices, scaled; log of the scale)."""
    out, logs = runs_of(m)
    whole, total = np.eye(m.shape[1])[None], logs[:, -1].sum()
    for part in out[:, -1]:
        whole, more = scaled(whole @ part[None])
        total += more[0]
    return whole[0], float(total)


def vectors(start: np.ndarray, m: np.ndarray) -> np.ndarray:
    """start times the product up to each row, each scaled to a sum of 1."""
    out, _ = runs_of(m)
    starts = np.empty((len(out), m.shape[1]))
    for k in range(len(out)):
        starts[k] = start
        start = scaled((start @ out[k, -1])[None])[0][0]
    return scaled(np.einsum("gs,glst->glt", starts, out).reshape(-1, m.shape[1])[: len(m)])[0]


def best(m: np.ndarray) -> np.ndarray:
    """Largest sums of logs over all ways through the rows, from each state to each: the product in which sums are maxima."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([(m[0 : len(m) - 1 : 2][:, :, :, None] + m[1::2][:, None, :, :]).max(axis=2), odd])
    return m[0]


def counts(x: np.ndarray, m: np.ndarray, before: np.ndarray, after: np.ndarray, first: bool) -> dict[str, np.ndarray]:
    """Expected moves, state weights and sums of x and of its squares by state of one block, from the state distribution before it and the backward vector after it."""
    alpha = vectors(before, m)
    back = vectors(after, np.ascontiguousarray(m[::-1].transpose(0, 2, 1)))[::-1]
    beta = np.concatenate([back[1:], after[None]])
    gamma = scaled(alpha * beta)[0]
    pairs = np.concatenate([before[None], alpha[:-1]])[:, :, None] * m * beta[:, None, :]
    pairs = scaled(pairs[1:] if first else pairs)[0]
    return {"moves": pairs.sum(axis=0), "weight": gamma.sum(axis=0), "sx": gamma.T @ x, "sxx": gamma.T @ (x * x), "begin": gamma[0] if first else np.zeros(m.shape[1])}


SHAPES = ("pi", "a", "mu", "sd")


def model_of(row, states: int, d: int) -> dict[str, np.ndarray]:
    sizes = {"pi": (states,), "a": (states, states), "mu": (states, d), "sd": (states, d)}
    return {k: np.array(getattr(row, k), float).reshape(sizes[k]) for k in SHAPES}


def updated(model: dict, sums: dict, states: int) -> dict:
    """The next model from a whole series' counts."""
    rows, weight = sums["moves"].sum(axis=1, keepdims=True), sums["weight"][:, None]
    safe = np.where(weight > 0, weight, 1)
    mu = np.where(weight > 0, sums["sx"] / safe, model["mu"])
    var = np.maximum(sums["sxx"] - 2 * mu * sums["sx"] + mu * mu * sums["weight"][:, None], 0)
    pi = np.maximum(sums["begin"], 1e-6)
    return {"a": np.where(rows > 0, sums["moves"] / np.where(rows > 0, rows, 1), 1 / states), "mu": mu, "sd": np.sqrt(np.maximum(var / np.maximum(weight, 1e-9), 1e-6)), "pi": pi / pi.sum()}


def fit_in_blocks(features: DataFrame, *keys: str, states: int = 3, rounds: int = 25, size: int = FOLD) -> DataFrame:
    """By key state, probability, log_lik, rounds, means and deviations of a hidden Markov model of features (keys, rn, f0 to f3), as volatility.fit_hmm() gives them.

    A series is cut into blocks of `size` rows. In each round every block gives the product of its step matrices (a few numbers), a key's
    products are joined in order to what stands before and after each block, and every block then gives its expected counts, which add up to the next
    model. Only products and counts of blocks meet by key, never rows. Models are a small table written each round; keys that have
    settled stay as they are. The last state is that of the best path: its score is the product in which sums are maxima.
    """
    names = [c for c in features.columns if c.startswith("f")]
    d = len(names)
    types = ", ".join(f"{k} {t}" for k, t in features.dtypes if k in keys)
    rows = placed(features, *keys, order="rn")
    long = written(rows.where(F.col("n") >= states * 10).select(*keys, "rn", "place", "n", *names), "features")
    item = F.struct("place", F.array(*names).alias("x"))
    blocks = written(long.groupBy(*keys, F.floor(F.col("place") / size).alias("block")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"])).alias("x")), "blocks")

    # starts: rows at quantiles of the second feature, ranked without a sort of a whole key
    ranked = placed(long.drop("place", "n").withColumn("_by", F.struct(names[1], "rn")), *keys, order="_by")
    at = F.array(*[F.floor(F.lit((k + 0.5) / states) * F.col("n")) for k in range(states)])
    means = ranked.where(F.array_contains(at, F.col("place"))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", F.array(*names).alias("x")))).alias("_m")).select(*keys, F.flatten(F.transform("_m", lambda s: s["x"])).alias("mu"))
    spread = F.array(*[F.greatest(F.stddev_samp(c), F.lit(1e-3)) for c in names])
    sds = long.groupBy(*keys).agg(spread.alias("_sd")).select(*keys, F.flatten(F.array_repeat("_sd", states)).alias("sd"))
    same = np.where(np.eye(states) == 1, 0.85, 0.15 / (states - 1)).ravel().tolist()
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    models = means.join(sds, list(keys)).select(*keys, literal([1 / states] * states).alias("pi"), literal(same).alias("a"), "mu", "sd", F.lit(-math.inf).alias("before_ll"), F.lit(0).alias("rounds"), F.lit(False).alias("settled"))
    models = written(models, "models")
    model_type = f"{types}, pi array<double>, a array<double>, mu array<double>, sd array<double>, before_ll double, rounds int, settled boolean"

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [product(steps(np.array(r.x).reshape(-1, d), model_of(r, states, d), r.block == 0)) for r in pdf.itertuples()]
            yield pdf[[*keys, "block"]].assign(m=[m.ravel() for m, _ in out], logs=[v for _, v in out])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        """What stands before and after each block of a key, and the log-likelihood so far."""
        pdf = pdf.sort_values("block", ignore_index=True)
        ms = np.stack(pdf["m"].to_list()).reshape(-1, states, states)
        before, after = np.empty((len(ms), states)), np.empty((len(ms), states))
        v, total = np.eye(states)[0], 0.0
        for k, m in enumerate(ms):
            before[k] = v
            (v,), (more,) = scaled((v @ m)[None])
            total += more
        w = np.full(states, 1 / states)
        for k in range(len(ms) - 1, -1, -1):
            after[k] = w
            w = scaled((ms[k] @ w)[None])[0][0]
        return pdf[[*keys, "block"]].assign(before=list(before), after=list(after), end=[v] * len(pdf), log_lik=float(total + pdf["logs"].sum()))

    chain_type = f"{types}, block long, before array<double>, after array<double>, end array<double>, log_lik double"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, model = np.array(r.x).reshape(-1, d), model_of(r, states, d)
                got = counts(x, steps(x, model, r.block == 0), np.array(r.before), np.array(r.after), r.block == 0)
                out.append(np.concatenate([got[k].ravel() for k in ("moves", "weight", "sx", "sxx", "begin")]))
            yield pdf[[*keys, "log_lik"]].assign(sums=out)

    def next_model(pdf: pd.DataFrame) -> pd.DataFrame:
        r, cuts = next(pdf.itertuples()), np.cumsum([states * states, states, states * d, states * d])
        parts = np.split(np.array(r.sums), cuts)
        sums = dict(zip(("moves", "weight", "sx", "sxx", "begin"), (parts[0].reshape(states, states), parts[1], parts[2].reshape(states, d), parts[3].reshape(states, d), parts[4])))
        new = updated(model_of(r, states, d), sums, states)
        return pdf[list(keys)].assign(**{k: [new[k].ravel()] for k in SHAPES}, before_ll=r.log_lik, rounds=r.rounds + 1, settled=abs(r.log_lik - r.before_ll) < 1e-4)

    def chain(live: DataFrame) -> tuple[DataFrame, DataFrame]:
        with_model = blocks.join(live.select(*keys, *SHAPES), list(keys))
        ends = with_model.mapInPandas(products, f"{types}, block long, m array<double>, logs double").groupBy(*keys).applyInPandas(chained, chain_type)
        return with_model, ends

    width = states * states + 2 * states + 2 * states * d
    for _ in range(rounds):
        live = models.where(~F.col("settled"))
        if live.limit(1).count() == 0:
            break
        with_model, ends = chain(live)
        parts = with_model.join(ends, [*keys, "block"]).mapInPandas(counted, f"{types}, log_lik double, sums array<double>")
        added = parts.groupBy(*keys).agg(F.max("log_lik").alias("log_lik"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
        new = live.join(added, list(keys)).groupBy(*keys).applyInPandas(next_model, model_type)
        models = written(models.where("settled").unionByName(new), "models")

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples())
        m = model_of(r, states, d)
        by = np.argsort(m["mu"][:, 1], kind="stable")
        m = {"pi": m["pi"][by], "a": m["a"][by][:, by], "mu": m["mu"][by], "sd": m["sd"][by]}
        return pdf.assign(**{k: [v.ravel()] for k, v in m.items()})

    models = written(models.groupBy(*keys).applyInPandas(ordered, model_type), "models")

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, model = np.array(r.x).reshape(-1, d), model_of(r, states, d)
                logs = np.log(np.maximum(emissions(x, model["mu"], model["sd"]), FLOOR))
                step = np.log(np.maximum(model["a"], FLOOR))[None] + logs[:, None, :]
                if r.block == 0:
                    step[0] = np.log(np.maximum(model["pi"], FLOOR)) + logs[0]
                out.append(best(step).ravel())
            yield pdf[[*keys, "block"]].assign(way=out)

    def last_state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        whole = np.stack(pdf["way"].to_list()).reshape(-1, states, states)
        r = pdf.iloc[-1]
        end, state = np.array(r["end"]), int(best(whole)[0].argmax())
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "state": [state], "probability": [float(end[state])], "log_lik": [float(r["log_lik"])], "rounds": [int(r["rounds"])], "means": [np.array(r["mu"]).reshape(states, d).tolist()], "deviations": [np.array(r["sd"]).reshape(states, d).tolist()]})

    with_model, ends = chain(models)
    ways = with_model.mapInPandas(paths, f"{types}, block long, way array<double>").join(ends.select(*keys, "block", "end", "log_lik"), [*keys, "block"]).join(models.select(*keys, "mu", "sd", "rounds"), list(keys))
    return ways.groupBy(*keys).applyInPandas(last_state, f"{types}, state int, probability double, log_lik double, rounds int, means array<array<double>>, deviations array<array<double>>")
