"""Values of what SQL can't say, against plain versions: generator, positions and exits, hidden states, models, gates, streams."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, live, ml, strategies, volatility
from tidemark.sources import declared, generator
from tidemark.sources.bars import REGIMES, SYMBOLS, TRANSITIONS
from tidemark.sources.tables import Expiring
from tidemark.streaming import bars as stream


def plain_draws(seed: int):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (1 | a)) & 0xFFFFFFFF
        t = ((t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield (t ^ t >> 14) / 4294967296


def plain_bars(symbol: str, n: int, seed: int) -> list:
    _, base, daily, _, tick, _ = next(s for s in SYMBOLS if s[0] == symbol)
    draws = plain_draws(seed)
    gauss = lambda: math.sqrt(-2 * math.log(next(draws))) * math.cos(2 * math.pi * next(draws))
    sigma, price, mean, trend, regime, out = daily * math.sqrt(1 / 24), base, base, 0.0, "calm", []
    for i in range(n):
        if i and i % 24 == 0:
            r, old = next(draws), regime
            for k, edge in zip(REGIMES, np.cumsum(TRANSITIONS[regime]).tolist()):
                if r <= edge:
                    regime = k
                    break
            if regime != old and regime == "trend":
                trend = (1 if next(draws) > 0.5 else -1) * sigma * (0.15 + next(draws) * 0.2)
            if regime != old and regime == "revert":
                mean = price
        pull = -0.002 * max(-0.3, min(0.3, math.log(max(price, tick) / base)))
        drift = {"trend": trend, "revert": (mean - price) / price * 0.03}.get(regime, 0) + pull
        vol = sigma * {"trend": 1, "revert": 0.85, "highvol": 2.3, "calm": 0.6}[regime]
        close = max(price * (1 + drift + vol * gauss()), tick)
        wick = abs(gauss()) * vol * 0.4
        volume = math.floor(800 + abs(gauss()) * 400 + {"highvol": 1500, "trend": 800}.get(regime, 0) + 0.5)
        out.append((price, max(price, close) * (1 + wick), min(price, close) * (1 - wick), close, volume, regime))
        price = close
    return out


@pytest.fixture(scope="module")
def made(spark):
    return generator.generated_bars(spark, 3000, start=datetime(2024, 1, 1)).cache()


def test_generated_bars(made):
    for symbol, seed in generator.SEEDS.items():
        rows = made.where(F.col("symbol") == symbol).orderBy("time").collect()
        want = plain_bars(symbol, 3000, seed)
        assert np.allclose([(r.open, r.high, r.low, r.close, r.volume) for r in rows], [w[:5] for w in want], rtol=1e-12) and [r.regime for r in rows] == [w[5] for w in want]
        assert rows[-1].time - rows[0].time == timedelta(hours=2999) and len({r.regime for r in rows}) > 2
    counts = {r.symbol: sum(r[k] for k in REGIMES) for r in backtest.regime_counts(made).collect()}
    assert counts == {"EUR/USD": 3000, "XAU/USD": 3000}


def test_live_ticks(spark, made):
    last = made.groupBy("symbol").agg(F.max("time").alias("time"), F.max_by("close", "time").alias("close"))
    old, new = ({r.symbol: r for r in x.collect()} for x in (last, generator.live_ticks(last)))
    for s, r in new.items():
        assert r.time == old[s].time + timedelta(hours=1) and r.open == old[s].close and r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high and r.volume >= 800 and abs(r.close / r.open - 1) < 0.05


def plain_exit(code: str, r, long: bool, entry: float, held: int) -> bool:
    """Whether an open position is left on bar r, as each strategy's rules say."""
    sign = 1 if long else -1
    if code == "zscore-mr":
        return r.z is not None and (sign * r.z < -3.5 or held >= 24 or sign * r.z > -0.3)
    if code == "decay-mom":
        return r.signal is not None and sign * r.signal < 0.05
    if code == "vol-breakout":
        return r.atr is not None and (sign * (r.close - entry) < -1.8 * r.atr or held >= 18)
    return r.slow is not None and (sign * math.log(r.close / entry) < -6 * abs(r.slow) or (r.downs if long else r.ups) >= 3 or held >= 30)


@pytest.mark.parametrize("code", list(strategies.STRATEGIES))
def test_positions_and_exits(made, code):
    """The ledger against a plain walk: decided on the close, done at the next open with costs, sized by risk, closed at the end."""
    symbol, cfg = "XAU/USD", backtest.Config(pip=0.1, spread=0.3)
    bars = made.where(F.col("symbol") == symbol)
    rows = strategies.signals(bars, code).orderBy("time").collect()
    equity, at, want, todo, curve = cfg.capital, None, [], None, []
    for i, r in enumerate(rows):
        if todo == "exit" and at:
            long, price, size, k = at
            out = r.open - 0.4 if long else r.open + 0.4
            pnl = ((out - price) if long else (price - out)) * size
            equity += pnl
            want.append((k, i, price, out, pnl))
            at = None
        elif todo and todo != "exit" and not at:
            long = todo[0] == "enter-long"
            price = r.open + 0.4 if long else r.open - 0.4
            at = (long, price, min(equity * 0.01 / max(todo[1], 0.5), equity * 20 / price), i)
        curve.append(equity + ((r.close - at[1]) * (1 if at[0] else -1) * at[2] if at else 0))
        todo = None
        if at and plain_exit(code, r, at[0], at[1], i - at[3]):
            todo = "exit"
        elif not at and r.action != "hold":
            todo = (r.action, r.stop)
    if at:
        long, price, size, k = at
        out = rows[-1].close - 0.3 if long else rows[-1].close + 0.3
        want.append((k, len(rows) - 1, price, out, ((out - price) if long else (price - out)) * size))
    book = backtest.ledger(bars.drop("regime"), [code], cfg)
    place = {r.time: i for i, r in enumerate(rows)}
    found = [(place[t.entry_time], place[t.time], t.entry_price, t.exit_price, t.pnl) for t in book.where("kind = 'trade'").orderBy("time").collect()]
    assert len(found) == len(want) > 3
    assert np.allclose(found, want)
    assert np.allclose([r.equity for r in book.where("kind = 'equity'").orderBy("time").collect()], curve)
    trades = declared.trades(book).collect()
    assert len(trades) == len(want) and len({t.id for t in trades}) == len(want)


def test_hidden_states():
    """Two rounds of the fit, the path and the likelihood against loops over their definitions."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, s, (60, 2)) for m, s in ((-2, 0.4), (0, 0.6), (2.5, 0.5))])
    t, k = len(x), 3
    order = sorted(range(t), key=lambda i: x[i][1])
    mu = [list(x[order[int((j + 0.5) / k * t)]]) for j in range(k)]
    sd = [[max(float(np.std(x[:, d], ddof=1)), 1e-3) for d in range(2)] for _ in range(k)]
    pi, a = [1 / k] * k, [[0.85 if i == j else 0.075 for j in range(k)] for i in range(k)]
    density = lambda i, j: math.prod(math.exp(-0.5 * ((x[i][d] - mu[j][d]) / sd[j][d]) ** 2) / (math.sqrt(2 * math.pi) * sd[j][d]) for d in range(2))

    def forward():
        alpha, logs = [], 0.0
        for i in range(t):
            row = [(pi[j] if i == 0 else sum(alpha[-1][h] * a[h][j] for h in range(k))) * density(i, j) for j in range(k)]
            logs += math.log(sum(row))
            alpha.append([v / sum(row) for v in row])
        return alpha, logs

    for _ in range(2):
        alpha, _ = forward()
        beta = [[1.0] * k]
        for i in range(t - 2, -1, -1):
            row = [sum(a[j][h] * density(i + 1, h) * beta[0][h] for h in range(k)) for j in range(k)]
            beta.insert(0, [v / sum(row) for v in row])
        gamma = [[al * be for al, be in zip(alpha[i], beta[i])] for i in range(t)]
        gamma = [[g / sum(row) for g in row] for row in gamma]
        xi = np.zeros((k, k))
        for i in range(t - 1):
            m = np.array([[alpha[i][j] * a[j][h] * density(i + 1, h) * beta[i + 1][h] for h in range(k)] for j in range(k)])
            xi += m / m.sum()
        a = (xi / xi.sum(axis=1, keepdims=True)).tolist()
        w = [sum(g[j] for g in gamma) for j in range(k)]
        new = [[sum(g[j] * r[d] for g, r in zip(gamma, x)) / w[j] for d in range(2)] for j in range(k)]
        sd = [[math.sqrt(max(sum(g[j] * (r[d] - new[j][d]) ** 2 for g, r in zip(gamma, x)) / w[j], 1e-6)) for d in range(2)] for j in range(k)]
        mu, pi = new, [max(g, 1e-6) / sum(max(h, 1e-6) for h in gamma[0]) for g in gamma[0]]
    got = volatility.fit_hmm(x, 3, 2)
    assert np.allclose(got["mu"], mu) and np.allclose(got["sd"], sd) and np.allclose(got["a"], a, atol=1e-6) and got["log_lik"] == pytest.approx(forward()[1])
    assert (got["path"] == np.repeat([0, 1, 2], 60)).mean() > 0.97


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, ml.D))
    y = x[:, 0] * 0.3 - x[:, 4] * 0.2 + 0.1 * rng.standard_normal(90)
    rows = [("s", i, 90, datetime(2018, 1, 1) + timedelta(days=30 * i), float(y[i]), x[i].tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "symbol string, rn long, n long, time timestamp_ntz, y double, x array<double>").cache(), x, y


def plain_ridge(x, y, w=None):
    z, w = np.column_stack([np.ones(len(x)), x]), np.ones(len(x)) if w is None else w
    return np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([0.0] + [1.0] * x.shape[1]), z.T @ (w * y))


def plain_sharpe(r):
    return r.mean() / r.std(ddof=1) * math.sqrt(252 * 6.5)


def test_models(table):
    rows, x, y = table
    found = {r.regime: r for r in ml.specialists(rows).collect()}
    beta, late = plain_ridge(x, y), plain_ridge(x, y, 0.5 ** ((89 - np.arange(90)) / 30))
    assert found["mean-reverting"].importance == pytest.approx(np.abs(beta[1:])) and found["mean-reverting"].prediction == pytest.approx(beta[0] + x[-1] @ beta[1:])
    assert found["volatile"].importance == pytest.approx(np.abs(late[1:]) / np.abs(late[1:]).sum()) and found["volatile"].prediction == pytest.approx(late[0] + x[-1] @ late[1:])
    off = beta[0] + x @ beta[1:] - y
    assert found["mean-reverting"].train_mse == pytest.approx((off**2).mean()) and found["mean-reverting"].train_r2 == pytest.approx(1 - (off**2).sum() / ((y - y.mean()) ** 2).sum())
    out, used = ml.boost(x, y)
    assert found["trending"].prediction == pytest.approx(out[-1]) and found["trending"].train_r2 > 0.5 and np.argmax(used) in (0, 4)
    top = {r.feature for r in ml.importance(ml.specialists(rows)).where("place <= 2").collect()}
    assert top == {ml.FEATURES[0], ml.FEATURES[4]}
    # features without a share are as if they were not there
    keep = [i in (0, 4, 7) for i in range(ml.D)]
    few = ml.masked(rows, rows.select("symbol").distinct().withColumn("keep", F.array(*map(F.lit, keep))))
    small = plain_ridge(x[:, [0, 4, 7]], y)
    assert [v for v, k in zip(ml.ridge(few, "symbol").first().beta[1:], keep) if k] == pytest.approx(small[1:])
    alone = ml.ridge(rows.where("rn < 5"), "symbol").first()
    assert not alone.fitted and alone.beta == pytest.approx([y[:5].mean()] + [0] * ml.D)


def test_trees():
    x = np.array([[float(i), 5.0] for i in range(12)])
    y = np.where(x[:, 0] <= 5, 1.0, 3.0)
    used = np.zeros(2)
    tree = ml.grow(x, y, 1, used)
    assert (tree["feature"], tree["at"], tree["low"], tree["high"]) == (0, 5.0, 1.0, 3.0) and used.tolist() == [1, 0]
    assert ml.grow(x[:4], y[:4], 3, used) == 1.0 and ml.fall(tree, x[0]) == 1.0


def test_validation(table):
    rows, x, y = table
    want, walks = [], []
    for f in range(6):
        a, b = f * 15, f * 15 + 15
        train = [i for i in range(90) if i < a - 5 or i >= b + 5]
        beta = plain_ridge(x[train], y[train])
        want.append(plain_sharpe(np.sign(beta[0] + x[a:b] @ beta[1:]) * y[a:b]))
    for s in range(40, 80, 10):
        beta = plain_ridge(x[:s], y[:s])
        walks.append(plain_sharpe(np.sign(beta[0] + x[s : s + 10] @ beta[1:]) * y[s : s + 10]))
    got = ml.validate(rows).first()
    assert got.fold_sharpes == pytest.approx(want) and got.walk_sharpe == pytest.approx(np.mean(walks)) and got.walk_windows == 4
    assert got.deflated == pytest.approx(np.mean(want) * math.sqrt(1 - (math.log(12) + 0.5772) / 24)) and got.oos_years == 7
    assert got.passes == (np.std(want, ddof=1) <= 2) and got.rationale.startswith("PASSES" if got.passes else "FAILS: fold Sharpe std")
    few = ml.validate(rows.where("rn < 20").withColumn("n", F.lit(20).cast("long"))).first()
    assert few.fold_sharpes is None and not few.passes


def test_ensemble(spark, table):
    rows, x, y = table
    models = ml.specialists(rows)
    p = {r.regime: r.prediction for r in models.collect()}
    weights = spark.createDataFrame([("s", 0.2, 0.7, 0.1)], "symbol string, trending double, mean_reverting double, volatile double")
    got = ml.ensemble(models, rows, weights).first()
    want = 0.2 * p["trending"] + 0.7 * p["mean-reverting"] + 0.1 * p["volatile"]
    cut, ps = 0.3 * y.std(ddof=1), np.array(list(p.values()))
    assert got.predicted == pytest.approx(want) and got.dominant == "mean-reverting"
    assert got.direction == ("long" if want > cut else "short" if want < -cut else "flat")
    assert got.confidence == pytest.approx(min(1, max(0, 1 - ps.std(ddof=1) / (abs(ps.mean()) + 1e-9))))


def test_gates(spark):
    at = datetime(2024, 1, 1)
    base = spark.createDataFrame([(s, at, 1.0, f"{family}-{s}", "n", "k", family, conf, "long") for s, family, conf in (("a", "momentum", 0.5), ("a", "always", 0.5), ("a", "breakout-prep", 0.5), ("b", "momentum", 0.5), ("c", "momentum", 0.1), ("c", "always", 0.9), ("d", "momentum", 0.4))], "symbol string, time timestamp_ntz, price double, strategy string, name string, kind string, family string, confidence double, direction string")
    ctx = spark.createDataFrame([("a", "momentum", "open", 1.35, "momentum", "normal", 1.0), ("b", "momentum", "closed", 1.6, "reduce-exposure", "normal", 1.0), ("c", "momentum", "caution", 1.5, "momentum", "random", 0.5), ("d", "momentum", "open", 1.3, "momentum", "predictable", 1.25)], "symbol string, dispatch string, fractal_gate string, dimension double, fractal_dispatch string, pe_state string, pe_multiplier double").withColumn("last_time", F.lit(at).cast("timestamp_ntz")).withColumn("last_price", F.lit(1.0))
    got = {r.strategy: (r.status, r.status_note, r.effective_confidence) for r in live.gated(base, ctx).collect()}
    assert got == {
        "momentum-a": ("active", "matches momentum regime · fractal confirmed", 0.5), "always-a": ("active", "carry · regime-agnostic · fractal confirmed", 0.5), "breakout-prep-a": ("suppressed", "suppressed — momentum regime active", 0.5),
        "momentum-b": ("hold", "HMM ok · fractal gate CLOSED (D=1.60 contradicts reduce-exposure)", 0.5),
        "momentum-c": ("hold", "matches momentum regime · fractal caution · PE random (×0.5) → exposure eliminated", 0.05), "always-c": ("active", "carry · regime-agnostic · fractal caution · PE random (×0.50)", 0.45), "momentum-d": ("active", "matches momentum regime · fractal confirmed · PE predictable (×1.25)", 0.5),
    }
    edge = spark.createDataFrame([("long", "a", 2.5, 0.1, "x", 0.01), ("short", "b", 9.0, 0.1, "x", 0.01), ("none", "c", 3.0, 0.1, "x", 0.01)], "edge string, target string, z double, net double, leader string, leader_return double")
    sent = {r.symbol: (r.direction, r.confidence, r.status) for r in live.injected(live.te_signals(edge), ctx, "cross-asset-te", "n", "cross-asset", F.col("confidence"), "TE edge", F.lit("said")).collect()}
    assert sent == {"a": ("long", 0.5, "active"), "b": ("short", 1.0, "hold")}
    one = live.signal_report(live.gated(base, ctx)).first()
    assert (one.signals, one.active, one.directed) == (7, 4, 7) and '"strategy":"always-a"' in one.rows[0]


def test_late_events(spark, tmp_path):
    """Files in two batches: an event behind the watermark is dropped, one within it changes its bar."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    hour = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[(1, hour(0), 1, "t", 5.0, ""), (2, hour(9), 1, "t", 7.0, "")], [(3, hour(1), 1, "t", 99.0, ""), (4, hour(8, 30), 1, "t", 6.0, ""), (5, hour(9, 30), 1, "t", 8.0, "")]]
    name = f"late-{tmp_path.name}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        next((tmp_path / f"in{i}").glob("part-*.parquet")).rename(tmp_path / f"events-{i}.parquet")
        found = stream.bars_table(spark, str(tmp_path), name)
    assert sorted((r.time, r.open, r.close, r.volume) for r in found.collect()) == [(hour(0), 5.0, 5.0, 1.0), (hour(8), 6.0, 6.0, 1.0), (hour(9), 7.0, 8.0, 2.0)]


def test_live_tail(spark, tmp_path):
    """The ring of a symbol's last closes, over several batches."""
    closes = [float(i * i % 17) for i in range(30)]
    for k in range(3):
        rows = [("s", datetime(2024, 1, 1) + timedelta(hours=i), closes[i]) for i in range(10 * k, 10 * k + 10)]
        spark.createDataFrame(rows, "symbol string, time timestamp, close double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    source = spark.readStream.schema("symbol string, time timestamp, close double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bars")
    query = stream.live_tail(source, 8).writeStream.format("memory").queryName("ring").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sorted(spark.table("ring").collect(), key=lambda r: r.time)
    for i, r in enumerate(rows):
        s = np.array(closes[max(0, i - 7) : i + 1])
        assert r.held == len(s) and r.mean == pytest.approx(s.mean()) and r.z == pytest.approx((s[-1] - s.mean()) / s.std(ddof=1) if len(s) > 1 and s.std() else 0)


def test_expiring_tables(spark):
    now, built = [0.0], []

    def build():
        built.append(1)
        return spark.range(len(built))

    cache = Expiring(300, lambda: now[0])
    assert [cache.get("k", build).count() for now[0] in (0.0, 299.0, 300.0, 301.0)] == [1, 1, 2, 2]


def test_model_report(spark, made):
    """The report's parts fit one another on generated bars."""
    rows = ml.samples(ml.raw_features(made.drop("regime").where("symbol = 'EUR/USD'"), 200, 100)).collect()
    assert len(rows) == len(range(200, 2999, 100)) and all(abs(v) < 8 for r in rows for v in r.x)
    x = pd.DataFrame([r.x for r in rows])
    assert np.allclose(x.mean(), 0, atol=1e-9) and np.allclose(x.std()[x.std() > 0], 1)


def test_volume_buckets_by_a_plain_loop(spark):
    """Overshoot stays in the bucket that it closes; a rest without volume is no bucket; equal volumes fill one bucket a bar; only zeros give none."""
    from tidemark.operators import microstructure

    start = datetime(2024, 1, 1)
    series = {"mixed": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 0.0], "equal": [2.0] * 5, "rest": [4.0, 4.0, 4.0, 0.0, 0.0], "zeros": [0.0] * 3, "short": [1.0, 5.0, 6.0, 1.0]}
    rows = [(s, start + timedelta(hours=i), v * 0.25, v * 0.75, v) for s, vs in series.items() for i, v in enumerate(vs)]
    flow = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, buy double, sell double, volume double")
    expected = []
    for s, vs in series.items():
        size, bucket, held, opened = sorted(vs)[len(vs) // 2] or 1000.0, 0, 0.0, 0
        for i, v in enumerate(vs):
            held += v
            if held >= size:
                expected.append((s, bucket, start + timedelta(hours=opened), held))
                bucket, held, opened = bucket + 1, 0.0, i
        if held > 0:
            expected.append((s, bucket, start + timedelta(hours=opened), held))
    found = microstructure.volume_buckets(flow).collect()
    assert sorted((r["symbol"], r["bucket"], r["time"], r["vol"]) for r in found) == sorted(expected)
    assert all(r["buy"] == r["vol"] * 0.25 and r["sell"] == r["vol"] * 0.75 for r in found)
    assert microstructure.volume_buckets(flow.where("false")).collect() == []


def test_garch_series_ends_where_the_fit_does(spark):
    """The last bar has the fit's volatility, the mean and deviation are those of all bars, and keys without a fit have no rows."""
    from tidemark.sources.bars import BAR, returns

    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("long", 90), ("short", 20)):
        for i, c in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))):
            rows.append((s, datetime(2024, 1, 1) + timedelta(hours=i), float(c), float(c), float(c), float(c), 1.0))
    rets = returns(spark.createDataFrame(rows, BAR))
    fit = volatility.garch(rets).collect()
    series = volatility.garch_series(rets).orderBy("rn").collect()
    assert [r["symbol"] for r in fit] == ["long"] and {r["symbol"] for r in series} == {"long"} and len(series) == 89
    vols = [r["vol"] for r in series]
    assert np.isclose(vols[-1], fit[0]["vol"], rtol=1e-12) and np.isclose(np.mean(vols), fit[0]["mean_vol"], rtol=1e-12) and np.isclose(np.std(vols, ddof=1), fit[0]["std_vol"], rtol=1e-9)


def test_pairs_side_by_side_give_what_each_gives_alone(spark):
    """Pairs that share symbols, in both directions; a symbol that is missing gives no rows."""
    from tidemark.operators import information, statarb
    from tidemark.sources import bars as B

    bars = B.daily_bars(spark, "/root/testdata/sf0.001", 200)
    pairs = [("A", "N"), ("N", "A"), ("A", "R"), ("A", "none")]
    rets = B.returns(bars)
    near = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    for run in (lambda p: information.cross_edge(information.paired(rets, p)), lambda p: statarb.report(bars, p), lambda p: information.report(bars, p)):
        together, alone = near(run(pairs).drop("target").collect()), near(r for p in pairs for r in run([p]).drop("target").collect())
        assert together == alone and len(together) == 3
