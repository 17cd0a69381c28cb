"""Series in blocks: any block size gives what one pass over a whole series gives."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fractal, information, microstructure, rolling, statarb, volatility
from tidemark.sources import bars as B
from tidemark.sources import series
from tidemark.sources.bars import BAR
from tidemark.sources.tables import written

START = datetime(2024, 1, 1)


def walk(symbol: str, n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out, close = [], 100.0
    for i in range(n):
        before, close = close, max(1.0, close * (1 + rng.gauss(0, 0.02)))
        out.append((symbol, START + timedelta(hours=i), before, max(before, close) + rng.random(), min(before, close) - rng.random() / 2, close, float(rng.choice([0, 1, 5, 9, 40]))))
    return out


@pytest.fixture(scope="module")
def rows():
    return walk("a", 700, 1) + walk("b", 333, 2) + walk("c", 1, 3) + walk("d", 35, 4)


@pytest.fixture(scope="module")
def bars(spark, rows):
    return written(spark.createDataFrame(rows, BAR).repartition(7), "bars")


def close_to(found, want, tolerance=1e-9) -> None:
    assert len(found) == len(want)
    for x, y in zip(sorted(map(tuple, found), key=repr), sorted(map(tuple, want), key=repr)):
        for a, b in zip(x, y):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)), (x, y)


def test_places(spark, rows):
    df = spark.createDataFrame(rows + [(None, START + timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(9)], BAR).repartition(5)
    by: dict = {}
    for r in series.placed(df, "symbol").collect():
        by.setdefault(r["symbol"], []).append((r["time"], r["place"], r["n"]))
    assert {k: len(v) for k, v in by.items()} == {"a": 700, "b": 333, "c": 1, "d": 35, None: 9}
    for v in by.values():
        assert [p for _, p, _ in sorted(v)] == list(range(len(v))) and {n for *_, n in v} == {len(v)}


@pytest.mark.parametrize("f, n, column", [(rolling.sma, 20, "sma"), (rolling.rolling_std, 20, "std"), (rolling.atr, 14, "atr"), (rolling.zscore, 48, "z"), (rolling.rolling_half_life, 48, "half_life"), (rolling.ewma_momentum, 24, "momentum"), (rolling.volume_rank, 50, "rank")])
def test_rolling_in_blocks(bars, f, n, column):
    whole = f(bars, n) if f in (rolling.sma, rolling.rolling_std) else f(bars, n=n)
    pick = lambda df: df.select("symbol", "rn", "time", column).collect()
    close_to(pick(rolling.whole(f, n, 64)(bars)), pick(whole))


def test_a_block_is_longer_than_its_halo(bars):
    with pytest.raises(ValueError):
        rolling.whole(rolling.sma, 20, 19)(bars)


def test_one_symbol_over_many_tasks(spark):
    """Half a million bars of one symbol: no task of the rolling stage has more than a few blocks."""
    df = spark.range(500_000).select(F.lit("one").alias("symbol"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("time"), *[F.rand(3).alias(c) for c in ("open", "high", "low", "close", "volume")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is put into one task
    try:
        out = rolling.whole(rolling.sma, 20, 16_384)(df).select("rn", "sma", F.spark_partition_id().alias("task"))
        held = [r["n"] for r in out.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 500_000 and len(held) >= 6 and max(held) < 250_000


@pytest.mark.parametrize("size", [1, 7, 100, 4096])
def test_drawdown(bars, rows, size):
    found = {r["symbol"]: tuple(r)[1:] for r in rolling.max_drawdown(bars, size=size).collect()}
    for s in "abcd":
        peak, at, best = -1.0, 0, (0.0, 0, 0)
        for i, c in enumerate(r[5] for r in rows if r[0] == s):
            if c > peak:
                peak, at = c, i
            if (peak - c) / peak > best[0]:
                best = ((peak - c) / peak, at, i)
        assert found[s] == best


def test_drawdown_of_equal_falls(spark):
    closes = [10.0, 5.0, 10.0, 5.0, 20.0, 10.0, 0.0, -1.0]
    for n in range(1, len(closes) + 1):
        df = spark.createDataFrame([("s", START + timedelta(hours=i), c, c, c, c, 1.0) for i, c in enumerate(closes[:n])], BAR)
        want = max(((max(closes[: i + 1]) - c) / max(closes[: i + 1]), -i) for i, c in enumerate(closes[:n]))
        for size in (1, 2, 3, 100):
            r = rolling.max_drawdown(df, size=size).first()
            assert (r["max_drawdown"], r["trough_at"]) == (want[0], -want[1] if want[0] > 0 else 0)
            assert r["peak_at"] == (closes.index(max(closes[: -want[1] + 1])) if want[0] > 0 else 0)


def test_garch_in_blocks(bars):
    rets = B.returns(bars)
    whole = volatility.garch(rets).collect()
    assert {r["symbol"] for r in whole} == {"a", "b", "d"}
    for size in (11, 400):
        close_to(volatility.garch(rets, size=size).collect(), whole)
        close_to(volatility.garch_series(rets, size=size).collect(), volatility.garch_series(rets).collect())


def test_hedge_ratio_in_blocks(bars, rows):
    pairs = [("a", "b"), ("b", "a"), ("a", "d"), ("c", "a")]
    pair = written(statarb.log_pair(bars, pairs), "pair")
    whole = statarb.kalman(pair).collect()
    for size in (8, 45):
        close_to(statarb.kalman(pair, size=size).collect(), whole)
    # a plain walk over one pair
    x, y = (np.log([r[5] for r in rows if r[0] == s][:333]) for s in "ab")
    x, y = x - x.mean(), y - y.mean()
    b = np.polyfit(x[:30], y[:30], 1)[0]
    p, errors = max(b * 0.01, 0.01) + 0.01, []
    for u, v in zip(x[30:], y[30:]):
        p += 1e-4
        gain = p * u / (u * u * p + 1e-3)
        errors.append(v - u * b)
        b, p = b + gain * errors[-1], max((1 - gain * u) * p, 0)
    r = next(r for r in whole if (r["x_symbol"], r["y_symbol"]) == ("a", "b"))
    assert np.allclose([r["hedge_ratio"], r["variance"], r["residual"], r["kalman_z"]], [b, p, errors[-1], (errors[-1] - np.mean(errors)) / np.std(errors, ddof=1)])


def test_hidden_states_in_blocks(spark):
    """One symbol in 1, 2 and 50 blocks, and a second one that is too short."""
    df = written(spark.createDataFrame(walk("a", 400, 9) + walk("b", 60, 2), BAR), "bars")
    (want,) = volatility.hmm(df, rounds=6).collect()
    for size in (4096, 200, 7):
        (r,) = volatility.hmm(df, rounds=6, size=size).collect()
        assert (r["symbol"], r["state"], r["rounds"]) == (want["symbol"], want["state"], want["rounds"])
        assert np.allclose([r["probability"], r["log_lik"]], [want["probability"], want["log_lik"]], atol=1e-8)
        assert np.allclose(r["means"], want["means"], atol=1e-8) and np.allclose(r["deviations"], want["deviations"], atol=1e-8)


@pytest.mark.parametrize("size", [5, 64, 65_536])
def test_volume_buckets_in_blocks(bars, size):
    flow = written(microstructure.classify_volume(bars), "flow")
    look = lambda **o: microstructure.volume_buckets(flow, **o).select("symbol", "bucket", "time", "buy", "sell", "vol").collect()
    close_to(look(size=size), look(most=1000))


def test_volume_buckets_without_volume(spark):
    df = spark.createDataFrame([("s", START + timedelta(hours=i), 0.0, 0.0, 0.0 if i % 2 else None) for i in range(9)], "symbol string, time timestamp_ntz, buy double, sell double, volume double")
    assert microstructure.volume_buckets(df, size=3).collect() == microstructure.volume_buckets(df, most=9).collect() == []


def test_entropies_by_what_enters_and_leaves(spark, bars):
    rets = written(B.returns(bars), "rets")
    found = {(r["symbol"], r["end_at"]): r["pe"] for r in information.permutation_series(rets, m=3, n=20).collect()}
    series_of = {s: [r["r"] for r in rets.where(F.col("symbol") == s).orderBy("rn").collect()] for s in "abd"}
    assert len(found) == sum(len(v) - 19 for v in series_of.values() if len(v) >= 23)
    for (s, end), pe in found.items():
        own = series_of[s][end - 20 : end]
        counts: dict = {}
        for i in range(len(own) - 2):
            k = tuple(sorted(range(3), key=lambda j: (own[i + j], j)))
            counts[k] = counts.get(k, 0) + 1
        total = sum(counts.values())
        assert math.isclose(pe, -sum(c / total * math.log2(c / total) for c in counts.values()) / math.log2(6), abs_tol=1e-9)
    pair = written(information.paired(rets, [("a", "b")]), "pair")
    flow = {r["end_at"]: (r["x_to_y"], r["y_to_x"]) for r in information.transfer_series(pair, n=30).collect()}
    cells = [(r["xq"], r["yq"]) for r in information.binned(pair, ["x", "y"], 4).orderBy("rn").collect()]
    assert sorted(flow) == list(range(30, len(cells)))
    for end in (30, 77, len(cells) - 1):
        own = cells[end - 30 : end]

        def te(x, y):
            triples = [(y[i + 1], y[i], x[i]) for i in range(len(y) - 1)]
            n = lambda f: {k: sum(f(t) == k for t in triples) for k in {f(t) for t in triples}}
            abc, bc, ab, b = n(lambda t: t), n(lambda t: t[1:]), n(lambda t: t[:2]), n(lambda t: t[1])
            return sum(v / len(triples) * math.log2((v / bc[k[1:]]) / (ab[k[:2]] / b[k[1]])) for k, v in abc.items())

        x, y = zip(*own)
        assert np.allclose(flow[end], (te(x, y), te(y, x)), atol=1e-9)


def test_block_sizes_have_no_end(spark):
    """Half of a series of 2^24 returns is a block size beyond 2^20."""
    df = spark.createDataFrame([("s", i, 0.1, 1 << 24) for i in (0, 5)], "symbol string, rn long, r double, n long")
    assert max(r["tau"] for r in fractal.blocks(df, "symbol").collect()) > (1 << 24) / 2 / 1.4


def test_stream_scores_go_on(spark, tmp_path):
    """Files that arrive after a stop go on from the state that was left; rows are those of one pass over all."""
    from tidemark.streaming import signals
    from tidemark.streaming.bars import EVENT

    rng = random.Random(6)
    events = [(i, START + timedelta(seconds=i), 1, rng.choice("xy"), float(rng.randrange(50)), "{}") for i in range(300)]
    for k, part in enumerate((events[:120], events[120:130], events[130:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        for p in (tmp_path / f"in{k}").glob("*.parquet"):
            p.rename(tmp_path / f"events{k}.parquet")
        found = signals.scores_table(spark, str(tmp_path), f"scores-{tmp_path.name}", n=9).collect()
    want = []
    for s in "xy":
        own = [e for e in events if e[3] == s and e[4] > 0]
        for i, e in enumerate(own):
            last = [v[4] for v in own[max(0, i - 8) : i + 1]]
            sd = float(np.std(last, ddof=1)) if len(last) > 1 else 0.0
            want.append((s, e[0], len(last), (e[4] - sum(last) / len(last)) / sd if sd else 0.0))
    close_to([(r["symbol"], r["event_id"], r["held"], r["z"]) for r in found], want)
    with pytest.raises(ValueError):
        signals.scores_table(spark, str(tmp_path), "idle", idle_ms=1000)


def test_stream_scores_in_blocks(spark, tmp_path):
    """A micro-batch's rows of a symbol are dealt over blocks, and no Python process gets them; each batch goes on from the one before."""
    from tidemark.streaming import signals
    from tidemark.streaming.bars import EVENT

    rng = random.Random(8)
    events = [(i, START + timedelta(seconds=i), 1, "x" if i % 5 else "y", float(rng.randrange(1, 50)), "{}") for i in range(900)]
    for k, part in enumerate((events[:500], events[500:])):
        spark.createDataFrame(rng.sample(part, len(part)), EVENT).repartition(3).write.parquet(f"{tmp_path}/in{k}")
        for i, p in enumerate((tmp_path / f"in{k}").glob("*.parquet")):
            p.rename(tmp_path / f"events{k}-{i}.parquet")
        found = {size: signals.scores_table(spark, str(tmp_path), f"blocks-{size}-{tmp_path.name}", n=7, size=size).collect() for size in (8, 65, 4096)}
    for rows in found.values():
        want = []
        for s in "xy":
            own = [e for e in events if e[3] == s]
            for i, e in enumerate(own):
                last = [v[4] for v in own[max(0, i - 6) : i + 1]]
                sd = float(np.std(last, ddof=1)) if len(last) > 1 else 0.0
                want.append((s, e[0], len(last), (e[4] - sum(last) / len(last)) / sd if sd else 0.0))
        close_to([(r["symbol"], r["event_id"], r["held"], r["z"]) for r in rows], want)


def test_streams_by_interval(spark, tmp_path):
    """A stream that looks for files again and again ends after its seconds, with what came; silent symbols may be forgotten."""
    from tidemark.streaming import bars as stream
    from tidemark.streaming import signals

    events = [(i, START + timedelta(minutes=i), 1, "x", float(i + 1), "{}") for i in range(50)]
    spark.createDataFrame(events, stream.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    for p in (tmp_path / "in").glob("*.parquet"):
        p.rename(tmp_path / "events0.parquet")
    rows = stream.bars_table(spark, str(tmp_path), f"bars-{tmp_path.name}", interval="1 second", seconds=4).collect()
    assert [(r["open"], r["close"]) for r in rows] == [(1.0, 50.0)]
    rows = signals.scores_table(spark, str(tmp_path), f"idle-{tmp_path.name}", n=5, idle_ms=3_600_000, interval="1 second", seconds=4).collect()
    assert sorted(r["event_id"] for r in rows) == list(range(50))


def test_supplied_bars_read_what_they_need(spark, bars, tmp_path):
    from tidemark.sources import supplied

    path = str(tmp_path / "bars")
    years = spark.createDataFrame([(s, datetime(y, 1, 1) + timedelta(days=i), 1.0, 2.0, 0.5, float(i), 3.0) for s in ("a", "b/c é") for y in (2020, 2021, 2022, 2023) for i in range(20)], BAR)
    supplied.save_bars(years, path)
    close_to(supplied.supplied_bars(spark, path).select(*BAR.names).collect(), years.collect())
    for folder in (tmp_path / "bars").glob("symbol=a/year=202[01]/*.parquet"):
        folder.write_bytes(b"not opened")
    recent = supplied.supplied_bars(spark, path, last=30).where("symbol = 'a'")
    assert recent.count() == 40 and B.tail(recent, 30).count() == 30
    assert supplied.supplied_bars(spark, path).where("symbol = 'a' and time >= timestamp_ntz'2023-01-05'").count() == 16
    assert supplied.supplied_bars(spark, path).where("symbol in ('nobody')").count() == 0
    assert len(supplied.BarsReader({"path": path, "last": "1"}).partitions()) == 2
