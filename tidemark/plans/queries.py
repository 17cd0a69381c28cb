"""Queries by name, each over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, fractal, information, live, microstructure, ml, rolling, statarb, strategies, volatility
from ..sources import bars as B
from ..sources import declared, generator, supplied
from ..sources.tables import kept, shared_folder
from ..streaming.bars import bars_table
from ..streaming.signals import scores_table

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def daily(f: Callable[[DataFrame], DataFrame], *columns: str, digits: int = 6, tail: int | None = None, pairs: list | None = None, keep: bool = False, **other: int) -> Query:
    """A query over daily bars, or the last `tail` of each symbol or pair. What reads its bars many times starts from a table of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = B.daily_bars(spark, sf_dir, tail, pairs)
        out = f(kept(bars, "bars") if keep else bars)
        return rounded(out.select(*columns) if columns else out, digits, **other)

    return run


AR = [("A", "R")]
PAIRS = [("A", "N"), ("A", "R"), ("N", "R")]


def pair_of(bars: DataFrame) -> DataFrame:
    return information.paired(B.returns(bars), AR)


def last_z(bars: DataFrame) -> DataFrame:
    rows = rolling.zscore(B.tail(bars, 48))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("time", "close", "mean", "std", "z"), "time").alias("l")).select("symbol", "l.*")


def ols_spread(bars: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    pair = statarb.log_pair(bars, AR)
    return statarb.ou(pair.select(*B.PAIR, "rn", (F.col("y") - F.regr_slope("y", "x").over(Window.partitionBy(*B.PAIR)) * F.col("x")).alias("s")))


def deflated(bars: DataFrame) -> DataFrame:
    from ..functions import aggregates as A
    from ..operators.ml import deflation

    return B.returns(bars).groupBy("symbol").agg((A.sharpe(F.col("r"), 252 * 6.5) * deflation(12)).alias("deflated"))


def garch_row(bars: DataFrame) -> DataFrame:
    return volatility.garch_report(B.returns(bars))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.range(1000).select(F.explode(F.array(*[F.lit(x).cast("long") for x in generator.SEEDS.values()])).alias("seed"), F.col("id").alias("draw"))
    rows = rows.withColumn("u", generator.uniform(F.col("seed"), F.col("draw")))
    z = generator.normal(F.col("u"), F.lead("u").over(Window.partitionBy("seed").orderBy("draw")))
    return rows.select("seed", "draw", F.round("u", 12).alias("u"), F.round(z, 9).alias("z"))


def generated(spark: SparkSession) -> DataFrame:
    from datetime import datetime

    return generator.generated_bars(spark, 2400, start=datetime(2024, 1, 1))


def model_windows(bars: DataFrame) -> DataFrame:
    rows = ml.windows(bars).groupBy("symbol", F.col("end").alias("stop"))
    return rows.agg(F.count(F.lit(1)).alias("bars"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max("y").alias("y"))


def window_measures(bars: DataFrame) -> DataFrame:
    keys = ("symbol", "end")
    rows = kept(ml.windows(bars), "windows", 0)
    rets = B.returns(rows, *keys)
    out = ml.last_residual(rows, *keys).join(ml.order_entropy(rets, *keys), list(keys)).join(ml.own_flow(rets, *keys), list(keys))
    return out.select("symbol", F.col("end").alias("stop"), "residual", "pe", "te")


def numbered_samples(bars: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("symbol")
    ends = ml.windows(bars).select("symbol", "end").distinct()
    return ends.select("symbol", (F.row_number().over(own.orderBy("end")) - 1).alias("rn"), F.count(F.lit(1)).over(own).alias("n"))


def folds(bars: DataFrame) -> DataFrame:
    rows = ml.fold_rows(numbered_samples(bars))
    part = lambda p: F.sum((F.col("part") == p).cast("long"))
    return rows.groupBy("symbol", F.col("fold").cast("long").alias("fold")).agg(part("test").alias("test"), part("train").alias("train"), (F.max("n") - F.count(F.lit(1))).alias("purged"))


def splits(bars: DataFrame) -> DataFrame:
    rows = ml.walk_rows(numbered_samples(bars))
    part = lambda p: F.sum((F.col("part") == p).cast("long"))
    return rows.groupBy("symbol", F.col("split").cast("long").alias("split")).agg(part("train").alias("train"), part("test").alias("test"))


def each_bar_a_trade(bars: DataFrame) -> DataFrame:
    rows = B.numbered(bars).where("prev is not null").select(F.lit("each").alias("strategy"), "symbol", (F.col("close") - F.col("prev")).alias("pnl"), F.lit(1).alias("bars"))
    out = backtest.trade_stats(rows)
    return out.withColumn("valid", backtest.verdict(backtest.Config())[0]).drop("strategy", "avg_bars")


def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    return rounded(bars_table(spark, sf_dir, f"stream-{uuid.uuid4().hex}", pattern="events.parquet"))


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    rows = scores_table(spark, sf_dir, f"stream-{uuid.uuid4().hex}", pattern="events.parquet")
    return rounded(rows.withColumn("time", F.col("time").cast("timestamp_ntz")), mean=9)


def from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's last 500 bars through the pluggable source: daily bars laid out by symbol and year, of which only the last years are opened."""
    import uuid

    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    supplied.save_bars(B.daily_bars(spark, sf_dir), path)
    return rounded(B.tail(supplied.supplied_bars(spark, path, 500).where(F.col("symbol") == "R"), 500))


def strategy_suite(bars: DataFrame) -> DataFrame:
    """The catalogue with each strategy's figures by symbol."""
    names = strategies.catalogue(bars.sparkSession)
    return names.join(backtest.suite(bars, CFG), F.col("code") == F.col("strategy")).drop("strategy")


def backtest_report(bars: DataFrame) -> DataFrame:
    """By strategy and symbol: last trades, newest first, and the equity curve at about 300 points, as JSON."""
    book = kept(backtest.ledger(bars, None, CFG), "ledger")
    trades = backtest.recent_trades(book, 200).groupBy("strategy", "symbol").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "side", "entry_time", "time", "entry_price", "exit_price", "bars", "pnl", "reason"))), lambda t: t.dropFields("place"))).alias("trades"), F.count(F.lit(1)).alias("n_trades"))
    curve = rolling.downsample(book.where("kind = 'equity'").select(F.concat_ws("\u0001", "strategy", "symbol").alias("symbol"), "time", F.col("equity").alias("close")), 300)
    points = curve.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(F.struct("time", F.col("close").alias("equity"))))).alias("curve"), F.count(F.lit(1)).alias("n_points"))
    points = points.select(F.split("symbol", "\u0001")[0].alias("strategy"), F.split("symbol", "\u0001")[1].alias("symbol"), "curve", "n_points")
    return points.join(trades, ["strategy", "symbol"], "left")


CFG = backtest.Config(pip=0.01, spread=0.05)

QUERIES: dict[str, Query] = {
    "bars_daily": daily(lambda b: b, digits=9),
    "bars_hourly": lambda s, d: rounded(B.event_bars(s, d)),
    "zscore_rolling": daily(rolling.whole(rolling.zscore, 48), "symbol", "time", "mean", "std", "z"),
    "zscore_latest": daily(last_z),
    "log_returns": daily(B.returns, "symbol", "time", "r", digits=9),
    "simple_returns": daily(lambda b: B.numbered(b).where("prev is not null").select("symbol", "time", (F.col("close") / F.col("prev") - 1).alias("r")), digits=9),
    "sma20": daily(rolling.whole(rolling.sma, 20), "symbol", "time", "sma"),
    "rolling_std20": daily(rolling.whole(rolling.rolling_std, 20), "symbol", "time", "std"),
    "atr14": daily(rolling.whole(rolling.atr, 14), "symbol", "time", "atr"),
    "ewma24": daily(rolling.whole(rolling.ewma_momentum, 24), "symbol", "time", "weighted", "rv", "momentum", digits=9, momentum=6),
    "percentile_rank50": daily(rolling.whole(rolling.volume_rank, 50), "symbol", "time", "rank"),
    "rolling_half_life48": daily(rolling.whole(rolling.rolling_half_life, 48), "symbol", "time", "half_life", digits=4),
    "resample_4": daily(lambda b: B.resample(b, 4)),
    "half_life": daily(rolling.half_life),
    "return_stats": daily(rolling.return_stats),
    "max_drawdown": daily(rolling.max_drawdown, digits=9),
    "ols_fit": daily(rolling.fit_close_on_time),
    "tail_500": daily(lambda b: b, "symbol", "time", "close", tail=500),
    "downsample": daily(rolling.downsample, "symbol", "time", "close"),
    "price_change": daily(rolling.price_change),
    "bvc": daily(microstructure.classify_volume, "symbol", "time", "buy", "sell", "delta"),
    "amihud": daily(microstructure.amihud, digits=9, z=6, percentile=6),
    "kyle_lambda": daily(lambda b: microstructure.kyle(microstructure.classify_volume(b))),
    "ofi_divergence": daily(lambda b: microstructure.divergence(microstructure.classify_volume(b))),
    "volume_buckets": daily(lambda b: microstructure.volume_buckets(microstructure.classify_volume(b)).withColumn("bucket", F.col("bucket").cast("long")), "symbol", "bucket", "time", "buy", "sell", "vol"),
    "vpin": daily(lambda b: microstructure.vpin(microstructure.classify_volume(b)), z=4),
    "toxicity": daily(lambda b: microstructure.report(b, most=500), "symbol", "toxicity", "toxicity_label", "liquidity", "liquidity_label", "vpin_z", "vpin_toxic", "kyle_z", "kyle_trend", "amihud_percentile", "flow_divergence", "interpretation", digits=5, keep=True, tail=500, vpin_z=4, kyle_z=4),
    "hurst_rs": daily(lambda b: fractal.rescaled_range(B.returns(b))),
    "hurst_dfa": daily(lambda b: fractal.detrended(B.returns(b))),
    "mfdfa_spectrum": daily(lambda b: fractal.spectrum(B.returns(b)), keep=True),
    "higuchi": daily(fractal.curve_dimension),
    "fractal_gate": daily(fractal.report, keep=True, tail=500),
    "transfer_entropy_rolling": daily(lambda b: information.transfer_series(pair_of(b)).drop(*B.PAIR)),
    "cross_asset_edge": daily(lambda b: information.cross_edge(pair_of(b)).drop(*B.PAIR), keep=True, tail=500, z=5, leader_return=9),
    "permutation_entropy_rolling": daily(lambda b: information.permutation_series(B.returns(b))),
    "permutation_state": daily(lambda b: information.permutation(B.returns(b)), tail=500),
    "mutual_info_rank": daily(lambda b: information.mutual(information.information_features(b, pair_of(b))).drop(*B.PAIR), keep=True, tail=500),
    "bipower_jumps": daily(lambda b: volatility.jumps(B.returns(b)), z=4),
    "garch_fit": daily(garch_row, "symbol", "omega", "alpha", "beta", "log_lik", "vol", "long_run_vol", "regime", keep=True, omega=9, log_lik=4),
    "garch_regimes": daily(lambda b: volatility.garch_series(B.returns(b)), "symbol", "time", "vol", "regime", keep=True),
    "hmm_features": daily(volatility.hmm_features, "symbol", "time", "f0", "f1", "f2", "f3", digits=4),
    "hmm_states": daily(volatility.hmm, "symbol", "state", "probability", "log_lik", digits=4, keep=True),
    "vol_regime": daily(lambda b: volatility.report(b, most=500), keep=True, tail=500),
    "ou_fit": daily(lambda b: ols_spread(b).drop(*B.PAIR), z=5),
    "cointegration": daily(lambda b: statarb.cointegration(statarb.log_pair(b, AR)).drop(*B.PAIR), t=5, trace=5),
    "kalman_beta": daily(lambda b: statarb.kalman(statarb.log_pair(b, AR)).drop(*B.PAIR), kalman_z=5),
    "pair_reversion": daily(lambda b: statarb.cointegration(statarb.log_pair(b, PAIRS)), t=5, trace=5),
    "pair_information": daily(lambda b: information.report(b, PAIRS), *B.PAIR, "x_to_y", "y_to_x", "leader", "z", "edge", "x_pe", "y_pe", "y_pe_state", "top_feature", "top_mi", "informative", "rationale", tail=500, keep=True, z=5),
    "statarb_gate": daily(lambda b: statarb.report(b, AR), "hedge_ratio", "kalman_z", "z", "half_life", "half_life_valid", "cointegrated", "composite", "gate", digits=5, keep=True, tail=500, pairs=AR, hedge_ratio=6),
    "zscore_mr_signal": daily(lambda b: strategies.signals(b, "zscore-mr"), "symbol", "time", "action", "strength", "stop", digits=5),
    "decay_mom_signal": daily(lambda b: strategies.signals(b, "decay-mom"), "symbol", "time", "action", "strength", "stop", digits=5, stop=6),
    "vol_breakout_signal": daily(lambda b: strategies.signals(b, "vol-breakout"), "symbol", "time", "action", "strength", "stop", digits=5),
    "carry_signal": daily(lambda b: strategies.signals(b, "carry-proxy"), "symbol", "time", "action", "strength", "stop", digits=5),
    "backtest_trades": daily(lambda b: backtest.ledger(b, None, CFG).where("kind = 'trade'").drop("equity", "drawdown", "kind"), keep=True),
    "backtest_stats": daily(lambda b: backtest.suite(b, CFG), keep=True),
    "deflated_sharpe": daily(deflated),
    "uniform_draws": draws,
    "generated_bars": lambda s, d: generated(s),
    "regime_matrix": lambda s, d: B.transition_matrix(s),
    "regime_distribution": lambda s, d: backtest.regime_counts(generated(s)),
    "stream_bars_hourly": hourly_stream,
    "stream_zscores": scored_stream,
    "bars_from_source": from_source,
    "trade_stats": daily(each_bar_a_trade, expectancy=9, avg_win=9, avg_loss=9),
    "strategy_suite": daily(strategy_suite, keep=True),
    "backtest_report": daily(backtest_report, keep=True),
    "timeframe_hurst": daily(fractal.timeframes, tail=500, keep=True),
    "ml_windows": daily(model_windows, tail=2000, digits=9),
    "ml_window_measures": daily(window_measures, tail=2000),
    "ml_folds": daily(folds, tail=2000),
    "ml_splits": daily(splits, tail=2000),
    "ml_features": daily(ml.raw_features, tail=2000, keep=True),
    "ml_report": daily(ml.report, tail=2000, keep=True),
    "dispatch_context": daily(live.context, tail=500, keep=True),
    "live_base": daily(live.base_signals, "strategy", "symbol", "time", "direction", "confidence", tail=500, keep=True, digits=4),
    "te_injection": daily(lambda b: live.te_signals(information.cross_edge(information.paired(B.returns(b), PAIRS))), "symbol", "direction", "confidence", tail=500, keep=True, digits=4),
    "statarb_injection": daily(lambda b: live.statarb_signals(statarb.report(b, AR, entry=0.5, shortest=0.05)), "symbol", "direction", "confidence", tail=500, pairs=AR, keep=True, digits=4),
    "signal_report": daily(lambda b: live.signal_report(live.live_signals(b, "A", "R", with_model=False)), tail=500, keep=True),
    "market_data": daily(lambda b: rolling.market_data(b, "A", 5000), tail=1000, keep=True),
    "declared_signals": daily(lambda b: declared.signals(live.live_signals(b, "A", "R", with_model=False)).drop("created_at"), tail=500, keep=True, digits=4),
    "declared_runs": daily(lambda b: declared.runs(backtest.suite(b, CFG), b).drop("created_at"), keep=True),
    "live_signals": daily(lambda b: live.live_signals(b, "A", "R"), tail=2000, keep=True),
    "declared_trades": daily(lambda b: declared.trades(backtest.ledger(b, None, CFG)).drop("created_at"), keep=True),
    "symbol_config": lambda s, d: B.symbol_config(s),
    "strategy_catalogue": lambda s, d: strategies.catalogue(s),
}
