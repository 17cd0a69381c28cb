"""Live signals: each strategy's decision on a symbol's last bar, gated by regime, fractal structure and entropy, and signals injected from pairs and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.bars import returns, tail
from ..sources.tables import kept
from . import fractal, information, ml, statarb, volatility
from .strategies import FAMILY, STRATEGIES, signals

# The wording of the notes, as results are compared by it.
ALWAYS = "carry · regime-agnostic"
MATCHES = "matches %s regime"
SUPPRESSED = "suppressed — %s regime active"
SHUT = "HMM ok · fractal gate CLOSED (D=%s contradicts %s)"
CAUTION = " · fractal caution"
CONFIRMED = " · fractal confirmed"
PE_RANDOM = " · PE random (×%s) → exposure eliminated"
PE_STATE = " · PE %s (×%s)"
BYPASS = {"cross-asset": "cross-asset edge · HMM bypass", "stat-arb": "stat-arb · HMM bypass", "ml-ensemble": "ML ensemble · HMM-gated (bypass)"}

LOOKBACK = 500
LEAST_BARS = 205
COLUMNS = ("strategy", "name", "kind", "symbol", "direction", "confidence", "price", "time", "dispatch", "regime_active", "regime_note", "fractal_gate", "status", "status_note", "pe_multiplier", "pe_state", "effective_confidence", "cross_asset")


def base_signals(bars: DataFrame) -> DataFrame:
    """A row per strategy and symbol with LEAST_BARS bars or more: direction, confidence, price and time of the last bar, from a bounded look back."""
    rows, packed = bars, []
    base = ["symbol", "time", "open", "high", "low", "close", "volume"]
    for k, s in enumerate(STRATEGIES.values()):
        rows = signals(rows, s.code)
        mine = F.struct(F.lit(s.code).alias("strategy"), F.lit(s.name).alias("name"), F.lit(s.kind).alias("kind"), F.lit(FAMILY.get(s.kind, "always")).alias("family"), F.col("action").alias("action"), F.col("strength").cast("double").alias("confidence"))
        rows = rows.select(*base, *packed, mine.alias(f"_s{k}"))
        packed.append(f"_s{k}")
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("time", F.col("close").alias("price"), F.array(*packed).alias("all")), "time").alias("l"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_BARS)
    out = last.select("symbol", "l.time", "l.price", F.explode("l.all").alias("s")).select("symbol", "time", "price", "s.*")
    return out.withColumn("direction", F.when(F.col("action") == "enter-long", "long").when(F.col("action") == "enter-short", "short").otherwise("flat")).drop("action")


def context(bars: DataFrame) -> DataFrame:
    """A row per symbol: dispatch, regime label, probability and volatility regime, fractal gate, dimension and dispatch, entropy state and multiplier, last price."""
    vol = volatility.report(bars, most=LOOKBACK).select("symbol", "dispatch", F.col("label").alias("regime_label"), F.col("probability").alias("regime_probability"), "vol_regime")
    frac = fractal.report(bars).select("symbol", F.col("gate").alias("fractal_gate"), "dimension", F.col("dispatch").alias("fractal_dispatch"))
    pe = information.permutation(returns(bars)).select("symbol", F.col("state").alias("pe_state"), F.col("multiplier").alias("pe_multiplier"))
    last = bars.groupBy("symbol").agg(F.max("time").alias("last_time"), F.max_by("close", "time").alias("last_price"))
    out = last.join(vol, "symbol", "left").join(frac, "symbol", "left").join(pe, "symbol", "left")
    return out.fillna({"fractal_gate": "caution", "pe_state": "normal", "pe_multiplier": 1.0})


def gated(base: DataFrame, ctx: DataFrame) -> DataFrame:
    """Base signals with both gates: suppressed where the regime calls for another family, on hold where the fractal gate is closed, else
    active; entropy scales the confidence, and a random series with little of it goes on hold.
    """
    rows = base.join(ctx, "symbol", "left")
    always = F.col("family") == "always"
    active = always | F.coalesce(F.col("family") == F.col("dispatch"), F.lit(False))
    note = F.when(always, ALWAYS).when(active, F.format_string(MATCHES, "dispatch")).otherwise(F.format_string(SUPPRESSED, "dispatch"))
    rows = rows.withColumn("regime_active", active).withColumn("regime_note", note).withColumn("effective_confidence", F.col("confidence") * F.col("pe_multiplier"))
    closed = F.col("fractal_gate") == "closed"
    rows = rows.withColumn("status", F.when(~F.col("regime_active"), "suppressed").when(closed, "hold").otherwise("active"))
    why = F.when(F.col("status") == "suppressed", F.col("regime_note")).when(F.col("status") == "hold", F.format_string(SHUT, C.fixed(F.col("dimension")), "fractal_dispatch"))
    rows = rows.withColumn("status_note", why.otherwise(F.concat("regime_note", F.when(F.col("fractal_gate") == "caution", CAUTION).otherwise(CONFIRMED))))
    live, random = F.col("status") == "active", (F.col("pe_state") == "random") & (F.col("effective_confidence") < 0.15)
    more = F.when(live & random, F.format_string(PE_RANDOM, C.fixed(F.col("pe_multiplier"), 1))).when(live & (F.col("pe_state") != "normal"), F.format_string(PE_STATE, "pe_state", C.fixed(F.col("pe_multiplier")))).otherwise("")
    return rows.withColumn("status_note", F.concat("status_note", more)).withColumn("status", F.when(live & random, "hold").otherwise(F.col("status"))).withColumn("cross_asset", F.lit(False)).select(*COLUMNS)


def injected(rows: DataFrame, ctx: DataFrame, code: str, name: str, kind: str, confidence: Column, subject: str, note: Column, cross: bool = False) -> DataFrame:
    """Signals (symbol, direction and what `confidence` and `note` read) that pass the regime gate by nature and meet the other two."""
    rows = rows.withColumn("confidence", confidence).withColumn("_note", note).join(ctx, "symbol")
    rows = rows.withColumn("effective_confidence", F.col("confidence") * F.col("pe_multiplier"))
    closed, random = F.col("fractal_gate") == "closed", (F.col("pe_state") == "random") & (F.col("effective_confidence") < 0.15)
    shut = F.concat(F.lit(f"{subject} · fractal gate CLOSED"), *([] if kind == "ml-ensemble" else [F.lit(" for "), F.col("symbol")]))
    out = rows.withColumn("status", F.when(closed | random, "hold").otherwise("active")).withColumn("status_note", F.when(closed, shut).when(random, F.lit(f"{subject} · PE random → exposure eliminated")).otherwise(F.col("_note")))
    fixed = {"strategy": code, "name": name, "kind": kind, "dispatch": "mean-reversion", "regime_active": True, "regime_note": BYPASS[kind], "cross_asset": cross}
    for c, v in fixed.items():
        out = out.withColumn(c, F.lit(v))
    return out.withColumn("price", F.col("last_price")).withColumn("time", F.col("last_time")).select(*COLUMNS)


def between(x: Column, low: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(low), x))


def te_signals(edge: DataFrame) -> DataFrame:
    """(symbol, direction, confidence, z, net, leader_return) of a cross-asset edge that spikes; no row otherwise."""
    return edge.where("edge <> 'none'").select(F.col("target").alias("symbol"), F.col("edge").alias("direction"), between((F.col("z") - 1) / 3, 0.5).alias("confidence"), "z", "net", "leader", "leader_return")


def statarb_signals(rep: DataFrame) -> DataFrame:
    """(symbol, direction, confidence, ...) of each open pair: long spreads buy y, short ones sell x; no row otherwise."""
    rows = rep.where("composite <> 'none' and gate = 'open'")
    up = F.col("composite") == "long-spread"
    return rows.select(F.when(up, F.col("y_symbol")).otherwise(F.col("x_symbol")).alias("symbol"), F.when(up, "long").otherwise("short").alias("direction"), between((F.abs("z") - 1) / 3, 0.5).alias("confidence"), "composite", "z", "half_life", "kalman_z", "hedge_ratio")


def ml_signals(rep: DataFrame, symbol: str) -> DataFrame:
    rows = rep.where((F.col("symbol") == symbol) & (F.col("ensemble.direction") != "flat") & F.col("validation.passes"))
    return rows.select("symbol", F.col("ensemble.direction").alias("direction"), between(F.col("ensemble.confidence"), 0.4).alias("confidence"), F.col("ensemble.dominant").alias("dominant"), F.col("validation.oos_sharpe").alias("oos_sharpe"), F.col("validation.deflated").alias("deflated"), F.col("pruning").alias("pruning"))


def live_signals(bars: DataFrame, x: str, y: str, with_model: bool = True) -> DataFrame:
    """All signals of the last bar: every strategy on every symbol, the pair's transfer-entropy edge and spread, and the model of symbol x."""
    recent = kept(tail(bars, LOOKBACK), "recent")
    ctx = kept(context(recent), "context")
    out = gated(base_signals(recent), ctx)
    edge = te_signals(information.cross_edge(information.paired(returns(recent), [(x, y)])))
    leader = F.when(F.col("leader") == "x", x).otherwise(y)
    said = F.concat(F.lit("TE spike z="), C.fixed(F.col("z")), F.lit(" · "), leader, F.when(F.col("leader_return") >= 0, " rising").otherwise(" falling"), F.lit(" → "), F.col("symbol"), F.lit(" "), F.col("direction"))
    out = out.unionByName(injected(edge, ctx, "cross-asset-te", "Cross-Asset Transfer Entropy Edge", "cross-asset", F.col("confidence"), "TE edge", said, True))
    spread = statarb_signals(statarb.report(recent, [(x, y)]))
    said = F.concat(F.lit("stat-arb spread "), F.col("composite"), F.lit(" (OU z="), C.fixed(F.col("z")), F.lit(", HL="), C.fixed(F.col("half_life"), 1), F.lit("b, Kalman z="), C.fixed(F.col("kalman_z")), F.lit(")"))
    out = out.unionByName(injected(spread, ctx, "stat-arb-ou", "Stat-Arb Spread Reversion (OU + Kalman)", "stat-arb", F.col("confidence"), "stat-arb", said))
    if with_model:
        model = ml_signals(ml.report(bars.where(F.col("symbol") == x)), x)
        said = F.concat(F.lit("ML ensemble "), F.col("direction"), F.lit(" (dom="), F.col("dominant"), F.lit(", conf="), C.fixed(F.col("confidence")), F.lit(", OOS Sharpe="), C.fixed(F.col("oos_sharpe")), F.lit(", deflated="), C.fixed(F.col("deflated")), F.when(F.col("pruning"), ", pruned").otherwise(""), F.lit(")"))
        out = out.unionByName(injected(model, ctx, "ml-ensemble", "ML Ensemble (GBT+Ridge+LSTM, HMM-gated)", "ml-ensemble", F.col("confidence"), "ML ensemble", said))
    return out


def signal_report(found: DataFrame) -> DataFrame:
    """One row: number of signals, of active and of valid directions, and all of them as JSON, by symbol and strategy."""
    rows = F.array_sort(F.collect_list(F.struct("symbol", "strategy", F.to_json(F.struct(*COLUMNS)).alias("json"))))
    return found.agg(F.count(F.lit(1)).alias("signals"), F.sum((F.col("status") == "active").cast("long")).alias("active"), F.sum((F.col("direction") != "flat").cast("long")).alias("directed"), F.transform(rows, lambda s: s["json"]).alias("rows"))
