"""The queries in DuckDB's SQL, for comparison."""

from __future__ import annotations

BARS = """
bars AS (SELECT l_returnflag AS symbol, l_shipdate AS time, first(p ORDER BY {o}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {o}) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity > 0) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
rets AS (SELECT symbol, time, high, low, close, prev, volume, rn - 1 AS rn, ln(close / prev) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM b WHERE prev IS NOT NULL)""".format(o="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax")
TAIL = BARS.replace("bars AS (", "all_bars AS (", 1).replace("\nb AS (", "\nbars AS (SELECT * FROM all_bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 500),\nb AS (", 1)
INF = "'inf'::DOUBLE"


def cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"{t} * (0.3193815::DOUBLE + {t} * (-0.3565638::DOUBLE + {t} * (1.781478::DOUBLE + {t} * (-1.821256::DOUBLE + {t} * 1.330274::DOUBLE))))"
    p = f"(0.3989423::DOUBLE * exp(-{z} * {z} / 2) * {poly})"
    return f"(CASE WHEN {z} > 0 THEN 1 - {p} ELSE {p} END)"


def last(n: int, keys: str = "symbol") -> str:
    return f"(PARTITION BY {keys} ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def life(slope: str) -> str:
    return f"(CASE WHEN -({slope}) > 0 AND -({slope}) < 1 THEN -ln(2) / ln(1 + ({slope})) ELSE {INF} END)"


def fold(values: str, alpha: str) -> str:
    """Exponentially weighted mean of a list by its closed weights."""
    a = f"({alpha})::DOUBLE"
    return f"list_sum([{values}[i] * (CASE WHEN i = 1 THEN pow(1 - {a}, len({values}) - 1) ELSE {a} * pow(1 - {a}, len({values}) - i) END) FOR i IN range(1, len({values}) + 1)])"


FLOW = f"""
f0 AS (SELECT *, close - prev AS dp FROM b),
f1 AS (SELECT *, greatest(coalesce(stddev_samp(dp) OVER {last(20)}, 0), 1e-9::DOUBLE) AS sigma FROM f0),
f2 AS (SELECT *, CASE WHEN rn = 0 THEN 0.5::DOUBLE ELSE {cdf('(dp / sigma)')} END AS up FROM f1),
flow AS (SELECT *, volume * up AS buy, volume * (1 - up) AS sell, CASE WHEN rn = 0 THEN 0::DOUBLE ELSE volume * up - volume * (1 - up) END AS delta FROM f2)"""


def latest(source: str, value: str, order: str, n: int, keys: str = "symbol") -> str:
    return f"""(SELECT {keys}, max(v) FILTER (d = 1) AS value, avg(v) AS mean, CASE WHEN coalesce(stddev_samp(v), 0) = 0 THEN 1e-9::DOUBLE ELSE stddev_samp(v) END AS std,
  avg(CASE WHEN v <= lv THEN 1::DOUBLE ELSE 0 END) AS percentile, coalesce(avg(v) FILTER (nn - d < nn // 2), 0) AS h1, coalesce(avg(v) FILTER (nn - d >= nn // 2), 0) AS h2
  FROM (SELECT *, max(v) FILTER (d = 1) OVER (PARTITION BY {keys}) AS lv, count(*) OVER (PARTITION BY {keys}) AS nn FROM
    (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) AS d FROM {source}) WHERE d <= {n}) GROUP BY {keys})"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SQL: dict[str, str] = {}
SQL["bars_daily"] = f"WITH {BARS} SELECT symbol, time, {', '.join(f'round({c}, 9) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars"
SQL["bars_hourly"] = """SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS time, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
  round(last(value ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY 1, 2"""
Z = f"z0 AS (SELECT *, avg(close) OVER {last(48)} AS mean, coalesce(stddev_samp(close) OVER {last(48)}, 0) AS std FROM b), z AS (SELECT *, CASE WHEN std = 0 THEN 0 ELSE (close - mean) / std END AS z FROM z0)"
SQL["zscore_rolling"] = f"WITH {BARS}, {Z} SELECT symbol, time, {r6('mean', 'std', 'z')} FROM z"
SQL["zscore_latest"] = f"WITH {BARS}, {Z} SELECT symbol, time, {r6('close', 'mean', 'std', 'z')} FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1"
SQL["log_returns"] = f"WITH {BARS} SELECT symbol, time, round(r, 9) AS r FROM rets"
SQL["simple_returns"] = f"WITH {BARS} SELECT symbol, time, round(close / prev - 1, 9) AS r FROM b WHERE prev IS NOT NULL"
SQL["sma20"] = f"WITH {BARS} SELECT symbol, time, round(CASE WHEN rn >= 19 THEN avg(close) OVER {last(20)} END, 6) AS sma FROM b"
SQL["rolling_std20"] = f"WITH {BARS} SELECT symbol, time, round(CASE WHEN rn >= 19 THEN stddev_samp(close) OVER {last(20)} END, 6) AS std FROM b"
SQL["atr14"] = f"WITH {BARS} SELECT symbol, time, round(CASE WHEN rn >= 14 THEN avg(CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END) OVER {last(14)} END, 6) AS atr FROM b"
MOM = f"""m0 AS (SELECT *, close / prev - 1 AS s FROM b), m1 AS (SELECT *, list(s) FILTER (s IS NOT NULL) OVER {last(24)} AS rs, coalesce(stddev_samp(s) OVER {last(24)}, 0) AS rv FROM m0),
mom AS (SELECT *, CASE WHEN rn >= 24 THEN {fold('rs', '0.18')} END AS weighted FROM m1)"""
SQL["ewma24"] = f"WITH {BARS}, {MOM} SELECT symbol, time, round(weighted, 9) AS weighted, round(rv, 9) AS rv, round(weighted / nullif(rv, 0), 6) AS momentum FROM mom"
SQL["percentile_rank50"] = f"WITH {BARS}, v AS (SELECT *, list(volume) OVER {last(50)} AS vs FROM b) SELECT symbol, time, round(CASE WHEN rn >= 49 THEN len(list_filter(vs, lambda x: x <= volume)) / len(vs)::DOUBLE END, 6) AS rank FROM v"
SQL["rolling_half_life48"] = f"WITH {BARS}, h AS (SELECT *, coalesce(regr_slope(close - prev, prev) OVER {last(47)}, 0) AS slope FROM b) SELECT symbol, time, round(CASE WHEN rn >= 47 THEN {life('slope')} END, 4) AS half_life FROM h"
SQL["resample_4"] = f"""WITH {BARS} SELECT symbol, rn // 4 AS block, min(time) AS time, round(first(open ORDER BY time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY time), 6) AS close, round(sum(volume), 6) AS volume FROM b GROUP BY 1, 2"""
SQL["half_life"] = f"WITH {BARS}, s AS (SELECT symbol, coalesce(regr_slope(close - prev, prev), 0) AS slope FROM b GROUP BY 1) SELECT symbol, round({life('slope')}, 6) AS half_life FROM s"
SQL["return_stats"] = f"""WITH {BARS}, s AS (SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(r) * sqrt(count(*)) / stddev_samp(r) AS t, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) / sqrt(avg(r * r) FILTER (r < 0)) * sqrt(252) AS sortino FROM rets GROUP BY 1)
SELECT symbol, n, {r6('mean', 'std', 't', 'sharpe', 'sortino')}, round(2 * (1 - {cdf('abs(t)')}), 6) AS p FROM s"""
SQL["max_drawdown"] = f"""WITH {BARS}, d AS (SELECT symbol, rn, close, max(close) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM b),
e AS (SELECT *, (peak - close) / peak AS fall, min(rn) OVER (PARTITION BY symbol, peak) AS top FROM d)
SELECT symbol, round(fall, 9) AS max_drawdown, top AS peak_at, rn AS trough_at FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fall DESC, rn) = 1"""
SQL["ols_fit"] = f"WITH {BARS} SELECT symbol, round(regr_slope(close, rn), 6) AS slope, round(regr_intercept(close, rn), 6) AS intercept, round(regr_r2(close, rn), 6) AS r2 FROM b GROUP BY 1"
SQL["tail_500"] = f"WITH {TAIL} SELECT symbol, time, round(close, 6) AS close FROM bars"
SQL["downsample"] = f"WITH {BARS} SELECT symbol, time, round(close, 6) AS close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b) WHERE rn % greatest(1, n // 300) = 0"
SQL["price_change"] = f"WITH {BARS} SELECT symbol, time, round(close, 6) AS close, round(close - prev, 6) AS change, round((close - prev) / prev * 100, 6) AS change_pct FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1"
SQL["bvc"] = f"WITH {BARS}, {FLOW} SELECT symbol, time, {r6('buy', 'sell', 'delta')} FROM flow"
SQL["amihud"] = f"WITH {BARS}, a AS (SELECT symbol, time, abs(close / prev - 1) / greatest(volume, 1) AS illiq FROM b WHERE prev IS NOT NULL) SELECT symbol, round(value, 9) AS illiq, round(mean, 9) AS mean, round(std, 9) AS std, round((value - mean) / std, 6) AS z, round(percentile, 6) AS percentile FROM {latest('a', 'illiq', 'time', 100)}"
KYLE = f"""k0 AS (SELECT *, coalesce(dp, 0) AS y FROM flow), k1 AS (SELECT symbol, time, rn, sum(delta) OVER w AS sx, sum(delta * delta) OVER w AS sxx, sum(y) OVER w - first(y) OVER w AS sy, sum(delta * y) OVER w - first(delta * y) OVER w AS sxy FROM k0 WINDOW w AS {last(101)}),
kyle AS (SELECT symbol, time, CASE WHEN 101 * sxx - sx * sx = 0 THEN 0 ELSE abs((101 * sxy - sx * sy) / (101 * sxx - sx * sx)) END AS impact FROM k1 WHERE rn >= 100)"""
TREND = "CASE WHEN h2 > h1 * 1.15 THEN 'rising' WHEN h2 < h1 * 0.85 THEN 'falling' ELSE 'stable' END"
SQL["kyle_lambda"] = f"WITH {BARS}, {FLOW}, {KYLE} SELECT symbol, {r6('impact')}, {r6('mean', 'std', 'z')}, trend FROM (SELECT symbol, value AS impact, mean, std, (value - mean) / std AS z, {TREND} AS trend FROM {latest('kyle', 'impact', 'time', 50)})"
OFI = """o0 AS (SELECT symbol, time, close, delta, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS d FROM flow), o1 AS (SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY time) AS cum, count(*) OVER (PARTITION BY symbol) AS nn FROM o0 WHERE d <= 100),
o2 AS (SELECT symbol, max(cum) FILTER (d = 1) AS cum_delta, avg(close) FILTER (nn - d < nn // 2) AS p1, avg(close) FILTER (nn - d >= nn // 2) AS p2, avg(cum) FILTER (nn - d < nn // 2) AS d1, avg(cum) FILTER (nn - d >= nn // 2) AS d2 FROM o1 GROUP BY 1),
o3 AS (SELECT *, CASE WHEN p2 > p1 * 1.0005 THEN 'up' WHEN p2 < p1 * 0.9995 THEN 'down' ELSE 'flat' END AS price_trend, CASE WHEN d2 > d1 THEN 'up' WHEN d2 < d1 THEN 'down' ELSE 'flat' END AS delta_trend FROM o2),
ofi AS (SELECT *, CASE WHEN price_trend = 'up' AND delta_trend = 'down' THEN 'bearish' WHEN price_trend = 'down' AND delta_trend = 'up' THEN 'bullish' ELSE 'none' END AS divergence,
  CASE WHEN (price_trend = 'up' AND delta_trend = 'down') OR (price_trend = 'down' AND delta_trend = 'up') THEN least(1, (abs(p2 - p1) / p1 * 100 + abs(d2 - d1) / (abs(d1) + 1)) / 2) ELSE 0 END AS strength FROM o3)"""
SQL["ofi_divergence"] = f"WITH {BARS}, {FLOW}, {OFI} SELECT symbol, round(cum_delta, 6) AS cum_delta, price_trend, delta_trend, divergence, round(strength, 6) AS strength FROM ofi"
BUCKETS = """q AS (SELECT symbol, rn, time, buy, sell, volume, count(*) OVER (PARTITION BY symbol) AS nn FROM flow),
size AS (SELECT symbol, list_sort(list(volume))[(max(nn) // 2) + 1] AS size FROM q GROUP BY 1),
walk(symbol, rn, bucket, t0, time, buy, sell, vol, closed) AS (
  SELECT q.symbol, 0::BIGINT, 0::BIGINT, q.time, q.time, q.buy, q.sell, q.volume, q.volume >= size.size FROM q JOIN size USING (symbol) WHERE rn = 0
  UNION ALL SELECT q.symbol, q.rn, CASE WHEN w.closed THEN w.bucket + 1 ELSE w.bucket END, CASE WHEN w.closed THEN w.time ELSE w.t0 END, q.time,
    CASE WHEN w.closed THEN q.buy ELSE w.buy + q.buy END, CASE WHEN w.closed THEN q.sell ELSE w.sell + q.sell END, CASE WHEN w.closed THEN q.volume ELSE w.vol + q.volume END,
    CASE WHEN w.closed THEN q.volume ELSE w.vol + q.volume END >= size.size FROM walk w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn + 1 JOIN size ON size.symbol = q.symbol),
buckets AS (SELECT symbol, bucket, t0 AS time, buy, sell, vol FROM walk QUALIFY row_number() OVER (PARTITION BY symbol, bucket ORDER BY rn DESC) = 1)"""
SQL["volume_buckets"] = f"WITH RECURSIVE {BARS}, {FLOW}, {BUCKETS} SELECT symbol, bucket, time, {r6('buy', 'sell', 'vol')} FROM buckets"
VPIN = """vp AS (SELECT symbol, bucket, sum(abs(buy - sell)) OVER w / sum(vol) OVER w AS vpin FROM buckets WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
SQL["vpin"] = f"WITH RECURSIVE {BARS}, {FLOW}, {BUCKETS}, {VPIN} SELECT symbol, round(value, 6) AS vpin, {r6('mean', 'std')}, round((value - mean) / std, 4) AS z, (value - mean) / std > 2 AS toxic FROM {latest('vp', 'vpin', 'bucket', 100)}"
AM = "am AS (SELECT symbol, time, abs(close / prev - 1) / greatest(volume, 1) AS illiq FROM b WHERE prev IS NOT NULL)"
CL = "greatest(0, least(1, ({} + 2) / 4))"
TOXIC = f"""{TAIL}, {FLOW}, {BUCKETS}, {VPIN}, {KYLE}, {OFI}, {AM},
t AS (SELECT v.symbol, (v.value - v.mean) / v.std AS vz, (k.value - k.mean) / k.std AS kz, {TREND.replace('h1', 'k.h1').replace('h2', 'k.h2')} AS trend, a.percentile AS ap, o.divergence AS dv, o.strength AS os
  FROM {latest('vp', 'vpin', 'bucket', 100)} v JOIN {latest('kyle', 'impact', 'time', 50)} k USING (symbol) JOIN {latest('am', 'illiq', 'time', 100)} a USING (symbol) JOIN ofi o USING (symbol)),
u AS (SELECT *, 0.35::DOUBLE * {CL.format('vz')} + 0.25::DOUBLE * {CL.format('kz')} + 0.2::DOUBLE * ap + 0.2::DOUBLE * os AS tox, 0.6::DOUBLE * (1 - ap) + 0.4::DOUBLE * (1 - {CL.format('kz')}) AS liq FROM t),
l AS (SELECT *, CASE WHEN tox > 0.75 THEN 'extreme' WHEN tox > 0.6 THEN 'toxic' WHEN tox > 0.4 THEN 'elevated' ELSE 'calm' END AS tl, CASE WHEN liq > 0.66 THEN 'deep' WHEN liq > 0.33 THEN 'normal' ELSE 'thin' END AS ll,
  concat_ws('; ', CASE WHEN vz > 2 THEN 'one-sided volume ' || printf('%.2f', vz) || ' deviations above its norm' END,
    CASE trend WHEN 'rising' THEN 'each unit of flow moves the price more than before' WHEN 'falling' THEN 'each unit of flow moves the price less than before' END,
    CASE WHEN ap > 0.8 THEN 'less liquid than in ' || printf('%.0f', ap * 100) || ' of 100 recent bars' END,
    CASE dv WHEN 'bearish' THEN 'sellers behind a rising price' WHEN 'bullish' THEN 'buyers behind a falling price' END) AS said FROM u)"""
SQL["toxicity"] = f"""WITH RECURSIVE {TOXIC} SELECT symbol, round(tox, 5) AS toxicity, tl AS toxicity_label, round(liq, 5) AS liquidity, ll AS liquidity_label, round(vz, 4) AS vpin_z, vz > 2 AS vpin_toxic, round(kz, 4) AS kyle_z, trend AS kyle_trend, round(ap, 5) AS amihud_percentile, dv AS flow_divergence,
  CASE WHEN said = '' THEN 'nothing unusual: toxicity ' || tl || ', liquidity ' || ll ELSE said END AS interpretation FROM l"""
TAUS = "SELECT unnest([{}]) AS tau"


def blocks(value: str, top: int = 1 << 19) -> str:
    from ..operators.fractal import scales

    taus = ", ".join(map(str, scales(top)))
    return f"blk AS (SELECT symbol, rn, {value}, n, tau, rn // tau AS block FROM src JOIN ({TAUS.format(taus)}) ON tau <= n // 2 WHERE (rn // tau + 1) * tau <= n)"


def fit(points: str, y: str, keys: str = "symbol") -> str:
    return f"SELECT {keys}, round(greatest(0, least(1, regr_slope(ln({y}), ln(tau)))), 6) AS h, round(regr_r2(ln({y}), ln(tau)), 6) AS r2 FROM {points} GROUP BY {keys}"


RS = f"""src AS (SELECT * FROM rets), {blocks('r')}, x AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol, tau, block) AS dev FROM blk),
y AS (SELECT *, sum(dev) OVER (PARTITION BY symbol, tau, block ORDER BY rn) AS cum FROM x), e AS (SELECT symbol, tau, block, max(cum) - min(cum) AS rng, sqrt(sum(dev * dev) / tau) AS sd FROM y GROUP BY 1, 2, 3),
pts AS (SELECT symbol, tau, avg(rng / sd) AS f FROM e WHERE sd > 0 GROUP BY 1, 2)"""
SQL["hurst_rs"] = f"WITH {BARS}, {RS} {fit('pts', 'f')}"
PROFILE = f"""dm AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol) AS d FROM rets), src AS (SELECT symbol, rn, n, sum(d) OVER (PARTITION BY symbol ORDER BY rn) AS y FROM dm), {blocks('y')},
f2 AS (SELECT symbol, tau, block, greatest(regr_syy(y, rn) - regr_sxy(y, rn) * regr_sxy(y, rn) / regr_sxx(y, rn), 0) / tau AS f2 FROM blk GROUP BY 1, 2, 3)"""
SQL["hurst_dfa"] = f"WITH {BARS}, {PROFILE}, pts AS (SELECT symbol, tau, avg(sqrt(f2)) AS f FROM f2 GROUP BY 1, 2) {fit('pts', 'f')}"
MF = f"{PROFILE}, mq AS (SELECT symbol, tau, q, avg(CASE WHEN q <> 0 THEN pow(f2, q / 2) ELSE ln(f2) / 2 END) AS m FROM f2, (SELECT unnest([-4, -2, -1, 0, 1, 2, 4])::DOUBLE AS q) WHERE f2 > 0 GROUP BY 1, 2, 3), pts AS (SELECT symbol, tau, q, CASE WHEN q <> 0 THEN pow(m, 1 / nullif(q, 0)) ELSE exp(m) END AS f FROM mq)"
SQL["mfdfa_spectrum"] = f"WITH {BARS}, {MF} SELECT symbol, q, h FROM ({fit('pts', 'f', 'symbol, q')})"
HIG = """hk AS (SELECT symbol, rn, n2, k, rn % k AS m, d FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol, k ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY symbol, k) AS n2, k, abs(lead(close, k) OVER (PARTITION BY symbol, k ORDER BY time) - close) AS d FROM b, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k))),
hc AS (SELECT symbol, n2, k, m, coalesce(sum(d), 0) * (n2 - 1) / ((n2 - m) // k * k) / ((n2 - m - 1) // k) AS l FROM hk GROUP BY 1, 2, 3, 4), hl AS (SELECT symbol, k, sum(l) / k AS l FROM hc GROUP BY 1, 2),
hig AS (SELECT symbol, greatest(1, least(2, regr_slope(ln(l), ln(1 / k::DOUBLE)))) AS dimension, regr_r2(ln(l), ln(1 / k::DOUBLE)) AS r2 FROM hl GROUP BY 1)"""
SQL["higuchi"] = f"WITH {BARS}, {HIG} SELECT symbol, round(dimension, 6) AS dimension, round(r2, 6) AS r2, CASE WHEN dimension < 1.4 THEN 'high' WHEN dimension > 1.7 THEN 'low' ELSE 'medium' END AS quality FROM hig"


def exponent(points: str, y: str, keys: str = "symbol", name: str = "h") -> str:
    """fit() before it is rounded."""
    return f"SELECT {keys}, greatest(0, least(1, regr_slope(ln({y}), ln(tau)))) AS {name} FROM {points} GROUP BY {keys}"


# a timeframe's series is a symbol of its own here, so the parts above serve it
FRAMES = f"""fr AS (SELECT symbol || '|' || tf AS symbol, min(time) AS time, last(close ORDER BY time) AS close FROM b, (VALUES ('1H', 1), ('4H', 4), ('1D', 24)) f(tf, factor) GROUP BY b.symbol, tf, rn // factor),
fp AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev FROM fr),
fx AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS rn, ln(close / prev) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM fp WHERE prev IS NOT NULL QUALIFY n >= 32),
hr AS (WITH rets AS (SELECT * FROM fx), {RS} {exponent('pts', 'f', name='rs')}), hd AS (WITH rets AS (SELECT * FROM fx), {PROFILE}, pts AS (SELECT symbol, tau, avg(sqrt(f2)) AS f FROM f2 GROUP BY 1, 2) {exponent('pts', 'f', name='dfa')}),
frames AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS timeframe, list_position(['1H', '4H', '1D'], split_part(symbol, '|', 2)) - 1 AS place, rs, dfa, (rs + dfa) / 2 AS h FROM hr JOIN hd USING (symbol))"""
SQL["timeframe_hurst"] = f"""WITH {TAIL}, {FRAMES} SELECT symbol, timeframe, place::INT AS place, {r6('rs', 'dfa', 'h')}, CASE WHEN h > 0.55 THEN 'persistent' WHEN h < 0.45 THEN 'anti-persistent' ELSE 'random-walk' END AS regime,
  round(abs(h - first(h) OVER (PARTITION BY symbol ORDER BY place)), 6) AS dislocation FROM frames"""
SQL["fractal_gate"] = f"""WITH {TAIL}, {FRAMES}, {HIG}, sq AS (WITH {MF} {exponent('pts', 'f', 'symbol, q')}),
cx AS (SELECT symbol, max(h) - min(h) AS delta_h, max(h) FILTER (q = 2) AS h2 FROM sq GROUP BY 1), mh AS (SELECT symbol, avg(h) AS mean_h FROM frames GROUP BY 1), lt AS (SELECT symbol, max(time) AS time FROM bars GROUP BY 1),
wd AS (SELECT a.symbol, abs(a.h - c.h) AS far, a.timeframe || ' vs ' || c.timeframe AS label FROM frames a JOIN frames c ON a.symbol = c.symbol AND a.place < c.place QUALIFY row_number() OVER (PARTITION BY a.symbol ORDER BY far DESC, a.place, c.place) = 1),
ga AS (SELECT symbol, time, mean_h, coalesce(far, 0) AS far, CASE WHEN far > 0 THEN label ELSE '-' END AS label, delta_h, h2, CASE WHEN delta_h < 0.15 THEN 'simple' WHEN delta_h > 0.4 THEN 'complex' ELSE 'moderate' END AS complexity, dimension,
  CASE WHEN dimension < 1.4 THEN 'high' WHEN dimension > 1.7 THEN 'low' ELSE 'medium' END AS quality, CASE WHEN mean_h > 0.55 THEN 'momentum' WHEN mean_h < 0.45 THEN 'mean-reversion' ELSE 'reduce-exposure' END AS dispatch
  FROM lt JOIN mh USING (symbol) JOIN cx USING (symbol) JOIN hig USING (symbol) LEFT JOIN wd USING (symbol)),
gb AS (SELECT *, CASE WHEN dispatch = 'reduce-exposure' THEN 'closed' WHEN quality = 'medium' THEN 'caution' WHEN (mean_h > 0.55 AND dimension < 1.4) OR (mean_h < 0.45 AND dimension > 1.7) THEN 'open' ELSE 'closed' END AS plain FROM ga)
SELECT symbol, time, round(mean_h, 6) AS mean_h, round(far, 6) AS max_dislocation, label AS dislocated, {r6('delta_h', 'h2')}, complexity, {r6('dimension')}, quality, dispatch,
  CASE WHEN delta_h > 0.5 THEN 'closed' WHEN delta_h > 0.4 AND plain = 'open' THEN 'caution' ELSE plain END AS gate FROM gb"""


def pair(x: str, y: str, table: str = "rets", value: str = "r") -> str:
    return f"pr AS (SELECT a.time, a.{value} AS x, c.{value} AS y, row_number() OVER (ORDER BY a.time) - 1 AS rn, count(*) OVER () AS n FROM {table} a JOIN {table} c ON a.time = c.time AND a.symbol = '{x}' AND c.symbol = '{y}')"


def binned(v: str, bins: int) -> str:
    return f"least({bins - 1}, greatest(0, floor(({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) * {bins})))::INT"


def te(a: str, b: str, c: str, name: str) -> str:
    return f"{name} AS (SELECT end_at, greatest(0, sum(c3 / n * log2((c3 / cbc) / (cab / cb)))) AS te FROM (SELECT end_at, c3::DOUBLE AS c3, sum(c3) OVER (PARTITION BY end_at, b, c)::DOUBLE AS cbc, sum(c3) OVER (PARTITION BY end_at, a, b)::DOUBLE AS cab, sum(c3) OVER (PARTITION BY end_at, b)::DOUBLE AS cb, sum(c3) OVER (PARTITION BY end_at)::DOUBLE AS n FROM (SELECT end_at, {a} AS a, {b} AS b, {c} AS c, count(*) AS c3 FROM win GROUP BY 1, 2, 3, 4)) GROUP BY 1)"


TE = f"""{pair('A', 'R')}, bn AS (SELECT rn, n, {binned('x', 4)} AS xq, {binned('y', 4)} AS yq FROM pr), nx AS (SELECT *, lead(xq) OVER (ORDER BY rn) AS xn, lead(yq) OVER (ORDER BY rn) AS yn FROM bn),
win AS (SELECT nx.*, w.end_at FROM nx JOIN (SELECT unnest(range(120, (SELECT max(n) FROM pr))) AS end_at) w ON nx.rn BETWEEN w.end_at - 120 AND w.end_at - 2),
{te('yn', 'yq', 'xq', 'fw')}, {te('xn', 'xq', 'yq', 'bw')}, ts AS (SELECT end_at, fw.te AS x_to_y, bw.te AS y_to_x FROM fw JOIN bw USING (end_at))"""
SQL["transfer_entropy_rolling"] = f"WITH {BARS}, {TE} SELECT end_at, {r6('x_to_y', 'y_to_x')} FROM ts"
EDGE = """tl AS (SELECT last(x_to_y ORDER BY end_at) AS x_to_y, last(y_to_x ORDER BY end_at) AS y_to_x, avg(x_to_y) AS mx, avg(y_to_x) AS my, stddev_samp(x_to_y) AS sx, stddev_samp(y_to_x) AS sy FROM ts),
tz AS (SELECT *, x_to_y - y_to_x AS net, CASE WHEN x_to_y >= y_to_x THEN (x_to_y - mx) / sx ELSE (y_to_x - my) / sy END AS z FROM tl),
edge AS (SELECT *, CASE WHEN abs(net) < 0.02 THEN 'balanced' WHEN net > 0 THEN 'x' ELSE 'y' END AS leader, z > 2 AS spike, (SELECT last(x ORDER BY rn) FROM pr) AS lx, (SELECT last(y ORDER BY rn) FROM pr) AS ly FROM tz)"""
SQL["cross_asset_edge"] = f"""WITH {TAIL}, {TE}, {EDGE} SELECT {r6('x_to_y', 'y_to_x', 'net')}, leader, round(z, 5) AS z, spike, CASE WHEN spike AND leader = 'x' THEN 'R' WHEN spike AND leader = 'y' THEN 'A' END AS target,
  CASE WHEN spike AND leader <> 'balanced' THEN CASE WHEN CASE WHEN leader = 'x' THEN lx ELSE ly END > 0 THEN 'long' ELSE 'short' END ELSE 'none' END AS edge, round(CASE WHEN leader = 'x' THEN lx ELSE ly END, 9) AS leader_return FROM edge"""
PE = """p0 AS (SELECT symbol, rn, n, r AS r0, lead(r, 1) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(r, 3) OVER w AS r3 FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
p1 AS (SELECT symbol, rn, n, ((r1 < r0)::INT + (r2 < r0)::INT + (r3 < r0)::INT) * 64 + ((r0 <= r1)::INT + (r2 < r1)::INT + (r3 < r1)::INT) * 16 + ((r0 <= r2)::INT + (r1 <= r2)::INT + (r3 < r2)::INT) * 4 + ((r0 <= r3)::INT + (r1 <= r3)::INT + (r2 <= r3)::INT) AS p FROM p0 WHERE r3 IS NOT NULL),
p2 AS (SELECT symbol, end_at, p, count(*) AS c FROM p1 JOIN (SELECT unnest(range(100, (SELECT max(n) + 1 FROM rets))) AS end_at) e ON end_at <= n AND rn BETWEEN end_at - 100 AND end_at - 4 GROUP BY 1, 2, 3),
pe AS (SELECT symbol, end_at, -sum(c / 97 * log2(c / 97::DOUBLE)) / log2(24) AS pe FROM p2 GROUP BY 1, 2)"""
SQL["permutation_entropy_rolling"] = f"WITH {BARS}, {PE} SELECT symbol, end_at, round(pe, 6) AS pe FROM pe"
SQL["permutation_state"] = f"""WITH {TAIL}, {PE}, l AS (SELECT * FROM {latest('pe', 'pe', 'end_at', 100)}) SELECT symbol, round(value, 6) AS pe, round(mean, 6) AS mean, round(percentile, 6) AS percentile,
  CASE WHEN percentile < 0.2 THEN 'predictable' WHEN percentile > 0.8 THEN 'random' ELSE 'normal' END AS state, CASE WHEN percentile < 0.2 THEN 1.25::DOUBLE WHEN percentile > 0.8 THEN 0.5 ELSE 1 END AS multiplier FROM l"""
MI = f"""{pair('A', 'R')}, mf AS (SELECT pr.rn, x, y, lead(y) OVER (ORDER BY pr.rn) AS nxt, sqrt(sum(y * y) OVER (ORDER BY pr.rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20) AS vol, (high - low) / close AS spread, volume FROM pr JOIN bars ON bars.time = pr.time AND bars.symbol = 'R'),
ml AS (SELECT f.feature, f.value, nxt AS target FROM (SELECT *, unnest([{{'feature': 'log-return', 'value': y}}, {{'feature': 'realized-vol', 'value': vol}}, {{'feature': 'leader-return', 'value': x}}, {{'feature': 'spread-proxy', 'value': spread}}, {{'feature': 'volume', 'value': volume}}]) AS f FROM mf WHERE rn >= 20 AND nxt IS NOT NULL)),
mq AS (SELECT feature, least(4, floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 5)) AS x, least(4, floor((target - min(target) OVER w) / (max(target) OVER w - min(target) OVER w) * 5)) AS y FROM ml WINDOW w AS (PARTITION BY feature)),
mc AS (SELECT feature, x, y, count(*)::DOUBLE AS c FROM mq GROUP BY 1, 2, 3), mm AS (SELECT *, sum(c) OVER (PARTITION BY feature, x) AS cx, sum(c) OVER (PARTITION BY feature, y) AS cy, sum(c) OVER (PARTITION BY feature) AS n FROM mc),
mi AS (SELECT feature, greatest(0, sum(c / n * log2(c * n / (cx * cy)))) AS mi FROM mm GROUP BY 1)"""
SQL["mutual_info_rank"] = f"WITH {TAIL}, {MI} SELECT feature, round(mi, 6) AS mi, round(1 - (row_number() OVER (ORDER BY mi DESC, feature) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS rank, mi > 0.05 AS informative FROM mi"
JUMP = """j0 AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY symbol ORDER BY rn)) AS p FROM rets), j1 AS (SELECT symbol, rn, time, sum(r * r) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS rv, pi() / 2 * sum(p) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) / 24 AS bv FROM j0),
js AS (SELECT *, greatest(rv - bv, 0) AS jump, CASE WHEN rv > 0 THEN greatest(rv - bv, 0) / rv ELSE 0 END AS ratio FROM j1 WHERE rn >= 25)"""
SQL["bipower_jumps"] = f"""WITH {BARS}, {JUMP}, l AS (SELECT symbol, value AS ratio, (value - mean) / std AS z FROM {latest('js', 'ratio', 'rn', 50)}), e AS (SELECT symbol, last(rv ORDER BY rn) AS rv, last(bv ORDER BY rn) AS bv, last(jump ORDER BY rn) AS jump FROM js GROUP BY 1)
SELECT symbol, {r6('ratio', 'rv', 'bv', 'jump')}, round(z, 4) AS z, z > 1.645 AND ratio > 0.3 AS detected FROM l JOIN e USING (symbol)"""
GA = """gr AS (SELECT symbol, list(r * r ORDER BY rn) AS r2, greatest(avg(r * r), 1e-12) AS v FROM rets GROUP BY 1),
gg AS (SELECT symbol, r2, v, i, a, b, greatest((1 - a - b) * v, 1e-8) AS omega FROM gr, (SELECT unnest({grid}, recursive := true))),
gs AS (SELECT *, list_reduce(list_prepend({{'s2': v, 'll': 0::DOUBLE}}, [{{'s2': x, 'll': 0::DOUBLE}} FOR x IN r2]), lambda p, q: {{'s2': omega + a * q.s2 + b * p.s2, 'll': p.ll - 0.5 * (1.8378770664::DOUBLE + ln(omega + a * q.s2 + b * p.s2) + q.s2 / (omega + a * q.s2 + b * p.s2))}}) AS f FROM gg),
gb AS (SELECT symbol, r2, v, omega, a AS alpha, b AS beta, f.ll AS log_lik, f.s2 AS s2 FROM gs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY f.ll DESC, i) = 1)"""


def garch_cte() -> str:
    from ..operators.volatility import GRID

    return GA.format(grid="[" + ", ".join(f"{{'i': {i}, 'a': {a!r}::DOUBLE, 'b': {b!r}::DOUBLE}}" for i, (a, b) in enumerate(GRID)) + "]").replace("{{", "{").replace("}}", "}")


SQL["garch_fit"] = f"WITH {BARS}, {garch_cte()} SELECT symbol, round(omega, 9) AS omega, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(log_lik, 4) AS log_lik, round(sqrt(s2), 6) AS vol, round(sqrt(omega / greatest(1 - alpha - beta, 1e-4)), 6) AS long_run_vol, CASE WHEN sqrt(s2) / sqrt(omega / greatest(1 - alpha - beta, 1e-4)) < 0.7 THEN 'low-vol' WHEN sqrt(s2) / sqrt(omega / greatest(1 - alpha - beta, 1e-4)) > 1.4 THEN 'high-vol' ELSE 'transitional' END AS regime FROM gb"
SQL["garch_regimes"] = f"""WITH RECURSIVE {BARS}, {garch_cte()}, gw(symbol, rn, s2, long_run) AS (SELECT symbol, -1::BIGINT, v, sqrt(omega / greatest(1 - alpha - beta, 1e-4)) FROM gb
  UNION ALL SELECT w.symbol, rets.rn, gb.omega + gb.alpha * (rets.r * rets.r) + gb.beta * w.s2, w.long_run FROM gw w JOIN gb ON gb.symbol = w.symbol JOIN rets ON rets.symbol = w.symbol AND rets.rn = w.rn + 1)
SELECT symbol, time, round(sqrt(s2), 6) AS vol, CASE WHEN sqrt(s2) / long_run < 0.7 THEN 'low-vol' WHEN sqrt(s2) / long_run > 1.4 THEN 'high-vol' ELSE 'transitional' END AS regime FROM gw JOIN rets USING (symbol, rn)"""
HMMF = f"""h0 AS (SELECT *, CASE WHEN prev IS NOT NULL THEN ln(close / prev) END AS lr FROM b), h1 AS (SELECT *, coalesce(lr, 0) AS g0, sqrt(coalesce(avg(lr * lr) OVER {last(20)}, 0)) AS g1, avg(volume) OVER {last(50)} AS vm, avg(volume * volume) OVER {last(50)} AS v2, avg(volume * volume * volume) OVER {last(50)} AS v3, CASE WHEN rn > 0 THEN (high - low) / close ELSE 0 END AS g3 FROM h0),
h2 AS (SELECT *, CASE WHEN rn >= 50 THEN (v3 - 3 * vm * v2 + 2 * vm * vm * vm) / pow(v2 - vm * vm, 1.5) ELSE 0 END AS g2 FROM h1),
hf AS (SELECT symbol, time, {', '.join(f"(g{d} - avg(g{d}) FILTER (rn >= 50) OVER w) / stddev_samp(g{d}) FILTER (rn >= 50) OVER w AS f{d}" for d in range(4))} FROM h2 WINDOW w AS (PARTITION BY symbol))"""
SQL["hmm_features"] = f"WITH {BARS}, {HMMF} SELECT symbol, time, {', '.join(f'round(f{d}, 4) + 0 AS f{d}' for d in range(4))} FROM hf"
LP = BARS + ", lp AS (SELECT symbol, time, ln(close) AS r FROM b), " + pair("A", "R", "lp")
LP_TAIL = LP.replace("pr AS (", "pr0 AS (") + ", pr AS (SELECT x, y, row_number() OVER (ORDER BY rn) - 1 AS rn, count(*) OVER () AS n FROM (SELECT * FROM pr0 ORDER BY rn DESC LIMIT 500))"
KAL = """kd AS (SELECT rn, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM pr), k0 AS (SELECT regr_slope(y, x) AS b0 FROM kd WHERE rn < 30),
kf(rn, bb, p, e) AS (SELECT 29::BIGINT, b0, greatest(b0 * 0.01::DOUBLE, 0.01::DOUBLE) + 0.01::DOUBLE, NULL::DOUBLE FROM k0
  UNION ALL SELECT kd.rn, kf.bb + (kf.p + 1e-4) * kd.x / (kd.x * kd.x * (kf.p + 1e-4) + 1e-3) * (kd.y - kd.x * kf.bb), greatest((1 - (kf.p + 1e-4) * kd.x / (kd.x * kd.x * (kf.p + 1e-4) + 1e-3) * kd.x) * (kf.p + 1e-4), 0), kd.y - kd.x * kf.bb FROM kf JOIN kd ON kd.rn = kf.rn + 1),
ks AS (SELECT last(bb ORDER BY rn) AS hedge_ratio, last(p ORDER BY rn) AS variance, last(e ORDER BY rn) AS residual, (last(e ORDER BY rn) - avg(e)) / greatest(stddev_samp(e), 1e-9) AS kalman_z FROM kf)"""
KSIG = "CASE WHEN kalman_z > 2 THEN 'short-residual' WHEN kalman_z < -2 THEN 'long-residual' ELSE 'none' END"
SQL["kalman_beta"] = f"WITH RECURSIVE {LP}, {KAL} SELECT {r6('hedge_ratio', 'variance', 'residual')}, round(kalman_z, 5) AS kalman_z, {KSIG} AS kalman_signal FROM ks"
OU = """ol AS (SELECT s, lag(s) OVER (ORDER BY rn) AS p, rn FROM sp), oc AS (SELECT regr_slope(s, p) AS b, regr_intercept(s, p) AS a, count(*) AS n, last(s ORDER BY rn) AS last FROM ol),
oe AS (SELECT stddev_samp(s - (a + b * p)) AS sigma FROM ol, oc WHERE p IS NOT NULL),
ou0 AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN -ln(b) ELSE 0 END AS theta, a / (1 - b) AS mu, CASE WHEN b > 0 AND b < 1 THEN -ln(2) / ln(b) ELSE 'inf'::DOUBLE END AS half_life, (last - a / (1 - b)) / sigma AS z FROM oc, oe),
ou AS (SELECT *, theta > 0 AND half_life BETWEEN 1 AND 48 AS half_life_valid, CASE WHEN theta > 0 AND half_life BETWEEN 1 AND 48 AND z > 2 THEN 'short-spread' WHEN theta > 0 AND half_life BETWEEN 1 AND 48 AND z < -2 THEN 'long-spread' ELSE 'none' END AS signal FROM ou0)"""
SQL["ou_fit"] = f"WITH {LP}, sp AS (SELECT rn, y - (SELECT regr_slope(y, x) FROM pr) * x AS s FROM pr), {OU} SELECT {r6('theta', 'mu', 'sigma', 'half_life', 'last')}, round(z, 5) AS z, half_life_valid, signal FROM ou"
COI = f"""cf AS (SELECT regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pr), ce AS (SELECT rn, y - (alpha + beta * x) AS e, alpha, beta FROM pr, cf), cl AS (SELECT *, lag(e) OVER (ORDER BY rn) AS ep FROM ce),
cg AS (SELECT regr_slope(e - ep, ep) AS g FROM cl), cs AS (SELECT stddev_samp((e - ep) - g * ep) / sqrt(sum(ep * ep)) AS se FROM cl, cg WHERE ep IS NOT NULL), coi AS (SELECT alpha, beta, g / se AS t, greatest(0, -g / se * 3) AS trace, -g / se * 3 > 12.25 AND g / se < -2.86 AS cointegrated FROM cf, cg, cs)"""
SQL["cointegration"] = f"WITH {LP}, {COI} SELECT {r6('alpha', 'beta')}, round(t, 5) AS t, round(trace, 5) AS trace, round({cdf('t')}, 6) AS p, cointegrated FROM coi"
SQL["statarb_gate"] = f"""WITH RECURSIVE {LP_TAIL}, {KAL}, {COI}, sp AS (SELECT rn, y - ((SELECT alpha FROM coi) + (SELECT hedge_ratio FROM ks) * x) AS s FROM pr), {OU}
SELECT round(hedge_ratio, 6) AS hedge_ratio, round(kalman_z, 5) AS kalman_z, round(z, 5) AS z, round(half_life, 5) AS half_life, half_life_valid, cointegrated,
  CASE WHEN signal <> 'none' AND {KSIG} <> 'none' AND (signal = 'long-spread') = ({KSIG} = 'long-residual') THEN signal ELSE 'none' END AS composite, CASE WHEN half_life_valid AND cointegrated THEN 'open' ELSE 'closed' END AS gate FROM ks, coi, ou"""


def each_pair(sql: str) -> str:
    """A statement over the pair A, R for all three pairs, with the pair's key."""
    one = lambda x, y: f"SELECT '{x}' AS x_symbol, '{y}' AS y_symbol, * FROM ({sql.replace("'A'", f"'{x}'").replace("'R'", f"'{y}'")})"
    return " UNION ALL ".join(one(x, y) for x, y in (("A", "N"), ("A", "R"), ("N", "R")))


SQL["pair_reversion"] = each_pair(SQL["cointegration"])
SQL["pair_information"] = each_pair(f"""WITH {TAIL}, {TE}, {EDGE}, {PE}, mf AS{MI.split(", mf AS", 1)[1]},
pl AS (SELECT *, CASE WHEN percentile < 0.2 THEN 'predictable' WHEN percentile > 0.8 THEN 'random' ELSE 'normal' END AS state FROM {latest('pe', 'pe', 'end_at', 100)}),
er AS (SELECT *, CASE WHEN spike AND leader <> 'balanced' THEN CASE WHEN CASE WHEN leader = 'x' THEN lx ELSE ly END > 0 THEN 'long' ELSE 'short' END ELSE 'none' END AS side FROM edge)
SELECT {r6('x_to_y', 'y_to_x')}, leader, round(z, 5) AS z, side AS edge, (SELECT round(value, 6) FROM pl WHERE symbol = 'A') AS x_pe, (SELECT round(value, 6) FROM pl WHERE symbol = 'R') AS y_pe, (SELECT state FROM pl WHERE symbol = 'R') AS y_pe_state,
  (SELECT first(feature ORDER BY mi DESC, feature) FROM mi) AS top_feature, (SELECT round(max(mi), 6) FROM mi) AS top_mi, (SELECT count(*) FILTER (mi > 0.05) FROM mi) AS informative,
  CASE WHEN side = 'none' THEN 'neither symbol leads' ELSE CASE WHEN leader = 'x' THEN 'A' ELSE 'R' END || ' leads (z ' || printf('%.2f', z) || ') and went ' || CASE WHEN side = 'long' THEN 'up' ELSE 'down' END || ': ' || side || ' ' || CASE WHEN leader = 'x' THEN 'R' ELSE 'A' END END AS rationale FROM er""")
ZS = f"s0 AS (SELECT *, avg(close) OVER {last(48)} AS mean, stddev_samp(close) OVER {last(48)} AS sd, coalesce(regr_slope(close - prev, prev) OVER {last(47)}, 0) AS slope FROM b), s1 AS (SELECT *, {life('slope')} AS hl, CASE WHEN rn >= 58 AND sd > 0 THEN (close - mean) / sd END AS z FROM s0), s2 AS (SELECT *, CASE WHEN hl > 0 AND hl < 60 THEN z END AS zz FROM s1)"
SQL["zscore_mr_signal"] = f"WITH {BARS}, {ZS} SELECT symbol, time, CASE WHEN zz > 1.8 THEN 'enter-short' WHEN zz < -1.8 THEN 'enter-long' ELSE 'hold' END AS action, round(CASE WHEN abs(zz) > 1.8 THEN least(1, (abs(zz) - 1.8::DOUBLE) / 1.5) ELSE 0 END, 5) AS strength, round(CASE WHEN abs(zz) > 1.8 THEN 3.5 * sd END, 5) AS stop FROM s2"
SQL["decay_mom_signal"] = f"WITH {BARS}, {MOM}, s AS (SELECT *, CASE WHEN rn >= 34 THEN weighted / nullif(rv, 0) END AS sg FROM mom) SELECT symbol, time, CASE WHEN sg > 0.7 THEN 'enter-long' WHEN sg < -0.7 THEN 'enter-short' ELSE 'hold' END AS action, round(CASE WHEN abs(sg) > 0.7 THEN least(1, (abs(sg) - 0.7::DOUBLE) / 1.3) ELSE 0 END, 5) AS strength, round(CASE WHEN abs(sg) > 0.7 THEN rv * 2.5 END, 6) AS stop FROM s"
SQL["vol_breakout_signal"] = f"""WITH {BARS}, v0 AS (SELECT *, CASE WHEN rn >= 55 THEN nullif(avg(greatest(high - low, abs(high - prev), abs(low - prev))) OVER {last(14)}, 0) END AS atr, list(volume) OVER {last(50)} AS vs FROM b), v1 AS (SELECT *, (close - prev) / atr AS mv, len(list_filter(vs, lambda x: x <= volume)) / len(vs)::DOUBLE AS pct FROM v0)
SELECT symbol, time, CASE WHEN abs(mv) > 1.4 AND pct > 0.6 AND mv > 0 THEN 'enter-long' WHEN abs(mv) > 1.4 AND pct > 0.6 THEN 'enter-short' ELSE 'hold' END AS action, round(CASE WHEN abs(mv) > 1.4 AND pct > 0.6 THEN least(1, abs(mv) / 3) ELSE 0 END, 5) AS strength, round(CASE WHEN abs(mv) > 1.4 AND pct > 0.6 THEN 1.8::DOUBLE * atr END, 5) AS stop FROM v1"""
SQL["carry_signal"] = f"""WITH {BARS}, c0 AS (SELECT *, ln(close / prev) AS l FROM b), c1 AS (SELECT *, list(l) FILTER (l IS NOT NULL) OVER {last(34)} AS ls FROM c0), c2 AS (SELECT *, CASE WHEN rn >= 44 THEN {fold('ls[-8:]', '2::DOUBLE / 9')} END AS fast, CASE WHEN rn >= 44 THEN {fold('ls', '2::DOUBLE / 35')} END AS slow FROM c1),
c3 AS (SELECT *, fast - slow AS slope, len(list_filter(ls, lambda x: x <= fast - slow)) / len(ls)::DOUBLE AS pct FROM c2)
SELECT symbol, time, CASE WHEN slope > 0 AND pct > 0.8 THEN 'enter-short' WHEN slope < 0 AND pct < 0.2 THEN 'enter-long' ELSE 'hold' END AS action, round(CASE WHEN slope > 0 AND pct > 0.8 THEN least(1, pct) WHEN slope < 0 AND pct < 0.2 THEN least(1, 1 - pct) ELSE 0 END, 5) AS strength,
  round(CASE WHEN (slope > 0 AND pct > 0.8) OR (slope < 0 AND pct < 0.2) THEN greatest(abs(slow) * 6 * close, close * 0.004::DOUBLE) END, 5) AS stop FROM c3"""
SQL["deflated_sharpe"] = f"WITH {BARS} SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(1638) * sqrt(1 - (ln(12) + 0.5772::DOUBLE) / 24), 6) AS deflated FROM rets GROUP BY 1"
SQL["symbol_config"] = "SELECT * FROM (VALUES ('EUR/USD', 1.085::DOUBLE, 0.006::DOUBLE, 0.00005::DOUBLE, 0.0001::DOUBLE, 'FX:EURUSD'), ('XAU/USD', 2330::DOUBLE, 0.012::DOUBLE, 0.3::DOUBLE, 0.1::DOUBLE, 'OANDA:XAU_USD')) t(symbol, base_price, daily_vol, spread, pip_size, tv_symbol)"
SQL["strategy_catalogue"] = "SELECT * FROM (VALUES ('zscore-mr', 'Z-score reversion', 'mean-reversion', 'mean-reversion'), ('decay-mom', 'Decay-weighted momentum', 'momentum', 'momentum'), ('vol-breakout', 'Volatility breakout', 'breakout', 'breakout-prep'), ('carry-proxy', 'Carry proxy', 'carry', 'always')) t(code, name, kind, family)"

SEED_LIST = ", ".join(str(s) for s in (0xA11CE, 0xB0B))
SQL["uniform_draws"] = f"""WITH d AS (SELECT seed, draw, ((seed::HUGEINT + (draw + 1) * 1831565813::HUGEINT) % 4294967296)::BIGINT AS a FROM (SELECT unnest([{SEED_LIST}])::BIGINT AS seed), (SELECT unnest(range(1000))::BIGINT AS draw)),
t AS (SELECT seed, draw, ((xor(a, a >> 15)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM d),
v AS (SELECT seed, draw, xor(((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT, t) AS v FROM t),
u AS (SELECT seed, draw, xor(v, v >> 14) / 4294967296::DOUBLE AS u FROM v)
SELECT seed, draw, round(u, 12) AS u, round(sqrt(-2 * ln(u)) * cos(2 * pi() * lead(u) OVER (PARTITION BY seed ORDER BY draw)), 9) AS z FROM u"""

MODEL_BARS = TAIL.replace("<= 500", "<= 2000")
WINDOWS = f"""{MODEL_BARS}, wn AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), we AS (SELECT symbol, unnest(range(200, n - 1, 20)) AS stop FROM wn),
wb AS (SELECT we.symbol, stop, b.rn AS k, b.time, b.close, lag(b.close) OVER (PARTITION BY we.symbol, stop ORDER BY b.rn) AS p FROM we JOIN b ON b.symbol = we.symbol AND b.rn >= stop - 200 AND b.rn < stop)"""
SQL["ml_windows"] = f"""WITH {WINDOWS}, y AS (SELECT symbol, rn - 1 AS stop, ln(close / prev) AS y FROM b)
SELECT symbol, stop, count(*) AS bars, min(time) AS first_time, max(time) AS last_time, round(max(y), 9) AS y FROM wb JOIN y USING (symbol, stop) GROUP BY 1, 2"""
SQL["ml_window_measures"] = f"""WITH {WINDOWS}, res AS (SELECT symbol, stop, arg_max(ln(close), k) - (avg(ln(close)) FILTER (p IS NOT NULL) - regr_slope(ln(close), ln(p)) * avg(ln(p)) + regr_slope(ln(close), ln(p)) * arg_max(ln(p), k)) AS residual FROM wb GROUP BY 1, 2),
wr AS (SELECT symbol, stop, k, ln(close / p) AS r FROM wb WHERE p IS NOT NULL),
p4 AS (SELECT symbol, stop, r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c, lead(r, 3) OVER w AS d FROM wr WINDOW w AS (PARTITION BY symbol, stop ORDER BY k)),
pc AS (SELECT symbol, stop, count(*) AS c FROM p4 WHERE d IS NOT NULL GROUP BY symbol, stop, a <= b, a <= c, a <= d, b <= c, b <= d, c <= d),
pe AS (SELECT symbol, stop, -sum(s * log2(s)) / log2(24) AS pe FROM (SELECT symbol, stop, c / sum(c) OVER (PARTITION BY symbol, stop)::DOUBLE AS s FROM pc) GROUP BY 1, 2),
q AS (SELECT symbol, stop, k, least(3, greatest(0, floor((r - min(r) OVER s) / (CASE WHEN max(r) OVER s = min(r) OVER s THEN 1e-9 ELSE max(r) OVER s - min(r) OVER s END) * 4))) AS q FROM wr WINDOW s AS (PARTITION BY symbol, stop)),
q3 AS (SELECT symbol, stop, lead(q) OVER w AS a, q AS b, lag(q) OVER w AS c FROM q WINDOW w AS (PARTITION BY symbol, stop ORDER BY k)),
n3 AS (SELECT symbol, stop, a, b, c, count(*)::DOUBLE AS n FROM q3 WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
te AS (SELECT symbol, stop, greatest(0, sum(n / t * log2((n / bc) / (ab / bb)))) AS te FROM (SELECT *, sum(n) OVER (PARTITION BY symbol, stop) AS t, sum(n) OVER (PARTITION BY symbol, stop, b, c) AS bc, sum(n) OVER (PARTITION BY symbol, stop, a, b) AS ab, sum(n) OVER (PARTITION BY symbol, stop, b) AS bb FROM n3) GROUP BY 1, 2)
SELECT symbol, stop, {r6('residual', 'pe', 'te')} FROM res JOIN pe USING (symbol, stop) JOIN te USING (symbol, stop)"""
SAMPLES = f"{WINDOWS}, s AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY stop) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM we)"
SQL["ml_folds"] = f"""WITH {SAMPLES}, f AS (SELECT s.*, fold, fold * (n // 6) AS a, CASE WHEN fold = 5 THEN n ELSE (fold + 1) * (n // 6) END AS z FROM s, (SELECT unnest(range(6)) AS fold) WHERE n >= 30)
SELECT symbol, fold, count(*) FILTER (rn >= a AND rn < z) AS test, count(*) FILTER (rn < a - 5 OR rn >= z + 5) AS train, count(*) FILTER ((rn < a AND rn >= a - 5) OR (rn >= z AND rn < z + 5)) AS purged FROM f GROUP BY 1, 2"""
SQL["ml_splits"] = f"""WITH {SAMPLES}, f AS (SELECT s.*, unnest(range(40, n - 10, 10)) AS split FROM s WHERE n >= 50)
SELECT symbol, split, count(*) FILTER (rn < split) AS train, count(*) FILTER (rn >= split AND rn < split + 10) AS test FROM f GROUP BY 1, 2"""

DECIDED = " UNION ALL ".join(f"(SELECT '{code}' AS strategy, symbol, time, action, strength FROM ({SQL[name]}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)" for code, name in (("zscore-mr", "zscore_mr_signal"), ("decay-mom", "decay_mom_signal"), ("vol-breakout", "vol_breakout_signal"), ("carry-proxy", "carry_signal")))
SQL["live_base"] = f"SELECT strategy, symbol, time, CASE action WHEN 'enter-long' THEN 'long' WHEN 'enter-short' THEN 'short' ELSE 'flat' END AS direction, round(strength, 4) AS confidence FROM ({DECIDED})"
SQL["te_injection"] = f"SELECT CASE leader WHEN 'x' THEN y_symbol ELSE x_symbol END AS symbol, edge AS direction, round(least(1, greatest(0.5, (z - 1) / 3)), 4) AS confidence FROM ({SQL['pair_information']}) WHERE edge <> 'none'"
SQL["statarb_injection"] = f"SELECT CASE WHEN z < 0 THEN 'R' ELSE 'A' END AS symbol, CASE WHEN z < 0 THEN 'long' ELSE 'short' END AS direction, round(least(1, greatest(0.5, (abs(z) - 1) / 3)), 4) AS confidence FROM ({SQL['statarb_gate']}) WHERE half_life BETWEEN 0.05 AND 48 AND cointegrated AND abs(z) > 0.5 AND abs(kalman_z) > 0.5 AND sign(z) = sign(kalman_z)"
SQL["market_data"] = f"""WITH {BARS}, m AS (SELECT * FROM bars WHERE symbol = 'A' QUALIFY row_number() OVER (ORDER BY time DESC) <= 1000), c AS (SELECT close, prev FROM b WHERE symbol = 'A' ORDER BY time DESC LIMIT 1)
SELECT symbol, time, {', '.join(f'round(m.{c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}, round(c.close - c.prev, 6) AS change, round((c.close - c.prev) * 100 / c.prev, 6) AS change_pct FROM m, c"""
SQL["stream_bars_hourly"] = SQL["bars_hourly"]
SQL["bars_from_source"] = f"WITH {BARS} SELECT symbol, time, {r6('open', 'high', 'low', 'close', 'volume')} FROM bars WHERE symbol = 'R' QUALIFY row_number() OVER (ORDER BY time DESC) <= 500"
SQL["stream_zscores"] = """WITH e AS (SELECT event_type AS symbol, ts AS time, event_id, value AS price, count(*) OVER w AS held, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0) AS std FROM events WHERE value > 0
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 47 PRECEDING)), z AS (SELECT *, CASE WHEN std = 0 THEN 0 ELSE (price - mean) / std END AS z FROM e)
SELECT symbol, time, event_id, round(price, 6) AS price, held::INT AS held, round(mean, 9) AS mean, round(std, 6) AS std, round(z, 6) AS z, CASE WHEN z > 1.8 THEN 'short' WHEN z < -1.8 THEN 'long' ELSE 'none' END AS signal FROM z"""
SQL["trade_stats"] = f"""WITH {BARS}, t AS (SELECT symbol, close - prev AS pnl, (close - prev) / 100000 AS r FROM b WHERE prev IS NOT NULL),
g AS (SELECT symbol, count(*) AS trades, avg(r) / stddev_samp(r) * sqrt(1638) AS sharpe, avg(r) / sqrt(avg(r * r) FILTER (r < 0)) * sqrt(1638) AS sortino, avg(CASE WHEN pnl > 0 THEN 1::DOUBLE ELSE 0 END) AS hit_rate, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) AS profit_factor,
  avg(r) * sqrt(count(*)) / stddev_samp(r) AS t, avg(r) AS expectancy, avg(r) FILTER (pnl > 0) AS avg_win, avg(r) FILTER (pnl <= 0) AS avg_loss FROM t GROUP BY 1)
SELECT symbol, trades, {r6('sharpe', 'sortino', 'hit_rate', 'profit_factor')}, round(t, 6) AS t_stat, round(2 * (1 - {cdf('abs(t)')}), 6) AS p_value, round(expectancy, 9) AS expectancy, round(avg_win, 9) AS avg_win, round(avg_loss, 9) AS avg_loss, trades >= 1000 AND 2 * (1 - {cdf('abs(t)')}) < 0.05 AND sharpe >= 0.5 AS valid FROM g"""
SQL["regime_matrix"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {p}::DOUBLE)" for a, row in {"trend": (0.96, 0.02, 0.01, 0.01), "revert": (0.02, 0.96, 0.01, 0.01), "highvol": (0.08, 0.05, 0.82, 0.05), "calm": (0.06, 0.06, 0.03, 0.85)}.items() for b, p in zip(("trend", "revert", "highvol", "calm"), row)) + ") AS t(regime, next, p)"
