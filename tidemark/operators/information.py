"""Information flow: transfer entropy, permutation entropy, mutual information, cross-asset edge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.bars import PAIR, in_pair_order, returns, side_by_side


def paired(rets: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Returns of the symbols of each pair side by side at the times that both have: x_symbol, y_symbol, time, rn, x, y, n."""
    return in_pair_order(side_by_side(rets, F.col("r"), pairs))


def binned(rows: DataFrame, names: list[str], bins: int) -> DataFrame:
    own = Window.partitionBy(*PAIR)
    for c in names:
        rows = rows.withColumn(f"{c}q", C.bin_of(F.col(c), F.min(c).over(own), F.max(c).over(own), bins))
    return rows


def entropy_of_triples(triples: DataFrame, key: list[str]) -> DataFrame:
    """Transfer entropy in bits by key from rows (a: next of the target, b: target, c: source), never below 0.

    Rows are first counted by triple; the counts of pairs and singles are sums over these few rows.
    """
    counts = triples.groupBy(*key, "a", "b", "c").agg(F.count(F.lit(1)).alias("n3"))
    part = lambda *cs: F.sum("n3").over(Window.partitionBy(*key, *cs))
    terms = counts.select(*key, "n3", part("b", "c").alias("nbc"), part("a", "b").alias("nab"), part("b").alias("nb"), part().alias("n"))
    bits = F.col("n3") / F.col("n") * F.log2((F.col("n3") / F.col("nbc")) / (F.col("nab") / F.col("nb")))
    return terms.groupBy(*key).agg(F.greatest(F.sum(bits), F.lit(0.0)).alias("te"))


def sliding_sums(events: DataFrame, first: Column, last: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, end_at, total: for every end of a window the signed sum of count * log2(count) over the symbols inside, from events (keys, kind, symbol, sign).

    An event lies in the windows that end at `first` to `last` (columns). It adds one to its symbol's count where it enters and takes one off where it has left, so
    a count is a running sum of two rows an event, and its change of count * log2(count) is exact from whole numbers; totals are running sums of
    these changes. Windows themselves are never built: rows don't grow with the window. Ends at which nothing changes have no row.
    """
    weigh = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)
    # what enters and leaves at one end counts as one step
    moves = events.select(*keys, "kind", "symbol_", "sign", F.explode(F.array(F.struct(first.alias("end_at"), F.lit(1).alias("step")), F.struct((last + 1).alias("end_at"), F.lit(-1).alias("step")))).alias("m")).groupBy(*keys, "kind", "symbol_", "sign", F.col("m.end_at").alias("end_at")).agg(F.sum("m.step").alias("step")).where("step <> 0")
    w = Window.partitionBy(*keys, "kind", "symbol_").orderBy("end_at").rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.withColumn("_c", F.sum("step").over(w)).withColumn("_d", F.col("sign") * (weigh(F.col("_c")) - weigh(F.col("_c") - F.col("step"))))
    at = moves.groupBy(*keys, "end_at").agg(F.sum("_d").alias("_d"))
    return at.select(*keys, "end_at", F.sum("_d").over(Window.partitionBy(*keys).orderBy("end_at").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def _every_end(rows: DataFrame, sums: DataFrame, first: Column, keys: tuple[str, ...], names: list[str]) -> DataFrame:
    """rows (keys, end_at) that are ends of windows, each with the last total of sums at or before it."""
    ends = rows.where(F.col("end_at") >= first).select(*keys, "end_at").join(sums, [*keys, "end_at"], "left")
    w = Window.partitionBy(*keys).orderBy("end_at").rowsBetween(Window.unboundedPreceding, 0)
    return ends.select(*keys, "end_at", *[F.last(c, True).over(w).alias(c) for c in names])


def transfer_series(pair: DataFrame, bins: int = 4, n: int = 120) -> DataFrame:
    """Transfer entropy x to y and y to x of the n pairs before each end (n to the last but one): the key of the pair, end_at, x_to_y, y_to_x.

    The entropy is a signed sum of count * log2(count) over triples (+), source with target (-), target with its next (-) and target (+), over n: sliding_sums()
    keeps these counts by what enters and leaves.
    """
    rows = binned(pair, ["x", "y"], bins)
    w = Window.partitionBy(*PAIR).orderBy("rn")
    rows = rows.withColumn("xn", F.lead("xq").over(w)).withColumn("yn", F.lead("yq").over(w)).where(F.col("xn").isNotNull())
    # the triple at rn is in windows that end at rn + 2 to rn + n, and counts from the first whole one on
    low, high = F.greatest(F.lit(n), F.col("rn") + 2), F.least(F.col("rn") + n, F.col("n") - 1)
    code = lambda *cs: sum((F.col(c) * bins**i for i, c in enumerate(cs)), F.lit(0)).cast("int")
    event = lambda kind, sign, *cs: F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign"), code(*cs).alias("symbol_"))

    def way(to: str, a: str, b: str, c: str) -> list[Column]:
        return [event(f"{to}3", 1, a, b, c), event(f"{to}s", -1, b, c), event(f"{to}n", -1, a, b), event(f"{to}1", 1, b)]

    events = rows.where(low <= high).select(*PAIR, low.alias("_low"), high.alias("_high"), F.inline(F.array(*way("f", "yn", "yq", "xq"), *way("b", "xn", "xq", "yq"))))
    sums = sliding_sums(events.withColumn("way", F.substring("kind", 1, 1)), F.col("_low"), F.col("_high"), (*PAIR, "way"))
    side = lambda k: F.max(F.when(F.col("way") == k, F.col("total")))
    both = sums.groupBy(*PAIR, "end_at").agg(side("f").alias("f"), side("b").alias("b"))
    # an end at which one direction stays as it was has a null there: the last value holds
    ends = _every_end(pair.select(*PAIR, F.col("rn").cast("int").alias("end_at")), both.withColumn("end_at", F.col("end_at").cast("int")), F.lit(n), PAIR, ["f", "b"])
    bits = lambda c: F.greatest(F.col(c) / (n - 1), F.lit(0.0))
    return ends.select(*PAIR, "end_at", bits("f").alias("x_to_y"), bits("b").alias("y_to_x"))


def transfer(pair: DataFrame, bins: int = 4, n: int = 120) -> DataFrame:
    """A row a pair: last x_to_y and y_to_x, net, who leads, z of the leading direction's last value and whether it spikes."""
    rows = transfer_series(pair, bins, n)
    last = rows.groupBy(*PAIR).agg(F.max_by(F.struct("x_to_y", "y_to_x"), "end_at").alias("l"), F.avg("x_to_y").alias("mx"), F.avg("y_to_x").alias("my"), C.std0(F.col("x_to_y")).alias("sx"), C.std0(F.col("y_to_x")).alias("sy")).select(*PAIR, "l.*", "mx", "my", "sx", "sy")
    last = pair.select(*PAIR).distinct().join(last, list(PAIR), "left").fillna(0.0)  # a pair shorter than a window has no flow
    net = F.col("x_to_y") - F.col("y_to_x")
    z = F.when(net >= 0, (F.col("x_to_y") - F.col("mx")) / C.or_tiny(F.col("sx"))).otherwise((F.col("y_to_x") - F.col("my")) / C.or_tiny(F.col("sy")))
    lead = F.when(F.abs(net) < 0.02, "balanced").when(net > 0, "x").otherwise("y")
    return last.select(*PAIR, "x_to_y", "y_to_x", net.alias("net"), lead.alias("leader"), z.alias("z"), (z > 2).alias("spike"))


def pattern(values: Column, m: int) -> Column:
    """Ordinal pattern of an array of m values: places in order of value, ties by place."""
    return F.array_join(F.transform(F.array_sort(F.transform(values, lambda v, k: F.struct(v.alias("v"), k.alias("k")))), lambda o: o["k"].cast("string")), "")


def permutation_series(rets: DataFrame, *keys: str, m: int = 4, n: int = 100) -> DataFrame:
    """Normalised permutation entropy of the n returns before each end (n to all): key, end, pe. Series shorter than n + m have none. Pattern counts follow by what enters and leaves (sliding_sums)."""
    keys = keys or ("symbol",)
    w = Window.partitionBy(*keys).orderBy("rn")
    rows = rets.select(*keys, "rn", "n", pattern(F.array("r", *[F.lead("r", i).over(w) for i in range(1, m)]), m).alias("p"), F.lead("r", m - 1).over(w).alias("_l"))
    rows = rows.where(F.col("_l").isNotNull() & (F.col("n") >= n + m))
    low, high = F.greatest(F.lit(n), F.col("rn") + m), F.least(F.col("rn") + n, F.col("n"))
    events = rows.where(low <= high).select(*keys, F.lit("p").alias("kind"), F.col("p").alias("symbol_"), F.lit(1).alias("sign"), low.alias("_low"), high.alias("_high"))
    sums = sliding_sums(events, F.col("_low"), F.col("_high"), keys).withColumn("end_at", F.col("end_at").cast("int"))
    ends = _every_end(rets.where(F.col("n") >= n + m).select(*keys, (F.col("rn") + 1).cast("int").alias("end_at")), sums, F.lit(n), keys, ["total"])
    # -sum of share * log2(share), with counts that add up to the patterns of a window
    patterns = n - m + 1
    return ends.select(*keys, "end_at", ((math.log2(patterns) - F.col("total") / patterns) / math.log2(math.factorial(m))).alias("pe"))


def permutation(rets: DataFrame, *keys: str, m: int = 4, n: int = 100) -> DataFrame:
    """Last entropy, its percentile among the last n, state and sizing multiplier; 'normal' at 1 for short series."""
    from .microstructure import latest

    keys = keys or ("symbol",)
    found = latest(permutation_series(rets, *keys, m=m, n=n), "pe", "end_at", n, *keys)
    out = rets.select(*keys).distinct().join(found, list(keys), "left")
    out = out.select(*keys, F.coalesce("value", F.lit(1.0)).alias("pe"), F.coalesce("mean", F.lit(1.0)).alias("mean"), F.coalesce("percentile", F.lit(0.5)).alias("percentile"))
    state = F.when(F.col("percentile") < 0.2, "predictable").when(F.col("percentile") > 0.8, "random").otherwise("normal")
    return out.withColumn("state", state).withColumn("multiplier", F.when(F.col("state") == "predictable", 1.25).when(F.col("state") == "random", 0.5).otherwise(1.0))


def mutual(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Mutual information in bits of each feature of a pair with the target, from rows (x_symbol, y_symbol, feature, value, target): feature, mi, rank; 10 rows at least."""
    key = [*PAIR, "feature"]
    own = Window.partitionBy(*key)
    q = rows.select(*key, C.bin_of(F.col("value"), F.min("value").over(own), F.max("value").over(own), bins).alias("x"), C.bin_of(F.col("target"), F.min("target").over(own), F.max("target").over(own), bins).alias("y"))
    cells = q.groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    part = lambda *cs: F.sum("c").over(Window.partitionBy(*key, *cs))
    cells = cells.select(*key, "c", part("x").alias("cx"), part("y").alias("cy"), part().alias("n"))
    mi = cells.groupBy(*key).agg(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))))).alias("mi"), F.max("n").alias("n")).where(F.col("n") >= 10)
    of_pair = Window.partitionBy(*PAIR)
    place = F.row_number().over(of_pair.orderBy(F.col("mi").desc(), "feature")) - 1
    k = F.count(F.lit(1)).over(of_pair)
    return mi.withColumn("rank", F.when(k > 1, 1 - place / F.nullif(k - 1, F.lit(0))).otherwise(1.0)).select(*key, "mi", "rank", (F.col("mi") > 0.05).alias("informative"))


def information_features(bars: DataFrame, pair: DataFrame) -> DataFrame:
    """Rows (x_symbol, y_symbol, feature, value, target) of five features of each pair's y and its next return, from the 21st return on to the last but one."""
    w = Window.partitionBy(*PAIR).orderBy("rn")
    own = bars.select(F.col("symbol").alias("y_symbol"), "time", "high", "low", "close", "volume")
    rows = pair.join(own, ["y_symbol", "time"]).withColumn("next", F.lead("y").over(w)).withColumn("vol", F.sqrt(F.sum(F.col("y") * F.col("y")).over(w.rowsBetween(-19, 0)) / 20))
    rows = rows.where((F.col("rn") >= 20) & F.col("next").isNotNull())
    features = {"log-return": F.col("y"), "realized-vol": F.col("vol"), "leader-return": F.col("x"), "spread-proxy": (F.col("high") - F.col("low")) / F.col("close"), "volume": F.col("volume")}
    return rows.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in features.items()])).alias("f"), F.col("next").alias("target")).select(*PAIR, "f.feature", "f.value", "target")


def cross_edge(pair: DataFrame) -> DataFrame:
    """A row a pair: which symbol the other should follow, and in which direction, if transfer entropy spikes; 'none' otherwise."""
    last = pair.groupBy(*PAIR).agg(F.max_by(F.struct("x", "y"), "rn").alias("l")).select(*PAIR, F.col("l.x").alias("last_x"), F.col("l.y").alias("last_y"))
    rows = transfer(pair).join(last, list(PAIR))
    live = F.col("spike") & (F.col("leader") != "balanced")
    moved = F.when(F.col("leader") == "x", F.col("last_x")).otherwise(F.col("last_y"))
    follows = F.when(F.col("leader") == "x", F.col("y_symbol")).otherwise(F.col("x_symbol"))
    return rows.select(*PAIR, "x_to_y", "y_to_x", "net", "leader", "z", "spike", F.when(live, follows).alias("target"), F.when(live, F.when(moved > 0, "long").otherwise("short")).otherwise("none").alias("edge"), F.coalesce(moved, F.lit(0.0)).alias("leader_return"))


def report(bars: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A row a pair over its bounded look back: transfer entropy and the edge it gives, entropy of both symbols, the feature that tells most
    about y's next return and the number of informative ones, with a sentence on the edge."""
    rets = returns(bars)
    pair = paired(rets, pairs)
    order = permutation(rets).select("symbol", "pe", F.col("state").alias("pe_state"))
    mi = mutual(information_features(bars, pair)).groupBy(*PAIR).agg(F.max_by("feature", "rank").alias("top_feature"), F.max("mi").alias("top_mi"), F.sum(F.col("informative").cast("long")).alias("informative"))
    out = cross_edge(pair).join(bars.groupBy("symbol").agg(F.max("time").alias("time")).withColumnRenamed("symbol", "y_symbol"), "y_symbol").join(mi, list(PAIR), "left")
    for side in "xy":
        out = out.join(order.select(F.col("symbol").alias(f"{side}_symbol"), F.col("pe").alias(f"{side}_pe"), F.col("pe_state").alias(f"{side}_pe_state")), f"{side}_symbol", "left")
    moved = F.when(F.col("edge") == "long", "up").otherwise("down")
    led = F.concat(F.when(F.col("leader") == "x", F.col("x_symbol")).otherwise(F.col("y_symbol")), F.lit(" leads (z "), C.fixed(F.col("z")), F.lit(") and went "), moved, F.lit(": "), F.col("edge"), F.lit(" "), F.col("target"))
    return out.withColumn("rationale", F.when(F.col("edge") == "none", "neither symbol leads").otherwise(led))
