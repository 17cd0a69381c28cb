"""Long series over many tasks: numbers without a window over a whole key, blocks with a halo, scans over blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: rows of a block of a rolling operator; what it looks back must be fewer
BLOCK = 65_536
#: rows of a block that is one array of a fold
FOLD = 4096


def placed(rows: DataFrame, *keys: str, order: str = "time") -> DataFrame:
    """rows with place (0 for the first of its key, in order) and n, the key's rows; (key, order) has no repeats.

    Rows are dealt by ranges of key and order and written with their number within the part. What comes before a part is a sum over one row
    for each part and key, so no task holds a key and nothing but these counts is ordered by a window.
    """
    keys = keys or ("symbol",)
    low = F.lit((1 << 33) - 1)  # the number within the part
    dealt = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    table = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(low)), "placed")
    parts = table.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_part") == F.col("_of"))
    return table.join(parts, same).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_of", "_shift", *[f"_{k}" for k in keys])


def in_blocks(rows: DataFrame, f: Callable[..., DataFrame], halo: int, *keys: str, size: int = BLOCK) -> DataFrame:
    """f(rows, *keys, 'block') where f looks back over `halo` rows at most: each block of `size` rows has the `halo` rows before it as well, which are left out of the result.

    f must keep the columns place and block. rn, where f adds it, is the number within the whole key again.
    """
    if halo >= size:
        raise ValueError("a block must be longer than what is looked back over")
    return blocked(placed(rows, *keys), f, halo, *keys, size=size)


def blocked(rows: DataFrame, f: Callable[..., DataFrame], halo: int, *keys: str, size: int = BLOCK) -> DataFrame:
    """in_blocks() of rows that have their places."""
    own = F.floor(F.col("place") / size)
    to = F.when(F.col("place") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    out = f(rows.withColumn("block", F.explode(to)), *(keys or ("symbol",)), "block").where(F.col("place") >= F.col("block") * size)
    return (out.withColumn("rn", F.col("place")) if "rn" in out.columns else out).drop("block", "place", "n")


def scanned(blocks: DataFrame, value: str, compose: Callable[[Column, Column], Column], most: int, *keys: str) -> DataFrame:
    """blocks (keys, block, value) with `before`: the values of all blocks before composed in order, null for a key's first.

    compose(earlier, later) must be associative. By doubling: after k rounds a value stands for 2^k blocks, so `most` blocks a key take log2 of that many.
    """
    w = Window.partitionBy(*keys).orderBy("block")
    blocks, step = blocks.withColumn("_v", F.col(value)), 1
    while step < most:
        blocks = blocks.withColumn("_lag", F.lag("_v", step).over(w)).withColumn("_v", F.when(F.col("_lag").isNotNull(), compose(F.col("_lag"), F.col("_v"))).otherwise(F.col("_v"))).drop("_lag")
        step *= 2
    return blocks.withColumn("before", F.lag("_v").over(w)).drop("_v")


def blocks_of(rows: DataFrame, number: str, size: int) -> int:
    """Blocks of the longest key: one small job."""
    last = rows.agg(F.max(number)).first()[0]
    return 1 if last is None else last // size + 1


def pooled(part: str) -> list[Column]:
    """k, mean and ss (squares about the mean) of a whole from those of its blocks (k, m, ss in a struct)."""
    k, m, ss = F.col(f"{part}.k"), F.col(f"{part}.m"), F.col(f"{part}.ss")
    total, mean = F.sum(k), F.try_divide(F.sum(k * m), F.sum(k))
    return [total.alias("k"), mean.alias("mean"), (F.sum(ss) + F.sum(k * m * m) - total * mean * mean).alias("ss")]
