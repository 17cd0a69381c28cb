"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: words as the contracts have them: runs of anything but space and the controls 9 to 13
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column | float, max_epochs: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) -> those and `target`: shares of total by weight, none above max_epochs times its size.

    Clamping sources one after the other and sharing their excess by weight among the rest ends at a level L with
    target = min(cap, L * weight): sources fill up in ascending order of cap / weight. So one ordered pass over the sources
    (a row per source, not per document) finds L. A total above all caps gives every source its cap. Sources
    of size zero get zero; ties in cap / weight change nothing.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = Window.orderBy(cap / F.col("weight"), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = sources.withColumn("total", F.lit(total) if not isinstance(total, Column) else total).withColumn("cap", cap).withColumn("level", level)
    # the first source that its level doesn't fill sets the level of all from there on
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    return levelled.withColumn("open_level", open_level["level"]).withColumn("target", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap")))).drop("total", "cap", "level", "open_level")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 9, docs_per_bucket: int = 2000) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, row_key, size, source_size, target, repeats, taken (words, repeats counted).

    Sources in code point order, null last, get `weights` in rotation. A source at rate r = target / size takes each
    document floor(r) times; the fraction is met by one further copy of documents in a seeded random order until their words
    reach it, deciding at the document that crosses the mark by which side is nearer. The order is kept in buckets of about
    docs_per_bucket rows (the number of buckets follows the source's rows), so a source with a third of all rows is still
    spread over tasks, and only bucket sums are ordered by source. Null texts have size 0; rows without words are
    taken floor(r) times. row_key hashes doc_id and text: rows equal in both are decided together, reruns agree.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("row_key"))
    rows = materialise(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    filled = water_fill(sums.withColumn("weight", weight).withColumn("_total", total), F.col("_total"), max_epochs).drop("_total", "weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = filled.withColumn("_whole", F.floor(rate + 1e-12)).withColumn("_extra", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))).withColumn("_buckets", F.ceil(F.col("_n") / docs_per_bucket))
    key = F.col("source").eqNullSafe(F.col("_s"))
    drawn = F.shiftrightunsigned("row_key", 2)  # 62 random bits, positive
    bucketed = rows.withColumn("_u", drawn).join(plan.withColumnRenamed("source", "_s"), key).drop("_s").withColumn("_bucket", F.floor(F.shiftrightunsigned("_u", 31) * F.col("_buckets") / float(1 << 31)))
    by_bucket = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    placed = bucketed.join(starts, key & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("_u").rangeBetween(Window.unboundedPreceding, -1)
    reached = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = (reached + F.col("size") / 2 <= F.col("_extra")) & (F.col("size") > 0)
    return placed.withColumn("repeats", F.col("_whole") + extra.cast("long")).withColumn("taken", F.col("size") * F.col("repeats")).select("doc_id", "row_key", "size", "source_size", "target", "repeats", "taken")


def mix(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """The mixture itself: every row of docs as many times as mix_plan() has it, all columns as they were."""
    plan = mix_plan(docs, seed=seed, **options).where("repeats > 0").groupBy("row_key").agg(F.first("repeats").alias("repeats"))
    # the row in one column, so that no name of its own can clash
    keyed = docs.select(F.struct("*").alias("whole"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))).alias("row_key"))
    return keyed.join(plan, "row_key").select("whole", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy")).select("whole.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
