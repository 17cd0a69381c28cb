"""Chat formatting: preference pairs as one prompt and two masked completions. Built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<turn:long,role:string,text:string>>"


def rendered(turns: Column) -> Column:
    """<|role|>, a newline, the text, <|end|>, a newline, for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def answer_spans(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Where in rendered(turns) the loss counts: text and end mark of each turn by `roles`, as (start, end) in code points."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + 7
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"].isin(*roles), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def format_preferences(turns: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per pair_id of turns (pair_id, side: 'chosen' or 'rejected', turn, role, text).

    Both conversations are put in order of turn (role, then text, among equal turns; null turns first; repeated rows stay). Their longest
    common prefix of equal (role, text) turns is rendered once as `prompt`; what is left of each is a completion, with a mask
    of the spans where the loss counts (see answer_spans). Null roles are 'unknown', null texts are empty. `usable` is false
    if a side is missing or either completion has no masked span; such rows are kept. Rows with a null pair_id or
    another side are no pair and are left out. A conversation is one training row, so its turns meet in one row: one shuffle, and
    nothing else is gathered.
    """
    own = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, own))).alias(s)
    both = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    shared = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.zip_with(F.slice("chosen", 1, F.greatest(shared, F.lit(1))), F.slice("rejected", 1, F.greatest(shared, F.lit(1))), lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])))
    place = F.array_position(differ, True)
    both = both.withColumn("n_shared", F.when(shared == 0, 0).when(place > 0, place - 1).otherwise(shared).cast("long"))
    rest = lambda s: F.slice(s, F.col("n_shared").cast("int") + 1, F.greatest(F.size(s) - F.col("n_shared").cast("int"), F.lit(0)))
    both = both.select("pair_id", "n_shared", F.slice("chosen", 1, F.col("n_shared").cast("int")).alias("_p"), rest("chosen").alias("_c"), rest("rejected").alias("_r"), F.size("chosen").alias("_nc"), F.size("rejected").alias("_nr"))
    out = both.select("pair_id", "n_shared", rendered(F.col("_p")).alias("prompt"), rendered(F.col("_c")).alias("chosen"), answer_spans(F.col("_c"), roles).alias("chosen_mask"), rendered(F.col("_r")).alias("rejected"), answer_spans(F.col("_r"), roles).alias("rejected_mask"), "_nc", "_nr")
    return out.withColumn("usable", (F.col("_nc") > 0) & (F.col("_nr") > 0) & (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)).drop("_nc", "_nr")


def mask_text(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def answered_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text: each conversation (conv_id, turn, role, text) is chosen; rejected are its own turns before its last answer, with the last answer of the next conversation in that place.

    Answers are turns of role assistant; the last one is that of the largest turn (and text, among equal turns). The next conversation is that of conv_id + 1.
    A conversation without an answer, or whose next one has none, has no rejected side. Null conv_ids and turns aren't paired.
    """
    said = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = said.where(F.col("conv_id") > -(1 << 63)).select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("text"))
    swaps = said.select("conv_id", F.col("last.turn").alias("at")).join(other, "conv_id")
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    before = own.join(swaps.select(F.col("conv_id").alias("pair_id"), "at"), "pair_id").where(F.col("turn") < F.col("at")).drop("at")
    swapped = before.unionByName(swaps.select(F.col("conv_id").alias("pair_id"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), "text"))
    return own.withColumn("side", F.lit("chosen")).unionByName(swapped.withColumn("side", F.lit("rejected")))


def op3_preferences(spark, sf_dir: str) -> DataFrame:
    """The table holds no preferences: each conversation stands against itself with another's last answer (see answered_pairs), so both sides share their turns before."""
    pairs = answered_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return format_preferences(pairs).withColumn("chosen_mask", mask_text("chosen_mask")).withColumn("rejected_mask", mask_text("rejected_mask"))


OP3_SQL = """
WITH a AS (SELECT conv_id, max(turn) AS place, max_by(coalesce(text, ''), (turn, coalesce(text, ''))) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant' GROUP BY conv_id),
v AS (SELECT a.conv_id, a.place, b.text FROM a JOIN a b ON b.conv_id = a.conv_id + 1),
s AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, 'rejected', turn, role, c.text FROM conversations c JOIN v USING (conv_id) WHERE turn < place
  UNION ALL SELECT conv_id, 'rejected', place, 'assistant', text FROM v),
t AS (SELECT pair_id, side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos FROM s),
c AS (SELECT * FROM t WHERE side = 'chosen'), r AS (SELECT * FROM t WHERE side = 'rejected'),
d AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos),
p AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n_shared FROM d GROUP BY pair_id),
w AS (SELECT t.*, p.n_shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM t JOIN p USING (pair_id)),
x AS (SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY pos) - length(body) AS at0 FROM w WHERE pos > n_shared),
y AS (SELECT *, (at0 + length(role) + 5)::BIGINT AS s, (at0 + length(body) - 1)::BIGINT AS e FROM x)
SELECT p.pair_id, p.n_shared,
  coalesce((SELECT string_agg(body, '' ORDER BY pos) FROM w WHERE w.pair_id = p.pair_id AND side = 'chosen' AND pos <= w.n_shared), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (side = 'chosen'), '') AS chosen,
  coalesce(string_agg(s || ':' || e, ',' ORDER BY pos) FILTER (side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (side = 'rejected'), '') AS rejected,
  coalesce(string_agg(s || ':' || e, ',' ORDER BY pos) FILTER (side = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (side = 'chosen' AND role = 'assistant') > 0 AND count(*) FILTER (side = 'rejected' AND role = 'assistant') > 0 AS usable
FROM p LEFT JOIN y USING (pair_id) GROUP BY p.pair_id, p.n_shared
"""
