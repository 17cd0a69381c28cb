"""Conversation structure repair: cheapest edits by a fold over sorted turns. Built-in functions alone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: turns of one fold; a longer conversation is folded in blocks
BLOCK = 256
WORDY = r"[^\x20\x09-\x0D]"
#: what can stand before: nothing (0), the system turn (1), a user turn (2), an assistant turn (3); a repaired conversation ends in 0 or 3
STATES = 4
BEST = "struct<c:bigint,a:string>"
FOUR = f"array<{BEST}>"
TURN = ("turn", "role", "text")


def with_damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: what crc32 of `conv_id:turn` mod 20 does to each row. 0 drops it (gone), 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes its role user; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), d.alias("_d"))
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with place (0 for the first of a conversation), fault ('blank', 'duplicate', 'truncated' or ''), joint (the initials of the row before and this one) and is_new (the turn has a number that the row before hasn't).

    The order is by turn (nulls first), then role and text. All windows are by conversation, so one shuffle serves them.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    # by place and not by turn: of equal rows the first in this order is the original
    seen = F.min("place").over(Window.partitionBy("conv_id", "role", "text")) < F.col("place")
    blank, ended = ~F.rlike("text", F.lit(WORDY)), F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    rows = rows.withColumn("fault", F.when(blank, "blank").when(seen, "duplicate").when(~ended, "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("joint", F.concat(F.lag(initial).over(order), initial))
    return rows.withColumn("is_new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def more(best: Column, cost: Column | int, letters: str) -> Column:
    """A (cost, audit) struct with edits added; null stays null, so that least() passes it over."""
    return F.when(best.isNotNull(), F.struct((best["c"] + cost).cast("long").alias("c"), F.concat(best["a"], F.lit(letters)).alias("a")))


def _four(*best: Column) -> Column:
    return F.array(*[b.cast(BEST) for b in best])


def with_inserts(s: Column) -> Column:
    """The four bests when empty turns may be inserted first: a user turn after 0, 1 or 3, an assistant turn after 2, or both."""
    return _four(s[0], s[1], F.least(s[2], more(s[0], 2, "I"), more(s[1], 2, "I"), more(s[3], 2, "I")), F.least(s[3], more(s[2], 2, "I"), more(s[0], 4, "II"), more(s[1], 4, "II")))


def with_turn(s: Column, t: Column) -> Column:
    """The four bests after a turn t (initial, must: it has to go, late: 1 if truncated): kept as it is, given the role that fits, or deleted."""
    on = lambda i, b: F.when(t["initial"] == i, more(b, t["late"], "K"))
    given = lambda b: more(b, t["late"] + 2, "R")
    gone = [more(s[k], 3, "D") for k in range(STATES)]
    stays = lambda b: F.when(~t["must"], b)
    to_user = F.least(s[0], s[1], s[3])  # all three take the same edits from here
    return _four(gone[0], F.least(gone[1], stays(on("s", s[0]))), F.least(gone[2], stays(F.least(on("u", to_user), given(to_user)))), F.least(gone[3], stays(F.least(on("a", s[2]), given(s[2])))))


def folded(turns: Column) -> Column:
    """For each state before a block the four bests after all its turns."""
    nothing = F.struct(F.lit(0).cast("long").alias("c"), F.lit("").alias("a"))
    starts = F.array(*[_four(*[nothing if k == start else F.lit(None) for k in range(STATES)]) for start in range(STATES)])
    return F.transform(starts, lambda begin: F.aggregate(turns, begin, lambda s, t: let(with_inserts(s), lambda w: with_turn(w, t))))


def joined(blocks: Column) -> Column:
    """Four (cost, audit, path) over a conversation's blocks: path has the state before each block and after the last.

    Edits of a block follow those before it: their costs add up, audits join, and the least of the four ways into a state stays.
    """
    kind = "struct<c:bigint,a:string,p:string>"
    begin = F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit("").alias("a"), F.lit("0").alias("p")).cast(kind), *[F.lit(None).cast(kind)] * (STATES - 1))

    def via(s: Column, b: Column, k: int, e: int) -> Column:
        step = b["four"][k][e]
        return F.when(s[k].isNotNull() & step.isNotNull(), F.struct((s[k]["c"] + step["c"]).alias("c"), F.concat(s[k]["a"], step["a"]).alias("a"), F.concat(s[k]["p"], F.lit(str(e))).alias("p")))

    return F.aggregate(blocks, begin, lambda s, b: F.array(*[F.least(*[via(s, b, k, e) for k in range(STATES)]).cast(kind) for e in range(STATES)]))


def repaired_lines(turns: Column, start: Column, audit: Column) -> Column:
    """role:text of the turns of a block that an audit from a state leaves. Roles alternate from the state on, but for a system turn that is kept first."""
    letters = F.split(audit, "")
    before = lambda p, drop: F.length(F.translate(F.substring(audit, 1, p), drop, ""))  # noqa: E731  # letters among the first p that are not `drop`
    first = F.array_position(F.transform(letters, lambda c: c != "D"), True)
    head = F.when((start == "0") & (first > 0) & (F.element_at(letters, F.greatest(first, F.lit(1)).cast("int")) == "K"), F.when(turns[before((first - 1).cast("int"), "I")]["initial"] == "s", 1).otherwise(0)).otherwise(F.when(start == "2", 1).otherwise(0))

    def line(c: Column, p: Column) -> Column:
        own = turns[before(p, "I")]
        role = F.when((before(p, "D") - head) % 2 == 0, "user").otherwise("assistant")
        return F.when(c == "K", F.concat(own["role"], F.lit(":"), own["text"])).when(c == "R", F.concat(role, F.lit(":"), own["text"])).when(c == "I", F.concat(role, F.lit(":")))

    return F.when(audit == "", F.array().cast("array<string>")).otherwise(let(head, lambda h: F.filter(F.transform(letters, line), lambda x: x.isNotNull())))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, gone): gaps, blank, duplicate, truncated, illegal, cost, audit, n_repaired and repaired.

    Faults and joints come from windows. The turns of `block` places are one array, and a fold over it carries four (cost, audit) structs, one for
    each state, from each of the four states before the block; a second fold joins the blocks of a conversation, so audits of long
    ones are joined from pieces and not turn by turn. Native least() of structs takes the smaller cost and, among equal ones, the audit that comes first in ASCII.

    A turn of another initial than s, u or a can be given a role or deleted. Rows of a null conv_id are one conversation. Repeated rows are duplicates of one another. A
    conversation all of whose rows are gone has zeros, an empty audit and no text.
    """
    own = with_faults(rows.where("not gone"))
    count = lambda f: F.sum((F.col("fault") == f).cast("long")).alias(f)
    turn = F.struct("place", F.substring("role", 1, 1).alias("initial"), F.col("fault").isin("blank", "duplicate").alias("must"), (F.col("fault") == "truncated").cast("int").alias("late"), "role", "text")
    own = own.select("conv_id", F.floor(F.col("place") / block).alias("block"), "turn", "fault", (F.col("joint").isNotNull() & ~F.col("joint").isin("su", "ua", "au")).cast("long").alias("bad"), F.col("is_new").cast("long").alias("is_new"), turn.alias("t"))
    blocks = own.repartition("conv_id", "block").groupBy("conv_id", "block").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("is_new").alias("numbers"), count("blank"), count("duplicate"), count("truncated"), F.sum("bad").alias("illegal"), F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = blocks.withColumn("four", folded(F.col("turns")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    whole = blocks.groupBy("conv_id").agg((F.max("high") - F.min("low") + 1 - F.sum("numbers")).alias("gaps"), *[total(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.struct("block", "turns", "four"))).alias("blocks"))
    whole = whole.withColumn("s", joined(F.col("blocks")))
    last = F.when(F.col("s")[3].isNotNull(), F.struct(F.col("s")[3]["c"].alias("c"), F.col("s")[3]["a"].alias("a"), F.lit("").alias("tail"), F.col("s")[3]["p"].alias("p")))
    closing = lambda k, cost, tail: F.when(F.col("s")[k].isNotNull(), F.struct((F.col("s")[k]["c"] + cost).alias("c"), F.concat(F.col("s")[k]["a"], F.lit(tail)).alias("a"), F.lit(tail).alias("tail"), F.col("s")[k]["p"].alias("p")))
    whole = whole.withColumn("best", F.least(closing(0, 0, ""), last, closing(2, 2, "I"), closing(1, 4, "II"), closing(0, 4, "II")))
    state = lambda i: F.substring(F.col("best.p"), i, F.lit(1))
    lines = F.flatten(F.transform("blocks", lambda b, i: repaired_lines(b["turns"], state(i + 1), b["four"][state(i + 1).cast("int")][state(i + 2).cast("int")]["a"])))
    added = F.when(F.col("best.tail") == "II", F.array(F.lit("user:"), F.lit("assistant:"))).when(F.col("best.tail") == "I", F.array(F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    fixed = whole.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.a").alias("audit"), F.concat(lines, added).alias("_lines"))
    fixed = fixed.select("*", F.size("_lines").cast("long").alias("n_repaired"), F.array_join("_lines", "\n").alias("repaired")).drop("_lines")
    gone = rows.groupBy("conv_id").agg(F.min("gone").alias("all")).where("all").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.lit(0).cast("long").alias("n_repaired"), F.lit("").alias("repaired"))
    return fixed.unionByName(gone)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    out = repair(with_damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


OP12_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
k AS (SELECT *, row_number() OVER () AS id, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: unicode(substring(key, i::INT, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d FROM k, crc),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d <> 0),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN min(pos) OVER (PARTITION BY conv_id, role, text) < pos THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM z),
g AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS joint FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM g GROUP BY conv_id),
-- a best way is text: five digits of cost, then the edits; so the least text is the least cost and, among equals, the first audit. x adds edits
p AS (SELECT conv_id, 0::BIGINT AS pos, '00000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM n
  UNION ALL
  SELECT w.conv_id, w.pos + 1,
    x(w.s0, 3, 'D'),
    least(x(w.s1, 3, 'D'), CASE WHEN NOT must AND i = 's' THEN x(w.s0, late, 'K') END),
    least(x(w.w2, 3, 'D'), CASE WHEN NOT must AND i = 'u' THEN least(x(w.s0, late, 'K'), x(w.s1, late, 'K'), x(w.w3, late, 'K')) END, CASE WHEN NOT must THEN least(x(w.s0, late + 2, 'R'), x(w.s1, late + 2, 'R'), x(w.w3, late + 2, 'R')) END),
    least(x(w.w3, 3, 'D'), CASE WHEN NOT must AND i = 'a' THEN x(w.w2, late, 'K') END, CASE WHEN NOT must THEN x(w.w2, late + 2, 'R') END)
  FROM (SELECT *, least(s2, x(s0, 2, 'I'), x(s1, 2, 'I'), x(s3, 2, 'I')) AS w2, least(s3, x(s2, 2, 'I'), x(s0, 4, 'II'), x(s1, 4, 'II')) AS w3 FROM p) w
  JOIN (SELECT conv_id, pos, i, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INT AS late FROM g) t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1),
e AS (SELECT n.*, least(s0, s3, x(s2, 2, 'I'), x(s1, 4, 'II'), x(s0, 4, 'II')) AS best FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.pos = n.last),
l AS (SELECT conv_id, j, substring(substring(best, 6), j::INT, 1) AS c, left(substring(best, 6), j::INT) AS upto FROM (SELECT *, unnest(range(1, length(best) - 4)) AS j FROM e)),
m AS (SELECT l.conv_id, j, c, length(replace(upto, 'D', '')) AS kept, g.role, g.text, g.i FROM l LEFT JOIN g ON c <> 'I' AND g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.pos = length(replace(upto, 'I', ''))),
o AS (SELECT *, max((kept = 1 AND c = 'K' AND i = 's')::INT) OVER (PARTITION BY conv_id) AS head FROM m WHERE c <> 'D'),
t AS (SELECT conv_id, count(*) AS n_repaired, string_agg(CASE WHEN c = 'K' THEN role ELSE CASE WHEN (kept - head) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM o GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 5)::BIGINT, 0) AS cost, coalesce(substring(best, 6), '') AS audit, coalesce(n_repaired, 0) AS n_repaired, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _spelled(sql: str) -> str:
    """x(best, cost, letters) written out, as a query can't define a macro."""
    return re.sub(r"x\((\w[.\w]*), ([^,()]+), ('\w+')\)", r"(lpad((left(\1, 5)::INT + \2)::VARCHAR, 5, '0') || substring(\1, 6) || \3)", sql)


OP12_SQL = _spelled(OP12_SQL)
