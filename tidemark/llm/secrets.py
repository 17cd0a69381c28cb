"""Secret scans: base patterns, and credentials told from examples by corpus-wide ownership frequency. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

# The base kinds as the contract lists them, in its order (Java syntax; (?i:) holds for ASCII letters alone).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: what the method adds: long tokens that no base pattern names and that mix digits, capitals and small letters; kept only where their owners are few
TOKEN = r"[A-Za-z0-9+/_-]{28,}"
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
KINDS = ("assign", "access", "hex", "owned")
#: characters of the blocks from which a redacted text is put together
CUT = 4096

SPAN = "struct<kind:int,start:long,end:long,value:string>"


def spans_of(text: Column, pattern: str, kind: int, least: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (kind, start, end, value) in code points; those whose value is shorter than `least` go.

    A split at the pattern gives the text between the matches: each match starts where the pieces and matches before it end. Matches are
    walked in runs of about the square root of their number, so that no long array is built element by element. Texts without a match skip all but the first look.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, 1, F.size(whole)), lambda p: F.length(p)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("len"), values.alias("value"))
    found = once(pairs, lambda all_: once(F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(all_))).cast("int")), lambda k: _walked(all_, k, kind)))
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(_empty())


def once(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _walked(pairs: Column, k: Column, kind: int) -> Column:
    """Spans of pairs (gap, len, value), k of them to a run: lengths of runs first, from them where each run starts, then the spans of each."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / k).cast("int")), lambda i: F.slice(pairs, i * k + 1, k))
    starts_of = lambda runs: F.aggregate(F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, p: n + p["gap"] + p["len"])), F.array(F.lit(0).cast("long")), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + p["len"]).alias("end"), p["value"].alias("value")).cast(SPAN)
        return F.struct((begin + p["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), _empty().alias("out")), step, lambda acc: acc["out"])
    return once(cut, lambda runs: F.flatten(F.zip_with(runs, F.slice(starts_of(runs), 1, F.size(runs)), spans)))


def _in_order(spans: Column) -> Column:
    """By start, then kind."""
    placed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return F.transform(placed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(_in_order(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _apart(found: DataFrame) -> DataFrame:
    """A row for each span s of base, and for each of added that overlaps none of them; where a text has both, an ordered pass over its spans tells."""
    columns = ("row", "owner", "repository", "s")
    both = (F.size("base") > 0) & (F.size("added") > 0)
    spread = lambda rows: rows.select("row", "owner", "repository", F.explode(F.concat("base", "added")).alias("s"))
    ordered = Window.partitionBy("row").orderBy("s.start", "s.kind")
    is_base = F.col("s.kind") < 3
    over = F.max(F.when(is_base, F.col("s.end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))  # base spans that start no later: kinds before 3 come first
    backwards = Window.partitionBy("row").orderBy(F.col("s.start").desc(), F.col("s.kind").desc())
    ahead = F.min(F.when(is_base, F.col("s.start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    told = spread(found.where(both)).withColumn("_over", over).withColumn("_ahead", ahead)
    free = (F.coalesce("_over", F.lit(0)) <= F.col("s.start")) & (F.coalesce("_ahead", F.col("s.end")) >= F.col("s.end"))
    return spread(found.where(~both)).unionByName(told.where(is_base | free).select(*columns))


def _judged(docs: DataFrame, owner: str, repository: str | None, live_owners: int, live_repositories: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(every row with its base and added candidates, the live spans of those rows that have any)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans_of(text, ASSIGN, 0, 6, 2), spans_of(text, ACCESS, 1, 20), spans_of(text, HEX, 2, 24))
    held = [F.struct("*").alias("whole")] if whole else []
    place = F.col(repository if repository else owner)
    # the row in one column, so that no name of its own can clash
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).alias("owner"), place.alias("repository"), text.alias("text"), base.alias("base"), *held)
    mixed = lambda s: F.rlike(s["value"], F.lit(MIXED[0])) & F.rlike(s["value"], F.lit(MIXED[1])) & F.rlike(s["value"], F.lit(MIXED[2]))
    added = F.filter(spans_of(F.col("text"), TOKEN, 3, 28), mixed)
    found = materialise(found.select("row", "doc_id", "owner", "repository", "base", added.alias("added"), *(["whole"] if whole else [])), "candidates")
    each = _apart(found).select("row", "owner", "repository", "s", F.xxhash64("s.value").alias("hash"))
    places = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    spread = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  # a null counts as one of its own
    by_hash = places.groupBy("hash").agg(spread("owner").alias("owners"), spread("repository").alias("repositories"))
    live = by_hash.where((F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))
    judged = each.join(live, "hash").groupBy("row").agg(F.collect_list("s").alias("live"))
    return found, judged


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str | None = None, live_owners: int = 2, live_repositories: int = 2) -> DataFrame:
    """For every row of docs: doc_id, base (spans of the contract's patterns), spans (base and added), live (spans to redact).

    Each candidate's value is hashed, and the hashes are counted over the whole corpus by distinct owner and distinct repository
    (columns of docs; without a repository column an owner is one repository; null counts as one of its own): first one row per hash,
    owner and repository, with partial sums, so that an example in a third of all rows costs a row per task; then per hash. A
    value held by at most `live_owners` owners and `live_repositories` repositories looks live, one held by more is a copied example. Only live
    hashes go back to the rows. `owned` candidates (runs of TOKEN with a digit, a capital and a small letter, of any length, outside all
    base spans) are added as spans only when live; base spans stay in any case. Null texts are empty; repeated rows count once per owner
    and each get their own result; an empty table gives none. base, spans and live are arrays of (kind, start, end, value), in order
    of start and kind. All in built-in functions.
    """
    found, judged = _judged(docs, owner, repository, live_owners, live_repositories, False)
    rows = found.join(judged, "row", "left").withColumn("live", _in_order(F.coalesce("live", _empty())))
    added = F.filter("live", lambda s: s["kind"] == 3)
    return rows.select("doc_id", _in_order(F.col("base")).alias("base"), _in_order(F.concat("base", added)).alias("spans"), "live")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))


def _with_gaps(judged: DataFrame) -> DataFrame:
    """row and its live spans in order, each with `after`: the end of what the spans before it cover."""
    ordered = Window.partitionBy("row").orderBy("s.start", "s.kind")
    each = judged.select("row", F.explode("live").alias("s")).withColumn("after", F.coalesce(F.max("s.end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "after"))).alias("live"))


def redact(docs: DataFrame, owner: str = "source", repository: str | None = None, live_owners: int = 2, live_repositories: int = 2, mark: str = "[SECRET]") -> DataFrame:
    """docs with live-looking spans replaced by `mark` (overlapping spans by one); columns and rows stay, texts without such spans unchanged.

    Rows without any candidate are not shuffled; the others are joined to their live spans by row.
    """
    found, judged = _judged(docs, owner, repository, live_owners, live_repositories, True)
    suspect = (F.size("base") > 0) | (F.size("added") > 0)
    text = F.col("whole.text")
    # pieces are cut from blocks of the text: a cut deep in a long text would count its characters from the start each time
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda i: F.substring(text, i * CUT + 1, F.lit(CUT)))

    def piece(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CUT).cast("int")
        last = F.floor(end / CUT).cast("int")
        near = F.when(first == last, held[first]).otherwise(F.array_join(F.slice(held, first + 1, last - first + 1), ""))
        return F.substring(near, (start % CUT + 1).cast("int"), (end - start).cast("int"))

    def cut(held: Column) -> Column:
        kept = F.transform("live", lambda s: F.when(s["start"] >= s["after"], F.concat(piece(held, s["after"], s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), piece(held, F.array_max(F.transform("live", lambda s: s["end"])), F.length(text)))

    marked = found.where(suspect).select("row", "whole").join(_with_gaps(judged), "row", "left")
    marked = marked.select(F.col("whole").withField("text", F.when(F.col("live").isNull(), text).otherwise(once(blocks, cut))).alias("whole"))
    return marked.unionByName(found.where(~suspect).select("whole")).select("whole.*")
