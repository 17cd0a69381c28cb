"""Quality classifier: an interpolated modified Kneser-Ney n-gram model over bytes, scored by sharded count joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_stream, materialise, pack_texts, row_key, row_keys, stream_groups, text_chunks, unpack_texts

ORDER = 5
#: a natural log of a probability travels as -log(p) in steps of 1 / STEPS, two bytes each; from 32 on as a double after them
STEPS = 2048
#: characters a batch of texts has: what a worker holds at once follows from it
CHUNK = 1_500_000
START, END = 2, 3
ROWS = "key long, kind int, batch long, codes binary, counts binary"


def packed(a: np.ndarray) -> bytes:
    """Ascending or small int64 values in few bytes: differences, byte planes, zstd."""
    return zstandard.compress(np.diff(a, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel())


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code of the ORDER bytes that end at each predicted byte, number of predictions of each text); a text ends with END, which is predicted as well."""
    raw = [bytes([START]) * (ORDER - 1) + (t or "").encode("utf-8", "surrogatepass") + bytes([END]) for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    codes = a[: len(a) - ORDER + 1].copy()
    for k in range(1, ORDER):
        codes = (codes << 8) | a[k : len(a) - ORDER + 1 + k]
    begins = np.cumsum(sizes) - sizes
    valid = np.ones(len(a), bool)
    for k in range(ORDER - 1):
        valid[begins + k] = False
    return codes[valid[ORDER - 1 :]], sizes - (ORDER - 1)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last: a shard then holds whole contexts of two bytes and more."""
    mixed = ((codes >> 8) & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes, place of each code among them); by hashing, as codes repeat much."""
    labels, found = pd.factorize(codes)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[labels]


def _count_rows(shards: int, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            codes, place = distinct(ngrams(rows["text"])[0])
            counts, shard = np.bincount(place, minlength=len(codes)), shard_of(codes, shards)
            keys = np.unique(shard)
            yield pa.record_batch({"key": pa.array(keys), "codes": pa.array([packed(codes[shard == k]) for k in keys], pa.binary()), "counts": pa.array([packed(counts[shard == k]) for k in keys], pa.binary())})

    return run


def _sum_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a shard added up, a batch's at a time."""
    def rows() -> Iterator[tuple[int, bytes, bytes]]:
        for b in batches:
            yield from zip(b.column("key").to_pylist(), b.column("codes").to_pylist(), b.column("counts").to_pylist())

    for key, group in groupby(rows(), lambda r: r[0]):
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, c, n in group:
            more = unpacked(c)
            both, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, unpacked(n)]), minlength=len(both)).astype(np.int64)
            codes = both
        yield pa.record_batch({"key": pa.array([key], pa.int64()), "codes": pa.array([packed(codes)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})


def orders(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) for orders ORDER down to 3: raw counts on top, below the number of distinct bytes before (all within a shard)."""
    out = [(codes, counts)]
    for n in range(ORDER - 1, 2, -1):
        out.append(np.unique(out[-1][0] & ((1 << 8 * n) - 1), return_counts=True))
    return out


def _stat_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of counts 1 to 4 by order, as (order, -k, n), and the shard's part of the two-byte continuation counts, as (2, code, n)."""
    for b in batches:
        for c, n in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist()):
            levels = orders(unpacked(c), unpacked(n))
            rows = [(ORDER - i, -k, int((counts == k).sum())) for i, (_, counts) in enumerate(levels) for k in (1, 2, 3, 4)]
            pairs, counts = np.unique(levels[-1][0] & 0xFFFF, return_counts=True)
            o, k, v = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.record_batch({"ord": np.concatenate([o, np.full(len(pairs), 2)]), "k": np.concatenate([k, pairs]), "n": np.concatenate([v, counts])})


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more from the numbers of n-grams seen 1, 2, 3, 4 times; where those are too few, 0.5, 1, 1.5."""
    n1, n2, n3, n4 = n
    if min(n) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.15], [0, 1, 2, 3])


def interpolate(codes: np.ndarray, counts: np.ndarray, d: np.ndarray, asked: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(last byte | the bytes before) of the asked codes at one order: discounted share plus the context's weight times the lower order."""
    if not len(codes):
        return lower
    context = codes >> 8
    firsts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    known = context[firsts]
    total = np.add.reduceat(counts, firsts)
    cut = d[np.minimum(counts, 3)]
    freed = np.add.reduceat(cut, firsts) / total
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    seen = np.where(codes[at] == asked, counts[at] - cut[at], 0.0)
    place = np.minimum(np.searchsorted(known, asked >> 8), len(known) - 1)
    hit = known[place] == asked >> 8
    return np.where(hit, seen / total[place] + freed[place] * lower, lower)


class Backoff:
    """What every shard needs besides its own counts; at most 65,536 numbers: discounts by order and the two-byte probabilities."""

    def __init__(self, stats: list[tuple[int, int, int]]):
        table = np.zeros(65536, np.int64)
        seen = {}
        for o, k, n in stats:
            if k >= 0:
                table[k] = n
            else:
                seen[(o, -k)] = n
        self.d = {o: discounts([seen.get((o, k), 0) for k in (1, 2, 3, 4)]) for o in range(3, ORDER + 1)}
        pairs = np.flatnonzero(table)
        ones, one_counts = np.unique(pairs & 0xFF, return_counts=True)
        of = lambda c: discounts([int((c == k).sum()) for k in (1, 2, 3, 4)])
        every = np.arange(65536)
        single = interpolate(ones, one_counts, of(one_counts), every & 0xFF, np.full(65536, 1 / 256))
        self.two = interpolate(pairs, table[pairs], of(table[pairs]), every, single)


def logs_packed(logs: np.ndarray) -> bytes:
    steps = np.minimum(np.rint(logs * -STEPS), 65535).astype("<u2")
    return steps.tobytes() + logs[steps == 65535].astype("<f8").tobytes()


def logs_unpacked(body: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(body, "<u2", n)
    out = steps / -STEPS
    out[steps == 65535] = np.frombuffer(body, "<f8", -1, 2 * n)
    return out


def _answer_rows(backoff: Backoff) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each key the counts come first (kind 0), then requests (kind 1), answered one at a time."""
        last, levels = None, []
        for b in batches:
            out: list[tuple] = []
            for key, kind, batch, shard, codes, counts in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "batch", "shard", "codes", "counts"))):
                if key != last:
                    last, levels = key, []
                if kind == 0:
                    levels = orders(unpacked(codes), unpacked(counts))
                    continue
                asked = unpacked(codes)
                p = backoff.two[asked & 0xFFFF]
                for n in range(3, ORDER + 1):
                    if levels:
                        p = interpolate(*levels[ORDER - n], backoff.d[n], asked & ((1 << 8 * n) - 1), p)
                out.append((batch, shard, logs_packed(np.log(p))))
            if out:
                yield pa.record_batch({"key": pa.array([r[0] for r in out], pa.int64()), "shard": pa.array([r[1] for r in out], pa.int64()), "body": pa.array([r[2] for r in out], pa.binary())})

    return run


def _request_rows(shards: int, salts: int, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            batch, _ = pack_texts(rows["doc_id"], rows["text"], rows["lang"])
            codes, _ = distinct(ngrams(rows["text"])[0])
            shard = shard_of(codes, shards)
            keys = np.unique(shard)
            yield pa.record_batch({"key": pa.array(keys * salts + batch % salts), "kind": pa.array(np.ones(len(keys)), pa.int32()), "batch": pa.array(np.full(len(keys), batch)), "shard": pa.array(keys), "codes": pa.array([packed(codes[shard == k]) for k in keys], pa.binary()), "counts": pa.nulls(len(keys), pa.binary())})

    return run


def _text_rows(chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            batch, blob = pack_texts(rows["doc_id"], rows["text"], rows["lang"])
            yield pa.record_batch({"key": pa.array([batch], pa.int64()), "shard": pa.array([-1], pa.int64()), "body": pa.array([blob], pa.binary())})

    return run


def _score_rows(shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, table in stream_groups(batches):
            at, body = np.asarray(table.column("shard")), table.column("body").to_pylist()
            answers = {int(k): v for k, v in zip(at, body) if k >= 0}
            for i in np.flatnonzero(at < 0).tolist():  # more than one only where whole batches repeat
                docs = unpack_texts(body[i])
                grams, counts = ngrams(docs.column("text").to_pylist())
                codes, place = distinct(grams)
                shard, logs = shard_of(codes, shards), np.full(len(codes), np.nan)
                for k, v in answers.items():
                    mine = shard == k
                    logs[mine] = logs_unpacked(v, int(mine.sum()))
                if np.isnan(logs).any():
                    raise RuntimeError("a batch of texts differs from the one that was asked for: read docs from a table")
                sums = np.add.reduceat(logs[place], np.cumsum(counts) - counts)
                keys = row_keys(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())
                yield pa.record_batch({"row": pa.array(keys, pa.int64()), "doc_id": docs.column("doc_id").combine_chunks(), "lang": docs.column("c0").combine_chunks(), "n_bytes": pa.array(counts - 1, pa.int64()), "perplexity": pa.array(np.exp(-sums / counts))})

    return run


def trusted(labels: DataFrame, seed: int = 4) -> DataFrame:
    """doc_id and fold (0 to 4, by a seeded hash) of the documents that all their labels call good and none toxic."""
    sums = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return sums.where("good = 1 and toxic = 0").select("doc_id", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)).alias("fold"))


def perplexities(docs: DataFrame, fitted: DataFrame, shards: int = 64, chunk: int = CHUNK) -> DataFrame:
    """row (row_key()), doc_id, lang, n_bytes and perplexity a byte of every row of docs (doc_id, text, lang), under a model of the fitted rows' texts.

    fitted (doc_id, no repeats) may be as large as docs. The counts of all their texts are summed by
    shard, where continuation counts and contexts of two bytes and more are whole; the two-byte table and the discounts
    are bounded by 65,536 numbers and go to every task. Then each batch of texts asks each shard for its distinct n-grams
    (a row per batch and shard), and the answers meet the batch's texts, packed, again. Requests of one shard
    are dealt over salts of about a thousand batches each. Every byte of every text is scored. docs must read the same both times, as a table
    does; a batch that differs raises. Null and empty texts are an END alone. Without fitted text every byte has probability 1/256.
    """
    slim = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    chars = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    salts = max(1, -(-chars // (1000 * chunk)))
    chosen = slim.join(fitted.select("doc_id"), "doc_id", "left_semi").select("text")
    parts = chosen.mapInArrow(_count_rows(shards, chunk), "key long, codes binary, counts binary")
    counts = materialise(keyed_stream(parts, "key").mapInArrow(_sum_rows, "key long, codes binary, counts binary"), "counts")
    stats = counts.mapInArrow(_stat_rows, "ord long, k long, n long").groupBy("ord", "k").agg(F.sum("n").alias("n"))
    backoff = Backoff([tuple(r) for r in stats.collect()])  # at most 65,536 two-byte codes and 12 counts of counts
    salted = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    model = salted.select((F.col("key") * salts + F.col("salt")).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), F.col("key").alias("shard"), "codes", "counts")
    columns = "key long, kind int, batch long, shard long, codes binary, counts binary"
    asked = slim.mapInArrow(_request_rows(shards, salts, chunk), columns)
    answers = keyed_stream(model.unionByName(asked), "key", "kind").mapInArrow(_answer_rows(backoff), "key long, shard long, body binary")
    texts = slim.mapInArrow(_text_rows(chunk), "key long, shard long, body binary")
    return keyed_stream(texts.unionByName(answers), "key").mapInArrow(_score_rows(shards), "row long, doc_id long, lang string, n_bytes long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, shards: int = 64) -> DataFrame:
    """row (row_key()), doc_id, lang, n_bytes, perplexity, threshold, kept for every row of docs, judged by its language's threshold.

    The model is fitted on all trusted rows of four folds in five, so it grows with the corpus; thresholds come from the fifth, whose texts
    the model hasn't seen: a language's `quantile` of their perplexities. A document whose labels contradict one another isn't trusted.
    A language (or null) without held-out rows takes the quantile over all; without any, all rows are kept. Rows without bytes have no
    perplexity to judge and are kept for other rules. Repeated doc_ids each get their row; empty tables give none.
    """
    known = materialise(trusted(labels), "trusted")
    scores = materialise(perplexities(docs, known.where("fold < 4"), shards), "scores")
    seen = scores.where("n_bytes > 0").join(known.where("fold = 4"), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by_lang = seen.groupBy(F.col("lang").alias("_lang")).agg(cut.alias("_cut"))
    overall = seen.agg(cut).first()[0]
    judged = scores.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("_cut", F.lit(overall).cast("double"))).drop("_lang", "_cut")
    return judged.withColumn("kept", F.coalesce((F.col("n_bytes") == 0) | (F.col("perplexity") <= F.col("threshold")), F.lit(True)))


def error_rates(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, ...] = (0.95, 0.98, 0.99, 0.995, 0.998), shards: int = 64) -> DataFrame:
    """quantile, good_kept, bad_kept: what each quantile would keep of trusted rows that neither model nor threshold has seen, and of rows labelled bad.

    As classify(), but half of the held-out fold (by a hash) sets the thresholds and the other half is judged. Rows of a language without threshold count as kept.
    """
    known = materialise(trusted(labels), "trusted")
    scores = materialise(perplexities(docs, known.where("fold < 4"), shards).where("n_bytes > 0"), "scores")
    bad = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 0").select("doc_id")
    held = known.where("fold = 4").select("doc_id", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0).alias("sets"))
    rows = scores.join(held, "doc_id").select("lang", "perplexity", "sets", F.lit(True).alias("good"))
    cuts = rows.where("sets").groupBy("lang").agg(F.percentile_approx("perplexity", F.array(*map(F.lit, quantiles)), F.lit(100_000)).alias("cuts")).select(F.col("lang").alias("_lang"), "cuts")
    judged = rows.where("not sets").drop("sets").unionByName(scores.join(bad, "doc_id", "left_semi").select("lang", "perplexity", F.lit(False).alias("good")))
    each = judged.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("good", "perplexity", F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("quantile"), F.coalesce("cuts", F.array(*[F.lit(math.inf)] * len(quantiles))).alias("cut"))).alias("c"))
    share = lambda good: F.avg(F.when(F.col("good") == good, (F.col("perplexity") <= F.col("c.cut")).cast("double")))
    return each.groupBy(F.col("c.quantile").alias("quantile")).agg(share(True).alias("good_kept"), share(False).alias("bad_kept"))


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that classify() rejects. Rows of one doc_id, or of none, are each judged by their own text and language."""
    rejected = classify(docs, labels, **options).where("not kept").select("row", "lang").distinct()
    rejected = rejected.select(F.col("row").alias("_row"), F.col("lang").alias("_lang"))
    whole = docs.select(row_key().alias("_row"), F.col("lang").cast("string").alias("_lang"), F.struct("*").alias("whole")).alias("d")
    found = (F.col("d._row") == F.col("r._row")) & F.col("d._lang").eqNullSafe(F.col("r._lang"))
    return whole.join(rejected.alias("r"), found, "left_anti").select("whole.*")
