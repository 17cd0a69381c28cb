"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised likelihoods and calibrated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perplexity import discounts, interpolate
from .shared import materialise, text_chunks

#: bytes of an n-gram: the predicted one and up to seven of its word, the space before it included
ORDER = 8
#: most characters (and 16 for each row) of labelled text that a class is fitted on
SAMPLE = 20_000_000
#: labelled rows are chosen by whole buckets of a hash
BUCKETS = 4096
#: what separates words becomes a space; the texts are lower-cased before
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
CHUNK = 1_500_000
#: a worker keeps the ratios of so many words, each of so many bytes at most; others are computed again
KEPT, LONGEST = 400_000, 64
#: nats by which a word must stand above its document's median to count, or to be an expression of its own, and words that every document is lengthened by
ABOVE, FAR, PRIOR = 1.5, 4.0, 20
FEATURES = ("mean", "excess", "share")


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes above 127 of the lower-cased text, in UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER bytes that end at each byte of each word and at the space after it, number of codes of each word); nothing before a word's own space is in a code."""
    body = np.frombuffer(b" " * (ORDER - 1) + b"".join(w + b" " for w in words), np.uint8)
    n = len(body) - ORDER + 1
    codes = np.zeros(n, np.uint64)
    for i in range(ORDER - 1):
        ch = body[i : i + n]
        codes[ch == 32] = 0
        codes <<= np.uint64(8)
        codes |= ch
    codes = (codes << np.uint64(8)) | body[ORDER - 1 :]
    return codes, np.fromiter(map(len, words), np.int64, len(words)) + 1


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a batch with their number in ordinary and in toxic text."""
    for rows in text_chunks(batches, CHUNK):
        found = []
        for toxic in (0, 1):
            held = Counter(w for text, t in zip(rows["text"], rows["toxic"]) if t == toxic for w in words_of(text))
            codes, sizes = word_codes(list(held))
            found.append((codes, np.repeat(np.fromiter(held.values(), np.int64, len(held)), sizes)))
        every, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        cut = len(found[0][0])
        counts = [np.bincount(place[s], weights=n, minlength=len(every)).astype(np.int64) for s, (_, n) in zip((slice(0, cut), slice(cut, None)), found)]
        yield pa.record_batch({"code": pa.array(every.view(np.int64)), "ordinary": pa.array(counts[0]), "toxic": pa.array(counts[1])})


class Ratios:
    """log P(byte | its word so far) of the toxic model less that of the ordinary one, for the codes of the fitted text and for their contexts.

    Both models take their highest order from their own class and, discounted, hand the rest to one Kneser-Ney model of all text: a continuation that neither
    class has seen in its context gets the shared probability on both sides, and what remains is the ratio of the contexts' own weights.
    """

    def __init__(self, codes: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        at = np.argsort(codes)
        codes, counts = codes[at], [ordinary[at], toxic[at]]
        levels = [(codes, counts[0] + counts[1])]
        for n in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & np.uint64((1 << 8 * n) - 1), return_counts=True))
        shared = np.full(len(codes), 1 / 256)
        for n, (known, seen) in enumerate(reversed(levels), 1):
            asked = codes if n == ORDER else codes & np.uint64((1 << 8 * n) - 1)
            shared = interpolate(known, seen, discounts([int((seen == k).sum()) for k in (1, 2, 3, 4)]), asked, shared)
        logs, weights = [], []
        self.contexts = np.unique(codes >> np.uint64(8))
        for c in counts:
            own, seen = codes[c > 0], c[c > 0]
            cuts = discounts([int((seen == k).sum()) for k in (1, 2, 3, 4)])
            logs.append(np.log(interpolate(own, seen, cuts, codes, shared)))
            firsts = np.flatnonzero(np.diff(own >> np.uint64(8), prepend=np.uint64((1 << 64) - 1)))
            freed = np.ones(len(self.contexts))
            if len(own):
                freed[np.searchsorted(self.contexts, own[firsts] >> np.uint64(8))] = np.add.reduceat(cuts[np.minimum(seen, 3)], firsts) / np.add.reduceat(seen, firsts)
            weights.append(np.log(freed))
        self.codes, self.of_code, self.of_context = codes, (logs[1] - logs[0]).astype(np.float32), (weights[1] - weights[0]).astype(np.float32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Log ratio of each word with the space after it."""
        out = np.zeros(len(words))
        at = 0
        while at < len(words):  # about a million bytes at once, or one long word
            stop, held = at, 0
            while stop < len(words) and (stop == at or held + len(words[stop]) < 1_000_000):
                held += len(words[stop]) + 1
                stop += 1
            codes, sizes = word_codes(words[at:stop])
            places = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            contexts = codes >> np.uint64(8)
            near = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
            each = np.where(self.codes[places] == codes, self.of_code[places], np.where(self.contexts[near] == contexts, self.of_context[near], 0))
            out[at:stop] = np.add.reduceat(each.astype(np.float64), np.cumsum(sizes) - sizes)
            at = stop
        return out


def measure(ratios: np.ndarray) -> tuple[float, float, float]:
    """(mean, excess, share) of a document's word ratios above their median, by length: the median takes out what a whole language or subject adds."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    above = ratios - np.median(ratios)
    return float(above.sum() / (len(above) + PRIOR)), float(np.maximum(above - ABOVE, 0).sum() / (len(above) + PRIOR)), float((above > FAR).sum() / (len(above) + PRIOR))


def _measure_rows(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, known = model.value, {}
        for rows in text_chunks(batches, CHUNK):
            texts = [words_of(t) for t in rows["text"]]
            missing = {w for ws in texts for w in ws if w not in known}
            if len(known) + len(missing) > KEPT:
                missing, known = {w for ws in texts for w in ws}, {}
            missing = sorted(missing)
            known.update(zip(missing, ratios.of_words(missing).tolist()))
            found = [measure(np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))) for ws in texts]
            for w in missing if len(known) > KEPT else [w for w in missing if len(w) > LONGEST]:
                del known[w]
            yield pa.record_batch({"doc_id": pa.array(rows["doc_id"], pa.int64()), **{f: pa.array([r[k] for r in found], pa.float64()) for k, f in enumerate(FEATURES)}})

    return run


def calibrate(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, scale, coefficients with the constant first) of a ridged logistic regression, by Newton steps."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(b)), z.T @ (weight * (toxic - p)) - b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return middle, scale, b


def remainder(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic, fold (1 to 4) and weight of labelled rows that may be learnt from: all of a class, or whole buckets of a hash of doc_id up to `sample` characters a class and fold part.

    Lengths and labels meet by doc_id without texts; the ids chosen (at most sample / 16 a class and part) go to every task, and texts stay where they are.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", remainder().cast("int")).where("fold <> 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(BUCKETS)))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    known = materialise(known.join(sizes, "doc_id").withColumn("part", (F.col("fold") == 4).cast("int")), "labelled")
    totals = known.groupBy("toxic", "part", "bucket").agg(F.sum(F.col("n") + 16).alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("toxic", "part", "bucket").collect()  # 16,384 rows at most
    chosen, weights = [], {}
    for side in sorted({(r["toxic"], r["part"]) for r in totals}):
        left, rows, taken = sample, 0, 0
        for r in totals:
            if (r["toxic"], r["part"]) == side:
                rows += r["rows"]
                if r["n"] <= left:
                    left -= r["n"]
                    taken += r["rows"]
                    chosen.append((*side, r["bucket"]))
        weights[side] = rows / max(taken, 1)
    picked = docs.sparkSession.createDataFrame([(t, p, b, weights[(t, p)]) for t, p, b in chosen], "toxic int, part int, bucket long, weight double")
    ids = known.join(F.broadcast(picked), ["toxic", "part", "bucket"]).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "fold", "weight").distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Ratios, tuple] | float:
    """The models and their calibration, or a fixed score where a class has no text: 0 without toxic text, 1 without other."""
    rows = materialise(sampled(docs, labels, sample), "labelled-texts")
    counts = rows.where("fold < 4").select("text", "toxic").mapInArrow(_count_rows, "code long, ordinary long, toxic long").groupBy("code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    table = counts.toArrow()  # no more rows than the sample has bytes
    codes, ordinary, toxic = (table.column(c).to_numpy() for c in ("code", "ordinary", "toxic"))
    if not toxic.any() or not ordinary.any():
        return 1.0 if toxic.any() else 0.0
    model = Ratios(codes.view(np.uint64), ordinary, toxic)
    context = docs.sparkSession.sparkContext
    judged = measured(rows.where("fold = 4").select("doc_id", "text"), context.broadcast(model)).join(rows.where("fold = 4").select("doc_id", "toxic", "weight").distinct(), "doc_id").toPandas()
    if judged["toxic"].nunique() < 2:
        return 1.0 if len(judged) and judged["toxic"].iloc[0] else 0.0
    return model, calibrate(judged[list(FEATURES)].to_numpy(float), judged["toxic"].to_numpy(float), judged["weight"].to_numpy(float))


def measured(docs: DataFrame, model) -> DataFrame:
    return docs.mapInArrow(_measure_rows(model), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the three measures of every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Two Kneser-Ney models of the bytes of words, one of toxic and one of ordinary text, share their lower orders (see Ratios). A word's
    evidence is the difference of its log-likelihoods; a document's is the mean of what stands above its own median word, by length, and the share of words far above.
    Three of five parts of the labelled rows (by crc32 of doc_id as text, mod 5) fit the models, a fourth the logistic regression that
    turns measures into a score, part 0 is never learnt from. Fitting takes whole hash buckets of rows up to `sample` characters a class,
    and the model, no larger than that sample, goes to every task; every text of docs is scored whole. Only texts enter a score.

    Null and empty texts have no words: their measures are 0 and their score what these give. A null doc_id is not held out and has no label. Of
    several labels of one doc_id the largest counts; rows with a null label don't. Repeated doc_ids each get a row. Without toxic labelled text all scores are 0, without
    other they are 1. An empty table gives no rows.
    """
    fitted = fit(docs, labels, sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    if isinstance(fitted, float):
        out = slim.select("doc_id", held_out, F.lit(fitted).alias("score"), *[F.lit(0.0).alias(f) for f in FEATURES])
    else:
        model, (middle, scale, b) = fitted
        line = F.lit(float(b[0]))
        for k, f in enumerate(FEATURES):
            line = line + (F.col(f) - float(middle[k])) / float(scale[k]) * float(b[k + 1])
        out = measured(slim, docs.sparkSession.sparkContext.broadcast(model)).select("doc_id", held_out, (1 / (1 + F.exp(-line))).alias("score"), *FEATURES)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
