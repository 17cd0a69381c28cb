"""Ranked lexical search: WAND over document shards, heaps of the best merged."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, text_chunks

#: characters of a document shard, and of a block of items that goes to every task
SHARD, BLOCK = 4_000_000, 2_000_000
#: a share of shards (1 in PRIME) is searched first: their best scores are a floor for the rest
PRIME = 16
#: what separates terms becomes a space, capitals become small; bytes above 127 belong to terms
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
INDEX = "shard long, n_docs long, n_terms long, body binary"
FOUND = "item int, doc_id long, score long"
END = 1 << 62
#: a cursor is one number: place of the document and, in the low bits, the term
LOW = 20


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters above 127, in UTF-8, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(len(a).to_bytes(8, "little") + a.astype("<i8").tobytes() for a in arrays), 1)


def unpacked(body: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(body), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, "<i8", n, at + 8))
        at += 8 + 8 * n
    return out


def _index_rows(vocabulary, limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a shard: its documents with terms (id, known id, number of terms) and postings by term (term, documents, place, occurrences)."""
        place = vocabulary.value
        for rows in text_chunks(batches, limit):
            ids, sizes, posts = [], [], []
            for doc_id, text in sorted(zip(rows["doc_id"], rows["text"]), key=lambda r: (r[0] is None, r[0] or 0)):
                words = terms_of(text)
                if not words:
                    continue
                seen = Counter(map(place.get, words))
                seen.pop(None, None)
                posts += [(t, len(ids), k) for t, k in seen.items()]
                ids.append(doc_id)
                sizes.append(len(words))
            if not ids:
                continue
            term, doc, tf = np.array(sorted(posts), np.int64).reshape(-1, 3).T
            known, starts = np.unique(term, return_index=True)
            body = packed(np.array([d or 0 for d in ids], np.int64), np.array([d is not None for d in ids], np.int64), np.array(sizes, np.int64), known, starts, doc, tf)
            yield pa.record_batch({"shard": pa.array([hash_of(body)], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_terms": pa.array([sum(sizes)], pa.int64()), "body": pa.array([body], pa.binary())})

    return run


def hash_of(body: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(body, 13) >> 1


def _held_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, added up over a task's shards."""
    held: Counter = Counter()
    for b in batches:
        for body in b.column("body").to_pylist():
            _, _, _, known, starts, doc, _ = unpacked(body)
            held.update(dict(zip(known.tolist(), np.diff(np.append(starts, len(doc))).tolist())))
    yield pa.record_batch({"term": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})


def search(places: list[list[int]], impacts: list[list[int]], most: list[int], heap: list[tuple], top: int, floor: int, keys: list[int]) -> None:
    """WAND over one shard's postings of an item's terms: heap gets the best (score, key), where a larger key wins a tie.

    places: ascending documents of each term, closed by END; most: the largest impact of each term. Cursors stand in order of their
    documents; the first at which the largest impacts add up to what it takes to enter the heap (at least `floor`) is the pivot: no document before it can enter.
    """
    ats = [0] * len(places)
    low = (1 << LOW) - 1
    cursors = sorted((p[0] << LOW) | k for k, p in enumerate(places))
    enter = max(floor, heap[0][0] if len(heap) == top else 1)
    last = END << LOW
    while cursors:
        reach = 0
        for at, c in enumerate(cursors):
            reach += most[c & low]
            if reach >= enter:
                break
        else:
            return
        pivot = c >> LOW
        if cursors[0] >> LOW == pivot:
            score = 0
            for at, c in enumerate(cursors):
                if c >> LOW != pivot:
                    break
                k = c & low
                score += impacts[k][ats[k]]
                ats[k] += 1
                cursors[at] = (places[k][ats[k]] << LOW) | k
            found = (score, keys[pivot])
            if score < enter:
                pass
            elif len(heap) < top:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)
            if len(heap) == top:
                enter = max(floor, heap[0][0])
        else:
            for i in range(at):
                k = cursors[i] & low
                ats[k] = bisect_left(places[k], pivot, ats[k])
                cursors[i] = (places[k][ats[k]] << LOW) | k
        cursors.sort()
        while cursors and cursors[-1] >= last:
            cursors.pop()


def _search_rows(asked, weights: np.ndarray, n_docs: int, n_terms: int, top: int, floors: dict[int, int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's heap lives through all shards of a task, so a later shard has a high bar from the start."""
        items = asked.value
        heaps: list[list[tuple]] = [[] for _ in items]
        for b in batches:
            for body in b.column("body").to_pylist():
                ids, there, sizes, known, starts, doc, tf = unpacked(body)
                norm = 50 + (50 * sizes * n_docs) // n_terms
                impact = np.repeat(weights[known], np.diff(np.append(starts, len(doc)))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
                most = dict(zip(known.tolist(), np.maximum.reduceat(impact, starts).tolist())) if len(known) else {}
                spans = dict(zip(known.tolist(), zip(starts.tolist(), np.append(starts[1:], len(doc)).tolist())))
                keys = [-d if t else -(1 << 64) for d, t in zip(ids.tolist(), there.tolist())]  # a null id comes last
                lists: dict[int, tuple] = {}
                for i, terms in enumerate(items):
                    here = [t for t in terms if most.get(t, 0) > 0]  # a weight of zero adds nothing
                    for t in here:
                        if t not in lists:
                            a, z = spans[t]
                            lists[t] = ([*doc[a:z].tolist(), END], impact[a:z].tolist())
                    if here:
                        search([lists[t][0] for t in here], [lists[t][1] for t in here], [most[t] for t in here], heaps[i], top, floors.get(i, 1), keys)
        rows = [(i, None if key == -(1 << 64) else -key, score) for i, heap in enumerate(heaps) for score, key in heap]
        item, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best `top` of each item with rank; Spark keeps no more than that of each task before the shuffle."""
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    spark = docs.sparkSession
    terms = [sorted(set(terms_of(text))) for _, text in items]
    names = sorted({t for ts in terms for t in ts})
    place = {t: k for k, t in enumerate(names)}
    if len(names) >= 1 << LOW:
        raise ValueError("too many terms for one block of items: give a smaller block")
    index = docs.select("doc_id", "text").mapInArrow(_index_rows(spark.sparkContext.broadcast(place), SHARD), INDEX)
    index = materialise(index, "shards")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = np.zeros(len(names), np.int64)
    for term, n in index.mapInArrow(_held_rows, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term of the block
        held[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    asked = spark.sparkContext.broadcast([[place[t] for t in ts] for ts in terms])
    run = lambda rows, floors: rows.select("body").mapInArrow(_search_rows(asked, weights, n_docs, max(n_terms, 1), top, floors), FOUND)
    first = merged(run(index.where(F.col("shard") % PRIME == 0), {}), top).where(F.col("rank") == top)
    floors = {r["item"]: r["score"] for r in first.collect()}  # a row for each item of the block at most
    best = merged(run(index, floors), top)
    names_of = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names_of), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `top` best documents of docs (doc_id, text) for each row of items (item_id, text).

    A term's weight and a document's length norm are those of the contract; N, L and df count all documents. Items are taken in blocks
    of about `block` characters, dealt by a hash; only a block's terms and items go to every task. For each block the documents are
    read once into shards: a row with the ids and lengths of about 4 million characters of documents and the postings of the block's terms, written to the
    shared folder. Statistics come from these rows. Then each shard is searched by WAND, item by item; a task keeps its heaps from shard to shard, and
    one shard in sixteen is searched before the others, as the `top`-th best score of any part is a floor for the whole: only documents that
    can't be among the best are passed over, so results are exact. Tasks' heaps merge in a window that keeps `top` rows a task and item.

    Null and empty texts have no terms and rank nowhere; a document without any of an item's terms, or with terms of weight zero alone,
    has no row. Repeated doc_ids are documents of their own; a null doc_id ranks after others of its score. Repeated item_ids each
    get their rows; items without terms get none. Empty tables give none.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block))
    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # bounded by the block's size
        found = _rank_block(docs, sorted((tuple(r) for r in rows), key=repr), top)
        out = found if out is None else out.unionByName(found)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS row FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, item, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT *, row_number() OVER () AS item FROM benchmark WHERE text IS NOT NULL)),
p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
m AS (SELECT doc_id, row, 100 - 50 + ((50 * len(terms)::BIGINT * N) // L) AS m FROM d, s WHERE len(terms) > 0),
x AS (SELECT item, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, row)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""
