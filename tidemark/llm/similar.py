"""Groups of texts with similar sets of word shingles: SimHash segments and Hamming balls propose, the sets themselves decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import keyed_stream, materialise, ragged, row_key, stream_groups
from .simhash import shingles

# Two sets with similarity 0.8 differ in a bit of their fingerprints with odds of 0.15 to 0.161, and of 0.1875 if they have 4 and 5
# shingles (ties make the difference). All odds below are for 0.1875; a closer pair is missed less often.
APART = 0.1875
#: a pair at 0.8 shares none of the segments with odds of at most this
MISSED = 1e-5
#: words of a fingerprint that are compared whole, and the radius: a pair at 0.8 is farther apart with odds of 1e-5, texts with nothing in common are as near with odds of 2e-7
WORDS, RADIUS = 3, 60
#: and the radius in the first two words alone, which spares most pairs the third (odds of 6e-6 and 3e-4)
FIRST_RADIUS = 44

#: a set of fewer shingles is similar to no other: 4 of 5 make 0.8, 3 of 4 less
SMALLEST = 4
#: shingles of the sets that one task compares; a joined group with more is compared in parts
MOST_HELD = 1 << 22

_rng = np.random.default_rng(29)
FLIP, TIMES = (_rng.integers(0, 1 << 63, 64, dtype=np.uint64) for _ in range(2))
TIMES = TIMES * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def segments(n: int) -> tuple[int, int]:
    """(number of segments, bits of each) for n texts: as n doubles, a segment gets a bit more beyond two million, so that buckets stay near 8192."""
    bits = max(8, n.bit_length() - 13)
    return math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** bits))), bits


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in order; a text of fewer words has one, a wordless one none."""
    return np.unique(shingles(text, width))


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set in 64 * words bits (as bytes of 0 and 1): a bit is set if it is in over half of what its word makes of the hashes."""
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255):  # sums of bytes
        x = (hashes[k : k + 255, None] ^ FLIP[:words]) * TIMES[:words]
        x = (x ^ (x >> np.uint64(32))) * MIX
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (ones * 2 > len(hashes)).view(np.uint8)


def _print_rows(width: int, words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, name, size, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width)
                raw = np.packbits(sketch(found, words)).tobytes() if len(found) >= SMALLEST else None
                node.append(xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63))
                name.append(node[-1] if raw is None else xxhash.xxh64_intdigest(raw, len(found)) - (1 << 63))
                size.append(len(found))
                bits.append(raw)
            yield pa.record_batch({"row": batch.column("row"), "doc_id": batch.column("doc_id").cast(pa.int64()), "node": pa.array(node, pa.int64()), "name": pa.array(name, pa.int64()), "size": pa.array(size, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _segment_rows(count: int, bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                raw = np.array([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
                cut = np.unpackbits(raw, axis=1)[:, : count * bits].reshape(len(raw), count, bits)
                key = (cut @ (1 << np.arange(bits))) + (np.arange(count) << bits)
                words = np.ascontiguousarray(raw[:, : 8 * WORDS]).view(np.int64)
                yield pa.record_batch({"key": key.ravel(), "name": np.repeat(rows.column("name").to_numpy(), count), "size": np.repeat(rows.column("size").to_numpy(), count), **{f"w{i}": np.repeat(words[:, i], count) for i in range(WORDS)}})

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, smallest that i is joined to) that join up just what the pairs (a, b) of numbers below n do."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        for side in (a, b):
            np.minimum.at(low, before[side], least)
            np.minimum.at(low, side, least)
        low = low[low]
        if np.array_equal(low, before):
            i = np.flatnonzero(low != np.arange(n))
            return i, low[i]


def fit(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can have similarity `least`."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-6


def near(words: list[np.ndarray], area: int = 1 << 16, most: int = 1 << 15, held: int = 1 << 20, sizes: np.ndarray | None = None, least: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, smallest that i is joined to) that join up just what all pairs of fingerprints (as WORDS arrays of words) within RADIUS would.

    With the sizes of their sets, pairs whose sizes alone rule out `least` are none.
    Up to `most` fingerprints all pairs (in order of size, all that may fit) are compared, some rows at a time. Beyond it each is compared with those that
    nothing has reached yet, so that a large group of like texts costs little more than one pass. A group of k has k - 1 pairs.
    """
    n = len(words[0])

    def hits(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.bitwise_count(words[0][rows, None] ^ words[0][others])
        apart += np.bitwise_count(words[1][rows, None] ^ words[1][others])
        i, j = np.divmod(np.flatnonzero(apart <= FIRST_RADIUS), len(others))
        i, j = rows[i], others[j]
        good = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words) <= RADIUS
        if sizes is not None:
            good &= fit(sizes[i], sizes[j], least)
        return i[good], j[good]

    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > most:
        left, out = np.arange(n), []
        while len(left):
            queue, left = left[:1], left[1:]
            while len(queue) and len(left):
                at, queue = queue[: max(1, area // len(left))], queue[max(1, area // len(left)) :]
                i, j = hits(at, left)
                reached, first = np.unique(j, return_index=True)
                out.append((i[first], reached))
                queue = np.concatenate([queue, reached])
                left = np.setdiff1d(left, reached, assume_unique=True)
        return forest(*map(np.concatenate, zip(*out)), n) if out else (a, b)
    order = np.arange(n) if sizes is None else np.argsort(sizes, kind="stable")
    ends = np.full(n, n) if sizes is None else np.searchsorted(sizes[order], sizes[order] / least + 1e-3, side="right")
    at = 0
    while at < n - 1:
        # as many rows as `area` allows, and not many more than what the first may fit
        wide = ends[at : at + max(128, ends[at] - at)] - at
        to = at + max(1, int(np.searchsorted(np.arange(1, len(wide) + 1) * wide, area, side="right")))
        i, j = hits(order[at:to], order[at + 1 : ends[to - 1]])
        a, b = np.concatenate([a, np.maximum(i, j)[i != j]]), np.concatenate([b, np.minimum(i, j)[i != j]])
        if len(a) > held:
            a, b = forest(a, b, n)
        at = to
    return forest(a, b, n) if len(a) else (a, b)


def _near_rows(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b) for each name of a bucket (in order of names) and the smallest name that it is joined to there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in stream_groups(batches):
            if table.num_rows > 1:
                name = table.column("name").to_numpy()
                i, j = near([table.column(f"w{k}").to_numpy().view(np.uint64) for k in range(WORDS)], sizes=table.column("size").to_numpy(), least=least)
                if len(i):
                    yield pa.record_batch({"a": pa.array(name[i]), "b": pa.array(name[j])})

    return run


def stars(pairs: DataFrame) -> DataFrame:
    """(a, b), each once, that join up just what `pairs` (a, smaller b) do: a name has one pair, with the smallest of its b, and so have those others of its b.

    What a name is joined to differs from bucket to bucket, but these are few names in all, so about one pair a name is left.
    A name has no more of them than there are segments.
    """
    least = pairs.groupBy("a").agg(F.collect_set("b").alias("near")).withColumn("b", F.array_min("near"))
    return least.select("b", F.explode(F.transform("near", lambda x: F.when(x == F.col("b"), F.col("a")).otherwise(x))).alias("a")).select("a", "b").distinct()


def parts(large: DataFrame, least: float, most: int) -> DataFrame:
    """(row, node, parts) of sets (row, node, key, size) in large groups: the tasks, by numbers, in which a set meets all of its group that may be similar to it.

    A group is cut by size into bands as wide as `least` lets sizes differ; a part holds two neighbouring bands. If these have
    more than `most` shingles, their sets are dealt over blocks by hash, and a part holds two blocks.
    """
    band = F.floor(F.log("size") / F.lit(1e-9 - math.log(least)))
    rows = large.select("*", F.posexplode(F.array(band - 1, band)).alias("own", "band"))
    # without sets of its own a band has nothing that its neighbour lacks
    bands = rows.groupBy("key", "band").agg(F.sum("size").alias("held"), F.max("own").alias("any")).where("any = 1").select("key", "band", F.when(F.col("held") > most, F.ceil(2 * F.col("held") / F.lit(most))).otherwise(1).cast("int").alias("blocks"))
    block, part = F.pmod("node", "blocks"), lambda *of: F.xxhash64("key", "band", *of)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda i: i != block)
    of = F.when(F.col("blocks") > 1, F.transform(others, lambda i: part(F.least(block, i), F.greatest(block, i)))).otherwise(F.array(part()))
    # bands are few: most of them belong to groups of more than `most` shingles
    return rows.join(F.broadcast(bands), ["key", "band"]).select("row", "node", of.alias("parts")).groupBy("row", "node").agg(F.flatten(F.collect_list("parts")).alias("parts"))


def _set_rows(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"parts": batch.column("parts"), "node": batch.column("node"), "body": pa.array([shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())})

    return run


def links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that join up just what all pairs with similarity `least` or more would join up.

    Of two sets with that similarity each has, among its rarest shingles (as many as it may lack, and one), one that is among the
    rarest of the other. So sets are looked up by these; a passage that many texts have in common is not among them unless it is
    most of a text. Each set is held once against those that nothing has reached yet, so a group of like sets costs little more
    than one pass and no pair that could link two groups is left out.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values))
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.sort(owner * len(values) + rank[codes]) - owner * len(values)
    begins = np.cumsum(sizes) - sizes
    heads = sizes - np.ceil(least * sizes - 1e-6).astype(np.int64) + 1
    first = np.arange(len(codes)) - begins[owner] < heads[owner]
    # of each code the sets that have it as a head, those that nothing has reached in front
    by_code = np.argsort(codes[first], kind="stable")
    listed = owner[first][by_code]
    held = np.bincount(codes[first], minlength=len(values))
    start = np.cumsum(held) - held
    shared = np.bincount(owner[first], weights=held[codes[first]] > 1, minlength=len(sets)) > 0
    last, rest = codes[begins + heads - 1], sizes - heads
    alive, marked, out = shared.copy(), np.zeros(len(values), np.int64), []
    for seed in np.flatnonzero(shared).tolist():
        queue = [seed] if alive[seed] else []
        alive[seed] = False
        while queue:
            at = queue.pop()
            own = codes[begins[at] : begins[at] + sizes[at]]
            head = own[: heads[at]]
            head = head[held[head] > 0]
            if not len(head):
                continue
            found = ragged(listed, start[head], held[head])
            left = alive[found]
            if 2 * np.count_nonzero(left) < len(found):  # shorten the lists: what was reached goes
                kept = np.add.reduceat(left, np.cumsum(held[head]) - held[head], dtype=np.int64)
                listed[np.arange(kept.sum()) + np.repeat(start[head] - np.cumsum(kept) + kept, kept)] = found[left]
                held[head] = kept
            if 8 * len(found) > len(sets):
                heads_in_common = np.bincount(found[left], minlength=len(sets))
                near = np.flatnonzero(heads_in_common)
                heads_in_common = heads_in_common[near]
            else:
                near, heads_in_common = np.unique(found[left], return_counts=True)
            # behind the heads of the one whose heads end first there is no more than its rest
            most = heads_in_common + np.where(last[near] < last[at], rest[near], rest[at])
            near = near[fit(sizes[near], sizes[at], least) & (most >= least / (1 + least) * (sizes[near] + sizes[at]) - 1e-6)]
            if not len(near):
                continue
            marked[own] = 1
            lengths = sizes[near]
            both = np.add.reduceat(marked[ragged(codes, begins[near], lengths)], np.cumsum(lengths) - lengths)
            marked[own] = 0
            reached = near[both / (lengths + sizes[at] - both) >= least]
            alive[reached] = False
            out += [(at, i) for i in reached.tolist()]
            queue += reached.tolist()
    return out


def _link_rows(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in stream_groups(batches):
            # equal rows are there more than once
            sets = dict(zip(table.column("node").to_pylist(), table.column("body").to_pylist()))
            node = sorted(sets)
            found = links([np.frombuffer(sets[k], np.uint64) for k in node], least)
            if found:
                i, low = forest(*np.array(found).T, len(node))
                yield pa.record_batch({"node": pa.array([node[k] for k in i.tolist()], pa.int64()), "component": pa.array([node[k] for k in low.tolist()], pa.int64())})

    return run


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(row, doc_id, component) for every row of docs (doc_id, text); row is row_key(). Serves `least` of 0.8 and above.

    Rows with one set of `width`-word shingles are one node, whatever their number. Sets have SimHash fingerprints, looked up by
    multi-index hashing: each is entered under the value of each of its segments, and in a bucket of one segment value
    those within RADIUS of one another are joined. What is joined so, directly or by others, comes together (in parts, if it is
    much), and there the sets decide: a pair is linked if its Jaccard similarity is `least` or more. Wordless texts are one node.
    """
    if least < 0.8:
        raise ValueError("segments and radius are for similarities of 0.8 and above")
    rows = docs.select(row_key().alias("row"), "doc_id", "text")
    count, bits = segments(rows.count())
    words = max(WORDS, -(-count * bits // 64))
    prints = materialise(rows.mapInArrow(_print_rows(width, words), "row long, doc_id long, node long, name long, size int, bits binary"), "prints")
    entries = prints.where("bits is not null").select("name", "size", "bits").distinct()
    columns = "key long, name long, size int, " + ", ".join(f"w{i} long" for i in range(WORDS))
    near_names = materialise(keyed_stream(entries.mapInArrow(_segment_rows(count, bits), columns), "key", "name").mapInArrow(_near_rows(least), "a long, b long"), "near")
    joined = components(stars(near_names)).withColumnRenamed("node", "name").withColumnRenamed("component", "key")
    nodes = prints.groupBy("node").agg(F.min("row").alias("row"), F.min("name").alias("name"), F.min("size").alias("size"))
    keyed = nodes.join(joined, "name", "left").select("row", "node", F.coalesce("key", "name").alias("key"), "size")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).where("n > 1").select("key", (F.col("held") > MOST_HELD).alias("large"))
    open_ = materialise(keyed.join(shared, "key"), "open")
    dealt = open_.where("not large").select("row", "node", F.array("key").alias("parts"))
    cut = open_.where("large").limit(1).count() > 0
    if cut:
        dealt = dealt.union(parts(open_.where("large"), least, MOST_HELD))
    # equal rows have equal texts: any of them will do
    sets = rows.select("row", "text").join(dealt, "row").select("parts", "node", "text").mapInArrow(_set_rows(width), "parts array<long>, node long, body binary")
    sets = sets.select(F.explode("parts").alias("key"), "node", "body")
    found = materialise(keyed_stream(sets, "key").mapInArrow(_link_rows(least), "node long, component long"), "linked")
    if cut:  # what the parts of a group say comes together
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return prints.select("row", "doc_id", "node").join(found, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component"))
