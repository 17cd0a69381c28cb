"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import keyed_stream, materialise, stream_groups

#: bits of a bucket's key at most: with more the tables a pair needs would outgrow what smaller buckets save
MOST_BITS = 16
_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(dim: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    key = (dim, number, seed)
    if key not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([seed, number, dim]).standard_normal((dim, dim)))
        _rotations[key] = q * np.sign(np.diag(r))
    return _rotations[key]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotated(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Unit rows under as many random rotations as `bits` coordinates take, at length one again (every rotation keeps lengths)."""
    number = -(-bits // x.shape[1])
    return np.concatenate([x @ rotation(x.shape[1], i, seed).T for i in range(number)], axis=1) / math.sqrt(number)


def encode(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs of the rotated unit rows, correction factor): the factor is the inner product of a rotated row with its own code vector."""
    r = rotated(x, bits, seed)
    return r > 0, np.abs(r).sum(axis=1) / math.sqrt(r.shape[1])


def half_width(factor: np.ndarray, n_bits: int, sigmas: float) -> np.ndarray:
    """Half width of each coded row's confidence bound: `sigmas` deviations of estimate()."""
    return sigmas * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, n_bits - 1))


def estimate(signs: np.ndarray, factor: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded rows with rotated unit rows.

    A code vector is the coded row times its factor plus a rest at right angles to it, in a random direction: the code's inner product
    with `other`, divided by the factor, is off by a term of mean zero and deviation sqrt(1 - f**2) / f / sqrt(bits - 1) at most.
    """
    code = np.where(signs, np.float32(1), np.float32(-1))
    return (code @ other.T.astype(np.float32)) / (factor[:, None] * math.sqrt(signs.shape[1])).astype(np.float32)


def tables_for(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits of a key, number of tables): buckets of about 256 at random, and odds of at most `miss` that a pair at `cosine` shares no bucket."""
    bits = int(min(MOST_BITS, max(4, round(math.log2(max(n, 1) / 256)) if n > 256 else 4)))
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - share))


def table_keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Key of each row in each table: consecutive slices of its code."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.uint32)).astype(np.uint32)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the batch's vectors by dimension."""
    column = batch.column("embedding")
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, values[offsets[at][:, None] + np.arange(dim)]


def _bucket_rows(bits: int, tables: int, seed: int, whole: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per vector and table: its bucket and, with `whole`, its id, code and factor; never the vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                batch = big.slice(lo, 1024)
                for at, matrix in _rows(batch):
                    signs, factor = encode(unit(matrix), bits * tables, seed)
                    # dimension and table are part of the bucket, so vectors of different length never meet
                    bucket = table_keys(signs, bits, tables).astype(np.int64) | (np.arange(tables, dtype=np.int64) << 24) | (np.int64(matrix.shape[1]) << 40)
                    out = {"bucket": pa.array(bucket.ravel())}
                    if whole:
                        code = np.packbits(signs, axis=1)
                        spread = pa.array(np.repeat(np.arange(len(at)), tables))
                        out |= {"id": batch.column("id").take(pa.array(at)).take(spread), "code": pa.array([c.tobytes() for c in code], pa.binary()).take(spread), "factor": pa.array(factor.astype(np.float32)).take(spread)}
                    yield pa.record_batch(out)

    return run


class Bucket:
    """The rows of a bucket, or of two blocks of a large one: codes, and which pairs count here."""

    def __init__(self, table: pa.Table, bits: int, tables: int):
        self.ids, self.bucket, self.block = (table.column(c).to_numpy() for c in ("id", "bucket", "block"))
        self.factor = table.column("factor").to_numpy().astype(np.float64)
        self.same = bool((table.column("low").to_numpy() == table.column("high").to_numpy()).all())
        n = table.num_rows
        dim = int(self.bucket[0]) >> 40
        n_bits = -(-bits * tables // dim) * dim
        self.signs = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, :n_bits].astype(bool)
        self.number, self.keys = (int(self.bucket[0]) >> 24) & 0xFFFF, table_keys(self.signs, bits, tables)

    def mine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs (places) that count here: each pair once, in the first table where it meets."""
        ok = (a < b) if self.same else (self.block[a] < self.block[b])
        ok[ok] = self.bucket[a[ok]] == self.bucket[b[ok]]  # two buckets may share a hash
        ok[ok] = (self.keys[a[ok], : self.number + 1] == self.keys[b[ok], : self.number + 1]).argmax(axis=1) == self.number
        return ok


def _open_rows(cosine: float, bits: int, tables: int, sigmas: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a bucket that have a pair which the codes leave open, by their codes alone: a row each, whatever the number of pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in stream_groups(batches):
            if table.num_rows < 2:
                continue
            held = Bucket(table, bits, tables)
            n_bits, live = held.signs.shape[1], np.zeros(table.num_rows, bool)
            # the share of equal signs of a pair at `cosine` deviates by sqrt(p (1 - p) / bits) at most: rotations only lessen that
            p = 1 - math.acos(cosine) / math.pi
            least = p - sigmas * math.sqrt(p * (1 - p) / n_bits)
            code = np.where(held.signs, np.float32(1), np.float32(-1))
            for lo in range(0, len(code), 512):
                a, b = np.nonzero((code[lo : lo + 512] @ code.T) >= np.float32((2 * least - 1) * n_bits))
                a += lo
                ok = held.mine(a, b)
                live[a[ok]] = live[b[ok]] = True
            if live.any():
                yield pa.record_batch({c: table.column(c).combine_chunks().filter(pa.array(live)) for c in ("key", "bucket", "id", "block", "low", "high", "code", "factor")})

    return run


def _link_rows(kind: str, cosine: float, bits: int, tables: int, seed: int, sigmas: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The exact step, on the rows that _open_rows() left, now with their vectors: links and smallest linked id of each, not pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in stream_groups(batches):
            n = table.num_rows
            if n < 2:
                continue
            held, weight = Bucket(table, bits, tables), table.column("weight").to_numpy()
            x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(n, -1))
            turned, width = rotated(x, bits * tables, seed), half_width(held.factor, held.signs.shape[1], sigmas)
            links, root, edges = np.zeros(n), held.ids.copy(), []
            for lo in range(0, n, 512):
                # only pairs whose bound reaches the threshold are recomputed
                a, b = np.nonzero(estimate(held.signs[lo : lo + 512], held.factor[lo : lo + 512], turned) + width[lo : lo + 512, None] >= cosine)
                a += lo
                ok = held.mine(a, b)
                a, b = a[ok], b[ok]
                for s in range(0, len(a), 100_000):
                    i, j = a[s : s + 100_000], b[s : s + 100_000]
                    hit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    edges.append((i[hit].astype(np.int32), j[hit].astype(np.int32)))
            i, j = (np.concatenate(f) for f in zip(*edges)) if edges else (np.zeros(0, np.int32),) * 2
            if not len(i):
                continue
            links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
            while True:  # smallest id among those linked here
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                if (low == root).all():
                    break
                root = low
            own = np.flatnonzero(links > 0)
            yield pa.record_batch({"id": pa.array(held.ids[own]), "links": pa.array(links[own].astype(np.int64)), "root": pa.array(root[own])})

    return run


def _packed_rows(kind: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _rows(batch):
                take = pa.array(at)
                yield pa.record_batch({"id": batch.column("id").take(take), "weight": batch.column("weight").take(take), "vector": pa.array([m.tobytes() for m in matrix.astype(kind)], pa.binary())})

    return run


def valid(vector):
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-5, block: int = 2048, seed: int = 2, sigmas: float = 5.0) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding: array of float or double).

    Equal vectors are one node with a weight, so copies are never paired. A node's code is the signs of several random rotations,
    with a correction factor; slices of the code are its keys in tables_for() hash tables. Id, code and factor go to a bucket of each table,
    vectors don't. In a bucket the codes alone leave pairs open (share of equal signs within `sigmas` deviations of that of
    the threshold); only rows with an open pair are joined to their vectors, once for each table where an open pair of theirs meets first. There
    the code of one and the rotated other give an unbiased estimate of their inner product, pairs whose upper confidence bound
    reaches the threshold are recomputed in double precision, and those at `cosine` or above link. A bucket returns rows, not pairs.
    Buckets above `block` rows are dealt as pairs of blocks to many tasks, all of them compared.

    A pair just at the threshold is missed with odds of at most `miss` by the tables (far less for nearer ones) and of about 3e-7
    (five sigmas, one side) by each of the two bounds; every link returned is exact. Null, zero and non-finite vectors link with
    nothing and are their own component; vectors of different length don't link. Rows that repeat a vector link with one
    another, also those with one vec_id or none; a null vec_id counts as a link but never names a component, unless no other does (null then).
    """
    kind = "<f8" if dict(vectors.dtypes)["embedding"] == "array<double>" else "<f4"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>" if kind == "<f8" else "array<float>").alias("embedding"))
    nodes = rows.where(valid("embedding")).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("id"), "vec_id", "weight", "embedding"), "vectors")
    bits, tables = tables_for(nodes.count(), cosine, miss)
    sizes = nodes.select("embedding").mapInArrow(_bucket_rows(bits, tables, seed, False), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    dealt = nodes.select("id", "embedding").mapInArrow(_bucket_rows(bits, tables, seed, True), "bucket long, id long, code binary, factor float")
    blocks = dealt.join(sizes, "bucket", "left").withColumn("_nb", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).drop("n")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    pairs = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")).withColumn("low", F.least("block", "_o")).withColumn("high", F.greatest("block", "_o")).drop("_nb", "_o")
    keyed = pairs.withColumn("key", F.xxhash64("bucket", "low", "high"))
    left_open = materialise(keyed_stream(keyed, "key").mapInArrow(_open_rows(cosine, bits, tables, sigmas), "key long, bucket long, id long, block int, low int, high int, code binary, factor float"), "open")
    whole = nodes.select("id", "weight", "embedding").mapInArrow(_packed_rows(kind), "id long, weight long, vector binary")
    found = materialise(keyed_stream(left_open.join(whole, "id"), "key").mapInArrow(_link_rows(kind, cosine, bits, tables, seed, sigmas), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    judged = nodes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select("embedding", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    named = judged.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(judged.join(named, "component").select("embedding", "n_links", "component_id", F.lit(True).alias("_in")), "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b) SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, v.vec_id = r.c AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN r ON r.a = v.vec_id
"""
