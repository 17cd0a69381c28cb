"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, row_key

FP_SCHEMA = "doc_id long, fp long"


def shingles(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """64-bit hash of each word shingle of a text (repeats count); one of all its words where they are no more than `width`."""
    digest = xxhash.xxh64_intdigest
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, and the six white space characters
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprints(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text's word shingles (repeats count), as uint64; bit set if set in over half the hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingles(text, width, seed)
        if not len(hashes):
            continue
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
            ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def _fingerprint_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column("text").to_pylist()).view(np.int64)
        yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": pa.array(fp)})


def ball(value, bits: int):
    """All values within one differing bit of `value` in its lowest `bits`."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))))


def near_pairs(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp of `prints`, no repeats) at `radius` (1 to 3) or fewer differing bits.

    A fingerprint is cut into two segments of 32 bits. Of three or fewer differing bits, one segment has at most one. So each
    segment value is looked up in its table under all 33 values of its Hamming ball of radius one, and a match is kept if the
    whole fingerprints differ in at most `radius` bits. Every pair within the radius is found; a pair may come twice.
    """
    if not 1 <= radius <= 3:
        raise ValueError("two segments with balls of radius one serve distances 1 to 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    segments = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")), F.struct(F.lit(1).alias("seg"), high.alias("value")))
    rows = prints.select("fp", F.explode(segments).alias("s")).select("fp", "s.seg", "s.value")
    table = rows.select(F.col("fp").alias("b"), "seg", "value")
    probes = rows.select(F.col("fp").alias("a"), "seg", F.explode(ball(F.col("value"), 32)).alias("value"))
    matches = probes.join(table, ["seg", "value"])
    return matches.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")


def simhash_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    Documents with one fingerprint are one node, whatever their number, so copies are never paired; nodes are linked by
    near_pairs() and joined into components; component_id is the smallest doc_id of the component, itself included. Null and
    wordless texts have fingerprint zero and link like any other. Repeated doc_ids stay separate rows. Rows
    with a null doc_id belong to their group but never name it, unless no other does (null then).
    """
    prints = materialise(docs.select("doc_id", "text").mapInArrow(_fingerprint_rows, FP_SCHEMA), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    edges = near_pairs(nodes.select("fp"), radius)
    found = components(edges)
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_fp = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the near copies: of each group of similar_groups() the row with the smallest doc_id stays, with all its columns.

    Rows equal in doc_id and text count as one document and leave one row. Rows are told apart by doc_id and text, so other
    texts of a doc_id are judged on their own; a row with a null doc_id stays only if its group has no other.
    """
    from .similar import similar_groups

    groups = materialise(similar_groups(docs, width, least), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = groups.groupBy("component").agg(F.min(rank)["row"].alias("first"))
    gone = groups.join(first, "component").where(F.col("row") != F.col("first")).select("row").distinct()
    # the row in one column, so that no name of its own can clash
    left = docs.select(row_key().alias("row"), F.struct("*").alias("whole")).join(gone, "row", "left_anti")
    repeated = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    return (left.dropDuplicates(["row"]) if repeated else left).select("whole.*")
