"""Helpers that several operators use: the shared folder, keyed streams inside tasks, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it, one on this machine, for a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def row_key() -> Column:
    """A row of documents by doc_id and text."""
    return F.xxhash64("doc_id", "text")


def row_keys(doc_ids: list[int | None], texts: list[str | None]) -> np.ndarray:
    """What row_key() gives: a null leaves the hash as it is."""
    out = np.zeros(len(texts), np.uint64)
    for i, (d, t) in enumerate(zip(doc_ids, texts)):
        h = 42 if d is None else xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)
        out[i] = h if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), h)
    return out.view(np.int64)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_stream(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key in one partition, in runs: what stream_groups() reads without holding a partition."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def stream_groups(batches: Iterable[pa.RecordBatch], key: str = "key") -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal keys (a long column, sorted) out of Arrow batches; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield int(last), pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(last), pa.Table.from_batches(held)


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[dict[str, list]]:
    """Rows as dicts of lists, cut when the texts reach `limit` characters (a longer text is a chunk of its own)."""
    names: list[str] = []
    rows: list[list] = []
    held = 0
    for batch in batches:
        names = batch.schema.names
        at = names.index(column)
        values = [c.to_pylist() for c in batch.columns]
        start = 0
        for i, text in enumerate(values[at]):
            held += len(text or "") + 16
            if held >= limit:
                rows = [r + v[start : i + 1] for r, v in zip(rows or [[] for _ in names], values)]
                yield dict(zip(names, rows))
                rows, held, start = [], 0, i + 1
        if start < len(values[at]):
            rows = [r + v[start:] for r, v in zip(rows or [[] for _ in names], values)]
    if rows and rows[0]:
        yield dict(zip(names, rows))


def pack_texts(doc_ids: list, texts: list, *more: list) -> tuple[int, bytes]:
    """A compressed batch of documents and the hash of its content, which serves as its key."""
    table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(texts, pa.large_string()), **{f"c{i}": pa.array(m, pa.string()) for i, m in enumerate(more)}})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    raw = sink.getvalue()
    return xxhash.xxh64_intdigest(raw, 7) - (1 << 63), zstandard.compress(raw, 3)


def unpack_texts(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.decompress(blob)) as r:
        return r.read_all()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + lengths[i]] for every i, concatenated."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - before, lengths)]
