"""Substring dedup by subtrees of suffixes, partitioned by prefixes of variable length."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_stream, pack_texts, stream_groups, text_chunks, unpack_texts

#: a word of up to LONGEST bytes has the sum of one random number for each byte and place (tabulation hashing); longer ones XXH64
LONGEST = 64
BYTE_AT = np.random.default_rng(13).integers(0, 1 << 64, LONGEST * 256, dtype=np.uint64)
M_LEFT, M_RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(a: np.ndarray) -> bytes:
    """Small int64 values in few bytes: byte planes, zstd."""
    return zstandard.compress(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


class Words:
    """The words of several texts: byte spans, text of each word, 64-bit symbol of each word, symbols of runs of words.

    Symbols of runs are built by doubling, mixed at each step, so that no pattern of words cancels out.
    """

    def __init__(self, texts: list[bytes], hashes: bool = True):
        self.raw = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.raw, np.uint8)
        inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
        change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.starts, self.ends = change[0::2], change[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc = np.searchsorted(np.cumsum(sizes), self.starts, side="right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.begins = np.cumsum(self.counts) - self.counts
        if not hashes:
            return
        lengths = self.ends - self.starts
        place = np.flatnonzero(inside).astype(np.int32) - np.repeat(self.starts.astype(np.int32), lengths)
        values = BYTE_AT[(np.minimum(place, LONGEST - 1) << 8) | a[inside]]
        symbol = mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths)) if len(lengths) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            symbol[i] = xxhash.xxh64_intdigest(self.raw[self.starts[i] : self.ends[i]], 13)
        self._runs = {1: symbol}

    def _run(self, n: int) -> np.ndarray:
        """Symbols of the n words (a power of two) from each place on."""
        if n not in self._runs:
            half = self._run(n // 2)
            right = np.zeros_like(half)
            right[: max(0, len(half) - n // 2)] = half[n // 2 :]
            self._runs[n] = mixed(half * M_LEFT + mixed(right + M_RIGHT))
        return self._runs[n]

    def suffixes(self, least: int) -> np.ndarray:
        """Places of the words with at least `least` words from them to their text's end."""
        last = np.cumsum(self.counts)[self.doc] if len(self.doc) else self.doc
        return np.flatnonzero(np.arange(len(self.doc)) + least <= last)

    def prefix(self, at: np.ndarray, length: int) -> np.ndarray:
        """The symbol of the first `length` words of each suffix: equal prefixes have equal symbols."""
        out, done = np.full(len(at), length, np.uint64), 0
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                out = mixed(out * M_LEFT + self._run(1 << k)[at + done])
                done += 1 << k
        return out


#: lengths at which a prefix may end, before the whole window
LENGTHS = (1, 2, 3, 5, 8)
#: slots of a counting table, and groups that suffixes are shuffled to at most: both bound what a plan holds at any size of the corpus
SLOTS, MOST_GROUPS = 1 << 16, 4096


class Plan:
    """How suffixes are split: by prefixes of one word, those too frequent by two, and so on; light prefixes share a group.

    hot[k] holds the slots of LENGTHS[k] above an eighth of a group's share. There are at most MOST_GROUPS groups; a group that has
    more suffixes than fit in memory is split further inside its task, into `subs` memory-sized subtrees by the whole window.
    """

    def __init__(self, window: int, groups: int, subs: int, hot: dict[int, np.ndarray]):
        self.window, self.groups, self.subs, self.hot = window, groups, subs, hot

    def lengths(self) -> list[int]:
        return [n for n in LENGTHS if n < self.window]

    def sub(self, label: np.ndarray) -> np.ndarray:
        return ((label >> np.uint64(20)) % np.uint64(self.subs)).astype(np.int64)

    def assign(self, words: Words, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Subtree of each suffix: its group times `subs` and its place in the group."""
        group = (label % np.uint64(self.groups)).astype(np.int64)
        left = np.arange(len(at))
        for n in self.lengths():
            symbol = words.prefix(at[left], n)
            hot = np.zeros(SLOTS, bool)
            hot[self.hot.get(n, [])] = True
            light = ~hot[(symbol % np.uint64(SLOTS)).astype(np.int64)]
            group[left[light]] = ((symbol[light] >> np.uint64(20)) % np.uint64(self.groups)).astype(np.int64)
            left = left[~light]
            if not len(left):
                break
        return group * self.subs + self.sub(label)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _count_rows(window: int, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [n for n in LENGTHS if n < window]
        seen = np.zeros((len(lengths), SLOTS), np.int64)
        for rows in text_chunks(batches, chunk):
            words = Words(_encoded(rows["text"]))
            at = words.suffixes(window)
            for k, n in enumerate(lengths):
                seen[k] += np.bincount((words.prefix(at, n) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        for k, n in enumerate(lengths):
            slot = np.flatnonzero(seen[k])
            yield pa.record_batch({"length": pa.array(np.full(len(slot), n), pa.int64()), "slot": pa.array(slot, pa.int64()), "n": pa.array(seen[k][slot])})

    return run


def make_plan(docs: DataFrame, window: int, chars_per_group: int, chunk: int, most_groups: int = MOST_GROUPS) -> Plan:
    """Prefixes are counted on all rows, in tables of SLOTS counts a task and length; the plan decides where suffixes go, never what is found."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    memory_sized = max(1, -(-chars // chars_per_group))
    groups = min(most_groups, memory_sized)
    counts = docs.select("text").mapInArrow(_count_rows(window, chunk), "length long, slot long, n long").groupBy("length", "slot").agg(F.sum("n").alias("n"))
    hot: dict[int, list[int]] = {}
    rows = counts.collect()  # at most SLOTS rows a length
    total = sum(r["n"] for r in rows if r["length"] == LENGTHS[0])
    for r in rows:
        if r["n"] * 8 * groups > max(total, 4096):
            hot.setdefault(r["length"], []).append(r["slot"])
    return Plan(window, groups, -(-memory_sized // groups), {k: np.array(v, np.int64) for k, v in hot.items()})


class Batch:
    """The suffixes of a batch of texts, whose rows must be in order of doc_id: the first of equal windows is then one of the batch's smallest document."""

    def __init__(self, rows: dict[str, list], plan: Plan):
        words = self.words = Words(_encoded(rows["text"]))
        self.known = np.array([d is not None for d in rows["doc_id"]] or [True], bool)
        self.ids = np.array([d or 0 for d in rows["doc_id"]] or [0], np.int64)
        self.at = words.suffixes(plan.window)
        #: label and first suffix of each distinct window, and the distinct window of each suffix
        self.label, first, self.window_of = np.unique(words.prefix(self.at, plan.window), return_index=True, return_inverse=True)
        self.first = self.at[first]
        subtree = plan.assign(words, self.first, self.label)
        order = np.lexsort((self.first, subtree))
        #: the distinct windows to send, by subtree and place in the batch; a null doc_id is smaller than none
        self.sent = order[self.known[words.doc[self.first[order]]]]
        self.subtree = subtree[self.sent]

    def place(self, suffix: np.ndarray) -> np.ndarray:
        """Words before a suffix in its document."""
        return suffix - self.words.begins[self.words.doc[suffix]]


def in_order(rows: dict[str, list]) -> dict[str, list]:
    """Rows by doc_id, nulls last, equal ones by text: the same whatever order they came in."""
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["text"][i] is None, rows["text"][i] or ""))
    return {k: [v[i] for i in order] for k, v in rows.items()}


def pack_suffixes(ids: np.ndarray, place: np.ndarray, label: np.ndarray) -> tuple[int, bytes, bytes]:
    """(number of runs of one doc_id, the runs and places, labels) of suffixes."""
    cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    step = np.diff(place, prepend=0)
    step[cuts] = place[cuts]
    return len(cuts), planes(np.concatenate((np.diff(ids[cuts], prepend=0), np.diff(np.append(cuts, len(ids))), step))), label.tobytes()


def unpack_suffixes(n_runs: int, head: bytes, labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, label = unplanes(head), np.frombuffer(labels, np.uint64)
    counts, step = h[n_runs : 2 * n_runs], h[2 * n_runs :]
    total = np.cumsum(step)
    begins = np.cumsum(counts) - counts
    return np.repeat(np.cumsum(h[:n_runs]), counts), total - np.repeat(total[begins] - step[begins], counts), label


def _suffix_rows(plan: Plan, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            rows = in_order(rows)
            key, _ = pack_texts(rows["doc_id"], rows["text"])
            held = Batch(rows, plan)
            suffix, label = held.first[held.sent], held.label[held.sent]
            ids, place, group = held.ids[held.words.doc[suffix]], held.place(suffix), held.subtree // plan.subs
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            out = [(int(group[a]), key, *pack_suffixes(ids[a:b], place[a:b], label[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)])]
            if out:
                yield pa.record_batch(dict(zip(("key", "batch", "n_runs", "head", "labels"), (pa.array(x) for x in zip(*out)))))

    return run


def _split_rows(plan: Plan) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a group as rows of its subtrees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for key, batch, n, head, labels in zip(*(rows.column(c).to_pylist() for c in ("key", "batch", "n_runs", "head", "labels"))):
                ids, place, label = unpack_suffixes(n, head, labels)
                sub = plan.sub(label)
                cuts = np.flatnonzero(np.diff(sub, prepend=-1))
                out += [(key * plan.subs + int(sub[a]), batch, *pack_suffixes(ids[a:b], place[a:b], label[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sub)])]
            if out:
                yield pa.record_batch(dict(zip(("key", "batch", "n_runs", "head", "labels"), (pa.array(x) for x in zip(*out)))))

    return run


def _subtree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build each subtree down to the window's depth, and give each suffix below a node with a smaller doc_id that document and its place there.

    Suffixes are sorted by label; a run of equal labels is what lies below one node of the window's depth or more. The node's
    smallest document, and the first place in it, stand for all that begin there.
    """
    for _, table in stream_groups(batches):
        batch = table.column("batch").to_pylist()
        parts = [unpack_suffixes(*x) for x in zip(*(table.column(c).to_pylist() for c in ("n_runs", "head", "labels")))]
        sizes = [len(p[2]) for p in parts]
        ids, place, label = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(label)
        nodes = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
        width = np.diff(np.append(nodes, len(label)))
        inner = width > 1  # a leaf has no other document
        order = order[np.repeat(inner, width)]
        width = width[inner]
        marked, owner, at = np.zeros(len(label), bool), np.zeros(len(label), np.int64), np.zeros(len(label), np.int64)
        if len(width):
            nodes = np.cumsum(width) - width
            least = np.repeat(np.minimum.reduceat(ids[order], nodes), width)
            first = np.minimum.reduceat(np.where(ids[order] == least, place[order], np.iinfo(np.int64).max), nodes)
            marked[order], owner[order], at[order] = ids[order] > least, least, np.repeat(first, width)
        key, out = int(table.column("key")[0].as_py()), []
        for e, n in zip(np.cumsum(sizes).tolist(), sizes):
            m = marked[e - n : e]
            where = np.flatnonzero(m)
            out.append(planes(np.concatenate((np.diff(where, prepend=0), np.diff(owner[e - n : e][m], prepend=0), at[e - n : e][m]))) if len(where) else b"")
        yield pa.record_batch({"key": pa.array(batch, pa.int64()), "part": pa.array([key] * len(batch), pa.int64()), "n": pa.array(sizes, pa.int64()), "body": pa.array(out, pa.binary())})


def _text_rows(chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            rows = in_order(rows)
            batch, blob = pack_texts(rows["doc_id"], rows["text"])
            yield pa.record_batch({"key": pa.array([batch], pa.int64()), "part": pa.array([-1], pa.int64()), "n": pa.array([len(rows["text"])], pa.int64()), "body": pa.array([blob], pa.binary())})

    return run


def find_repeats(rows: dict[str, list], plan: Plan, marks: dict[int, tuple[int, bytes]]) -> tuple[Batch, np.ndarray]:
    """(batch, repeats): rows (first word, end, source doc_id, place there) of the batch's maximal repeats, in order of words.

    Each window that also begins in a smaller document is credited to the smallest of them, at its first place there. Neighbouring windows
    credited to neighbouring places of one document are one repeat: it can be made no longer on either side.
    """
    held, window = Batch(rows, plan), plan.window
    doc = held.words.doc
    n = len(held.first)
    owner, place, smaller = held.ids[doc[held.first]] if n else np.zeros(0, np.int64), held.place(held.first), np.zeros(n, bool)
    cuts = np.flatnonzero(np.diff(held.subtree, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(held.sent)]):
        size, body = marks.get(int(held.subtree[a]), (-1, b""))
        if size != b - a:
            raise RuntimeError("a batch of texts differs from the one that was split: read docs from a table")
        if body:
            where, ids, at = unplanes(body).reshape(3, -1)
            hit = held.sent[a:b][np.cumsum(where)]
            owner[hit], place[hit], smaller[hit] = np.cumsum(ids), at, True
    of = held.window_of
    hit = held.known[doc[held.at]] & (smaller[of] | (held.ids[doc[held.at]] > owner[of]))
    at, of = held.at[hit], of[hit]
    if not len(at):
        return held, np.zeros((0, 4), np.int64)
    follows = (np.diff(at) == 1) & (doc[at[1:]] == doc[at[:-1]]) & (owner[of[1:]] == owner[of[:-1]]) & (np.diff(place[of]) == 1)
    begin = np.flatnonzero(np.concatenate(([True], ~follows)))
    last = np.append(begin[1:], len(at)) - 1
    return held, np.stack([at[begin], at[last] + window, owner[of[begin]], place[of[begin]]], axis=1)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])
SPANS = "array<struct<start:long,end:long,source:long,source_start:long>>"


def _result_rows(plan: Plan) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in stream_groups(batches):
            part, size, body = np.asarray(table.column("part")), table.column("n").to_pylist(), table.column("body").to_pylist()
            marks = {int(p): (n, b) for p, n, b in zip(part, size, body) if p >= 0}
            for i in np.flatnonzero(part < 0).tolist():  # more than one only where whole batches repeat
                docs = unpack_texts(body[i])
                held, repeats = find_repeats({"doc_id": docs.column("doc_id").to_pylist(), "text": docs.column("text").to_pylist()}, plan, marks)
                words = held.words
                edges = np.zeros(len(words.doc) + 1, np.int64)
                np.add.at(edges, repeats[:, 0], 1)
                np.add.at(edges, repeats[:, 1], -1)
                removed = np.cumsum(edges[:-1]) > 0
                n_removed = np.bincount(words.doc, weights=removed, minlength=len(words.counts)).astype(np.int64)
                own = words.doc[repeats[:, 0]]
                spans = pa.StructArray.from_arrays([pa.array(c) for c in (repeats[:, 0] - words.begins[own], repeats[:, 1] - words.begins[own], repeats[:, 2], repeats[:, 3])], fields=list(SPAN))
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(words.counts))))), pa.int32()), spans)
                kept = []
                for b, n, gone in zip(words.begins.tolist(), words.counts.tolist(), n_removed.tolist()):
                    keep = np.flatnonzero(~removed[b : b + n]) + b if gone < n else ()
                    kept.append(b" ".join([words.raw[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]).decode("utf-8", "surrogatepass") if len(keep) else "")
                yield pa.record_batch({"doc_id": docs.column("doc_id").combine_chunks(), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(n_removed), "spans": spans, "kept_text": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, chars_per_group: int = 1_500_000, chunk: int = 4_000_000, most_groups: int = MOST_GROUPS) -> DataFrame:
    """doc_id, n_words, n_removed, spans (the maximal repeats removed) and kept_text of every row of docs (doc_id, text).

    Every suffix of every text is dealt to a group by a prefix of variable length: one word where the word is rare, longer where it
    is frequent (see Plan). There are at most `most_groups` groups, so that what a batch of texts (about `chunk` characters) sends is bounded at
    any size of the corpus; inside its task a group is split into subtrees that fit in memory. A suffix carries the 64-bit symbol
    of its first `window` words, its doc_id and its place. Sorted symbols give a subtree's nodes at the window's depth; each node has
    its smallest doc_id and the first place there. How deep a node goes beyond the window is not looked up in the subtree but read along
    the text: windows that follow one another in both documents are one repeat. So a span has start and end in words (end
    exclusive), the document it repeats and where it starts there, and is maximal: neither side can be extended by a window of that document.
    Spans of different sources may overlap or abut; n_removed counts each word once. Of equal suffixes in one batch only the
    first is sent, so a passage in a third of all texts costs a suffix per batch.

    Different windows with one symbol have odds of 2**-64 a pair: with n different windows n**2 / 2**65 pairs are expected to agree by
    chance (0.02 in all at a billion windows; at 10**13 a few millions, one window in some millions).

    A word goes if a window over it also starts in a row with a smaller doc_id, judged on the input. Rows with one doc_id don't
    count against each other; rows with a null doc_id are kept whole and count against none; null and empty texts have
    no words; texts shorter than the window stay; an empty table gives no rows. docs must read the same each time, as a table does; a batch that differs raises.
    """
    slim = docs.select("doc_id", "text")
    plan = make_plan(slim, window, chars_per_group, chunk, most_groups)
    columns = "key long, batch long, n_runs long, head binary, labels binary"
    suffixes = keyed_stream(slim.mapInArrow(_suffix_rows(plan, chunk), columns), "key")
    if plan.subs > 1:  # within each task: no second shuffle
        suffixes = suffixes.mapInArrow(_split_rows(plan), columns).sortWithinPartitions("key")
    marks = suffixes.mapInArrow(_subtree_rows, "key long, part long, n long, body binary")
    texts = slim.mapInArrow(_text_rows(chunk), "key long, part long, n long, body binary")
    return keyed_stream(texts.unionByName(marks), "key").mapInArrow(_result_rows(plan), f"doc_id long, n_words long, n_removed long, spans {SPANS}, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
