"""Quality rules with suffix-array repetition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_chunks

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"


def suffix_array(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the next) of several texts at once, texts apart.

    symbols: non-negative ints; doc: ascending number of the text that each belongs to. Prefix doubling: after the round with
    step h, suffixes are ranked by their first 2h symbols (a rank is the place of its class), and only suffixes
    whose class has several members go on. A suffix that ends counts as smaller. Common prefixes come from the ranks of all rounds:
    from the longest step down, equal ranks mean that many equal symbols.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    room = np.append(np.flatnonzero(np.diff(doc)), n - 1)  # last place of each text
    left = np.repeat(room, np.diff(np.concatenate(([-1], room)))) - np.arange(n) + 1  # symbols from here to the text's end
    key = doc.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    sizes = np.diff(np.append(np.flatnonzero(first), n))
    open_ = order[np.repeat(sizes, sizes) > 1]
    levels, h = [rank.astype(np.int32)], 1
    while len(open_):
        second = np.where(left[open_] > h, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        sort = np.lexsort((second, rank[open_]))
        at, a, b = open_[sort], rank[open_][sort], second[sort]
        new_class = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_class | np.concatenate(([True], b[1:] != b[:-1]))
        place = np.arange(len(at))
        heads = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_class, place, 0))
        rank[at] = a + heads
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = at[np.repeat(sizes, sizes) > 1]
        h *= 2
        levels.append(rank.astype(np.int32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(doc[i] == doc[j]) if n > 1 else np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        for _ in range(2 if k == len(levels) - 1 else 1):
            a, b = i[live] + common[live], j[live] + common[live]
            fits = (left[np.minimum(a, n - 1)] >= step) & (left[np.minimum(b, n - 1)] >= step) & (common[live] < np.minimum(left[i[live]], left[j[live]]))
            same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            common[live[same]] += step
    return order, common


def repeated_from(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the longest substring that starts there and occurs elsewhere in its text: the deeper of its two common-prefix intervals."""
    longest = np.zeros(len(order), np.int64)
    if len(order) > 1:
        longest[order[:-1]] = common
        longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places inside the union of the spans [i, i + longest[i]) of those that are `least` or longer."""
    n = len(longest)
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(longest >= least)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + longest[starts], -1)
    return np.cumsum(edges[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """Counts of each text: see repetition_rules()."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]  # of bytes: the six white space characters of ASCII alone
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    index: dict[bytes, int] = {}
    symbols = np.fromiter((index.setdefault(w, len(index)) for w in chain.from_iterable(words)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(words)), n_words)
    longest = repeated_from(*suffix_array(symbols, doc))
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(words)).astype(np.int64)
    longest_repeat = np.zeros(len(words), np.int64)
    np.maximum.at(longest_repeat, doc, longest)
    lines = []
    for r in raw:
        # the contract's lines hold a word; equal means equal as they stand
        own = [x for x in r.split(b"\n") if x.strip(BLANKS)]
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t or "") - (len(r) - len(r.translate(None, BLANKS))) for t, r in zip(texts, raw)], np.int64),
        "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": per_doc(covered(np.where(longest >= 3, 3, 0), 3)),
        "repeat_covered": per_doc(covered(longest, min_repeat)),
        "longest_repeat": longest_repeat,
    }


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat")


def _rule_rows(min_repeat: int, max_covered: float, max_longest: int, chunk: int = 4_000_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            m = measure(rows["text"], min_repeat)
            base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~base & (m["repeat_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            yield pa.record_batch({"doc_id": pa.array(rows["doc_id"], pa.int64()), **{k: pa.array(m[k], pa.int64()) for k in FIELDS}, "base_failed": pa.array(base), "kept": pa.array(kept)})

    return run


def repetition_rules(docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 200) -> DataFrame:
    """Counts and verdict for every row of docs (doc_id, text), each text as a whole and on its own.

    A suffix array over a text's words gives its common-prefix intervals; those of `min_repeat` words or more are maximal
    repeated substrings, and `repeat_covered` is the number of words in the union of all their occurrences,
    `longest_repeat` the length of the longest (of any length). kept is false if base_failed (under 50 words, or over half of them in three-word
    windows found twice), if over max_covered of the words are covered, or if a repeat is longer than max_longest.
    Null and empty texts have no words and fail. No shuffle: a row in, a row out; repeated rows each get their own.
    """
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in FIELDS) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(_rule_rows(min_repeat, max_covered, max_longest), schema)


def op8_repetition_rules(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
