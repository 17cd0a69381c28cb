"""Ids of texts by way of their distinct words: each new word is encoded once in a worker, then looked up."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress, islice

import numpy as np

from .shared import ragged


class Numbers(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


class WordCache:
    """Maps words to id runs. encode_new(words) gives (flat ids, lengths). Beyond `cap` words the less used half goes (bounded memory)."""

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], cap: int = 500_000):
        self.encode_new, self.cap = encode_new, cap
        self.index = Numbers()
        self.flat, self.starts, self.lengths, self.uses = np.zeros(1 << 16, np.int32), *(np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def _shrink(self) -> None:
        """Keep the cap / 2 most used words and halve their counts, so that what was frequent long ago goes in time."""
        n = len(self.index)
        keep = np.zeros(n, bool)
        keep[np.argpartition(self.uses[:n], n - self.cap // 2)[n - self.cap // 2 :]] = True
        words = list(compress(self.index, keep.tolist()))
        starts, lengths, uses = (a[:n][keep] for a in (self.starts, self.lengths, self.uses))
        self.flat = ragged(self.flat, starts, lengths)
        self.used, self.starts, self.lengths, self.uses = len(self.flat), np.cumsum(lengths) - lengths, lengths, uses // 2
        self.index = Numbers(zip(words, range(len(words))))

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, words: list) -> None:
        """Ids of words that the index has just numbered."""
        flat, lengths = self.encode_new(words)
        m = len(words)
        n = len(self.index) - m
        self.flat, self.starts, self.lengths, self.uses = self._room(self.flat, self.used + len(flat)), *(self._room(a, n + m) for a in (self.starts, self.lengths, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + m] = lengths
        self.uses[n : n + m] = 0
        self.used += len(flat)

    def _numbers(self, words: list) -> np.ndarray:
        """Numbers of words; new ones get ids."""
        if len(self.index) > self.cap:
            self._shrink()
        index, known = self.index, len(self.index)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if len(index) > known:
            try:
                self._add(list(islice(index, known, None)))
            except BaseException:  # words without ids must not stay known
                self.index = Numbers(islice(index.items(), known))
                raise
        return at

    def _runs(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers, and how many ids each of the docs has that they make up, `sizes` words a doc."""
        lengths = self.lengths[at]
        before = np.concatenate(([0], np.cumsum(lengths)))
        counts = np.diff(np.concatenate(([0], before[np.cumsum(sizes)])))
        return ragged(self.flat, self.starts[at], lengths), counts

    def encode_words(self, words: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for the words of all docs one after the other, `sizes` of them a doc."""
        at = self._numbers(words)
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        return self._runs(at, sizes)

    def encode(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all docs one after the other, number of ids of each doc) for docs given as lists of words."""
        return self.encode_words(list(chain.from_iterable(docs)), np.fromiter(map(len, docs), np.int64, len(docs)))

    def encode_coded(self, words: list, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for docs given as places in `words` (each word once) one after the other, `sizes` of them a doc."""
        at = self._numbers(words)
        self.uses[at] += np.bincount(codes, minlength=len(words))
        return self._runs(at[codes], sizes)
