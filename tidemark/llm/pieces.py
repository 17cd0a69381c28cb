"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs for merge-type vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ragged, text_chunks
from .word_cache import WordCache

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NONE = np.int32(2**31 - 1)
SHIFT = 22


class PieceModel:
    """A merge-type (BPE) model file, its pairs with their priority, and the library to check against.

    Pieces of the file cross neither from a letter to a space mark nor a newline (both are tested on loading), so texts
    are cut there into parts that merge on their own, and each distinct part is encoded once.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are served")
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep their text as it is are served")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4, 5)}
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("pieces that cross words or lines are not served")
        self.bytes = np.array([proto.pieces and self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.size = len(proto.pieces)
        # symbols: ids of pieces, and size + code point for characters that are no piece
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda s: normal[s] if s in normal else int(self.of_char[ord(s)]) if len(s) == 1 else None
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        found = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    found.append(((left << SHIFT) | right, order[proto.pieces[i].score], i))
        found.sort()
        self.keys, ranks, merged = (np.array(x, np.int64) for x in zip(*found))
        self.ranks, self.merged = ranks.astype(np.int32), merged.astype(np.int32)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it merges to no piece."""
        key = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Symbols of one word a row, padded by -1, merged until no pair is left.

        The agenda of a row is its vector of pair ranks: the best rank is merged first, of equal ranks the leftmost, and
        only the two pairs beside the merge are looked up anew. All rows advance together; those that are done leave.
        """
        out = np.full_like(rows, -1)
        if rows.shape[1] < 2:
            return rows.copy()
        where, cols = np.arange(len(rows)), np.arange(rows.shape[1])
        ranks = self._find(rows[:, :-1], rows[:, 1:])[0]
        while True:
            best = ranks.argmin(axis=1)
            n = np.arange(len(rows))
            done = ranks[n, best] == NONE
            if done.any():
                out[where[done]] = rows[done]
                rows, ranks, where, best = rows[~done], ranks[~done], where[~done], best[~done]
                n = n[: len(rows)]
            if not len(rows):
                return out
            _, merged = self._find(rows[n, best], rows[n, best + 1])
            shift = np.minimum(cols + (cols > best[:, None]), len(cols) - 1)
            rows = np.take_along_axis(rows, shift, axis=1)
            rows[:, -1] = -1
            rows[n, best] = merged
            ranks = np.take_along_axis(ranks, shift[:, :-1].clip(max=ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NONE
            after = np.minimum(best + 1, rows.shape[1] - 1)
            right, _ = self._find(merged, np.where(best + 1 < rows.shape[1], rows[n, after], -1))
            ranks[n, np.minimum(best, ranks.shape[1] - 1)] = np.where(best < ranks.shape[1], right, NONE)
            left, _ = self._find(np.where(best > 0, rows[n, np.maximum(best - 1, 0)], -1), merged)
            inner = best > 0
            ranks[n[inner], best[inner] - 1] = left[inner]

    def _agenda(self, symbols: list[int]) -> list[int]:
        """The same for one long part, with a heap of (rank, position) and a linked list of symbols: O(n log n)."""
        n = len(symbols)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = getattr(self, "_pairs", None)
        if pairs is None:
            pairs = self._pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (hit := pairs.get((symbols[i] << SHIFT) | symbols[j])):
                heapq.heappush(heap, (hit[0], i, (symbols[i] << SHIFT) | symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, key, merged = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or (symbols[i] << SHIFT) | symbols[j] != key:
                continue
            symbols[i], alive[j], nxt[i] = merged, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [s for s, a in zip(symbols, alive) if a]

    def _to_ids(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols; a character that is no piece becomes its bytes."""
        return np.array([x for s in symbols.tolist() for x in ([s] if s < self.size else self.bytes[list(chr(s - self.size).encode("utf-8", "surrogatepass"))].tolist())], np.int32)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of distinct parts, checked against the library in one call; raises where they differ."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (parts, flat ids, lengths)
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 32), (32, 64)):
            chosen = np.flatnonzero((lens > low) & (lens <= high))
            if not len(chosen):
                continue
            points = np.frombuffer("".join([parts[i] for i in chosen.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            rows = np.full((len(chosen), high), -1, np.int32)
            rows[np.arange(high) < lens[chosen][:, None]] = self.of_char[points]
            rows = self._merge_rows(rows)
            filled = rows >= 0
            odd = (rows >= self.size).any(axis=1)
            groups.append((chosen[~odd], rows[~odd][filled[~odd]], filled[~odd].sum(axis=1)))
            for i, row in zip(chosen[odd].tolist(), rows[odd]):
                run = self._to_ids(row[row >= 0])
                groups.append((np.array([i]), run, np.array([len(run)])))
        for i in np.flatnonzero(lens > 64).tolist():
            points = np.frombuffer(parts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            run = self._to_ids(np.array(self._agenda(self.of_char[points].tolist()), np.int64))
            groups.append((np.array([i]), run, np.array([len(run)])))
        if not groups:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        where, flat, counts = (np.concatenate(x) for x in zip(*groups))
        order = np.argsort(where)
        flat = ragged(flat, (np.cumsum(counts) - counts)[order], counts[order])
        return self._check(parts, flat, counts[order])

    def _check(self, parts: list[str], flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hold the ids of all parts against the library: each part is laid on a line of its own, across which nothing merges.

        The ids are the agenda's; where the library has others, the error counts the parts and shows the first.
        """
        text = "".join(["\n" + p for p in parts if p != "\n"]).replace(SPACE, " ")
        keep = np.fromiter((p != "\n" for p in parts), bool, len(parts))
        want = np.array(self.library.encode(text), np.int32)
        ours = flat[np.repeat(keep, counts)]
        lines = np.zeros(len(ours) + int(keep.sum()), bool)
        lines[np.cumsum(counts[keep] + 1) - counts[keep] - 1] = True
        laid = np.full(len(lines), self.bytes[10], np.int32)
        laid[~lines] = ours
        if not keep.any() or np.array_equal(want[1:], laid):
            return flat, counts
        runs = np.split(flat, np.cumsum(counts)[:-1])
        wrong = [parts[i] for i in np.flatnonzero(keep).tolist() if not np.array_equal(self.library.encode("\n" + parts[i].replace(SPACE, " "))[2:], runs[i])]
        if wrong:
            raise RuntimeError(f"the agenda's ids differ from the library's in {len(wrong)} of {len(parts)} parts, the first {wrong[0][:80]!r}")
        return flat, counts


_models: dict[str, tuple[PieceModel, WordCache]] = {}


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, PieceModel]:
    """(ids one after the other, ids of each text, model). Null and empty texts have none."""
    if path not in _models:
        model = PieceModel(path)
        _models[path] = model, WordCache(model.encode_parts)
    model, cache = _models[path]
    parts = [PART.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    ids, counts = cache.encode(parts)
    return ids, counts, model


def piece_rows(path: str, decode: bool = True, digests: bool = False, chunk: int = 1_500_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches, chunk):
            ids, counts, model = encode_texts(rows["text"], path)
            ends = np.cumsum(counts)
            runs = [ids[b - c : b].tolist() for b, c in zip(ends.tolist(), counts.tolist())]
            texts = model.library.decode(runs, num_threads=1) if decode and runs else [""] * len(runs)
            out = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "n_tokens": pa.array(counts, pa.int64())}
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in runs])
                out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts])
            else:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.record_batch(out)

    return run


def encode_documents(docs: DataFrame, path: str, decode: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them for every row of docs (doc_id, text), as the sentencepiece library has them.

    Without begin or end ids and without sampling. Null and empty texts give no ids and an empty decoded text. With `digests`,
    ids and decoded text are given as their SHA-256 (`ids_sha256` of the decimal ids joined by commas, `decoded_sha256`),
    which spares the way back to the JVM; without `decode` no text comes back. No shuffle: a row in, a row out; repeated rows and
    any other columns don't matter.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    out = docs.select("doc_id", "text").mapInArrow(piece_rows(path, decode, digests), schema)
    return out if decode or digests else out.drop("decoded")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), digests=True)
