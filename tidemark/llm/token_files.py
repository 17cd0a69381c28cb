"""Token ids in binary files with directly addressable codes: chunk levels, continuation bitmaps, rank directories."""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_stream, materialise, ragged, shared_dir, text_chunks
from .word_cache import Numbers, WordCache

MAGIC = b"DACF0001"
BLOCK = 512  # bits a rank directory entry stands for


class Codes:
    """Directly addressable codes over unsigned integers.

    Level 0 holds the lowest `bits` (8) of every value; a value that needs more has its bit set in the level's bitmap, and its
    next 8 bits stand in level 1 at the rank of that bit; and so on. ranks[k] counts the set bits before block k, so the
    place of any value on any level takes one directory entry and at most eight words of bitmap: no block is decoded.
    """

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, values: np.ndarray) -> Codes:
        rest, levels = np.asarray(values, np.uint64), []
        n = len(rest)
        while len(rest):
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            words = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 64, np.uint64)
            words.view(np.uint8)[: len(bits)] = bits
            ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            levels.append(((rest & 0xFF).astype(np.uint8), words, np.cumsum(ones, dtype=np.uint64) - ones))
            rest = rest[more] >> np.uint64(8)
        return cls(n, levels)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at any positions, in any order."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the file")
        out, open_ = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (data, words, ranks) in enumerate(self.levels):
            out[open_] |= data[at].astype(np.uint64) << np.uint64(8 * k)
            word, bit = at // 64, (at % 64).astype(np.uint64)
            go = (words[word] >> bit) & np.uint64(1) == 1
            at, word, bit, open_ = at[go], word[go], bit[go], open_[go]
            if not len(at):
                break
            before = ranks[at // BLOCK].astype(np.int64)
            for j in range(BLOCK // 64 - 1):  # whole words of the block before the bit's own
                inside = word % (BLOCK // 64) > j
                before += np.where(inside, np.bitwise_count(words[word - word % (BLOCK // 64) + j]), 0)
            at = before + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return out

    def all(self) -> np.ndarray:
        """Every value, level by level from the last."""
        rest = np.zeros(0, np.uint64)
        for data, words, _ in reversed(self.levels):
            out = data.astype(np.uint64)
            if len(rest):
                out[np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[: len(data)])] |= rest << np.uint64(8)
            rest = out
        return rest

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<QQ", self.n, len(self.levels))]
        for data, words, ranks in self.levels:
            parts += (struct.pack("<Q", len(data)), data.tobytes(), bytes(-len(data) % 8), words.tobytes(), ranks.tobytes())
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: memoryview) -> Codes:
        n, count = struct.unpack_from("<QQ", raw)
        at, levels = 16, []
        for _ in range(count):
            (m,) = struct.unpack_from("<Q", raw, at)
            blocks = -(-m // BLOCK)
            data = np.frombuffer(raw, np.uint8, m, at + 8)
            words = np.frombuffer(raw, np.uint64, blocks * BLOCK // 64, at + 8 + -(-m // 8) * 8)
            at += 8 + -(-m // 8) * 8 + len(words) * 8
            levels.append((data, words, np.frombuffer(raw, np.uint64, blocks, at)))
            at += blocks * 8
        return cls(n, levels)


def file_bytes(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, number of documents, doc_ids, a flag for those that are not null, the ends of their ids, the codes."""
    return b"".join((MAGIC, struct.pack("<Q", len(doc_ids)), doc_ids.astype("<i8").tobytes(), known.astype("<i8").tobytes(), np.cumsum(counts).astype("<i8").tobytes(), Codes.of(ids).to_bytes()))


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """(doc_ids, known, ends, codes) of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<Q", raw, 8)
    table = np.frombuffer(raw, "<i8", 3 * n, 16).reshape(3, n)
    return table[0], table[1].astype(bool), table[2], Codes.from_bytes(memoryview(raw)[16 + 24 * n :])


_encoders: dict[str, "ByWords | WholeTexts"] = {}

# What the word-level path takes for granted of a tokenizer: it folds and normalises within words, cuts at white space, and
# takes runs of letters and runs of marks as pieces of their own, each ended by the marked piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# kinds of bytes in UTF-8: ASCII letters, ASCII marks, the first and the second byte of Latin-1 letters beyond ASCII
_KINDS = np.zeros(256, np.uint8)
for _kind, _spans in enumerate((b"AZaz", b"!/:@[`{~", b"\xc3\xc3", b"\x80\x96\x98\xb6\xb8\xbf"), 1):
    for _first, _last in zip(_spans[::2], _spans[1::2]):
        _KINDS[_first : _last + 1] = _kind


def parts(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Each word as (letters, marks behind them) if it is a run of Latin-1 letters and ASCII marks behind it, else as (nothing, the word). No word has a line feed."""
    if not words:
        return [], []
    raw = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
    kind = _KINDS[raw]
    pair = (kind[:-1] == 3) & (kind[1:] == 4)  # the last byte is a line feed
    letter = kind == 1
    letter[:-1] |= pair
    letter[1:] |= pair
    mark = kind == 2
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    bad = ~(letter | mark)
    bad[ends] = False
    bad[1:] |= mark[:-1] & letter[1:]
    plain = letter[starts]
    plain[np.searchsorted(ends, np.flatnonzero(bad))] = False
    before = np.cumsum(letter)
    cut = starts + np.where(plain, before[ends] - before[starts] + 1, 0)  # a plain word begins with a letter
    both = np.insert(raw, cut, 10).tobytes().split(b"\n")
    return both[:-1:2], both[1::2]


def cuts_at_words(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) treats words as the word-level path does."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": CUTS} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    rest = [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    # an added token must lie within one word, and in none that parts() takes apart
    added = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) and re.match(r"[!-/:-@\[-`{-~]+[A-Za-z]", t["content"]) for t in spec.get("added_tokens", []))
    model = spec.get("model", {})
    return bool(spec.get("normalizer") == NORMALIZER and first and rest and added and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout"))


def _flat(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter(chain.from_iterable(runs), np.int32, int(lengths.sum())), lengths


class WholeTexts:
    """Encodes texts as they are: for tokenizers whose rules the word-level path doesn't know."""

    def __init__(self, batch: Callable):
        self.batch = batch

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.batch([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)])


def _lines(words: pa.Array) -> list[bytes]:
    """Strings without line feeds (large_string) as bytes."""
    whole = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\n", pa.large_string()))
    return whole.view(pa.large_binary())[0].as_py().split(b"\n") if len(words) else []


class ByWords(WordCache):
    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # ASCII white space alone; other white space stays within words, for the tokenizer to drop. The empty words at a text's ends have no ids
        docs = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        # each word once, so that few strings are looked up
        coded = docs.flatten().dictionary_encode()
        return self.encode_coded(_lines(coded.dictionary), coded.indices.to_numpy(), np.diff(docs.offsets.to_numpy()))


def encoder(path: str) -> ByWords | WholeTexts:
    """The tokenizer in a file, by words where its rules allow that."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return ByWords(_word_encoder(tokenizer, batch, letters_alone(tokenizer))) if cuts_at_words(json.loads(tokenizer.to_str())) else WholeTexts(batch)


def letters_alone(tokenizer) -> Callable:
    """Batches of words of lower-case Latin-1 letters, between spaces, through the tokenizer's model: they need neither its normaliser nor the cuts
    of CUTS. Letters are spelt byte by byte here, by the library's own table, as that costs the library more for each word."""
    from tokenizers import Tokenizer, pre_tokenizers

    spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelt = list(map(chr, range(256)))
    for c in map(chr, range(0xC0, 0x100)):
        for byte, char in zip(c.encode(), "".join(piece for piece, _ in spelling.pre_tokenize_str(c)), strict=True):
            spelt[byte] = char
    table = "".join(spelt)
    letters = Tokenizer(tokenizer.model)
    letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    batch = getattr(letters, "encode_batch_fast", letters.encode_batch)
    return lambda texts, **options: batch([codecs.charmap_decode(t.encode(), "strict", table)[0] for t in texts], **options)


def _word_encoder(tokenizer, batch: Callable, of_letters: Callable) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith(WORD_END)]] = True

    def in_lines(words: list[bytes], width: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters, many to a call: each is one run of pieces, of which the last alone is marked as a word's end."""
        flat, _ = WholeTexts(of_letters).encode_texts([b" ".join(words[i : i + width]) for i in range(0, len(words), width)])
        ends = np.flatnonzero(last[flat]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(flat)):
            return WholeTexts(batch).encode_texts(words)
        return flat, np.diff(ends, prepend=0)

    letters = WordCache(in_lines)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of white-space-free words. A word of letters and closing marks has the ids of its letters, then those of its marks, as the
        tokenizer cuts there anyway; letters are folded first, as it does itself, and kept for other words with them. So fewer strings reach the library."""
        cores, marks = parts(words)
        odd = Numbers({b"": 0})  # no mark: no ids
        mark = np.fromiter(map(odd.__getitem__, marks), np.int64, len(words))
        some = np.fromiter(map(bool, cores), bool, len(words))
        folded = list(filter(None, b"\n".join(cores).decode().lower().encode().split(b"\n")))
        flat, lengths = map(np.concatenate, zip(WholeTexts(batch).encode_texts(list(odd)), letters.encode_words(folded, np.ones(len(folded), np.int64))))
        starts = np.cumsum(lengths) - lengths
        two = np.stack([np.where(some, np.cumsum(some) + len(odd) - 1, 0), mark], axis=1)
        return ragged(flat, starts[two].ravel(), lengths[two].ravel()), lengths[two].sum(axis=1)

    return encode


def ranges_of(doc_ids: list[int | None], ties: np.ndarray, bounds: np.ndarray, nulls: int) -> np.ndarray:
    """Range of each row in ascending order of (doc_id, tie): `nulls` ranges for rows without a doc_id, then one for each bound and one more.

    bounds may repeat: a doc_id that fills several ranges is dealt over them by its rows' ties (hashes of their texts).
    """
    spread = lambda tie, n: ((tie >> np.uint64(32)) * np.asarray(n, np.uint64) >> np.uint64(32)).astype(np.int64)
    known = np.array([d is not None for d in doc_ids], bool)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return np.where(known, nulls + low + spread(ties, np.maximum(high - low, 1)), spread(ties, max(nulls, 1)))


def _token_rows(path: str, end_id: int, bounds: np.ndarray, nulls: int, chunk: int = 8_000_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = encoder(path)
        for rows in text_chunks(batches, chunk):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
            ids, counts = _encoders[path].encode_texts(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            ends += np.arange(1, len(ends) + 1)
            # two bytes an id where all fit, else four
            wide = len(ids) and int(ids.max()) > 0xFFFF
            raw = ids if wide else ids.astype("<u2")
            starts = np.concatenate(([0], ends[:-1]))
            ties = np.array([xxhash.xxh64_intdigest(t, 6) for t in texts], np.uint64)
            key = ranges_of(rows["doc_id"], ties, bounds, nulls)
            # the tie in the order of unsigned numbers, as the ranges have it
            yield pa.record_batch({"key": key, "doc_id": pa.array(rows["doc_id"], pa.int64()), "tie": (ties ^ np.uint64(1 << 63)).view(np.int64), "wide": pa.array(np.full(len(key), bool(wide))), "ids": pa.array([raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())})

    return run


def _write_rows(folder: str, ids_per_file: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files of about ids_per_file ids out of sorted rows; no more than a file's rows are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def write(key: int, piece: int, doc_ids: list, runs: list) -> pa.RecordBatch:
            known = np.array([d is not None for d in doc_ids], bool)
            counts = np.fromiter(map(len, runs), np.int64, len(runs))
            raw = file_bytes(np.array([d or 0 for d in doc_ids], np.int64), known, counts, np.concatenate(runs).astype(np.uint64))
            name, part = f"{root}/part-{key:06d}-{piece:06d}.dac", f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:  # a task that runs twice writes the same file twice
                out.write(raw)
            store.move(part, name)
            return pa.record_batch({"part": pa.array([key], pa.int64()), "piece": pa.array([piece], pa.int64()), "n_docs": pa.array([len(runs)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64()), "n_bytes": pa.array([len(raw)], pa.int64())})

        last, piece, held, doc_ids, runs = None, 0, 0, [], []
        for batch in batches:
            for key, doc_id, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "wide", "ids"))):
                if runs and (key != last or held >= ids_per_file):
                    yield write(last, piece, doc_ids, runs)
                    piece, held, doc_ids, runs = piece + 1, 0, [], []
                if key != last:
                    last, piece = key, 0
                doc_ids.append(doc_id)
                runs.append(np.frombuffer(raw, "<u4" if wide else "<u2"))
                held += len(runs[-1])
        if runs:
            yield write(last, piece, doc_ids, runs)

    return run


#: ranges at most; beyond it ranges become longer, and a task writes more files one after the other
MOST_RANGES = 1 << 15


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, chars_per_file: int = 4_000_000) -> DataFrame:
    """Encode docs (doc_id, text) and write their ids to `folder` (a URI that all executors reach) in ascending doc_id order.

    The doc_ids are cut at quantiles into ranges of about `chars_per_file` characters (MOST_RANGES at most, so the bounds stay
    small); each range is a task that writes its sorted rows to files of that size, part-000000-000000.dac first. Rows with
    a null doc_id come first of all; rows of one doc_id are in order of a hash of their text, and are dealt over several ranges where they fill
    more than one. Null and empty texts have the end id alone. An empty table writes no file. Texts become ids before
    the shuffle, at two bytes an id where they fit. Returns the manifest, a row per file: part, piece, n_docs, n_tokens, n_bytes.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    chars, of_null = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0))).first()
    per_range = max(chars_per_file, -(-chars // MOST_RANGES))
    nulls, n = -(-of_null // per_range), max(1, -(-(chars - of_null) // per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, n + 1)[1:-1]]), F.lit(max(10_000, 20 * n)))).first()[0] if n > 1 else []
    bounds = np.array(cuts or [], np.int64)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select("doc_id", "text").mapInArrow(_token_rows(path, end_id, bounds, nulls), "key long, doc_id long, tie long, wide boolean, ids binary")
    written = keyed_stream(rows, "key", "doc_id", "tie").mapInArrow(_write_rows(folder, chars_per_file // 4), "part long, piece long, n_docs long, n_tokens long, n_bytes long")
    return materialise(written, "manifest")


def _read_rows(digest: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                doc_ids, known, ends, codes = read_file(raw)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                ids = codes.all().astype("<u4")
                part, piece = map(int, name.rsplit("part-", 1)[1].removesuffix(".dac").split("-"))
                out = {"part": pa.array(np.full(len(ends), part), pa.int64()), "piece": pa.array(np.full(len(ends), piece), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "offset": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64())}
                if digest:
                    out["ids_crc32"] = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(out)

    return run


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (or, with digest, ids_crc32) of every document in the files.

    Only a row per range (MOST_RANGES at most) is ordered in one place, to find where each begins; a range's own files are
    ordered within it, and the files are read side by side.
    """
    spark = manifest.sparkSession
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("of_part"))
    starts = manifest.select("part", "piece", before(Window.partitionBy("part").orderBy("piece")).alias("of_piece")).join(parts, "part")
    columns = "part long, piece long, doc_id long, offset long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder).select("path", "content")
    return files.mapInArrow(_read_rows(digest), columns).join(starts, ["part", "piece"]).select("doc_id", (F.col("of_part") + F.col("of_piece") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def fetch_tokens(raw: bytes, doc_id: int, positions: list[int]) -> list[int]:
    """Single tokens of one document out of a file's bytes, without decoding the rest."""
    doc_ids, known, ends, codes = read_file(raw)
    k = int(np.flatnonzero((doc_ids == doc_id) & known)[0])
    start = int(ends[k - 1]) if k else 0
    if positions and not 0 <= min(positions) <= max(positions) < int(ends[k]) - start:
        raise IndexError("position outside the document")
    return codes.get(np.array(positions, np.int64) + start).tolist()


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), folder)
    return read_token_files(manifest, folder, digest=True)
