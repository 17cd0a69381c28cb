"""Operators on texts, against brute force over whole tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tidemark.llm import pieces, repetition, secrets, simhash, substring_dedup, token_files
from tidemark.llm.registry import queries

from .fixtures import SCHEMA, documents, extra, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@pytest.fixture(scope="module", params=["fixture", "sf0.001"])
def folder(request, spark, data, tmp_path_factory):
    if request.param == "sf0.001":
        return data
    return table(spark, documents(), tmp_path_factory.mktemp("docs"))


def read(spark, folder) -> list:
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def result(spark, folder, name: str) -> list[dict]:
    return [r.asDict() for r in next(f for k, f in queries().items() if k.startswith(f"{name}_"))(spark, folder).collect()]


def same(found: list[dict], want: list[tuple], columns: list[str]) -> None:
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(want, key=repr)


def test_op1_substring_dedup(spark, folder):
    rows = [(d, WORD.findall(t or "")) for d, t, _ in read(spark, folder)]
    first: dict = {}
    for d, words in rows:
        for i in range(len(words) - 12):
            w = tuple(words[i : i + 13])
            first[w] = min(first.get(w, d), d)
    want = []
    for d, words in rows:
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))))
    same(result(spark, folder, "op1"), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def test_op1_small_groups_and_batches(spark, tmp_path):
    """Any number of groups and any batches give the same result: frequent prefixes are split further, large groups into subtrees."""
    rows = [(d, t) for d, t, *_ in documents()] + [(None, "alpha " * 40), (7, "alpha " * 40)]
    docs = spark.read.parquet(f"{table(spark, rows, tmp_path, 'doc_id long, text string')}/documents.parquet")
    look = lambda **o: sorted(map(repr, substring_dedup.dedup_substrings(docs, **o).select("doc_id", "n_words", "n_removed", "kept_text", "spans").collect()))
    assert look() == look(chars_per_group=600, chunk=2000) == look(chars_per_group=600, chunk=2000, most_groups=3)


def test_op1_plan_counts_every_row(spark):
    """A prefix of 600 suffixes is above the limit of 512 only if none of its rows is left out, whatever the corpus' size (400 million characters here)."""
    import numpy as np

    blank = spark.range(0, 20, 1, 20).selectExpr("id AS doc_id", "repeat(' ', 20000000 + int(id % 2)) AS text")
    rows = spark.range(100, 700, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', 'frequent', transform(sequence(1, 12), i -> concat('w', id * 20 + i))) AS text")
    plan = substring_dedup.make_plan(blank.union(rows), 13, 1_500_000, 4_000_000, most_groups=1)
    word = substring_dedup.Words([b"frequent"])
    slot = int(word.prefix(np.zeros(1, np.int64), 1)[0] % np.uint64(substring_dedup.SLOTS))
    assert plan.hot[1].tolist() == [slot]


def test_op1_long_words_of_two_letters(spark, tmp_path):
    """Words on which polynomial hashes modulo a power of two agree, and words beyond the table's length."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other, rest = thue.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{thue} {rest}"), (2, f"{other} {rest}"), (3, f"{'x' * 70}a {rest}"), (4, f"{'x' * 70}b {rest}"), (5, f"{'x' * 70}b {rest}")]
    docs = spark.read.parquet(f"{table(spark, rows, tmp_path, 'doc_id long, text string')}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}


def test_op1_maximal_repeats(spark, tmp_path):
    """Repeats that overlap or abut, from different documents, are spans of their own; each is as long as it can be."""
    import random

    rng = random.Random(17)
    word = lambda: f"u{rng.randrange(10**9)}"
    one, two, three = ([word() for _ in range(n)] for n in (40, 30, 25))
    texts = {1: one, 2: two, 3: [word(), *three], 4: [word(), *one[5:30], *two[3:20], word(), *three, word(), *one[10:40]]}
    docs = spark.read.parquet(f"{table(spark, [(d, ' '.join(w)) for d, w in texts.items()], tmp_path, 'doc_id long, text string')}/documents.parquet")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.dedup_substrings(docs, chunk=300).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [(1, 26, 1, 5), (26, 43, 2, 3), (44, 69, 3, 1), (70, 100, 1, 10)]}


def test_op5_secrets(spark, folder):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    want = []
    for d, t, _ in read(spark, folder):
        spans = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least]
        n = Counter(s[3] for s in spans)
        want.append((d, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))))
    found = result(spark, folder, "op5")
    same(found, want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    owners, tokens = defaultdict(set), defaultdict(list)
    rows = read(spark, folder)
    for i, (d, t, s) in enumerate(rows):
        spans = [(m.start(), m.end(), m[0]) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least]
        values = [m[g] for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{28,}", t or ""):
            if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not any(a < m.end() and m.start() < b for a, b, _ in spans):
                tokens[i].append((m.start(), m.end(), m[0]))
                values.append(m[0])
        for v in values:
            owners[v].add(s)
    want = [(d, ",".join(f"owned:{a}:{b}" for a, b, v in tokens[i] if len(owners[v]) <= 2)) for i, (d, _, _) in enumerate(rows)]
    assert sorted((r["doc_id"] or -1, ",".join(s for s in r["spans"].split(",") if s.startswith("owned"))) for r in found) == sorted((d or -1, o) for d, o in want)
    for r in found:  # base spans are among all spans
        own = [s for s in r["spans"].split(",") if s and not s.startswith("owned")]
        assert sha(",".join(own)) == r["base_sha256"]


def test_secret_ownership(spark):
    key = "Zk3" + "aB9x" * 8
    rows = [(i, f"see {key} here", None, f"repo{i}", 1) for i in range(4)] + [(10, "mine Qw9" + "tY7u" * 8, None, "solo", 1), (11, "password=hunter2hunter2", None, "solo", 1), (12, "password=hunter2hunter2", None, "solo", 1), (13, None, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in secrets.scan_secrets(docs, live_owners=2).collect()}
    assert not found[0].spans and found[10].spans[0].kind == 3 and [s.kind for s in found[11].live] == [0]
    texts = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert docs.count() == len(texts)
    late = "aB" * 60 + "7" + "x" * 30  # the first digit comes late in a long token
    assert [(s.start, s.end) for s in secrets.scan_secrets(spark.createDataFrame([(1, f"see {late}", None, "a", 1)], SCHEMA)).first().spans] == [(4, 155)]
    forks = spark.createDataFrame([(i, f"mine {key}", "one", f"repo{i}") for i in range(5)], "doc_id long, text string, owner string, repo string")
    assert all(r.live for r in secrets.scan_secrets(forks, "owner").collect()) and not any(r.live for r in secrets.scan_secrets(forks, "owner", "repo").collect())
    assert texts[0] == rows[0][1] and texts[10] == "mine [SECRET]" and texts[11] == texts[12] == "[SECRET]" and texts[13] is None


def test_secrets_of_one_text_by_thousands(spark):
    """Work grows with the number of matches: 30,000 in one text, some overlapping, are found and redacted as a plain walk does."""
    import random
    import time

    rng = random.Random(4)
    parts = [f"{rng.getrandbits(128):032x}" + ("" if i % 3 else f" Zk3aB9xaB9xaB9xaB9xaB9xaB9xaB9xé{i}") + (" token=Zk3aB9xaB9xaB9xaB9xaB9xaB9xaB9x" if i % 7 == 0 else "") for i in range(20_000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text, "a"), (2, "plain", "b")], "doc_id long, text string, source string")
    began = time.perf_counter()
    row = secrets.scan_secrets(docs).where("doc_id = 1").first()
    spans = [(m.start(), m.end()) for p in (secrets.HEX, r"token=[A-Za-z0-9+/_.=-]+") for m in re.finditer(p, text)]
    owned = [m.span() for m in re.finditer(secrets.TOKEN, text) if all(re.search(c, m[0]) for c in secrets.MIXED)]
    base = {p for a, b in spans for p in range(a, b)}
    assert sorted((s.start, s.end) for s in row.spans) == sorted(spans + [(a, b) for a, b in owned if not base & {*range(a, b)}])
    found = secrets.redact(docs).where("doc_id = 1").first().text
    covered = sorted((s.start, s.end) for s in row.live)
    want, at = [], 0
    for a, b in covered:
        if a >= at:
            want.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    assert found == "".join(want) + text[at:]
    assert time.perf_counter() - began < 60


def test_op6_token_files(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(token_files.model_path()), 0, []
    for d, t, _ in sorted(read(spark, folder)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    same(result(spark, folder, "op6"), want, ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_op6_odd_rows(spark, tmp_path):
    """Repeated rows, many rows of one doc_id and of none, clashing columns: starts follow one another in doc_id order, each text's ids are its own."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.model_path())
    rows = [(d, t) for d, t, *_ in documents()[:20]] * 2 + [(None, f"none {i} " * 30) for i in range(60)] + [(7, f"seven {i}, *** Été's " * 30) for i in range(60)]
    docs = spark.read.parquet(f"{table(spark, rows, tmp_path, 'doc_id long, text string')}/documents.parquet")
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(extra(docs), token_files.model_path(), folder, chars_per_file=4000)
    found = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    assert manifest.where("n_docs > 0").count() > 10 and manifest.select("part").distinct().count() > 5
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == [sum(len(x.ids) for x in found[:i]) for i in range(len(found))]
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=repr) == sorted(want, key=repr)


def test_op6_encoder():
    """Word by word or whole: the library's ids, also past the cache's cap, and for a tokenizer with other rules."""
    import random

    from tokenizers import Tokenizer, normalizers

    tokenizer, by_words = Tokenizer.from_file(token_files.model_path()), token_files.encoder(token_files.model_path())
    assert isinstance(by_words, token_files.ByWords)
    by_words.cap, rng = 200, random.Random(4)
    words = ["Das's", "l'Été", "don't,", "we'll***", "Straße***", "ÀÉ###", "<|endoftext|>", "a<|endoftext|>b", "'tis", "İß", "ΣΑΣ", "e\u0301", "x_", "7a", "漢字"]
    texts = [" ".join(rng.choice([*words, chr(97 + rng.randrange(26)) * rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 20))) for _ in range(900)]
    for at in range(0, len(texts), 100):
        flat, counts = by_words.encode_texts([t.encode() for t in texts[at : at + 100]])
        runs = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]
        assert counts.tolist() == list(map(len, runs)) and flat.tolist() == [i for r in runs for i in r]
    tokenizer.normalizer = normalizers.NFC()
    import json

    assert not token_files.cuts_at_words(json.loads(tokenizer.to_str()))


def test_op6_letters_alone():
    """Words of letters, whatever their case and marks, never reach the tokenizer with all its rules, and have the library's ids beside words that do."""
    import random

    from tokenizers import Tokenizer

    tokenizer, path, seen = Tokenizer.from_file(token_files.model_path()), token_files.model_path(), []
    rules = lambda texts, **o: seen.extend(texts) or tokenizer.encode_batch(texts, **o)
    encode = token_files._word_encoder(tokenizer, rules, token_files.letters_alone(tokenizer))
    rng = random.Random(9)
    letters = ["".join(rng.choice("abcXYZéÉßÿÞøØ") for _ in range(rng.randrange(1, 14))) + rng.choice(["", ",", "!)", "'s"[:1]]) for _ in range(3000)]
    other = ["7a", "a7", "×a", "e\u0301", "漢字", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "J\u030c", "a\u00a0b", "\u0130"]
    words = [w.encode() for w in rng.sample(letters + other, 3000 + len(other))]
    flat, lengths = encode(words)
    want = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == list(map(len, want)) and flat.tolist() == [i for r in want for i in r]
    assert not {w.rstrip(",!)'").lower() for w in letters} & set(seen) and set(other) <= set(seen)


def test_op6_parts_of_words():
    """Letters and the marks behind them as a pattern cuts them, and every Latin-1 letter spelt as the library spells it, without its own step for that."""
    import random

    from tokenizers import Tokenizer

    rng, letter = random.Random(5), "[A-Za-zÀ-ÖØ-öø-ÿ]"
    words = ["".join(rng.choice("aZéß×÷Àÿ.,'~7漢éºşĀ§`@\x01") for _ in range(rng.randrange(1, 6))) for _ in range(20_000)]
    cut = [re.fullmatch(rf"({letter}+)([!-/:-@\[-`{{-~]*)", w) for w in words]
    want = [m.groups() if m else ("", w) for m, w in zip(cut, words)]
    assert list(zip(*token_files.parts([w.encode() for w in words]))) == [(a.encode(), b.encode()) for a, b in want] and sum(map(bool, cut)) > 1000
    assert token_files.parts([]) == ([], [])

    tokenizer = Tokenizer.from_file(token_files.model_path())
    lines = [" ".join(chr(c) * n for c in (*range(97, 123), 0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100))) for n in (1, 2, 3)]
    spelt = token_files.letters_alone(tokenizer)(lines, add_special_tokens=False)
    assert [e.ids for e in spelt] == [tokenizer.encode(t, add_special_tokens=False).ids for t in lines]


def test_op6_looks_up_each_word_once():
    """A word is looked up once for all its places in a call, letters that came with other marks are known, and the ids are the library's."""
    from tokenizers import Tokenizer

    looked, sent = [], []

    class Watched(dict):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    tokenizer, by_words = Tokenizer.from_file(token_files.model_path()), token_files.encoder(token_files.model_path())
    by_words.index = Watched()
    texts = ["the cat, the cat. THE CAT!\x0b\x0cthe\x85cat\u2003x \x1f\x00 a\x00", "", " \t\r\n", "\ncat  the ", "naïve 漢字 don't 7a"] * 30
    for some in (texts, texts[1:3], [], texts[3:4]):
        looked.clear()
        flat, counts = by_words.encode_texts([t.encode() for t in some])
        runs = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == list(map(len, runs)) and flat.tolist() == [i for r in runs for i in r]
        assert len(looked) == len(set(looked))

    spelt = token_files.letters_alone(tokenizer)
    encode = token_files._word_encoder(tokenizer, tokenizer.encode_batch, lambda lines, **o: sent.extend(lines) or spelt(lines, **o))
    for words in ([b"cat,", b"dog"], [b"Cat.", b"x", b"."], [b"DOG!", b"cat"]):
        flat, lengths = encode(words)
        runs = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        assert lengths.tolist() == list(map(len, runs)) and flat.tolist() == [i for r in runs for i in r]
    assert [w for line in sent for w in (line if isinstance(line, bytes) else line.encode()).split()] == [b"cat", b"dog", b"x"]


def test_op6_random_access(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (np.zeros(0), rng.integers(0, 200, 700), rng.integers(0, 1 << 33, 3000), np.full(513, 300), 1 << rng.integers(0, 40, 2000)):
        codes = token_files.Codes.from_bytes(memoryview(token_files.Codes.of(values.astype(np.uint64)).to_bytes()))
        at = rng.integers(0, max(1, len(values)), 500 if len(values) else 0)
        assert np.array_equal(codes.all(), values.astype(np.uint64)) and np.array_equal(codes.get(at), values[at].astype(np.uint64))
    docs = spark.read.parquet(f"{table(spark, documents(), tmp_path)}/documents.parquet")
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, token_files.model_path(), folder, chars_per_file=30_000).collect()
    files = sorted((tmp_path / "tokens").glob("part-*.dac"))
    assert len(files) > 1
    raw = files[-1].read_bytes()
    doc_ids, _, ends, codes = token_files.read_file(raw)
    start = int(ends[-2]) if len(ends) > 1 else 0
    whole = codes.all()[start : int(ends[-1])].tolist()
    assert token_files.fetch_tokens(raw, int(doc_ids[-1]), [len(whole) - 1, 0]) == [whole[-1], whole[0]]


def test_op7_sentencepiece(spark, folder):
    import sentencepiece

    library, want = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), []
    for d, t, _ in read(spark, folder):
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    same(result(spark, folder, "op7"), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_agenda_agrees_with_library():
    """Long parts and short ones, before the check against the library could mend anything."""
    import numpy as np

    model = pieces.PieceModel(pieces.model_path())
    model._check = lambda parts, flat, counts: (flat, counts)
    rng = np.random.default_rng(1)
    parts = ["▁" + "".join(rng.choice(list("abcdeinrst漢ö"), n)) for n in [*range(1, 70), 200, 1000]] + ["▁" * n for n in range(1, 40)]
    flat, counts = model.encode_parts(parts)
    for p, run in zip(parts, np.split(flat, np.cumsum(counts)[:-1])):
        assert run.tolist() == model.library.encode("\n" + p.replace("▁", " "))[2:]


def brute_counts(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_op8_rules(spark, folder):
    found = result(spark, folder, "op8")
    same(found, [(d, *brute_counts(t)) for d, t, _ in read(spark, folder)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_op8_suffix_array():
    """Common-prefix intervals: longest repeat and covered words, against all pairs of places."""
    import random

    rng = random.Random(8)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        n, longest = len(words), [0] * len(words)
        for i in range(n):
            for j in range(n):
                if i != j:
                    k = 0
                    while i + k < n and j + k < n and words[i + k] == words[j + k]:
                        k += 1
                    longest[i] = max(longest[i], k)
        cover = {i + k for i, m in enumerate(longest) if m >= 4 for k in range(m)}
        m = repetition.measure([" ".join(words), None, "z"], 4)
        assert (m["longest_repeat"][0], m["repeat_covered"][0]) == (max(longest, default=0), len(cover))


def brute_print(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_op10_simhash(spark, folder):
    rows = [(d, brute_print(t)) for d, t, _ in read(spark, folder)]
    root = {fp: fp for _, fp in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = list(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict = {}
    for d, fp in rows:
        least[find(fp)] = min(least.get(find(fp), d), d)
    same(result(spark, folder, "op10"), [(d, f"{fp:016x}", least[find(fp)]) for d, fp in rows], ["doc_id", "fingerprint", "component_id"])


def test_simhash_chains(spark):
    """Pairs at every distance and a long chain: all within three bits are found, none beyond, and chains join up."""
    import random

    from tidemark.llm.components import components

    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), i % 6)) for b in bases for i in range(6)} | set(bases)
    found = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert found == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (5000, 5000), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {i: 0 for i in range(501)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("name", ["op1", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_table(spark, tmp_path, name):
    assert result(spark, table(spark, [], tmp_path), name) == []


@pytest.mark.parametrize("name", ["op1", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_repeats_nulls_and_clashing_columns(spark, tmp_path, name):
    """Repeated rows each get a row, null ids don't fail, other columns don't matter."""
    rows = documents()[:40]
    rows += rows[5:9] + [(None, "a b c d", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    extra(docs).repartition(2).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (sorted(map(repr, result(spark, f"{tmp_path}/{x}", name))) for x in "ab")
    assert a == b and len(a) == len(rows)


def test_wrong_agenda_raises():
    """A wrong merge is an error that counts the parts, and is not mended in silence."""
    model = pieces.PieceModel(pieces.model_path())
    parts = ["▁hello", "▁world", "▁a"]
    model.encode_parts(parts)
    model.ranks = model.ranks[::-1].copy()
    with pytest.raises(RuntimeError, match=r"differ from the library's in [12] of 3 parts"):
        model.encode_parts(parts)
