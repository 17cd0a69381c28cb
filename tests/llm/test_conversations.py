"""Toxicity, conversation repair and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import ranking, repair, toxicity

from .fixtures import SCHEMA, documents, extra, table

BLANKS = r"[^\x20\x09-\x0D]"


# op12


def damaged(rows: list[tuple]) -> dict:
    """Rows of each conversation after damage, in order."""
    out: dict = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if d == 0:
            continue
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        out[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_repair(rows: list[tuple]) -> tuple:
    """Figures of one conversation; the cheapest edits by a search over all states, without the operator's shortcuts."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.findall(BLANKS, text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # states by what was emitted: '' nothing, 's', 'u', 'a'
    steps = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    def inserted(best: dict) -> dict:
        best = dict(best)
        for _ in range(3):
            for (state, (cost, audit, lines)), role in itertools.product(list(best.items()), ("user", "assistant")):
                if (state, role[0]) in steps:
                    new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                    if role[0] not in best or new[:2] < best[role[0]][:2]:
                        best[role[0]] = new
        return best

    best: dict = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}

        def offer(state, way):
            if state not in after or way[:2] < after[state][:2]:
                after[state] = way

        late = int(fault == "truncated")
        for state, (cost, audit, lines) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in steps:
                offer(role[:1], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (state, new[0]) in steps:
                    offer(new[0], (cost + 2 + late, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    cost, audit, lines = min((w for s, w in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations() -> list[tuple]:
    rng = random.Random(12)
    text = lambda: rng.choice(["Yes.", "no", "", " \t", None, "What?", "x" * 50 + "!", "ends so. ", "é。", "Same."]) if rng.random() < 0.6 else f"t{rng.randrange(10**6)}."
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "unknown", ""])
    rows = [(c, rng.choice([None, t, t, t, t + rng.randrange(3)]), role(), text()) for c in range(60) for t in range(rng.randrange(1, 14))]
    rows += [(None, t % 7, role(), text()) for t in range(30)] + [(77, None, "user", "Hi.")] * 3
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)] + [(501, 2, "system", "s" * 100_000)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "dropped.")]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_op12_against_a_plain_search(spark, block):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", *[f"'x' AS {c}" for c in ("gone", "place", "block", "t", "four", "s", "best", "fault", "joint", "blank", "_d")])
    found = repair.repair(repair.with_damage(df), block).collect()
    assert len(found) == len({c for c, *_ in rows})
    want = {c: plain_repair(r) for c, r in damaged(rows).items()}
    for r in found:
        have = tuple(hashlib.sha256(r["repaired"].encode()).hexdigest() if f == "repaired_sha256" else r[f] for f in FIGURES)
        assert have == want[r["conv_id"]], r["conv_id"]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in r["repaired"].split("\n"))) or r["conv_id"] == 501


def test_op12_long_conversation(spark):
    """20,000 turns of one conversation."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}.") for t in range(20_000)]
    r = repair.repair(repair.with_damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (r["cost"], r["audit"]) == plain_costs(damaged(rows)[1])


def plain_costs(rows: list[tuple]) -> tuple[int, str]:
    got = plain_repair(rows)
    return got[5], got[6]


def test_op12_empty(spark, tmp_path):
    from tidemark.llm.registry import queries

    folder = table(spark, [], tmp_path, "conv_id long, turn long, role string, text string", "conversations")
    assert queries()["op12_conversation_repair"](spark, folder).collect() == []


# op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text) -> list[str]:
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranks(docs: list[tuple], items: list[tuple], top: int = 50) -> list[tuple]:
    rows = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, counts, n in rows:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in set(terms(text)) if t in counts)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"block": 40}])
def test_op13_against_all_scores(spark, options):
    docs = [(d, t) for d, t, *_ in documents()] + [(None, "alpha3 beta"), (None, None), (-5, "alpha3 beta"), (8, "alpha3 beta"), (8, "alpha3 beta"), (9, "ALPHA3-Beta_naïve\x80straße")]
    items = [(1, "Alpha3 beta4 ALPHA3 token"), (2, ""), (3, None), (4, "nowhere at all"), (5, "naïve STRASSE straße 漢字1 x1 gamma7 the la"), (5, "la"), (None, "iota5 kappa6"), (6, " ".join(f"delta{i} zeta{i}" for i in range(40)))]
    found = ranking.rank_documents(extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score"), **options)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_ranks(docs, items, options.get("top", 50)), key=repr)


def test_op13_shards_and_floors(spark, monkeypatch):
    """Small shards, a floor from some of them: results stay the same."""
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(1, 90)))) for i in range(1500)]
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(12))) for i in range(25)]
    monkeypatch.setattr(ranking, "SHARD", 3000)
    monkeypatch.setattr(ranking, "PRIME", 3)
    found = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), top=7)
    assert sorted(map(tuple, found.collect())) == sorted(plain_ranks(docs, items, 7))


def test_op13_skips():
    """A bar that only two terms together reach leaves documents with one of them unscored."""
    heap: list = []
    places, impacts = [[*range(0, 1000, 2), ranking.END], [*range(0, 1000, 50), ranking.END]], [Touched([5] * 500), Touched([9] * 20)]
    ranking.search(places, impacts, [5, 9], heap, 3, 14, [-d for d in range(1000)])
    assert sorted(heap, reverse=True) == [(14, 0), (14, -50), (14, -100)] and impacts[0].n <= 20


class Touched(list):
    n = 0

    def __getitem__(self, i):
        self.n += 1
        return super().__getitem__(i)


def test_op13_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranking.rank_documents(none, items).collect() == []
    assert ranking.rank_documents(spark.createDataFrame([(1, "word")], "doc_id long, text string"), items.limit(0)).collect() == []


# op11


def plain_ratio(texts: list[tuple[str, int]], word: str) -> float:
    """Log ratio of a word by dictionaries of strings, context by context."""
    grams = [Counter(), Counter()]
    for text, toxic in texts:
        for w in toxicity.words_of(text):
            padded = b" " + w + b" "
            for i in range(1, len(padded)):
                grams[toxic][padded[max(0, i - 7) : i + 1]] += 1
    # a word's first bytes stand after fewer bytes than seven: nothing stands before the space
    pad = lambda g: b"\0" * (8 - len(g)) + g
    grams = [Counter({pad(g): n for g, n in c.items()}) for c in grams]
    # the very first space of a text has no byte before it, those between words are counted at the end of each word
    level = {8: grams[0] + grams[1]}
    for n in range(7, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])

    def cuts(counts: Counter) -> list[float]:
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05 * (k + 1)), k + 1) for k in range(3))]

    def mix(counts: Counter, gram: bytes, lower: float) -> float:
        d, same = cuts(counts), {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        total = sum(same.values())
        v = same.get(gram, 0)
        return (v - d[min(v, 3)]) / total + sum(d[min(x, 3)] for x in same.values()) / total * lower

    out = 0.0
    padded = b" " + word.encode() + b" "
    for i in range(1, len(padded)):
        gram = pad(padded[max(0, i - 7) : i + 1])
        p = 1 / 256
        for n in range(1, 9):
            p = mix(level[n], gram[8 - n :], p)
        out += math.log(mix(grams[1], gram, p)) - math.log(mix(grams[0], gram, p))
    return out


def test_op11_ratios_by_plain_counts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 11)))
    texts = [(" ".join(word() for _ in range(60)), 0) for _ in range(6)] + [(" ".join(word() + rng.choice(["", "zq"]) for _ in range(25)), 1) for _ in range(4)]
    held = [Counter(w for t, toxic in texts if toxic == k for w in toxicity.words_of(t)) for k in (0, 1)]
    codes = [Counter() for _ in held]
    for k, h in enumerate(held):
        cs, sizes = toxicity.word_codes(list(h))
        for c, n in zip(cs.tolist(), np.repeat(list(h.values()), sizes).tolist()):
            codes[k][c] += n
    every = np.array(sorted(codes[0] | codes[1]), np.uint64)
    model = toxicity.Ratios(every, *[np.array([c[int(x)] for x in every]) for c in codes])
    asked = [*list(held[1])[:12], *list(held[0])[:12], b"zqzqzq", b"never", b"x", b"abcdeabcdeabcde"]
    assert np.allclose(model.of_words(asked), [plain_ratio(texts, w.decode()) for w in asked], atol=1e-5)


def test_op11_accuracy(spark):
    """Held-out documents of sf0.1: about one toxic label in fifteen has nothing toxic in its text."""
    from tidemark.llm.registry import queries

    folder = "/root/testdata/sf0.1"
    found = queries()["op11_toxicity"](spark, folder)
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits, said, toxic = sum(r.toxic and r.predicted for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert hits / said >= 0.95 and hits / toxic >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op11_odd_rows(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["good", "fine", "word", f"w{rng.randrange(99)}"]) for _ in range(30)) + (" vile scum" if i % 4 == 0 else ""), None, None, 1) for i in range(200)]
    docs += [(None, "vile scum", None, None, 1), (None, None, None, None, 1), (900, "", None, None, 1), (901, "\x00 ퟿ é" + "x" * 300_000, None, None, 1), (902, "word " * 200_000, None, None, 1), (5, "again vile", None, None, 1)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(4, 1, 0), (None, 1, 1), (7, 0, None), (4444, 0, 1)]
    df = extra(spark.createDataFrame(docs, SCHEMA).repartition(4))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS score", "2 AS fold", "'a' AS text")
    found = toxicity.score_toxicity(df, marked).collect()
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in docs)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert all(by_id[i][0].predicted == (i % 4 == 0) for i in range(200) if i != 5)
    assert by_id[900][0].score == min(r.score for r in by_id[None]) and not by_id[900][0].predicted and by_id[None][0].held_out is False
    assert [r.score for r in toxicity.score_toxicity(df, marked.limit(0)).limit(3).collect()] == [0.0] * 3
    assert {r.score for r in toxicity.score_toxicity(df, marked.selectExpr("doc_id", "1 AS toxic")).collect()} == {1.0}
    assert toxicity.score_toxicity(df.limit(0), marked).collect() == []


def test_op11_sample(spark):
    """The bound holds exactly, by class; a row larger than what is left is passed over."""
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2000)], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels, 20_000).collect()
    for toxic, last in itertools.product((0, 1), (False, True)):
        size = sum(len(r.text) + 16 for r in rows if r.toxic == toxic and (r.fold == 4) == last)
        assert 15_000 < size <= 20_000
        assert abs(sum(r.weight for r in rows if r.toxic == toxic and (r.fold == 4) == last) - sum(zlib.crc32(str(i).encode()) % 5 in ((4,) if last else (1, 2, 3)) for i in range(2000) if (i % 3 == 0) == toxic)) < 1e-6
