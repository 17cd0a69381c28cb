"""Vectors, conversations, the classifier, the mixture and the pipeline."""

from __future__ import annotations

import functools
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, perplexity, preferences, secrets, simhash, vectors
from tidemark.llm.registry import oracle_sql, queries

from .fixtures import SCHEMA, documents, extra, table


def test_op2_against_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 24))
    x = np.concatenate([base, base[:10] + 0.2 * rng.standard_normal((10, 24)), base[:5] * 7, np.repeat(base[:1], 40, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [1.0, None]), (904, [1.0, 0.0]), (905, []), (906, [1e300] * 24), (907, [1e300] * 24)]
    schema = "vec_id long, embedding array<double>"
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in x:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    want = {i: (int(near[i].sum()), root[i]) for i in range(len(x))} | {i: (0, i) for i in range(900, 906)} | {906: (1, 906), 907: (1, 906)}
    for block in (2048, 8):  # buckets in one piece, and dealt as pairs of blocks
        found = vectors.near_vectors(spark.createDataFrame(rows, schema), block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want and all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_op2_estimates_are_unbiased():
    rng = np.random.default_rng(6)
    x = vectors.unit(rng.standard_normal((400, 64)))
    signs, factor = vectors.encode(x, 160, 2)
    assert signs.shape[1] == 192
    est = vectors.estimate(signs, factor, vectors.rotated(x, 160, 2))
    off = est - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.003 and (np.abs(off) <= vectors.half_width(factor, 192, 5.0)[:, None]).mean() > 0.9999


def test_op2_null_ids_and_clashing_columns(spark):
    """Rows without an id are nodes like any other; they link and are counted, and name nothing."""
    a, b = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    rows = [(None, a), (None, a), (5, b), (6, b), (None, [0.0, 1.0, 0.0]), (9, None), (9, [0.0, 0.0, 2.0]), (9, [0.0, 0.0, 1.0])]
    found = vectors.near_vectors(extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")))).collect()
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in found) == [(0, 0, 0, True), (0, 3, 5, False), (0, 3, 5, False), (5, 3, 5, True), (6, 3, 5, False), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True)]


@pytest.mark.parametrize("n", [3000, 30000])
def test_op2_recall(spark, n):
    """All links of planted pairs about the threshold, at two sizes (other numbers of bits and tables), against brute force in blocks."""
    rng = np.random.default_rng(n)
    base = vectors.unit(rng.standard_normal((n // 3, 48)))
    x = vectors.unit(np.concatenate([base, *(base + s * rng.standard_normal(base.shape) / np.sqrt(48) for s in (0.2, 0.33))]))
    want = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1000):
        want[lo : lo + 1000] = (x[lo : lo + 1000] @ x.T >= 0.95).sum(axis=1) - 1
    docs = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float64()))}))
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(docs).select("vec_id", "n_links").collect()}
    assert want.sum() > n // 2 and sum(found[i] != w for i, w in enumerate(want.tolist())) <= 2 and sum(found.values()) >= 0.9999 * want.sum()


@pytest.mark.parametrize("name", ["op2_near_vectors", "op3_preferences"])
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = queries()[name](spark, data)
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(names).collect())) == sorted(want)


def test_op3_edges(spark):
    schema = "pair_id long, side string, turn long, role string, text string"
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")] + [(1, "chosen", 1, "assistant", "a"), (1, "rejected", 1, "assistant", "b"), (2, "chosen", None, None, None), (3, "other", 0, "user", "x"), (None, "chosen", 0, "user", "x")]
    found = {r.pair_id: r for r in preferences.format_preferences(spark.createDataFrame(rows, schema)).collect()}
    assert set(found) == {1, 2} and found[1].usable and not found[2].usable
    assert found[1].prompt == "<|user|>\nhi<|end|>\n" and found[1].chosen == "<|assistant|>\na<|end|>\n"
    (span,) = found[1].rejected_mask
    assert found[1].rejected[span.start : span.end] == "b<|end|>"


def test_op3_pairs_share_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    big = (1 << 53) + 1  # ids beyond what a double can hold
    rows = [(c, t, r, f"{c} {t}") for c in (1, 2, big, big + 1) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))] + [(3, 0, "user", "alone"), (None, 0, "assistant", "x"), (1, None, "user", None), ((1 << 63) - 1, 0, "assistant", "last"), (-(1 << 63), 0, "assistant", "first")]
    found = {r.pair_id: r for r in preferences.format_preferences(preferences.answered_pairs(spark.createDataFrame(rows, schema))).collect()}
    assert set(found) == {c for c, *_ in rows} - {None}
    one = found[1]
    assert one.n_shared == 0 and "1 4" in one.chosen and "2 4" in one.rejected  # the turn without a number stands first, on one side alone
    assert found[big].n_shared == 4 and found[big].usable and found[big].rejected == f"<|assistant|>\n{big + 1} 4<|end|>\n"
    assert not found[2].usable and not found[3].usable and not found[(1 << 63) - 1].usable


def test_op3_empty_repeats_long_and_clashing_columns(spark):
    """No rows give none; repeated turns stay; a very long text is rendered whole; columns with names of its own don't matter."""
    schema = "pair_id long, side string, turn long, role string, text string"
    assert preferences.format_preferences(spark.createDataFrame([], schema)).collect() == []
    long_text = "word " * 200_000
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")] * 2 + [(1, "chosen", 1, "assistant", long_text), (1, "rejected", 1, "assistant", None), (2, "chosen", 0, "user", ""), (2, "rejected", 0, "user", "")]
    turns = spark.createDataFrame(rows, schema)
    named = turns.select("*", *[F.lit("x").alias(n) for n in ("prompt", "chosen", "rejected", "n_shared", "usable", "_p", "_c", "_nc", "at", "out")])
    plain, clashing = ({r.pair_id: r for r in preferences.format_preferences(t).collect()} for t in (turns, named))
    assert plain == clashing and plain[1].n_shared == 2 and plain[1].prompt == "<|user|>\nhi<|end|>\n" * 2 and long_text in plain[1].chosen
    assert plain[1].usable and not plain[2].usable and plain[2].n_shared == 1 and plain[2].chosen == plain[2].rejected == ""


def test_op9_odd_rows(spark, tmp_path):
    """Repeated rows and rows without a doc_id, source or text each get their row; the same again in a second run."""
    rows = documents()[:20] * 2 + [(None, "a b c", "en", None, 1), (None, None, None, None, None), (None, "a b c", "en", None, 1)]
    folder = table(spark, rows, tmp_path)
    found = sorted(map(repr, queries()["op9_mix_sources"](spark, folder).collect()))
    assert len(found) == len(rows) and found == sorted(map(repr, queries()["op9_mix_sources"](spark, folder).collect()))


def brute_model(texts: list[str]):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    n = perplexity.ORDER
    grams = Counter()
    for t in texts:
        raw = [perplexity.START] * (n - 1) + list(t.encode()) + [perplexity.END]
        grams.update(tuple(raw[i : i + n]) for i in range(len(raw) - n + 1))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: perplexity.discounts([sum(c == j for c in g.values()) for j in (1, 2, 3, 4)]) for k, g in levels.items()}
    context = {k: defaultdict(list) for k in levels}
    for k, g in levels.items():
        for gram, c in g.items():
            context[k][gram[:-1]].append(c)

    def p(gram: tuple) -> float:
        k = len(gram)
        if not k:
            return 1 / 256
        lower = p(gram[1:])
        seen = context[k].get(gram[:-1])
        if not seen:
            return lower
        c = levels[k][gram]
        return ((c - cut[k][min(c, 3)] if c else 0) + sum(cut[k][min(x, 3)] for x in seen) * lower) / sum(seen)

    return p


def test_op4_model(spark, tmp_path):
    rows = [r for r in documents() if len(r[1] or "") < 3000] + [(None, "no id", "en", "b", 1)]
    docs = spark.read.parquet(f"{table(spark, rows, tmp_path)}/documents.parquet")
    train = [r[0] for r in rows if r[0] is not None and r[0] % 2]
    p = brute_model([r[1] or "" for r in rows if r[0] is not None and r[0] % 2])
    want = {}
    for d, t, *_ in rows:
        raw = [perplexity.START] * 4 + list((t or "").encode()) + [perplexity.END]
        logs = [math.log(p(tuple(raw[i : i + 5]))) for i in range(len(raw) - 4)]
        want[d] = math.exp(-sum(logs) / len(logs))
    fitted = spark.createDataFrame([(i,) for i in train], "doc_id long")
    found = perplexity.perplexities(extra(docs), fitted, shards=5, chunk=2000).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.perplexity == pytest.approx(want[r.doc_id], rel=1e-3)


def test_op4_small_probabilities():
    """Logs travel in steps of 1/2048; those below -32 as they are."""
    logs = np.array([0.0, -0.3, -31.99, -32.0, -700.0, -5.0, -40.25])
    back = perplexity.logs_unpacked(perplexity.logs_packed(logs), len(logs))
    assert np.abs(back - logs).max() <= 1 / 4096 and (back[[4, 6]] == [-700.0, -40.25]).all()


def test_op4_accuracy(spark, data):
    """Held-out labels: good documents stay, most bad ones go; the threshold is the held-out fold's quantile by language."""
    sf = os.path.join(os.path.dirname(data), "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries()["op4_kneser_ney"](spark, sf).join(labels, "doc_id", "left").join(perplexity.trusted(labels), "doc_id", "left").collect()
    share = lambda q: np.mean([r.kept for r in rows if r.quality == q])
    assert share(1) >= 0.985 and share(0) <= 0.06
    rates = {round(r.quantile, 3): r for r in perplexity.error_rates(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert rates[0.98].good_kept >= 0.97 and rates[0.98].bad_kept <= 0.08
    assert rates[0.995].bad_kept - rates[0.98].bad_kept > 3 * (rates[0.995].good_kept - rates[0.98].good_kept)
    for lang in {r.lang for r in rows}:
        held = sorted(r.perplexity for r in rows if r.lang == lang and r.fold == 4 and r.n_bytes)
        (threshold,) = {r.threshold for r in rows if r.lang == lang}
        assert held[math.ceil(0.98 * len(held)) - 1] == pytest.approx(threshold)
        assert all(r.kept == (r.perplexity <= threshold or not r.n_bytes) for r in rows if r.lang == lang)


def test_op4_without_labels_or_documents(spark):
    labels = "doc_id long, quality int, toxic int"
    none, docs = spark.createDataFrame([], labels), spark.createDataFrame(documents()[:9], SCHEMA)
    assert all(r.kept for r in perplexity.classify(docs, none).collect())
    assert perplexity.classify(docs.limit(0), spark.createDataFrame([(0, 1, 0)], labels)).collect() == []
    mixed = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, 1, None), (3, 1, 0), (4, None, 0), (None, 1, 0)]
    assert [r.doc_id for r in perplexity.trusted(spark.createDataFrame(mixed, labels)).collect()] == [3]


def fill(sizes: list[float], weights: list[float], total: float) -> list[float]:
    """Clamp and share out again until none is above its cap."""
    caps, open_, out = [2 * s for s in sizes], set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > caps[i]}
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i], left = caps[i], left - caps[i]
        open_ -= over
    return out


@pytest.mark.parametrize("where", ["fixture", "sf0.001"])
def test_op9(spark, data, tmp_path, where):
    folder = data if where == "sf0.001" else table(spark, documents(), tmp_path)
    rows = queries()["op9_mix_sources"](spark, folder).collect()
    assert sorted(rows) == sorted(queries()["op9_mix_sources"](spark, folder).collect())
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    size, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s], most[s] = r.target, max(most[s], r.size)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    order = sorted(target, key=lambda s: (s is None, s or ""))
    want = fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    for s, w in zip(order, want):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= most[s]
        assert all(r.source_size == size[s] for r in rows if source[r.doc_id] == s)


def test_mix_keeps_columns(spark):
    docs = extra(spark.createDataFrame(documents(), SCHEMA))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    marked = secrets.redact(docs)
    assert marked.columns == docs.columns and marked.count() == docs.count()
    assert simhash.drop_near_copies(docs).columns == docs.columns


def plain_quality(docs: list, labels: list) -> list:
    """Rows below their language's 0.98 quantile of held-out perplexities, under the brute-force model of four folds."""
    fold = {r.doc_id: r.fold for r in labels}
    p = functools.cache(brute_model([r.text or "" for r in docs if fold.get(r.doc_id, 9) < 4]))
    score = {}
    for r in docs:
        raw = [perplexity.START] * 4 + list((r.text or "").encode()) + [perplexity.END]
        score[r.doc_id] = math.exp(-sum(math.log(p(tuple(raw[i : i + 5]))) for i in range(len(raw) - 4)) / (len(raw) - 4))
    held = lambda lang: sorted(score[r.doc_id] for r in docs if fold.get(r.doc_id) == 4 and r.text and lang in (r.lang, None))
    cut = {lang: (x := held(lang) or held(None))[math.ceil(0.98 * len(x)) - 1] for lang in {r.lang for r in docs}}
    return [r for r in docs if not r.text or score[r.doc_id] <= cut[r.lang] * (1 + 1e-4)]


def plain_copies(docs: list) -> list:
    sets, root = [five_words(r.text) for r in docs], list(range(len(docs)))

    def find(x: int) -> int:
        return x if root[x] == x else find(root[x])

    for i in range(len(docs)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(docs):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [r for r in docs if r.doc_id in least.values()]


def plain_secrets(docs: list) -> list:
    """(doc_id, text) with the spans of values that at most two sources hold replaced."""
    kinds = [(re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
    found, owners = [], defaultdict(set)
    for r in docs:
        t = r.text or ""
        spans = [(m.start(), m.end(), m[g]) for k, g, least in kinds for m in k.finditer(t) if len(m[g]) >= least]
        spans += [x for x in ((m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{28,}", t)) if all(re.search(c, x[2]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not any(a < x[1] and x[0] < b for a, b, _ in spans)]
        found.append(spans)
        for *_, v in spans:
            owners[v].add(r.source)
    out = []
    for r, spans in zip(docs, found):
        text, at, done = r.text, 0, ""
        for a, b, _ in sorted(s for s in spans if len(owners[s[2]]) <= 2):
            if a >= at:
                done += text[at:a] + "[SECRET]"
            at = max(at, b)
        out.append((r.doc_id, done + text[at:] if text else text))
    return out


def test_pipeline_by_stages(spark, data):
    """Each stage against a plain version of it on the rows before."""
    import sentencepiece

    from tidemark.llm import pieces

    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    labels = perplexity.trusted(spark.read.parquet(f"{data}/labels.parquet")).collect()
    for name, stage in corpus_pipeline.STAGES:
        if name == "secrets":  # most rows with secrets went before
            planted = [(9000 + i, f"the password=hunter2{i // 2} and AKIA{'QX' * 9} are {'aB3' * (9 + i)}, {'0af' * 8}", "en", f"s{i}", 80) for i in range(12)]
            docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(3)
        before, docs = docs, stage(spark, docs, data).cache()
        old, new = before.collect(), docs.collect()
        kept[name] = new
        if name != "pieces":
            assert docs.columns == before.columns
        ids = sorted(r.doc_id for r in new)
        if name == "quality":
            assert ids == sorted(r.doc_id for r in plain_quality(old, labels)) and len(new) < len(old)
        if name == "near_copies":
            assert ids == sorted(r.doc_id for r in plain_copies(old)) and len(new) < len(old)
        if name == "secrets":
            assert sorted(((r.doc_id, r.text) for r in new), key=repr) == sorted(plain_secrets(old), key=repr) and any("[SECRET]" in (r.text or "") for r in new)
        if name == "mixture":
            size, taken, most = Counter(), Counter(), Counter()
            words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            for r in old:
                size[r.source] += words(r)
                most[r.source] = max(most[r.source], words(r))
            for r in new:
                taken[r.source] += words(r)
            order = sorted(size, key=lambda s: (s is None, s or ""))
            want = fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
            assert all(abs(taken[s] - w) <= most[s] for s, w in zip(order, want)) and set(new) <= set(old)
            assert max(Counter(ids).values()) <= 2
        if name == "pieces":
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
            want = [(r.doc_id, x := library.encode(r.text or ""), library.decode(x)) for r in old]
            assert sorted((r.doc_id, list(r.ids), r.decoded) for r in new) == sorted(want) and all(r.n_tokens == len(r.ids) for r in new)
    again = corpus_pipeline.run(spark, data).select("doc_id", "n_tokens").collect()
    assert {r.doc_id for r in again} <= {r.doc_id for r in kept["near_copies"]} and again


def test_pipeline_empty(spark, tmp_path):
    folder = table(spark, [], tmp_path)
    table(spark, [], tmp_path, "doc_id long, quality int, toxic int", "labels")
    assert corpus_pipeline.run(spark, folder).collect() == []


def five_words(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_by_similarity(spark):
    """Planted near copies of texts of tens to hundreds of words: what stays is what all pairs at 0.8 leave."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "  ", "two words", "Two  WORDS"]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(30, 400))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(1, 2 + len(base) // 40)):
                copy[at] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = list(map(five_words, texts))
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in range(len(texts)):
        moved = False
        for i, j in pairs:
            low = min(root[i], root[j])
            moved |= root[i] != root[j]
            root[i] = root[j] = low
        if not moved:
            break
    assert len(set(root)) < len(texts) - 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(root))


def test_near_copies_go_through_simhash(spark):
    """Pairs at 0.8 share a segment and lie within the radius, at every number of texts; a bucket is joined up as all pairs in it say."""
    import numpy as np

    from tidemark.llm import similar

    rng = np.random.default_rng(8)
    assert [similar.segments(n)[1] for n in (0, 2_000_000, 12_000_000, 1 << 30)] == [8, 8, 11, 18]
    for n in (200_000, 12_000_000):
        count, bits = similar.segments(n)
        assert (1 - (1 - similar.APART) ** bits) ** count <= similar.MISSED
        for both, one, other in [(4, 0, 1), (8, 1, 1), (12, 0, 3), (40, 5, 5), (400, 0, 100)] * 40:
            values = rng.integers(0, 1 << 64, both + one + other, np.uint64)
            apart = similar.sketch(values[: both + one], 19) != similar.sketch(np.concatenate([values[:both], values[both + one :]]), 19)
            assert (~apart[: count * bits].reshape(count, bits).any(axis=1)).any()
            assert apart[:192].sum() <= similar.RADIUS and apart[:128].sum() <= similar.FIRST_RADIUS

    def names(a, b, n):
        low = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                low[i] = low[j] = min(low[i], low[j])
        return low

    for _ in range(8):
        n = int(rng.integers(1, 60))
        flat = rng.integers(0, 2, (4, 192), np.uint8)[rng.integers(0, 4, n)] ^ (rng.random((n, 192)) < rng.choice([0.02, 0.15, 0.2])).astype(np.uint8)
        words = list(np.packbits(flat, axis=1).view(np.uint64).T.copy())
        apart = flat[:, None] != flat[None]
        want = names(*np.nonzero((apart.sum(axis=2) <= similar.RADIUS) & (apart[:, :, :128].sum(axis=2) <= similar.FIRST_RADIUS)), n)
        for options in ({}, {"area": 300}, {"most": 5, "area": 100}, {"held": 10, "area": 200}):
            assert names(*similar.near(words, **options), n) == want

    # texts of 8 and 9 words: 4 and 5 shingles, the pair at 0.8 that fingerprints tell apart most
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(8 + k))) for i in range(300) for k in (0, 1)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == list(range(0, 600, 2))


def test_near_copies_join_few_rows(spark, monkeypatch):
    """A large group of near copies gives components() about one pair a text, not those of each bucket; the pairs join up what theirs did."""
    import random

    import numpy as np

    from tidemark.llm import similar

    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 64, (similar.WORDS, 200), np.uint64)
    words[:, 50:62] = words[:, 50:51]
    for options in ({}, {"most": 5}):
        assert sorted(zip(*(x.tolist() for x in similar.near(list(words), **options)))) == [(i, 50) for i in range(51, 62)]

    rng, seen = random.Random(6), []
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice([w] * 120 + [f"x{rng.randrange(10**9)}"]) for w in base) for _ in range(400)]
    whole = similar.components
    monkeypatch.setattr(similar, "components", lambda pairs: whole(seen.append(pairs) or pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = len({r.component for r in similar.similar_groups(docs).collect()})
    assert seen[0].count() <= 2 * len(texts)
    monkeypatch.setattr(similar, "stars", lambda pairs: pairs)
    assert before < 40 and before == len({r.component for r in similar.similar_groups(docs).collect()})
    assert seen[1].distinct().count() > 3 * seen[0].count()


def joined(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """The smallest number below n that each is joined to by the pairs, itself included."""
    low = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            moved |= low[i] != low[j]
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_near_copies_of_short_texts(spark, monkeypatch):
    """Short texts with nothing in common, and sets whose sizes alone rule the similarity out, are not brought together; those of 4 and 5 shingles are."""
    from tidemark.llm import similar

    opened, whole = [], similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, label: (out := whole(df, label), label == "open" and opened.append(out.count()))[0])
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [text(i, 5 + i % 3) for i in range(900)] + [text(0, 12), text(0, 13) + " end " + text(1, 12)]
    left = similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len({r.component for r in left.collect()}) == len(texts)
    assert opened == [0]  # hundreds of sets of 2 shingles were one group

    left = similar.similar_groups(spark.createDataFrame([(0, text(0, 8)), (1, text(0, 9)), (2, text(1, 7)), (3, text(1, 8))], "doc_id long, text string"))
    assert len({r.component for r in left.collect()}) == 3


def test_near_copies_in_parts(spark, monkeypatch):
    """A group too large for one task is compared in parts: whatever may be similar meets in one, none is much over the limit, and the groups stay as they were."""
    import random

    import numpy as np

    from tidemark.llm import similar

    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(4, 60, 250).tolist() + [4, 5, 8, 10, 16, 20] + [40] * 60)}
    rows = spark.createDataFrame([(i, int(rng.integers(1 << 62)), 7, n) for i, n in sizes.items()], "row long, node long, key long, size int")
    for most in (1000, 4000, 1 << 20):
        of = {r.row: set(r.parts) for r in similar.parts(rows, 0.8, most).collect()}
        assert set(of) == set(sizes) and all(of.values())
        assert all(of[i] & of[j] for i in sizes for j in range(i) if similar.fit(sizes[i], sizes[j], 0.8))
        held = {}
        for i, parts in of.items():
            for k in parts:
                held[k] = held.get(k, 0) + sizes[i]
        assert max(held.values()) < 2 * most

    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice([w] * 110 + [f"x{rng.randrange(10**9)}"]) for w in base[: rng.choice([200, 195, 185])]) for _ in range(250)]
    sets = [similar.shingle_set(t, 5) for t in texts]
    low = joined([(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8], len(sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1 << 22, 3000):
        monkeypatch.setattr(similar, "MOST_HELD", most)
        groups = {}
        for r in similar.similar_groups(docs).collect():
            groups.setdefault(r.component, []).append(r.doc_id)
        assert sorted(map(sorted, groups.values())) == sorted([i for i, x in enumerate(low) if x == k] for k in set(low))
    assert 1 < len(groups) < 200


def test_fingerprints_of_fitting_sizes():
    """A bucket is joined up as all pairs within the radius and of sizes that fit say."""
    import numpy as np

    from tidemark.llm import similar

    rng = np.random.default_rng(12)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        flat = rng.integers(0, 2, (4, 192), np.uint8)[rng.integers(0, 4, n)] ^ (rng.random((n, 192)) < rng.choice([0.02, 0.15, 0.2])).astype(np.uint8)
        words = list(np.packbits(flat, axis=1).view(np.uint64).T.copy())
        sizes = rng.integers(4, rng.choice([6, 30, 300]), n).astype(np.int32)
        apart = flat[:, None] != flat[None]
        good = (apart.sum(axis=2) <= similar.RADIUS) & (apart[:, :, :128].sum(axis=2) <= similar.FIRST_RADIUS) & (np.minimum.outer(sizes, sizes) >= 0.8 * np.maximum.outer(sizes, sizes) - 1e-6)
        want = joined(list(zip(*np.nonzero(good))), n)
        for options in ({}, {"area": 300}, {"most": 5, "area": 100}, {"held": 10, "area": 200}):
            assert joined(list(zip(*similar.near(words, sizes=sizes, **options))), n) == want


def test_sets_with_a_common_passage(monkeypatch):
    """Sets that share a passage, and no more, are not compared one with another; the pairs join up what all pairs at 0.8 do."""
    import numpy as np

    from tidemark.llm import similar

    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    passage, gathered, whole = new(14), [], similar.ragged
    monkeypatch.setattr(similar, "ragged", lambda values, starts, lengths: gathered.append(lengths.sum()) or whole(values, starts, lengths))
    sets = [np.unique(np.concatenate([passage, new(10)])) for _ in range(1500)]
    assert similar.links(sets, 0.8) == [] and sum(gathered) < 10 * 1500

    pool = new(150)
    for _ in range(60):
        bases = [rng.choice(pool, int(rng.integers(4, 50)), replace=False) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 60))):
            b = bases[int(rng.integers(4))]
            sets.append(np.unique(np.concatenate([b[: len(b) - int(rng.integers(0, 1 + len(b) // 6))], rng.choice(pool, int(rng.integers(3))), passage[: int(rng.integers(5))]])))
        want = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
        assert joined(similar.links(sets, 0.8), len(sets)) == joined(want, len(sets))


def test_pipeline_decodes(spark):
    """The last stage gives the text of the ids back, for every row."""
    import sentencepiece

    from tidemark.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.createDataFrame(documents(), SCHEMA)
    rows = dict(corpus_pipeline.STAGES)["pieces"](spark, docs, "").collect()
    assert len(rows) == docs.count() and all(r.decoded == library.decode(list(r.ids)) for r in rows)
    assert sorted(r.decoded for r in rows if r.n_tokens) == sorted(d[1].replace(pieces.SPACE, " ") for d in documents() if d[1])


def test_row_keys(spark):
    from tidemark.llm.shared import row_key, row_keys

    rows = [(3, "a"), (-5, "naïve 漢字 " * 9), (None, "x"), (7, None), (None, None), (1 << 40, "")]
    assert [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select(row_key()).collect()] == row_keys(*zip(*rows)).tolist()


def test_rows_of_one_doc_id(spark):
    """Rows that share a doc_id, or have none, are judged each by its own text."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(3, text("a") + " end"), (5, text("a")), (5, text("b")), (7, text("b") + " end"), (9, text("c")), (9, text("c") + " end"), (None, text("d")), (None, text("d") + " end"), (None, text("a") + " fin")]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in left) == [(0, "d"), (3, "a"), (5, "b"), (9, "c")]

    good = [(i, "the cat sat on the mat and the dog sat on the rug " * 4, "en") for i in range(400)]
    bad = "zq#7 %%x QJ\x01kv 9}{~" * 12
    docs = spark.createDataFrame([*good, (900, good[0][1], "en"), (900, bad, "en"), (None, bad, "en"), (None, good[0][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    left = perplexity.keep_good(docs, labels).collect()
    assert len(left) == 402 and all(r.text != bad for r in left)
