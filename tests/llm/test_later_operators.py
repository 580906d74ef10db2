"""Operators 11, 12 and 13 against brute force, planted words and numpy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import deobfuscate, period_runs, queries, toxicity, whitening
from verdigris.llm.common import table

from llm_cases import SF_SMALL, docs, documents, no_docs, sentence  # noqa: F401

SPACE = r"[^\x20\x09-\x0D]+"


# --- 12: periodic runs

def brute_runs(words):
    """Every maximal stretch by comparing words of each distance."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def kept_words(words, runs):
    dropped = {k for a, n, q in runs for k in range(a + q, a + n)}
    return [w for k, w in enumerate(words) if k not in dropped]


def brute_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(r.randint(1, 4)):
        words = []
        while len(words) < r.randint(0, 150):
            block = [r.randint(0, r.choice((1, 2, 30))) for _ in range(r.randint(1, r.choice((1, 3, 9, 17))))]
            words += (block * r.randint(1, 8))[:r.randint(1, 200)]
        texts.append(words)
    ids = list(itertools.chain.from_iterable([*t, -1 - k] for k, t in enumerate(texts)))
    start, end, period = period_runs.find_runs(np.array(ids, dtype=np.int64), max(map(len, texts)))
    want, at = [], 0
    for t in texts:
        want += [(at + a, n, q) for a, n, q in brute_runs(t)]
        at += len(t) + 1
    assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == want


def test_runs_of_a_fibonacci_word_and_its_powers():
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    words = [ord(c) for c in b[:40] + (b[:23] * 5)[:100] + b]
    start, end, period = period_runs.find_runs(np.array([*words, -1]), len(words))
    assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(words)


def test_synchronising_sets_are_local_and_dense():
    r = random.Random(3)
    words = np.array([r.randint(0, 3) for _ in range(600)], dtype=np.int64)
    words[400:440] = words[100:140]
    levels = period_runs._levels(words, 64, 0)
    for k in (0, 1, 2, 3):
        size, none = 1 << k, np.zeros(len(levels[k]), dtype=bool)
        chosen = set(period_runs.synchronising(levels[k], size, none).tolist())
        for i in range(100, 140 - 2 * size + 1):
            assert (i in chosen) == (i + 300 in chosen)
        assert all(chosen & set(range(i, i + size)) for i in range(0, 600 - 3 * size))


def test_equal_window_hashes_are_found_out(monkeypatch):
    levels = period_runs._levels

    def weak(ids, longest, seed):
        found = levels(ids, longest, seed)
        return [h & np.uint64(7) for h in found] if seed == 0 else found

    monkeypatch.setattr(period_runs, "_levels", weak)
    words = [*range(30), *[7, 8, 9] * 6, *range(40, 70), -1]
    start, end, period = period_runs.find_runs(np.array(words), len(words) - 1)
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == [(30, 18, 3)]


def test_marked_runs_on_all_cases(docs):
    rows = period_runs.mark(docs).collect()
    assert len(rows) == len(documents())
    for r in rows:
        words = re.findall(SPACE, r.text or "")
        runs = brute_runs(words)
        assert r.periodic.n_words == len(words) and [tuple(x) for x in r.periodic.runs] == runs
        assert r.periodic.kept_text == " ".join(kept_words(words, runs))
        assert (r.found, r.judged, r.t) == ("f", "j", "t")


def test_marked_runs_on_an_empty_table(no_docs):
    assert period_runs.mark(no_docs).count() == 0


def test_period_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op12_period_runs(spark, SF_SMALL).collect()}
    rows = table(spark, SF_SMALL, "documents").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = brute_planted(r.doc_id, re.findall(SPACE, r.text or ""))
        runs = brute_runs(words)
        some += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0]), default=None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want, r.doc_id
    assert some > 5


def test_best_run_of_equal_exponents(spark):
    runs = [(5, 8, 2), (5, 16, 4), (9, 12, 3), (20, 9, 2), (30, 18, 4)]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r[0] and tuple(r[0]) for r in df.select(period_runs.best_run(F.col("runs"))).collect()] == [(20, 9, 2), None]


# --- 13: whitening

def grid(vectors):
    return [[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in vectors]


def test_whitening_query_equals_numpy(spark):
    rows = table(spark, SF_SMALL, "embeddings").collect()
    x = np.array(grid([r.embedding for r in rows]))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    got = queries.op13_whitening(spark, SF_SMALL).collect()
    k = min(16, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(rows) * k
    at = {r.vec_id: i for i, r in enumerate(rows)}
    w = np.zeros((len(rows), k))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at[r.vec_id]], sums, strict=True))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-8 and r.identity_error < 1e-8
    want = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-6


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(1)
    fine = [[float(a), float(b), float(a + b), 0.5] for a, b in r.normal(size=(40, 2))]  # rank two of four
    rows = [(i, v, "c") for i, v in enumerate(fine)] + [(7, fine[7], "again"), (None, fine[3], "n"), (90, None, "x"), (91, [1.0, None, 1.0, 1.0], "x"),
            (92, [1.0, nan, 1.0, 1.0], "x"), (93, [1.0, -inf, 1.0, 1.0], "x"), (94, [], "x"), (95, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    got = whitening.whiten(df).collect()
    x = np.array(grid(fine))
    x2 = np.unique(x, axis=0)
    v = np.cov(x2.T.astype(float), bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    k = int((e > 1e-9 * e[0]).sum())
    assert len(got) == 42 * k and {r.vec_id for r in got} == {*range(40), None}
    for r in got:
        assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-6 and r.identity_error < 1e-6


def test_whitening_needs_several_passes_for_a_bad_condition(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3)) * [1e9, 1e4, 1.0] @ np.linalg.qr(r.normal(size=(3, 3)))[0]
    df = spark.createDataFrame([([int(c * 64) for c in row],) for row in x], "x array<long>")
    found = whitening.fit(df.distinct(), 3)
    want = np.linalg.svd(np.array([[int(c * 64) for c in row] for row in x]) - np.mean([[int(c * 64) for c in row] for row in x], axis=0))[1] ** 2 / 300
    assert found.passes >= 3 and len(found.eigenvalues) == 2  # the third is below RANK
    assert np.allclose(found.eigenvalues, want[:2], rtol=1e-6)


def test_whitening_of_nothing(spark):
    kinds = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None)], kinds)).count() == 0


def test_deviations_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(i, [float(i) * 1e12, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        whitening.whiten(df).collect()


# --- 11: toxicity

CLEAN = [a + b + c for a in ("ba", "le", "mi", "to", "ru") for b in ("n", "rd", "st", "m") for c in ("el", "a", "ing", "o")]
HIDDEN = ["sc0undrel", "v1llain", "r4sc4l", "s c o u n d r e l", "v.i.l.l.a.i.n", "raaascal", "vill@in", "$coundrel"]
BAD = ["scoundrel", "villain", "rascal"]


def toxic_corpus(n=400, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(r.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def judge(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    characters = deobfuscate.model(deobfuscate.count_trigrams(df))
    return characters, toxicity.train(df, labels, characters)


def test_trigram_counts_equal_brute_force(docs):
    want = np.zeros((28, 28, 28), dtype=int)
    for _, text, *_ in documents():
        kinds = [ord(c.lower()) - 96 if c.isascii() and c.isalpha() else 27 if ord(c) >= 128 else 0 for c in text or ""]
        b = a = 0
        for c in kinds:
            if c or a:
                want[b, a, c] += 1
            b, a = (0, 0) if c == 0 else (a, c)
    assert np.array_equal(deobfuscate.count_trigrams(docs), want.ravel())


def every_way(span, table):
    """The best plain text by trying each way through the lattice."""
    best = None
    for way in itertools.product(*deobfuscate._lattice(span)):
        score, b, a = 0.0, 0, 0
        for _, kinds, p in way:
            score += p
            for k in kinds:
                if k or a:
                    score += table[b][a][k]
                b, a = (0, 0) if k == 0 else (a, k)
        score += table[b][a][0] if a else 0.0
        if best is None or score > best[0]:
            best = (score, "".join(o[0] for o in way))
    return best


@pytest.mark.parametrize("span", [*HIDDEN[:3], "s c o u n", "aaa 1|1", "x.y.z.1", "$$$a", "é3é", "bb88!!"])
def test_viterbi_equals_trying_all_ways(judge, span):
    table = judge[0].tolist()
    assert deobfuscate.decode(span, table) == every_way(span, table)[1]


def test_hidden_words_are_restored(judge):
    restorer = deobfuscate.Restorer(judge[0])
    for hidden in HIDDEN:
        raw = f"banel {hidden} toma.".encode()
        plain, _, n = restorer.restored(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert plain.tobytes().decode().split()[1] in BAD and n.tolist() == [1], hidden


def test_plain_texts_stay(judge):
    raw = b"banel a b lesta*** the&&& 1234 2024-01-02 toma!! $$$ (x) rumo, 99 \xc3\xa9"
    plain, offs, n = deobfuscate.Restorer(judge[0]).restored(np.frombuffer(raw, np.uint8), np.array([0, 5, len(raw)]))
    assert plain.tobytes() == raw and offs.tolist() == [0, 5, len(raw)] and n.tolist() == [0, 0]


def test_toxic_texts_are_found_also_when_hidden(spark, judge):
    r = random.Random(8)
    rows = [(i, " ".join([*r.sample(CLEAN, 12), *([HIDDEN[i // 2 % len(HIDDEN)]] if i % 2 else []), *r.sample(CLEAN, 9)])) for i in range(64)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), *judge[:1], judge[1], keep=["doc_id"]).collect()
    assert all(x.toxicity.predicted == x.doc_id % 2 and x.toxicity.n_restored == x.doc_id % 2 for x in got)


def test_scores_equal_a_plain_version(spark, judge):
    characters, (known, w, bias) = judge
    weight = dict(zip(known.tolist(), w.tolist(), strict=True))
    rows = toxic_corpus(60, 9)
    got = toxicity.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), characters, judge[1]).collect()
    from verdigris.llm import wordhash
    hasher = wordhash.Hasher()

    def hashed(text, seed):
        raw = np.frombuffer(text.encode(), np.uint8)
        return int(wordhash.mix(hasher.hash_spans(raw, np.array([0]), np.array([len(raw)]), True), seed)[0])

    for r in got:
        words = set(re.findall(r"[a-z]+", r.text))
        present = {hashed(x, 30) for x in words} | {hashed(x[:n], 30 + n) for x in words for n in (4, 5) if len(x) > n}
        margin = bias + sum(weight.get(h, 0.0) for h in present)
        assert abs(r.toxicity.score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_fit_reaches_the_optimum():
    r = np.random.default_rng(4)
    x = (r.random((80, 6)) < 0.3).astype(float)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (r.random(80) < 0.1)).astype(float)
    rows, which = np.nonzero(x)
    w, bias = toxicity.fit_logistic(y, rows, which, 6, 0.5, 4000)
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w + bias))) - y))
    assert np.all(w >= 0) and np.all(np.abs(g[w > 0] + 0.5) < 1e-6) and np.all(g[w == 0] > -0.5 - 1e-6)


def test_toxicity_on_all_cases(spark, docs, no_docs, judge):
    got = toxicity.score(docs, *judge[:1], judge[1]).collect()
    assert len(got) == len(documents()) and all(0 <= r.toxicity.score <= 1 for r in got)
    empty = {r.toxicity.score for r in got if not r.text}
    assert len(empty) == 1
    assert toxicity.score(no_docs, *judge[:1], judge[1]).count() == 0
    assert deobfuscate.count_trigrams(no_docs).sum() == 0


def test_training_without_labels_of_both_kinds(spark, docs, no_docs, judge):
    for rows in ([], [(10, 0), (11, 0)], [(10, 1)], [(None, 1), (10, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        known, w, bias = toxicity.train(docs, labels, judge[0])
        assert len(known) == len(w) == 0 and np.isfinite(bias)
    assert toxicity.train(no_docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), judge[0])[2] == 0.0


def test_repeated_rows_and_labels_change_nothing(spark, judge):
    rows = toxic_corpus()
    df = spark.createDataFrame([r[:2] for r in rows for _ in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows for _ in range(3)], "doc_id long, toxic int")
    known, w, bias = toxicity.train(df, labels, judge[0])
    assert np.array_equal(known, judge[1][0]) and np.allclose(w, judge[1][1]) and abs(bias - judge[1][2]) < 1e-9


def test_toxicity_query_learns_from_its_fold_only(spark):
    got = queries.op11_toxicity(spark, SF_SMALL).collect()
    assert len(got) == table(spark, SF_SMALL, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    labels = {r.doc_id: r.toxic for r in table(spark, SF_SMALL, "labels").collect()}
    clean = [r for r in got if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
