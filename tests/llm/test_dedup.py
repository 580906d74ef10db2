"""Operators 2, 6 and 10 against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.llm import components, exact_dedup, jaccard_join, substring_dedup, wordhash

from llm_cases import docs, documents, no_docs, sentence  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 2: exact dedup

def test_cuckoo_filter_inserts_deletes_and_overflows():
    marks = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    bucket = exact_dedup.DigestBucket(places=4)
    for i, m in enumerate(marks):
        bucket.insert(m, (i, i), 1)
    assert bucket.filter.places >= 1024  # it was resized from its stored keys
    assert all(m in bucket.filter for m in marks)
    bucket.insert(marks[5], (7, 1), 2)
    assert bucket.content[marks[5]] == [(7, 1), 3]
    for m in marks[:2000]:
        bucket.delete(m, 3)
    assert set(bucket.content) == set(marks[2000:])
    assert all(m in bucket.filter for m in marks[2000:])
    assert sum(m in bucket.filter for m in marks[:2000]) < 20  # only by chance
    bucket.delete(hashlib.sha256(b"never there").digest(), 1)
    assert len(bucket.content) == 1000


def expected_groups():
    groups = {}
    for i, t, *_ in documents():
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return groups


def test_exact_dedup(spark, docs):  # noqa: F811
    rows = exact_dedup.dedup(docs).collect()
    want = []
    for text, ids in expected_groups().items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by_text.values())
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_distinct_texts_keeps_columns_and_one_row(spark, docs, no_docs):  # noqa: F811
    out = exact_dedup.distinct_texts(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.text or "").translate(LOWER) for r in got) == sorted(expected_groups())
    assert exact_dedup.distinct_texts(no_docs).columns == docs.columns
    assert exact_dedup.distinct_texts(no_docs).count() == 0
    assert exact_dedup.dedup(no_docs).count() == 0


def test_index_versions_take_insertions_and_deletions(spark, docs):  # noqa: F811
    rows = exact_dedup.digests(docs)
    first = exact_dedup.updated(None, exact_dedup.changes(rows.where("id < 14"), 3))
    second = exact_dedup.updated(first, exact_dedup.changes(rows.where("id >= 14"), 3),
                                 exact_dedup.changes(rows.where("id in (10, 12)"), 3))
    got = {bytes(r.digest): r.group_size for r in exact_dedup.live_groups(second).collect()}
    want = {}
    for i, t, *_ in documents():
        if i is not None and i not in (10, 12):
            d = hashlib.sha256((t or "").translate(LOWER).encode()).digest()
            want[d] = want.get(d, 0) + 1
    assert got == want


def test_deletions_insertions_and_retries_keep_the_largest_live_row(spark):
    r = random.Random(11)
    texts = ["same", "SAME", "other", "", None, "x" * 50]
    rows = {k: (k, r.choice([None, *range(8)]) if k % 5 == 0 else k * 7 % 41, r.choice(texts)) for k in range(60)}

    def made(keys):
        keys = list(keys)
        df = spark.createDataFrame([rows[k] for k in keys], "key long, doc_id long, text string")
        return exact_dedup.digests(df, row_col="key")

    live, version = set(), None
    for step in range(6):
        put = set(r.sample(sorted(rows), 20))
        cut = set(r.sample(sorted(rows), 15)) if step else set()
        for _ in range(2 if step % 2 else 1):  # retried as a whole
            version = exact_dedup.advanced(version, made(put), made(cut) if cut else None, buckets=3)
            live = (live - cut) | put
        want = {}
        for k in live:
            d = hashlib.sha256((rows[k][2] or "").translate(LOWER).encode()).digest()
            want.setdefault(d, []).append(rows[k][1])
        got = {bytes(x.digest): (x.keep_id, x.group_size) for x in exact_dedup.live_groups(version.index).collect()}
        assert got == {d: (max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()}
    version = exact_dedup.advanced(version, made([]), made(rows))
    assert exact_dedup.live_groups(version.index).count() == 0 and version.members.count() == 0


# --- 6: substring dedup

def brute_substrings(rows, window):
    """rows: (order key, words); words removed by the contract's rule."""
    seen, gone = {}, {}
    for k, words in sorted(rows, key=lambda x: x[0]):
        cover = gone.setdefault(k, [False] * len(words))
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i:i + window]), (k, i)) != (k, i):
                cover[i:i + window] = [True] * window
    return {k: [w for w, g in zip(words, gone[k], strict=True) if not g] for k, words in rows}


@pytest.mark.parametrize("window,period,cover", [(20, 13, (0, 1, 3, 9)), (9, 7, (0, 1, 3)), (7, 7, (0, 1, 3))])
def test_substring_dedup(spark, docs, window, period, cover):  # noqa: F811
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "h", "text").collect()
    rows = {((r.doc_id is None, r.doc_id or 0, r.h), tuple(words_of(r.text))) for r in keyed}
    kept = brute_substrings(rows, window)
    got = substring_dedup.dedup(docs, window=window, period=period, cover=cover).collect()
    want = [(r.doc_id, len(words_of(r.text)), " ".join(kept[(r.doc_id is None, r.doc_id or 0, r.h)])) for r in keyed]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.kept_text)) for r in got)
    assert all(r.n_words - len(words_of(r.kept_text)) == sum(s.end - s.start for s in r.removed) for r in got)


def test_substring_dedup_random_small_alphabet(spark):
    import random
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(0, 60)))) for i in range(60)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5),
                                window=9, period=7, cover=(0, 1, 3)).collect()
    kept = brute_substrings([(i, words_of(t)) for i, t in rows], 9)
    assert {x.doc_id: x.kept_text for x in got} == {i: " ".join(w) for i, w in kept.items()}


def test_substring_dedup_refuses_a_set_that_is_no_cover(spark, docs, no_docs):  # noqa: F811
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs, cover=(0, 1, 2))
    assert substring_dedup.dedup(no_docs).count() == 0


# --- 10: Jaccard join

def shingles(text, k=5):
    words = words_of((text or "").translate(LOWER))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute_classes(rows, share=(75, 100)):
    sets = [(i, shingles(t)) for i, t in rows]
    of = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a][1] & sets[b][1])
        if both and share[1] * both >= share[0] * len(sets[a][1] | sets[b][1]):
            old, new = of[b], of[a]
            of = [new if x == old else x for x in of]
    least = {}
    for (i, _), c in zip(sets, of, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [(i, len(s), least[c]) for (i, s), c in zip(sets, of, strict=True)]


def test_jaccard_join(spark, docs, no_docs):  # noqa: F811
    got = jaccard_join.join(docs).collect()
    want = brute_classes([(i, t) for i, t, *_ in documents()])
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert jaccard_join.join(no_docs).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {c for i, n, c in want if c == i and i is not None}


def variants():
    """Classes of near copies whose members differ from each other by more than
    the radius: chains, balls and members at its very edge."""
    import random
    r, rows = random.Random(5), []
    for base in range(6):
        words = sentence(100 + base, 120).split()
        for _ in range(25):
            copy = list(words)
            for _ in range(r.choice((0, 1, 2, 4, 6))):
                copy[r.randrange(len(copy))] = f"w{r.randrange(9999)}"
            rows.append(" ".join(copy))
        chain = list(words)
        for step in range(12):
            chain[step * 9] = f"c{step}"
            rows.append(" ".join(chain))
    return list(enumerate(rows))


@pytest.mark.parametrize("region_shingles,pivots,cell_members", [(2500, 3, 4000), (400, 2, 3)])
def test_regions_split_exactly(spark, region_shingles, pivots, cell_members):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.join(df, region_shingles=region_shingles, pivots=pivots, cell_members=cell_members).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(brute_classes(rows))


@pytest.mark.parametrize("pivots", [1, 2, 8])
def test_voronoi_regions_of_a_task_lose_no_link(pivots):
    import random
    import numpy as np
    r, regions = random.Random(pivots), 0
    for trial in range(12):
        sets = []
        for base in range(r.choice((1, 3, 9))):
            now = set(range(base * 7, base * 7 + r.choice((4, 12, 40))))
            for _ in range(40):
                now = set(now)
                for _ in range(r.choice((0, 1, 1, 3, 9))):
                    now.discard(r.choice(sorted(now)) if len(now) > 3 else -1)
                    now.add(r.randrange(2000 if trial % 2 else 90))
                sets.append(frozenset(now))
        sets = sorted(set(sets), key=sorted)
        r.shuffle(sets)
        of = list(range(len(sets)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = [new if x == old else x for x in of]
        got, made = jaccard_join.Region([np.array(sorted(x), np.uint64) for x in sets], (75, 100)).split(pivots)
        assert got.tolist() == of
        regions += made
    assert regions > 20


def text_id(i):
    return None if i is None else f"doc/{i:03d} é\r\n"


def test_jaccard_join_and_substring_dedup_keep_text_ids(spark, docs):  # noqa: F811
    named = docs.withColumn("doc_id", F.format_string("doc/%03d é\r\n", "doc_id")).withColumn(
        "doc_id", F.when(~F.col("doc_id").contains("null"), F.col("doc_id")))
    want = {(text_id(r.doc_id), r.n_shingles, text_id(r.component_id)) for r in jaccard_join.join(docs).collect()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(named).collect()} == want
    assert {r.doc_id for r in jaccard_join.one_of_each(named).collect()} == {text_id(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()}
    plain = [(text_id(r.doc_id), r.n_words, r.removed, r.kept_text) for r in substring_dedup.dedup(docs).collect()]
    texts = [(r.doc_id, r.n_words, r.removed, r.kept_text) for r in substring_dedup.dedup(named).collect()]
    assert sorted(map(repr, plain)) == sorted(map(repr, texts))


def test_cells_are_compared_by_pairs_of_blocks(spark):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.join(df, cell_block=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(brute_classes(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (7, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 300: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hub_ends", [0, 3, 256])
def test_components_with_hubs(spark, monkeypatch, hub_ends):
    import random
    monkeypatch.setattr(components, "HUB_ENDS", hub_ends)
    r = random.Random(1)
    edges = [(0, x) for x in range(1, 400)] + [(900, x) for x in range(390, 800)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(50)]
    root = {x: x for e in edges for x in e}
    for a, b in edges * 2:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {x: new if y == old else y for x, y in root.items()}
    r.shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert {x.node: x.root for x in got.collect()} == root


def test_word_hashes_agree_with_words():
    import numpy as np
    texts = ["", "a b", "  x\ty\r\nz ", "ÄÖ ä", "q" * 50, "a b"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(x) for x in raw])
    w = wordhash.Hasher().words(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert w.counts.tolist() == [len(words_of(t)) for t in texts]
    flat = [x for t in texts for x in words_of(t)]
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert w.hash[0] == w.hash[-2] and w.hash[1] == w.hash[-1]
