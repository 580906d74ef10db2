"""Operators 3, 5, 7, 8 and 9 and the pipeline's stages against brute force."""

import base64
import hashlib
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import decontaminate, quality, queries, secret_scan, url_filter, warc
from verdigris.llm.common import scratch_path

from llm_cases import SF_SMALL, docs, documents, no_docs, sentence  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

URLS = ["http://a.Example.NET/en/x?u#f", None, "no host", "https://example.net", "http://x.org/fr/p#q", "ftp://net/", "", "://",
        "http://exXample.net/en", "http://b.example.com/de/1?x=http://net/", "http://b.example.com?a/b", "://net/", "http://..net/a",
        "http://example.com.net/de/", "http://a.b.c.d.e.f.org/fr/", "http://ORG/fr/", "http://x.net#/en/", "http://net./x",
        "http://example.net/EN/", "http://h/" + "p" * 20000, "http://" + "a." * 2000 + "net/"]


# --- 3: URL filter

def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("rules", [queries.URL_RULES, [], [("net", "", "block"), ("a.net", "/x", "allow"), ("net", "/xab", "block"),
                                                          ("NET", "/x", "allow"), ("net", "/x", "block"), ("h", "/pp", "block")]])
def test_url_rules(spark, rules):
    rows = [(i if i % 5 else None, u, f"h{i}", "p", "r", "v") for i, u in enumerate([*URLS, *URLS[:3], "http://a.net/xabc", "http://net/x"])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string").repartition(3)
    got = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = [(r[0], *brute_judge(r[1], [(h.lower(), p, v) for h, p, v in rules])) for r in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_url_rules_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")).count() == 0


# --- 5: WARC

PAGES = [(1, "http://a/ b\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u3", ""), (4, "u4", None), (None, "u5", "<p>é</p>"),
         (5, "u6", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5), (6, "u7", "x" * 3_000_000), (6, "u7", "x" * 3_000_000),
         (7, "u8", "x" * 3_000_000), (None, "u9", "alone"), (8, "u10", "ab")]


def brute_records(min_bytes):
    firsts = {}
    for i, _, h in PAGES:
        h = (h or "").encode()
        if len(h) >= min_bytes and i is not None:
            firsts[h] = min(firsts.get(h, i), i)
    for i, _, h in PAGES:
        h = (h or "").encode()
        first = firsts.get(h)
        yield (i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(),
               "response" if first in (None, i) else "revisit", None if first in (None, i) else first)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES],
                                  "page_id long, url string, html string, sha1 string, size string").repartition(3)
    path = scratch_path(spark, "warc-test")
    got = warc.round_trip(spark, pages, path, min_bytes=min_bytes).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) \
        == sorted(map(repr, brute_records(min_bytes)))
    full = warc.read(spark, path).collect()
    payloads = sorted(bytes(r.payload) for r in full if r.record_type == "response")
    want = {(i, (h or "").encode()) for i, _, h in PAGES}
    assert set(payloads) <= {h for _, h in want}
    assert all(r.payload is None for r in full if r.record_type == "revisit")
    assert {r.url for r in got} == {None, "http://a/%20b%0D%0A", *(f"u{n}" for n in range(3, 11))}


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages, scratch_path(spark, "warc-plain"))
    raw = b"".join(zlib.decompress(bytes(r.content), 31) for r in
                   spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect())
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.endswith(b"\r\n\r\n")
    assert b"WARC-Type: revisit\r\n" in raw and b"WARC-Refers-To: <urn:uuid:" in raw


def test_warc_keeps_text_ids_and_line_ends(spark):
    import random
    r = random.Random(4)
    htmls = ["".join(r.choice("\r\n\n\r\ra") for _ in range(n)) for n in (0, 1, 2, 3, 40, 70_000, 400_000)]
    rows = [(f"page {k % 7}: {'é' * (k % 3)}\r\n{k // 7}", "u", h) for k, h in enumerate(htmls + htmls)]
    pages = spark.createDataFrame([*rows, (None, "u", "none")], "page_id string, url string, html string").repartition(2)
    path = scratch_path(spark, "warc-text-ids")
    got = {x.page_id: x for x in warc.round_trip(spark, pages, path).collect()}
    assert set(got) == {i for i, *_ in rows} | {None}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h, i)
    for i, _, h in rows:
        assert (got[i].payload_bytes, got[i].refers_to) == (len(h), None if first[h] == i else first[h])
    full = {x.page_id: x.payload for x in warc.read(spark, path, "string").collect() if x.payload is not None}
    assert all(bytes(full[i]).decode() == h for h, i in first.items())


@pytest.mark.parametrize("lines", [[b"WARC/1.1", b"Content-Length: 4"], [b"WARC/1.1", b"Content-Length: 4", b"", b"abc"],
                                   [b"WARC/1.1", b"WARC-Record-ID: x", b"Content-Length: 4", b"", b"ab", b"c", b""]])
def test_cut_archives_are_refused(lines):
    with pytest.raises(ValueError):
        list(warc.parse(lines))


def test_warc_of_an_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 7: secret scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group(0)) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group(0)) >= 24]
    return sorted(out)


SECRETS = ["é😀 token=abcdefgh", "PASSWORD : \"hunter2222\" passwd:x api-key=123456 apiKEY='a.b/c+d=' api_key==abcdef", "tokentoken=token=token:abcdefgh",
           "AKIA" + "A" * 15, "AKIA" + "B" * 16 + " xAKIA" + "1" * 30, "AKIAKIA" + "Z9" * 10, "f" * 24 + "g" + "0" * 23 + " " + "ab" * 30,
           "secret\n=abcdefgh secret = \nabcdefgh", None, "", "token=\"\"abcdefgh", "token=" + "0f" * 20, "😀" * 40 + "secret:AKIA" + "C" * 20]


def test_base_spans(spark):
    rows = [(i if i else None, t, "own", i) for i, t in enumerate([*SECRETS, *SECRETS[:2], "pass " * 9000 + "token=zzzzzz9"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, base long").repartition(3)
    got = secret_scan.report(secret_scan.scan(df)).collect()
    want = []
    for i, t, *_ in rows:
        spans = brute_spans(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)


def test_ownership_separates_examples_from_live_credentials(spark):
    live, example = "s3cr3tV4lue9876", "ex4mpleV4lue1234"
    rows = [(1, f"token={live}", "acme"), (2, f"we ran it with {live} twice: {live}", "acme"),
            *[(10 + i, f"password={example}", f"o{i}") for i in range(5)], (20, f"docs say {example}", "o9"),
            (21, f"prefix{live} is another word", None), (22, "token=onlyletters", "z"), (23, "onlyletters here", "z")]
    out = {r.doc_id: r for r in secret_scan.report(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert out[2].spans == f"reuse:15:{15 + len(live)},reuse:38:{38 + len(live)}"
    assert (out[1].n_live, out[1].n_example) == (1, 0) and (out[10].n_live, out[10].n_example) == (0, 1)
    assert all(out[i].spans == "" for i in (20, 21, 23))
    assert out[22].spans.startswith("assign:") and out[22].n_live == 0


def brute_reports(rows, max_owners, max_repos, live_chars=12):
    """Counts by ownership and all spans, from the rules alone."""
    def trimmed(v):
        return v.strip("+/_.=-")

    def live(v):
        return len(v) >= live_chars and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v))
    base, holders = [], {}
    for n, (i, t, owner) in enumerate(rows):
        t, found = t or "", []
        for a, k, b in brute_spans(t):
            v = trimmed(re.search(r"[A-Za-z0-9+/_.=-]+$", t[a:b]).group(0) if k == 0 else t[a:b])
            if k == 0:
                v = trimmed(ASSIGN.match(t, a).group(2))
            found.append((a, k, b, v))
            holders.setdefault(v, set()).add((owner, i))
        base.append(found)
    example = {v: len({o for o, _ in h}) > max_owners or len(h) > max_repos for v, h in holders.items()}
    out = []
    for (i, t, owner), found in zip(rows, base, strict=True):
        t, spans = t or "", set()
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t):
            pieces = [(m.start(), m.group(0))]
            pieces += [(m.start() + p.start(), p.group(0)) for p in re.finditer("[^=/]+", m.group(0))]
            for at, word in pieces:
                a = at + len(word) - len(word.lstrip("+/_.=-"))
                v = trimmed(word)
                if live(v) and example.get(v) is False and not any(x < a + len(v) and a < y for x, _, y, _ in found):
                    spans.add((a, 3, a + len(v)))
        names = ("assign", "access", "hex", "reuse")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted({(a, k, b) for a, k, b, _ in found} | spans))
        out.append((i, sum(live(v) and not example[v] for *_, v in found), sum(example[v] for *_, v in found), listed))
    return out


def test_ownership_and_reuse_equal_brute_force(spark):
    r = random.Random(5)
    values = [f"k{n}Ey{n * 7919}Qz{n}vv" for n in range(12)] + ["plainlettersonly", "123456789012345", "a1/b2=c3/d4567"]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(r.randint(0, 4)):
            v = values[min(int(r.expovariate(0.25)), len(values) - 1)]
            parts.append(r.choice([f"token={v}", f"password: '{v}.'", v, f"{v}.", f"KEY={v}", f"https://h/p/{v}/x", f"x{v}", f"({v})", "words and words"]))
        rows.append((i, " ".join(parts) if i % 50 else None, f"owner{r.randint(0, 3) if i % 3 else 0}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for max_owners, max_repos in ((2, 10), (3, 25), (4, 1000)):
        got = secret_scan.report(secret_scan.scan(df, max_owners=max_owners, max_repos=max_repos)).collect()
        assert sorted((x.doc_id, x.n_live, x.n_example, x.spans) for x in got) == sorted(brute_reports(rows, max_owners, max_repos))
    assert any(x.n_example and "reuse" in x.spans for x in got) or any("reuse" in x.spans for x in got)


def test_many_long_words_take_linear_time(spark):
    words = [f"abcdefghijk{n}x" for n in range(60_000)]
    live = "s3cr3tV4lue9876"
    rows = [(1, f"token={live}", "o"), (2, " ".join([*words, live]), "o")]
    began = time.time()
    out = {x.doc_id: x for x in secret_scan.report(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    at = len(" ".join(words)) + 1
    assert out[2].spans == f"reuse:{at}:{at + len(live)}" and time.time() - began < 60


def test_secret_scan_on_all_cases(spark, docs, no_docs):  # noqa: F811
    assert secret_scan.report(secret_scan.scan(docs)).count() == len(documents())
    assert secret_scan.report(secret_scan.scan(no_docs)).count() == 0


# --- 8: quality classifier

def test_classifier_learns_and_holds_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/labels.parquet").collect()}
    out = queries.op8_quality(spark, SF_SMALL.replace("0.001", "0.01"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_classifier_scores_every_case(spark, docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(10, 1), (10, 1), (12, 1), (14, None), (None, 0), (33, 0), (33, 1), (31, 0), (99, 0)],
                                   "doc_id long, quality int")
    weights = quality.train(docs, labels, epochs=2)
    assert np.array_equal(weights, quality.train(docs.repartition(5), labels, epochs=2))  # any partitioning learns the same
    scored = quality.score(docs, weights)
    assert scored.count() == len(documents()) and "judged" in scored.columns
    rows = quality.score(docs, weights, keep=["doc_id", "text"], result="q").collect()
    bias = 1 / (1 + np.exp(-float(weights[-1])))
    assert all(abs(r.q.score - bias) < 1e-9 for r in rows if not (r.text or "").strip())
    assert {round(r.q.score, 9) for r in rows if r.doc_id == 13} == {round(r.q.score, 9) for r in rows if r.doc_id == 10}
    nothing = quality.train(docs, labels.where("doc_id < 0"))
    assert all(r.q.score == 0.5 for r in quality.score(docs, nothing, keep=["doc_id"], result="q").collect())
    assert quality.accepted(no_docs, weights).columns == no_docs.columns


def plain_ftrl(rows, bits, epochs=quality.EPOCHS, alpha=quality.ALPHA, beta=quality.BETA, l1=quality.L1, l2=quality.L2):
    """FTRL-proximal by the book, one coordinate at a time; rows are (y, {feature: value})."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for y, x in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return np.array([weight(i) if i in z else 0.0 for i in range(2**bits + 1)])


def test_learned_weights_equal_plain_ftrl_and_repeated_rows_change_nothing(spark):
    from verdigris.llm import wordhash
    r, bits = random.Random(3), 16
    texts = [(i, " ".join(r.choice(("good", "fine", "Bad!", "x9", "buy")) for _ in range(r.randint(0, 12))), i % 3 % 2) for i in range(40)]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    got = quality.train(df, labels, bits=bits)
    order = [x.doc_id for x in df.orderBy(F.xxhash64("doc_id", "text")).collect()]
    hasher, rows = wordhash.Hasher(), []
    for i in order:
        raw = np.frombuffer(texts[i][1].encode(), np.uint8)
        x = {2**bits: 1.0}
        parts = []
        for number, _ in quality.features(hasher, raw, np.array([0, len(raw)]), bits):
            which, n = np.unique(number, return_counts=True)
            parts += [(int(a), float(np.float32(quality.SCALE * b / max(1, len(number))))) for a, b in zip(which, n, strict=True)]
        assert len({a for a, _ in parts}) == len(parts)  # no weight is shared here
        rows.append((texts[i][2], dict(parts) | x))
    assert np.count_nonzero(got) > 10 and np.allclose(got, plain_ftrl(rows, bits), atol=1e-5)
    twice = quality.train(df.union(df), labels.union(labels), bits=bits)
    assert np.array_equal(got, twice)
    few = quality.train(df, labels, bits=bits, max_bytes=100)
    assert not np.array_equal(got, few)


# --- 9: decontamination

def brute_contamination(items, rows, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[a:a + m]), set()).add(i)
    lengths = {len(w) for w in windows}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                if (of := windows.get(tuple(w[a:a + m]))) is not None:
                    hit.update(range(a, a + m))
                    found |= of
        yield i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)


def test_benchmark_with_long_ids_is_dealt_into_smaller_blocks(spark):
    items = [("i" * 300 + str(i), f"alpha{i} beta{i} gamma{i}") for i in range(4000)]
    table = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(i, f"so alpha{i} beta{i} gamma{i} and on" if i % 3 else "nothing here") for i in range(60)], "doc_id long, text string")
    windows = decontaminate.benchmark_windows(table)
    blocks = decontaminate.dealt_blocks(windows, 400_000, 500_000)
    size = windows.groupBy(decontaminate._block_of(blocks)).agg(F.sum(F.octet_length("item") + decontaminate.WINDOW_BYTES).alias("s"))
    assert blocks >= 4 and size.agg(F.max("s")).first()[0] <= 500_000
    got = decontaminate.mark(df, table, block_bytes=500_000).collect()
    assert all(r.found.items == (["i" * 300 + str(r.doc_id)] if r.doc_id % 3 else []) for r in got)


def test_a_block_is_sent_without_this_package(spark):
    table = spark.createDataFrame([("a", "one two three four"), ("b", "one two three four")], "item_id string, text string")
    block = decontaminate.prepared(decontaminate.benchmark_windows(table).toArrow())
    assert b"verdigris" not in pickle.dumps(block)


@pytest.mark.parametrize("block_windows", [400_000, 2500])
@pytest.mark.parametrize("window,gram", [(13, 5), (6, 6), (8, 1)])
def test_decontamination(spark, docs, window, gram, block_windows):  # noqa: F811
    items = [(1, sentence(3, 45)), (2, sentence(3, 45) + " more " + sentence(9, 9)), (3, None), (4, ""), (5, "One, TWO!"), (6, "changed"),
             (None, sentence(8, 20)), (7, "same same same same same same same same same same same same same same"), (7, "twice"), (7, "twice"),
             (10, sentence(7, 6000)), (11, "€中文 end")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hi string")
    got = decontaminate.mark(docs, table, keep=["doc_id", "found"], window=window, gram=gram, block_windows=block_windows, result="f").collect()
    want = brute_contamination(items, [(i, t) for i, t, *_ in documents()], window)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.f.n_words, r.f.n_hit, r.f["items"], r.f.contaminated)) for r in got)
    assert all(r.found == "f" for r in got)


def test_copies_of_a_contaminated_text_count_once_in_each_block(spark, monkeypatch):
    """Of 400 copies only one row for each block gets to the lists of hits."""
    plans, kept = [], decontaminate.stored

    def stored(df, name):
        if name == "more-hits":
            plans.append(df._jdf.queryExecution().optimizedPlan())
        return kept(df, name)

    monkeypatch.setattr(decontaminate, "stored", stored)
    hot, other = sentence(3, 45), sentence(5, 60)
    texts = [(i, hot) for i in range(400)] + [(400, other), (401, "nothing of it"), (402, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    items = [(1, hot), (2, other), (3, hot[10:])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(df, table, block_windows=9, result="f").collect()
    want = brute_contamination(items, texts, 13)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.f.n_words, r.f.n_hit, r.f["items"], r.f.contaminated)) for r in got)
    groups, node = [], plans[0]
    while node.children().size() == 1:
        if node.nodeName() == "Aggregate":
            groups.append((node.groupingExpressions().size(), "collect_list" in node.aggregateExpressions().toString()))
        node = node.children().head()
    assert groups == [(1, True), (2, False)]  # lists by digest, of one row by digest and block


def test_decontamination_of_empty_tables(spark, docs, no_docs):  # noqa: F811
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, sentence(3, 45))], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(documents())
    assert decontaminate.clean(no_docs, some).columns == no_docs.columns
    assert decontaminate.clean(no_docs, some).count() == 0
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.clean(docs, some).collect()} == {15, 16, 17}


# --- the pipeline

def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    # the same by brute force, from the classifier's own verdicts on
    accepted = {r.doc_id: r.text for r in corpus_pipeline.keep_quality(spark, raw, SF_SMALL).collect()}
    by_text = {}
    for i, t in accepted.items():
        by_text[t.translate(LOWER)] = max(i, by_text.get(t.translate(LOWER), i))
    rows = [(i, accepted[i]) for i in by_text.values()]
    from test_dedup import brute_classes
    rows = [(i, accepted[i]) for i, _, c in brute_classes(rows) if c == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    left = {i for i, *_, bad in brute_contamination(items, rows, 13) if not bad}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == left
    assert all(got[i].decoded_sha256 == hashlib.sha256(accepted[i].encode()).hexdigest() for i in left)


def test_each_stage_on_every_case(spark, docs, no_docs, tmp_path):  # noqa: F811
    labels = [(i, int(i not in (31, 33))) for i in range(10, 36)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, sentence(3, 45))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table, rows in ((docs, True), (no_docs, False)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert (out.count() > 0) == rows
            if n < 4:
                assert out.columns == table.columns
            else:
                assert out.count() == table.count()


def test_queries_and_sql_are_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    import os
    import sys

    import duckdb
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    from oracle_check import rows_of
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(columns) == sorted(out.columns)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(columns, cur.fetchall())


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op3_url_filter", "op7_secret_scan"):
        plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|InArrow", plan)
