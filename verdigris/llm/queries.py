"""The operators' registered queries over the given tables, and their DuckDB
SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import (byte_bpe, decontaminate, deobfuscate, exact_dedup, jaccard_join, period_runs, quality, secret_scan,
                           substring_dedup, token_count, toxicity, url_filter, warc, whitening)
from verdigris.llm.common import table

#: The URL rules of the contract (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return (byte_bpe.decode(encoded, ranks, pattern)
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (warc.round_trip(spark, table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (substring_dedup.dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", n_removed.alias("n_removed"),
                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(quality.training_fold(F.col("doc_id"))))
    return (quality.score(docs, weights, keep=["doc_id"])
            .select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
                    "judged.score", "judged.predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
                         "found.contaminated")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    characters = deobfuscate.model(deobfuscate.count_trigrams(docs))
    weights = toxicity.train(docs, labels.where(toxicity.training_fold(F.col("doc_id"))), characters)
    return (toxicity.score(docs, characters, weights, keep=["doc_id"])
            .select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                    "toxicity.score", "toxicity.predicted", "toxicity.n_restored"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = period_runs.with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("periodic.runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    best = period_runs.best_run(F.col("periodic.runs"))
    return (period_runs.mark(docs, keep=["doc_id"])
            .select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best.alias("best"),
                    F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), "periodic.kept_text")
            .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_exact_dedup, op3_url_filter, op4_token_count, op5_warc, op6_substring_dedup, op7_secret_scan,
                              op8_quality, op9_decontaminate, op10_jaccard_join, op11_toxicity, op12_period_runs, op13_whitening)
}

OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

OP3_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.n = 1
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p),
bits AS (
  SELECT page_id, payload_bytes, h,
         list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')),
                        'string_agg', '') AS b FROM d),
coded AS (
  SELECT page_id, payload_bytes, h,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
           + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
           + CAST(substr(b, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest FROM bits),
firsts AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM coded JOIN firsts USING (h)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
im AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM im),
lengths AS (SELECT DISTINCT m FROM windows),
dm AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw JOIN lengths ON len(w) >= m),
hits AS (SELECT DISTINCT doc_id, i, m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM dm)
         JOIN windows USING (m, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.l, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op5_warc": OP5_SQL, "op6_substring_dedup": OP6_SQL,
                              "op9_decontaminate": OP9_SQL, "op10_jaccard_join": OP10_SQL}
