"""Operator 7: secret scan with corpus-wide ownership frequency, DataFrame
functions only.

Base spans are the leftmost non-overlapping matches of each kind:

* ``assign``: a keyword, a separator and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: a run of 24 or more of ``0-9a-f``.

Every base value, without punctuation at its edges, is hashed and counted over
the whole corpus by distinct repositories and distinct owners.  A value that
more than ``max_owners`` owners or ``max_repos`` repositories hold is a widely
copied example; any other that mixes letters and digits and has at least
``live_chars`` characters is a live-looking credential of its owner.  The
method adds spans of kind ``reuse``: other places of the corpus, outside base
spans, where a live-looking value stands alone: as a whole word of the value
alphabet, or as one of the parts into which ``=`` and ``/`` cut a word, each
without punctuation at its edges.

A match ends where its text does, so matches alternate with the pieces that
``split`` leaves; lengths of both, summed up, give the spans in code points.
They are summed in blocks (within each, and over the blocks before), so the
work of a text grows with its matches and not with their square.  Each of the
five patterns reads a text three times (test, extraction and split), and no
table is read again: spans and hashes go to a stored one, and everything after
works on that.  Counting is three partial aggregations (value, owner and
repository; value and owner; value), so a value that a third of all documents
hold does not gather in one task.

Defined results: null counts as empty; rows are told apart by a row number, so
null ids and repeated rows each give one row; a null repository or owner
counts as one more repository or owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import named, stored

#: The kinds in their order; the pattern, the group with the value and the least length of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Words of the value alphabet, and their parts between ``=`` and ``/``, that may repeat a credential: from a letter or
#: digit to the last one, before the check for both.  A match begins where no letter or digit stands before, so a short
#: word is tried once.
WORDS = (r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9]", r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9+_.-]{10,}[A-Za-z0-9]")
#: Owners and repositories that a live-looking value may have, and its least length.
MAX_OWNERS, MAX_REPOS, LIVE_CHARS = 2, 10, 12
#: Matches whose positions are summed at a time.
BLOCK = 512

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(start, end, value) of all non-overlapping matches."""
    def steps(whole):
        value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pieces = F.transform(F.split(text, pattern, -1), F.length)
        return F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: _let(steps(whole), _placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _placed(steps: Column) -> Column:
    """Spans of matches (gap before, size, value), one at least, by running
    sums over blocks of them."""
    def blocks(x):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

    def total(block):
        return F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + m["size"])

    def appended(acc, at, item):
        return F.struct(at.alias("at"), F.array_append(acc["out"], item).alias("out"))

    def spans(block, start):
        none = F.struct(start.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(block, none, lambda acc, m: appended(
            acc, acc["at"] + m["gap"] + m["size"],
            F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["size"]).alias("end"), m["value"].alias("value"))),
            lambda acc: acc["out"])

    def starts(cut):  # where each block begins
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(cut, none, lambda acc, n: appended(acc, acc["at"] + n, acc["at"]), lambda acc: acc["out"])

    return _let(blocks(steps), lambda cut: _let(starts(F.transform(cut, total)), lambda at: F.flatten(
        F.transform(cut, lambda block, i: spans(block, F.get(at, i))))))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[+/_.=-]+|[+/_.=-]+$", "")


def _hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _looks_live(value: Column, live_chars: int) -> Column:
    return (F.length(value) >= live_chars) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
             owner_col: str = "source", live_chars: int = LIVE_CHARS) -> DataFrame:
    """Stored: row, id, repo, owner, base (kind order, start, end, hash, live) and words (start, end, hash)."""
    scan = df.select(F.monotonically_increasing_id().alias("row"), named(id_col).alias("id"),
                     named(repo_col).cast("string").alias("repo"), named(owner_col).cast("string").alias("owner"),
                     F.coalesce(named(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    for k, (kind, pattern, group, _) in enumerate(KINDS):
        scan = scan.withColumn(f"_{k}", _matches(text, pattern, group))
    for k, pattern in enumerate(WORDS):
        scan = scan.withColumn(f"_words{k}", _matches(text, pattern, 0))
    scan = scan.drop("text")

    def base(k: int, least: int):
        return F.transform(F.filter(F.col(f"_{k}"), lambda m: F.length(m["value"]) >= least),
                           lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"),
                                              _hash(_trimmed(m["value"])).alias("hash"),
                                              _looks_live(_trimmed(m["value"]), live_chars).alias("live")))

    all_base = F.array_sort(F.concat(*(base(k, least) for k, (_, _, _, least) in enumerate(KINDS))))
    words = F.concat(*(F.transform(F.filter(f"_words{k}", lambda m: _looks_live(m["value"], live_chars)),
                                        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _hash(m["value"]).alias("hash")))
                       for k in range(len(WORDS))))
    return stored(scan.select("row", "id", "repo", "owner", all_base.alias("base"), words.alias("words")), "secrets")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per base value's hash: repos, owners, live (owner-specific and
    live-looking) and example (widely copied)."""
    null = F.lit("\x00")
    each = (found.select(F.coalesce("repo", null).alias("repo"), F.coalesce("owner", null).alias("owner"),
                         F.explode(F.transform("base", lambda b: F.struct(b["hash"].alias("hash"), b["live"].alias("live")))).alias("v"))
            .select("repo", "owner", "v.hash", "v.live"))
    per_repo = each.groupBy("hash", "owner", "repo").agg(F.max("live").alias("live"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("live").alias("live"))
    return (per_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"),
                                          F.max("live").alias("live"))
            .withColumn("example", (F.col("owners") > max_owners) | (F.col("repos") > max_repos))
            .withColumn("live", F.col("live") & ~F.col("example")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
         owner_col: str = "source", max_owners: int = MAX_OWNERS, live_chars: int = LIVE_CHARS,
         max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``df``: id, base (start, kind, end, hash, live),
    reuse (start, end) and n_live, n_example (base spans by ownership)."""
    found = findings(df, id_col, text_col, repo_col, owner_col, live_chars)
    values = stored(ownership(found, max_owners, max_repos), "secret-values")
    held = (found.select("row", F.explode(F.transform("base", lambda b: b["hash"])).alias("hash"))
            .groupBy("row", "hash").agg(F.count("*").alias("n")).join(values, "hash")
            .groupBy("row").agg(F.sum(F.when(F.col("live"), F.col("n")).otherwise(0)).alias("n_live"),
                                F.sum(F.when(F.col("example"), F.col("n")).otherwise(0)).alias("n_example")))
    outside = F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    reuse = (found.select("row", F.explode(outside).alias("w"))
             .select("row", "w.hash", F.struct("w.start", "w.end").alias("span"))
             .join(values.where("live").select("hash"), "hash", "left_semi")
             .groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("reuse")))
    zero = F.lit(0).cast("long")
    return (found.join(held, "row", "left").join(reuse, "row", "left")
            .select(F.col("id").alias(id_col), "base",
                    F.coalesce("reuse", F.array().cast("array<struct<start:int,end:int>>")).alias("reuse"),
                    F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example")))


def listed(spans: Column) -> Column:
    """Spans (start, kind, end) in their order as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("reuse"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and the list of all spans."""
    def plain(x, kind):
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"))

    base = F.transform("base", lambda b: plain(b, b["kind"]))
    extra = F.transform("reuse", lambda r: plain(r, F.lit(len(KINDS))))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == number)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return scanned.select(id_col, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                          listed(F.array_sort(F.concat(base, extra))).alias("spans"), "n_live", "n_example")
