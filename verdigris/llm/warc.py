"""Operator 5: WARC archives with revisit records.

Headers (id, URL, payload digest and size, no payload) are shuffled by payload
digest; in each group of equal payloads of at least ``min_bytes`` bytes the
record with the smallest id is the response and the others revisit it.  The
decisions join the pages on (id, digest), so that copies of one hot payload
spread by id, and only responses carry a payload into the archives.  Records
get fresh headers and are written by Spark's text writer (gzip, one record
after another, CR LF CR LF between them), so commits, retries and any file
system Spark knows work as for every other sink.

``read`` streams the archives as Spark's text source gives them, cut at CR LF,
through a parser that goes by Content-Length and holds one record at a time,
so an archive may have any size.  It recomputes the digest of every payload it
meets, and joins each revisit record to its original response by record id;
payload size and digest of a revisit are those of that response.

Defined results: null payloads count as empty; equal empty payloads are a
group like others.  Null ids come after all others; every row with the
smallest id of its group is a response (repeated rows of one page are one
page).  A null URL leaves out WARC-Target-URI.  Control characters and blanks
in a URL are percent-encoded.  Ids keep their type, any that Spark orders and
casts from its text; archives hold them percent-encoded, and ``read`` is told
the type (long unless given).  Empty tables give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import named, released, scratch_path, stored

#: Records of one archive file at most.
ARCHIVE_RECORDS = 5_000
#: Payloads that a reader hands on at a time (one at least).
READ_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, SHA-1 (hexadecimal) and size of each page."""
    payload = F.coalesce(named(payload_col).cast("binary"), F.lit(b""))
    return (pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url"),
                         payload.alias("payload"))
            .withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload").cast("long")))


def decisions(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, sha1) to record type, original id and original URL."""
    rank = F.struct(F.col("id").isNull().alias("last"), "id", F.coalesce("url", F.lit("")).alias("url"))
    originals = (heads.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min(rank).alias("o"))
                 .select("sha1", F.col("o.id").alias("first_id"), F.col("o.url").alias("first_url")))
    each = heads.groupBy("sha1", "id").agg(F.first("size").alias("size"))
    return (each.join(originals, "sha1", "left")
            .select("sha1", "id", "first_url", F.when((F.col("size") >= min_bytes)
                                                      & ~F.col("id").eqNullSafe(F.col("first_id")),
                                                      F.col("first_id")).alias("refers_to")))


def _record_id(page, sha1: str) -> str:
    h = hashlib.md5(f"{page}/{sha1}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page, url: str | None, sha1: str, payload: bytes | None, refers_to, first_url: str | None, date: str) -> bytes:
    """A WARC/1.1 record without its last line end; ``payload`` None: a revisit."""
    revisit = payload is None
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = b"" if revisit else (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
                                 + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(page, sha1)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"X-Page-ID: {quote(str(page), safe='')}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, sha1)}"]
        if first_url:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes one record per page below ``path``; returns ``path``."""
    full = headers(pages, id_col, url_col, payload_col)
    decided = stored(decisions(stored(full.drop("payload"), "warc-headers"), min_bytes), "warc-decisions")
    joined = (full.alias("p").join(decided.alias("d"), (F.col("p.sha1") == F.col("d.sha1"))
                                   & F.col("p.id").eqNullSafe(F.col("d.id")))
              .select("p.id", "p.url", "p.sha1", F.when(F.col("d.refers_to").isNull(), F.col("payload")).alias("payload"),
                      "d.refers_to", "d.first_url"))

    def task(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([record(i, u, s, p, r, f, date) for i, u, s, p, r, f in rows], pa.binary())], ["value"])

    (joined.mapInArrow(released(task), "value binary").select(F.col("value").cast("string"))
     .write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))
    return path


def parse(lines: Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Records of archives cut at CR LF: header fields and block.  Archives may
    follow each other, as each ends with its last record's line ends."""
    lines = iter(lines)
    for line in lines:
        if not line:
            continue  # the line ends between records
        fields = {}
        while line := next(lines, None):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(": ")
            fields[name] = value
        if line is None:
            raise ValueError("an archive ends within a record's header")
        size, block = int(fields["Content-Length"]), []
        have = -2
        while have < size:
            if (line := next(lines, None)) is None:
                raise ValueError("an archive ends within a record")
            block.append(line)
            have += len(line) + 2
        if have > size:
            raise ValueError(f"{fields['WARC-Record-ID']}: the block is longer than its Content-Length")
        yield fields, b"\r\n".join(block)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to (the page_id of a revisit's original), payload
    (null for a revisit)."""
    return resolve(records(spark, path, id_type=id_type))


def records(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "long") -> DataFrame:
    lines = (spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.gz").text(path)
             .select(F.col("value").cast("binary").alias("line")))

    def row(fields: dict, block: bytes) -> dict:
        page = fields.get("X-Page-ID")
        out = {"page_id": unquote(page) if page is not None else None, "url": fields.get("WARC-Target-URI"),
               "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
               "refers_to_id": fields.get("WARC-Refers-To"), "payload": None, "payload_bytes": None,
               "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
        if out["record_type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
            if payload_digest(payload) != out["payload_digest"]:
                raise ValueError(f"{out['record_id']}: the payload doesn't have its digest")
            out |= {"payload": payload if payloads else None, "payload_bytes": len(payload)}
        return out

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_id", pa.string()),
                        ("record_type", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def task(batches):
        held, size = [], 0
        for fields, block in parse(line.as_py() for batch in batches for line in batch.column(0)):
            held.append(row(fields, block))
            size += len(block) if payloads else 0
            if len(held) == 500 or size > READ_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    return (lines.mapInArrow(released(task), "page_id string, url string, record_id string, record_type string, "
                                             "refers_to_id string, payload binary, payload_bytes long, payload_digest string")
            .withColumn("page_id", F.col("page_id").cast(id_type)))


def resolve(found: DataFrame) -> DataFrame:
    """Revisit records joined to their original responses; responses, which
    refer to nothing, pass by the join."""
    response = F.col("record_type") == "response"
    originals = (found.where(response).groupBy("record_id")
                 .agg(F.min("page_id").alias("original"), F.min("payload_bytes").alias("original_bytes"),
                      F.min("payload_digest").alias("original_digest")))
    r, o = found.where(~response).alias("r"), originals.alias("o")
    revisits = (r.join(o, F.col("r.refers_to_id") == F.col("o.record_id"), "left")
                .select("r.page_id", "r.url", F.col("o.original_bytes").alias("payload_bytes"),
                        F.coalesce("o.original_digest", "r.payload_digest").alias("payload_digest"),
                        "r.record_type", F.col("o.original").alias("refers_to"), "r.payload"))
    plain = found.where(response).select("page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                         F.lit(None).cast(found.schema["page_id"].dataType).alias("refers_to"), "payload")
    return plain.unionByName(revisits)


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the pages' archives and reads their headers back, once."""
    path = write(pages, path or scratch_path(spark, "warc"), **options)
    id_type = pages.select(named(options.get("id_col", "page_id"))).schema[0].dataType.simpleString()
    return resolve(stored(records(spark, path, payloads=False, id_type=id_type), "warc-read")).drop("payload")
