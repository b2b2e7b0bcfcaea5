"""WARC archives: pages written as request, response or revisit, and metadata records, and captures put together again.

Spark's text writer lays the archives down (a record ends with an empty line twice, which is its line separator), so
they go wherever Spark can write; they are read as whole files and walked record by record by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a file, about, and records at most.
FILE_BYTES, FILE_RECORDS = 64 << 20, 30_000


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8: five hexadecimal digits make four letters."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*of: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *of))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


#: Copies of one row that are counted off at once.
COPIES = 100_000


def write_archives(pages: DataFrame, path: str) -> None:
    """Write for each row of pages (page_id, url, html) a request, a response or revisit, and a metadata record.

    The payload is the html in UTF-8, null as empty. Of equal payloads, empty ones included, those of the smallest page_id
    are responses, the others are revisits of the first of these, which have headers only; rows without page_id come
    after all others, and where no row has one the first is the response. Record ids follow from page_id, url, html and a
    running number among rows that repeat all three, so each row writes records of its own. Line breaks in a url are
    percent-encoded; a null url is empty. An empty table writes none.

    Rows are counted by page, url and digests of their html before anything is shuffled; of the html itself only one for
    each digest and map task is, so a payload that many pages share travels no oftener than that.

    A file holds as many records as make FILE_BYTES at the table's mean size of a page; pages are dealt by hashes of
    their payloads, so large ones spread over files. Each file is one gzip member, as Spark's text writer makes it.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long") + 1000).alias("bytes")).first()
    per_file = min(FILE_RECORDS, max(3, 3 * FILE_BYTES * size["n"] // (size["bytes"] or 1)))
    keyed = rows.withColumns({"sha1": base32_sha1(F.col("html")), "sha256": F.sha2("html", 256), "bytes": F.octet_length("html")})
    bodies = keyed.groupBy("sha256").agg(F.first("html").alias("html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    own = _uuid(F.lit("response"), page, F.col("url"), F.col("sha256"))
    some = keyed.groupBy("page_id", "url", "sha1", "sha256", "bytes").agg(F.count("*").alias("n")).withColumn("own", own)
    order = F.struct(F.col("page_id").isNull(), "page_id", "own")
    first = some.groupBy("sha1", "sha256").agg(F.min(F.struct(order.alias("order"), "page_id", "own", "url")).alias("first"), F.max("bytes").alias("bytes"))
    # One more key than the groups have makes both sides of the join exchange their rows, so that the adaptive skew join
    # can split a payload many pages share.
    found = some.join(first, ["sha1", "sha256", "bytes"])
    starts, least = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")), F.least(F.col("low") + COPIES, F.col("n")) - 1
    each = found.withColumn("low", F.explode(starts)).withColumn("copy", F.explode(F.sequence("low", least)))
    number = lambda of, k: _uuid(of, k.cast("string"))
    each = each.select("page_id", "url", "sha1", "sha256", "bytes", number(F.col("own"), F.col("copy")).alias("id"), number(F.col("first.own"), F.lit(0)).alias("first_id"), F.col("first.url").alias("first_url"), F.coalesce(F.col("page_id") == F.col("first.page_id"), F.lit(False)).alias("least"))
    answers = each.withColumn("answer", F.col("least") | (F.col("id") == F.col("first_id")))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    kind = lambda name: ("WARC-Type", F.lit(name))
    other = lambda name: ("WARC-Record-ID", _uuid(F.lit(name), F.col("id")))
    beside = ("WARC-Concurrent-To", F.col("id"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    answer = [("WARC-Record-ID", F.col("id")), *common, digest, ("Content-Type", F.lit("application/http;msgtype=response"))]
    revisit = [kind("revisit"), ("WARC-Refers-To", F.col("first_id")), ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Profile", F.lit(SAME_PAYLOAD)), *answer]
    request = _record([kind("request"), other("request"), *common, beside, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1"), F.lit(END)))
    metadata = _record([kind("metadata"), other("metadata"), *common, beside, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), page, F.lit("\r\n")))
    whole = answers.where("answer").join(bodies, "sha256").select(F.array(request, _record([kind("response"), *answer], F.concat(http, F.col("html"))), metadata).alias("r"))
    again = answers.where("not answer").select(F.array(request, _record(revisit, http), metadata).alias("r"))
    whole.unionByName(again).select(F.explode("r").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


RECORD = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, claimed_digest string, content_type string, block_bytes long, payload_bytes long, payload_digest string, fields map<string,string>"


def _walk(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends within a record")
        yield head, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below path, gzipped or not; with their payloads, or with only these' lengths and digests.

    payload_bytes and payload_digest are worked out from the bytes that are there: of HTTP records the part after the
    headers, else the whole block; null for revisits, which have none. fields: those of a block of application/warc-fields.
    """
    schema = RECORD + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "claimed_digest", "content_type"), ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest", "content-type")]
        arrow = pa.schema([*((n, pa.string()) for n in kinds[0]), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), *([("payload", pa.binary())] if payloads else [])])
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for head, block in _walk(io.BufferedReader(stream, 1 << 16)):
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    has = head.get("warc-type") != "revisit"
                    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line] if head.get("content-type") == "application/warc-fields" else None
                    row = [head.get(k) for k in kinds[1]]
                    row += [len(block), len(payload) if has else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if has else None, fields]
                    rows.append(row + [payload] * payloads)
                    held += len(block)
                    if held > 1 << 22 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata).

    response is the response or revisit record; request and metadata are those that name it in WARC-Concurrent-To, null
    where there is none. Records that repeat an id count once; of several requests (or metadata records) of one capture
    that of the smallest id counts. Records that belong to no capture are left out. An empty table gives an empty one.
    """
    columns = [c for c in records.columns if c != "fields"]
    whole = F.struct(*columns, "fields")
    answers = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull()).dropDuplicates(["record_id"]).select("record_id", whole.alias("response"))
    out = answers
    for kind in ("request", "metadata"):
        mine = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(whole, F.coalesce("record_id", F.lit(""))).alias(kind))
        out = out.join(mine, "record_id", "left")
    return out


def resolve_revisits(found: DataFrame) -> DataFrame:
    """captures with a struct `original` for revisits: record id, metadata and payload length and digest of the response they refer to.

    The response's own digest must be the one the revisit claims; else original is null.
    """
    digest = F.concat(F.lit("sha1:"), F.col("response.payload_digest"))
    originals = found.where("response.type = 'response'").select(F.col("record_id").alias("refers_to"), digest.alias("claimed"), F.struct("record_id", "metadata", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("original"))
    keyed = found.withColumns({"refers_to": F.when(F.col("response.type") == "revisit", F.col("response.refers_to")), "claimed": F.col("response.claimed_digest")})
    return keyed.join(originals, ["refers_to", "claimed"], "left").drop("refers_to", "claimed")
