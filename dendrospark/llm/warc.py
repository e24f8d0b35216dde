"""WARC archives with revisit resolution (operator 9).

Headers (ids and digests, no payloads) are shuffled by payload digest to find the record that keeps the
payload; the others become revisits that point to it. Tasks write their records to archives of bounded size where the rows
lie, each record with fresh headers and as a gzip member of its own, so that readers can seek to it by the index that writing gives. Reading parses
files as streams by Content-Length and joins revisits to the responses they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import BROADCAST_ROWS, mapped, scratch, small, table, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_of_hex(digest: Column, n: int = 40) -> Column:
    """Upper-case base32 of ``n`` hex digits, five digits to four letters."""
    letters = F.lit(BASE32)
    out = []
    for at in range(1, n + 1, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def urn(*parts: Column) -> Column:
    """A record id that follows from ``parts``."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolve(records: DataFrame, min_bytes: int = 0, few: int | None = None) -> DataFrame:
    """``records`` (page_id, url, html) with payload, digest, payload_bytes and, for a revisit, ``original``: the page it refers to.

    Of equal payloads of ``min_bytes`` or more, the largest page_id is the response; its
    repeated rows are all responses. Null ids come before all others; a group of null ids
    alone has only responses. A null html is the empty payload.

    Digests met more than once are sent to every task where there are at most ``few``; beyond, they are joined with the headers, and
    what a row becomes is attached by page and digest, of which no value is frequent but for rows without an id.
    """
    few = BROADCAST_ROWS if few is None else few
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = records.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    headers = rows.select("page_id", "digest")
    again = headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 AND original IS NOT NULL")
    again = written(again.select("digest", "original"), "digests-met-again")
    if again.count() <= few:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:
        known = written(headers.distinct().join(again, "digest").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original"), "headers-met-again")
        rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.withColumn("original", F.when(revisit, F.col("original")))


def as_warc(resolved: DataFrame, date: Column) -> DataFrame:
    """One WARC record a row, as text, without the blank lines that close it, beside page_id, digest and record_id.

    Where ``original`` is given, a revisit of the record ``refers_id``; such rows need no payload.
    """
    digest = base32_of_hex(F.col("digest"))
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        field("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        F.when(revisit, field("WARC-Refers-To", F.col("refers_id"))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return resolved.select("page_id", "digest", "record_id", F.concat(head, block).alias("value"))


#: Bytes that a file may have before compression; a longer record has a file of its own.
FILE_BYTES = 128 << 20


def _archived(records: DataFrame, path: str, kind: str, file_bytes: int) -> DataFrame:
    """Records (as ``as_warc`` gives them) as files ``kind``-...; their index, with page_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        context = TaskContext.get()
        store, top = fs.FileSystem.from_uri(path)
        out, name, at, size, made = None, "", 0, 0, 0

        def close() -> None:
            out.close()
            store.move(f"{top}/_{context.taskAttemptId()}-{name}", f"{top}/{name}")

        for pdf in batches:
            places = []
            for value in pdf["value"]:
                data = value.encode("utf-8", "surrogatepass") + b"\r\n" * 2
                if out is not None and size + len(data) > file_bytes:
                    close()
                    out = None
                if out is None:
                    name, at, size, made = f"{kind}-{context.partitionId():05d}-{made:05d}.warc.gz", 0, 0, made + 1
                    out = store.open_output_stream(f"{top}/_{context.taskAttemptId()}-{name}", compression=None)
                member = gzip.compress(data, 6)
                out.write(member)
                places.append((name, at, len(member)))
                at, size = at + len(member), size + len(data)
            yield pd.concat([pdf[["page_id", "record_id", "digest"]].reset_index(drop=True), pd.DataFrame(places, columns=["file", "offset", "length"])], axis=1)
        if out is not None:
            close()

    kinds = records.select("page_id").schema.add("record_id", "string").add("digest", "string").add("file", "string").add("offset", "long").add("length", "long")
    return written(mapped(records, run, kinds), "warc-index")


def write_warc(resolved: DataFrame, path: str, date: Column | None = None, file_bytes: int | None = None) -> DataFrame:
    """Archives under ``path`` (any store that pyarrow reaches); their index: page_id, record_id, digest, file, offset and length of each gzip member.

    Responses are written first; revisits, which need no payload, then refer to the ids that those got: each record has its own, repeated rows included. ``date``: when
    the records were made; now, if not given. A file gets its name when it is whole; a task that runs again writes the same files.
    """
    spark, file_bytes = resolved.sparkSession, file_bytes or FILE_BYTES
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    date = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if date is None else date
    own = lambda kind: urn(F.col("page_id"), F.col("digest"), F.lit(kind), F.monotonically_increasing_id())
    first = resolved.where("original IS NULL").withColumns({"record_id": own("response"), "refers_id": F.lit(None).cast("string")})
    first = _archived(as_warc(first, date), path, "response", file_bytes)
    revisits = resolved.where("original IS NOT NULL").drop("payload").withColumn("payload", F.lit(""))
    ids = first.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("original"), "digest").agg(F.min("record_id").alias("refers_id"))
    ids = written(ids.join(revisits.select("digest").distinct(), "digest", "left_semi"), "responses-met-again")
    revisits = revisits.join(small(ids), ["original", "digest"]).withColumn("record_id", own("revisit"))
    return first.unionByName(_archived(as_warc(revisits, date), path, "revisit", file_bytes))


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, one record in memory at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue  # the blank lines that close a record
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


HEADERS = (
    "record_id string, record_type string, page_id long, url string, digest string, refers_id string, "
    "payload_bytes long, body_digest string, http_bytes long"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records under ``path``, with length and digest of the payload found in each; no rows where there are no archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    http, _, body = block.partition(b"\r\n\r\n")
                    told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    page = h.get("x-page-id")
                    rows.append(
                        (
                            h["warc-record-id"],
                            h["warc-type"],
                            None if page is None else int(page),
                            h.get("warc-target-uri"),
                            h["warc-payload-digest"].removeprefix("sha1:"),
                            h.get("warc-refers-to"),
                            len(body),
                            base64.b32encode(hashlib.sha1(body).digest()).decode(),
                            int(told[0]) if told else None,
                        )
                    )
                names = [x.split()[0] for x in HEADERS.split(", ")]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "http_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return mapped(files.select("content"), run, HEADERS)


def resolved_headers(headers: DataFrame) -> DataFrame:
    """Each record with the payload of the response it is or refers to.

    A revisit whose response is missing keeps its own digest and has no payload length.
    """
    key = F.coalesce("refers_id", "record_id")
    responses = (
        headers.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("key"))
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"), F.max("body_digest").alias("full_digest"))
    )
    return headers.withColumn("key", key).join(responses, "key", "left").select(
        "page_id",
        "url",
        F.col("full_bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"),
    )


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a null html is the empty payload."""
    path, pages = scratch(spark, "warc"), table(spark, sf_dir, "pages")
    write_warc(resolve(pages), path)
    return resolved_headers(written(read_warc(spark, path), "warc-headers")).drop("url")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN NULL ELSE largest END AS refers_to
FROM r
"""

QUERIES = {"op9_warc_revisits": op9_warc_revisits}
ORACLE = {"op9_warc_revisits": SQL}
