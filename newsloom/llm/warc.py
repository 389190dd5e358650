"""WARC archives as a chunked record table.

A record with a large payload is written as segments (first record and continuations, as the WARC
standard has them), so that writer, reader and digest hold one chunk at a time, never a whole record.
Archives are written and read by Spark's own text source and therefore in any store that Spark knows.
No chunk contains the version line that starts a record or ends like one: payloads are cut inside each
such place, and a URL has the slash of the version written as ``%2F``.  So the version line separates
records without ambiguity.  Payloads move once, to meet their place in the plan of revisits; they are
hashed again while an archive is read from its beginning to its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import kept_table, pieces, ready, views
from newsloom.session import scratch_path

# fixed values of the format
VERSION = "WARC/1.1\r\n"
HEAD_END = re.compile(rb"\r\n\r\n")
CHUNK_BYTES = 1 << 18
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, by eight groups of twenty bits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _name(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("None"))


def revisit_plan(pages: DataFrame, min_bytes: int = 0, id_col="page_id", payload_col="html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page.

    Of equal payloads of at least ``min_bytes`` the largest id is the response.  The groups are found by
    aggregates with map-side combine on digest and size; only these small rows are shuffled.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    sized = kept_table(sized, "payloads")
    last = sized.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") < F.col("last_id"))
    return sized.join(last, ["payload_digest", "payload_bytes"]).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("last_id")).alias("refers_to"),
    )


MARKER = re.compile(re.escape(VERSION.encode()))
OPEN_MARKER = VERSION.rstrip().encode()


def _cut(payload: memoryview, chunk_bytes: int) -> Iterator[memoryview]:
    """Chunks of at most ``chunk_bytes``, whole characters each, without a version line inside or begun at the end."""
    at = 0
    while at < len(payload):
        end = min(len(payload), at + chunk_bytes)
        while end < len(payload) and end > at + 4 and payload[end] & 0xC0 == 0x80:
            end -= 1
        marker = MARKER.search(payload, at, end)
        if marker:
            end = marker.start() + 4
        elif payload[at:end][-len(OPEN_MARKER) :] == OPEN_MARKER:
            end -= 4
        yield payload[at:end]
        at = end


def _record_kernel(chunk_bytes: int):
    """Text of the archive records of a page, one row per segment, with the digest carried along."""

    def block(lines: list[str], body: bytes, size: int) -> bytes:
        # the text source adds the last line feed
        head = VERSION + "\r\n".join([*lines, f"Content-Length: {size}"]) + "\r\n\r\n"
        return b"".join([head.encode(), body, b"\r\n\r"])

    def records(page_id, url, payload, digest, n_bytes, kind, refers_to) -> Iterator[bytes]:
        # id and payload name a record; the number of the page comes first
        name = f"<urn:page:{page_id}:{digest}>"
        common = [f"WARC-Target-URI: {url}"] if url else []
        if kind == "revisit":
            yield block(
                [
                    "WARC-Type: revisit", f"WARC-Record-ID: {name}", *common,
                    f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"WARC-Payload-Digest: sha1:{digest}",
                    f"X-Payload-Length: {n_bytes}", "WARC-Segment-Number: 1",
                ],
                b"", 0,
            )
            return
        number, sha = 0, hashlib.sha1()
        parts = _cut(payload, chunk_bytes)
        chunk = next(parts, memoryview(b""))
        while chunk is not None:
            number += 1
            following = next(parts, None)
            sha.update(chunk)
            head = [
                f"WARC-Type: {'response' if number == 1 else 'continuation'}",
                f"WARC-Record-ID: {name if number == 1 else f'<urn:page:{page_id}:{digest}:{number}>'}",
                *([f"WARC-Segment-Origin-ID: {name}"] if number > 1 else common),
                f"WARC-Segment-Number: {number}",
            ]
            if following is None:
                head.append(f"WARC-Segment-Total-Length: {n_bytes}")
                head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}")
            yield block(head, chunk, len(chunk))
            chunk = following

    def batch_of(rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows, held = [], 0
            small = zip(*(batch.column(c).to_pylist() for c in ("name", "url", "digest", "payload_bytes", "record_type", "refers_to")), strict=True)
            for (name, url, digest, n_bytes, kind, refers_to), payload in zip(small, views(batch.column("payload")), strict=True):
                # a header is one line
                line = "".join((url or "").split()).replace(OPEN_MARKER.decode(), OPEN_MARKER.decode().replace("/", "%2F"))
                for segment in records(name, line, payload, digest, n_bytes, kind, refers_to):
                    rows.append(segment)
                    held += len(segment)
                    if held > 1 << 23:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def write_archives(pages: DataFrame, path: str, min_bytes=0, chunk_bytes=CHUNK_BYTES, id_col="page_id", url_col="url", payload_col="html") -> None:
    """Writes one record per page (and its continuations) as gzip archives below ``path``.

    A null payload is written as an empty one, a null URL without its header; pages without id are named
    ``None``.  Rows that repeat id and payload have a record each.  Further columns are not written.
    """
    plan = revisit_plan(pages, min_bytes, id_col, payload_col).distinct()
    plan = plan.withColumn("name", _name(F.col("page_id"))).withColumnRenamed("payload_digest", "digest")
    body = ready(pages).select(
        _name(F.col(id_col).cast("long")).alias("name"),
        base32_sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).alias("digest"),
        F.col(url_col).alias("url"),
        F.col(payload_col).alias("payload"),
    )
    # dealt alike at every size: a page and its line of the plan have one key
    matched = body.join(plan.hint("shuffle_merge"), ["name", "digest"])
    needed = F.when(F.col("record_type") == "response", F.col("payload"))
    rows = matched.select("name", "url", needed.alias("payload"), "digest", "payload_bytes", "record_type", "refers_to")
    rows.mapInArrow(_record_kernel(chunk_bytes), "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per record segment: record_id, chunk_no, record_type, headers, content (bytes).

    The task that reads an archive holds one segment at a time.  A segment whose length differs from its
    header stops the job: an archive in which a payload holds the version line is not read wrongly.
    """
    # the first piece of a file is empty
    raw = spark.read.option("lineSep", VERSION).text(path).where("length(value) > 0")
    return raw.mapInArrow(
        _parse_kernel,
        "record_id string, chunk_no int, record_type string, refers_to string, target_uri string, "
        "payload_digest string, total_bytes long, content binary",
    )


def _parse_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "chunk_no", "record_type", "refers_to", "target_uri", "payload_digest", "total_bytes", "content"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in pieces(batches, 64):
        rows = []
        for raw in views(batch.column(0)):
            ends = HEAD_END.search(raw)
            fields = dict(line.split(": ", 1) for line in bytes(raw[: ends.start()]).decode().split("\r\n") if ": " in line)
            size, rest = int(fields["Content-Length"]), raw[ends.end() :]
            if bytes(rest[size:]).strip(b"\r\n"):
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is longer than its Content-Length")
            if len(rest) < size:
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is shorter than its Content-Length")
            total = fields.get("WARC-Segment-Total-Length", fields.get("X-Payload-Length"))
            rows.append(
                (
                    fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
                    int(fields.get("WARC-Segment-Number", 1)),
                    fields["WARC-Type"],
                    fields.get("WARC-Refers-To"),
                    fields.get("WARC-Target-URI"),
                    fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                    int(total) if total is not None else None,
                    bytes(rest[:size]),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def record_digests(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest) of every record.

    ``chunks`` come straight from ``read_chunks``: an archive is one split, in which continuations follow
    their record, so the digest is updated chunk by chunk and nothing is shuffled.
    """
    columns = ["record_id", "chunk_no", "record_type", "refers_to", "payload_digest", "total_bytes", "content"]
    return chunks.select(*columns).mapInArrow(
        _digest_kernel,
        "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string",
    )


def _digest_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    now, last, sha, size, told = None, 0, None, 0, None

    def closed():
        record_id, kind, refers_to = now
        if kind == "revisit":
            return (record_id, kind, refers_to, told[1], told[0])
        digest = base64.b32encode(sha.digest()).decode()
        if told != (digest, size):
            raise ValueError(f"record {record_id}: digest {digest} and {size} bytes, but the archive says {told}")
        return (record_id, kind, refers_to, size, digest)

    for batch in batches:
        rows = []
        heads = zip(*(batch.column(i).to_pylist() for i in range(6)), views(batch.column(6)), strict=True)
        for record_id, number, kind, refers_to, digest, total, content in heads:
            if number == 1:
                if now is not None:
                    rows.append(closed())
                now, sha, size = (record_id, kind, refers_to), hashlib.sha1(), 0
            elif now is None or record_id != now[0] or number != last + 1:
                raise ValueError(f"segment {number} of record {record_id} does not follow the one before")
            last = number
            sha.update(content)
            size += len(content)
            told = (digest, total)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types, strict=True)], names)


def page_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+):", 1).try_cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes all pages, reads the archives back and says per page what was found there.

    A revisit has size and digest of the payload it refers to.  Rows that repeat id and payload
    come back as often; a page without id comes back without id; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_archives(pages, path, min_bytes, chunk_bytes)
    return record_digests(read_chunks(spark, path)).select(
        page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number(F.col("refers_to")).alias("refers_to"),
    )
