"""WARC archives: write, index, and read back selected records.

Writing: every task streams its rows into one ``.warc.gz`` (one gzip member per
record) and hands back an index row per record: file, offset, length, URL,
payload digest, type.  The index is a Parquet table that Spark commits; a file
left over from a lost or repeated task is in no index row and so does not exist
for readers.

Reading starts from the index alone.  The selected records are dealt out by file
and ``CHUNK`` of offset, sorted, neighbours are joined to one ranged read while
the gap is small, and every record is cut out of its range.

Equal payloads of ``min_bytes`` or more are stored once: the record with the
largest id is the ``response``, the others are ``revisit`` records that name it.
The join that tells them uses only (digest, id) aggregates, so a payload that a
third of the pages share is folded together before the shuffle.

Edge cases: a null payload is empty; payloads below ``min_bytes`` are always
responses; rows that tie for the largest id are all responses; a null id counts
as smaller than every other; a null URL is an empty header; control characters
and blanks in URLs are percent-encoded in the header and whole in the index; a
very long payload is one record, held whole by its task; an empty table writes no
archive and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import math
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casediff.session import scratch_path

from .common import table

MIN_BYTES = 1000
#: Offsets dealt out together, the largest gap that is read over, and the largest single read.
CHUNK, GAP, READ = 8 << 20, 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
RECORD = ("page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, "
          "refers_to bigint, payload binary")


def _filesystem(path: str):
    """A pyarrow file system and the path in it; a bare path is local."""
    from pyarrow import fs
    if "://" in path or re.match(r"[a-z]\w+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: bytes):
    digits = record_id.strip()[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _uri(url) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())


def build_record(page_id, url, digest: str, n_bytes: int, payload: bytes | None, refers_to) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes a revisit that names ``refers_to``."""
    sha = base64.b32encode(bytes.fromhex(digest))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if payload is None else b"response"),
            b"WARC-Record-ID: " + _record_id(page_id).encode(), b"WARC-Date: " + DATE.encode(),
            b"WARC-Target-URI: " + _uri(url), b"WARC-Payload-Digest: sha1:" + sha,
            b"Content-Type: application/http; msgtype=response"]
    if payload is None:
        head += [b"WARC-Refers-To: " + _record_id(refers_to).encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http + (payload or b"")
    head.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ``payload`` is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    body = rest[:int(fields[b"Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    kind = fields[b"WARC-Type"].decode()
    return {
        "page_id": _page_id(fields[b"WARC-Record-ID"]), "url": fields[b"WARC-Target-URI"].decode(),
        "record_type": kind, "payload_bytes": size,
        "payload_digest": base64.b32decode(fields[b"WARC-Payload-Digest"].partition(b":")[2]).hex(),
        "refers_to": _page_id(fields[b"WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": None if kind == "revisit" else payload}


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row tuples of a batch, without a Python copy of the whole batch."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url: str = "url",
                 html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``bytes``, ``refers_to`` (null: response)."""
    payload: Column = F.coalesce(F.col(html).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("bigint")})
    copies = (p.where(F.col("bytes") >= min_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("digest").alias("d"), "first"))
    j = p.join(copies, (p.digest == copies.d) & (p.bytes >= min_bytes), "left")
    return j.select("page_id", "url", "payload", "digest", "bytes",
                    F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """Write the planned records below ``root`` and return the committed index."""

    def write(batches):
        name = f"{root}/archive/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = _filesystem(name)
        out, at = None, 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, n_bytes, refers_to in _rows(batch):
                if out is None:
                    system.create_dir(posixpath.dirname(path), recursive=True)
                    out = system.open_output_stream(path, compression=None)
                raw = gzip.compress(build_record(
                    page_id, url, digest, n_bytes, payload.encode() if refers_to is None else None, refers_to), 6)
                out.write(raw)
                index.append((name, at, len(raw), url, digest, "response" if refers_to is None else "revisit", page_id))
                at += len(raw)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (
                    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()),
                    strict=True)], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        if out is not None:
            out.close()

    spark = records.sparkSession
    records.select("page_id", "url", "payload", "digest", "bytes", "refers_to").mapInArrow(
        write, INDEX).write.parquet(f"{root}/index")
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_records(index: DataFrame, gap: int = GAP, most: int = READ, chunk: int = CHUNK) -> DataFrame:
    """The records of the index rows, by joined ranged reads."""

    def ranges(rows):
        run = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > gap
                        or row[1] + row[2] - run[0][1] > most):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches):
        opened, source = None, None
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                  ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                  ("payload", pa.binary())]
        for batch in batches:
            for run in ranges(_rows(batch)):
                if run[0][0] != opened:
                    if source is not None:
                        source.close()
                    opened = run[0][0]
                    system, path = _filesystem(opened)
                    source = system.open_input_file(path)
                start = run[0][1]
                data = source.read_at(max(r[1] + r[2] for r in run) - start, start)
                found = [parse_record(gzip.decompress(data[r[1] - start:r[1] - start + r[2]])) for r in run]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[n] for f in found], t) for n, t in fields], names=[n for n, _ in fields])
        if source is not None:
            source.close()

    # as many tasks as the archives have chunks; the index alone is too small for Spark to tell
    size = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartition(
        max(1, math.ceil(size / chunk)), F.col("file"), F.floor(F.col("offset") / chunk)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, RECORD)


def archive(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Plan and write the archives of ``pages`` below ``root``; the index."""
    return write_archives(plan_records(pages, min_bytes), root)


def select(index: DataFrame, condition: Column) -> DataFrame:
    """Read back the records whose index row fits ``condition``."""
    return read_records(index.where(condition))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    r = read_records(index)
    # what the archive holds is measured anew for responses; a revisit has its headers alone
    whole = F.col("payload").isNotNull()
    return r.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d FROM p),
m AS (SELECT d, max(page_id) AS first FROM q WHERE n >= {MIN_BYTES} GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN m USING (d)"""
