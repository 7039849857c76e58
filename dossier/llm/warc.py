"""WARC archives: written one gzip member per record, read sequentially.

Writing: of records with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest page_id is a response and
the others are revisits that name it; a row that repeats both page_id and payload of a response is a response
too. Each task writes its archives to the shared folder under a name of its own attempt and returns what it wrote; only archives
that a finished task returned are read, so a task that was lost and ran again leaves no double records.

Reading: bytes come in blocks through an incremental decompressor; a member is one record; the
block is framed by Content-Length; block and payload digests are verified. Damaged archives raise ValueError.

A null html is an empty payload, a null url has no target header, a null page_id no id header (such a record can
be a revisit, or a response that none revisits). Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import query, shared_folder, table, written

LEAST_REVISIT = 100
ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 20
LEVEL = 1
WRITTEN_AT = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
           "digest_ok boolean, payload binary")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors reach."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, first: int | None) -> bytes:
    """The text of one record; `first` is the page it revisits, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {WRITTEN_AT}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", "") + "%"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{payload_digest}", f"WARC-Block-Digest: sha256:{digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed; never more than a block of the rest is held."""
    data, open_member, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                break
        if open_member is None:
            open_member, parts = zlib.decompressobj(wbits=31), []
        parts.append(open_member.decompress(data))
        data = open_member.unused_data
        if open_member.eof:
            yield b"".join(parts)
            open_member = None
    if open_member is not None:
        raise ValueError("archive ends within a record")


def parse(member: bytes) -> dict:
    """One record: its headers (lower-case names) and its block, framed by Content-Length."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("record without a WARC header")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("record whose length differs from its Content-Length")
    block = rest[:length]
    return headers | {"block": block, "payload": block.partition(b"\r\n\r\n")[2]}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html as archives below the folder; returns path, records, bytes of each archive."""
    hashed = pages.select("page_id", "url", "html").select(
        "page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    first = (hashed.where(F.col("size") >= LEAST_REVISIT).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = hashed.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("first"))

    def run(batches):
        disk, root = store(folder)
        disk.create_dir(root, recursive=True)
        task, done, out, n, size, path = TaskContext.get().partitionId(), [], None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, sha, revisits in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    path = f"{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = disk.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                text = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), sha.as_py(), revisits.as_py())
                member = pack.compress(text) + pack.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records bigint, bytes bigint")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives; payloads=False leaves the bytes out of the rows."""

    def rows(path: str, disk, root: str):
        with disk.open_input_stream(f"{root}/{path}", compression=None) as stream:
            for member in members(stream):
                r = parse(member)
                payload, claimed = r["payload"], r.get("warc-payload-digest", "").removeprefix("sha256:")
                revisit = r["warc-type"] == "revisit"
                actual = claimed if revisit else digest(payload)
                ok = actual == claimed and r.get("warc-block-digest", "") == f"sha256:{digest(r['block'])}"
                refers = r.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                yield (int(r["x-page-id"]) if "x-page-id" in r else None, r.get("warc-target-uri"), r["warc-type"],
                       int(refers) if revisit else None, None if revisit else len(payload), actual, ok,
                       payload if payloads and not revisit else None)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches):
        disk, root = store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path, disk, root):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits get the payload size of the response they name; a revisit without its response raises."""
    narrow = written(records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok"), "warc-records")
    responses = (narrow.where("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("sha"))
                 .agg(F.max("payload_bytes").alias("size")))
    joined = narrow.join(responses, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("sha")), "left")
    size = F.coalesce("payload_bytes", "size")
    sound = F.when(F.col("digest_ok") & size.isNotNull(), size).otherwise(
        F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return joined.select("page_id", sound.cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


@query("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY sha HAVING count(*) > 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha AS payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id <> first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (sha)""")
def op2_warc(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    archives = written(write_archives(table(spark, sf_dir, "pages"), folder), "warc-archives")
    return resolved(read_archives(archives, folder, payloads=False))
