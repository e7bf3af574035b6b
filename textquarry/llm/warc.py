"""Operator 10: WARC archives with a splittable reader.

Writing: each task writes gzip archives of one member per record into the shared
folder; a record whose payload equals that of a larger page is a revisit of it.
Reading: archives are cut into byte ranges; a task looks for gzip magic in its
range, proves a candidate by decoding the header it would open, and owns the
records that begin in its range, the last of which may end beyond it. Members follow
one another without a gap, so from a proven one on every next must open as one too,
also the first beyond the range: a damaged or cut archive raises :class:`WarcError`
instead of losing records.

Defined results: a null html is the empty payload; a null url is written as the
unknown URI; pages of equal payload all refer to the largest page_id, whose own
rows (repeated ones too) are responses; a null page_id is written as no number, read
back as null, and revisits a page of equal payload that has an id (else it is a
response); pages of any length are one record, taken whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, scratch_path, small_batches, unbound, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task reads, and of an archive before the next begins.
RANGE, ARCHIVE = 8 << 20, 64 << 20
#: Digests of payloads that occur more than once, as many as are broadcast (some 60 bytes each).
BROADCAST_ROWS = 1_000_000
#: Tasks up to which each range has one; beyond, up to so many ranges go to a task.
TASKS, RANGES = 4096, 64
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNKNOWN = "urn:unknown"


class WarcError(ValueError):
    """An archive that is damaged or cut."""


def _fs(uri: str):
    """File system and path of a URI (file, hdfs, s3, gs), in any worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else UNKNOWN
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, root: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under root; returns (path, bytes).

    Payloads of least_bytes or more are deduplicated. Digests of payloads that occur twice
    or more are broadcast to the pages while they are few; else pages meet them by digest.
    Files of tasks that failed or ran twice, which the table doesn't name, are deleted in the end.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    twice = (
        rows.where(F.octet_length(body) >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1 and largest is not null")
        .select("digest", "largest")
    )
    twice = written(twice, "warc-repeated")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    last = F.when((F.octet_length(body) >= least_bytes) & ~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))
    marked = rows.join(twice, "digest", "left").select("page_id", "url", "html", last.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, done = None, "", 0, []
        files, base = _fs(root)
        files.create_dir(base, recursive=True)

        def close() -> None:
            out.close()
            files.move(f"{base}/{path}.open", f"{base}/{path}")
            done.append((f"{root}/{path}", size))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                p, u, h, r = (x.as_py() for x in row)
                if out is None:
                    path, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{path}.open", compression=None)
                member = record(p, u, (h or "").encode(), r)
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "bytes"])
        give_back()

    listed = written(marked.mapInArrow(run, "path string, bytes long"), "warc-list")
    swept_root(root, {r.path.rpartition("/")[2] for r in listed.select("path").collect()})  # a name an archive
    return listed


def swept_root(root: str, kept: set[str]) -> list[str]:
    """Deletes the files of root that have other names; what it deleted."""
    from pyarrow import fs

    files, base = _fs(root)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    gone = sorted(f.path for f in found if f.is_file and f.base_name not in kept and ".warc.gz" in f.base_name)
    for path in gone:
        files.delete_file(path)
    return gone


def members(data: bytes, start: int, stop: int, more, whole: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that begin in [start, stop).

    data begins at offset start; more(offset, n) reads on, up to whole bytes in all.
    """

    def opened(at: int, head_only: bool = False) -> tuple[bytes, int] | None:
        """The record of the member at an offset, and where it ends; None if no record opens there."""
        nonlocal data
        z, body, feed, seen, proven = zlib.decompressobj(31), [], at - start, b"", False
        try:
            while not z.eof:
                chunk = data[feed : feed + 65536]
                if not chunk:
                    extra = more(start + len(data), 1 << 20) if start + len(data) < whole else b""
                    if not extra:
                        break
                    data += extra
                    continue
                feed += len(chunk)
                body.append(z.decompress(chunk))
                if not proven:
                    seen += body[-1][:5]
                    if not seen.startswith(b"WARC/"[: len(seen[:5])]):
                        return None
                    proven = len(seen) >= 5
                    if proven and head_only:
                        return b"", at
        except zlib.error as e:
            if proven:
                raise WarcError(f"damaged record at byte {at}: {e}") from e
            return None
        if proven and not z.eof:
            raise WarcError(f"cut record at byte {at}")
        return (b"".join(body), start + feed - len(z.unused_data)) if proven else None

    at, sure = start, start == 0
    while at < stop:
        if not sure:
            found = data.find(MAGIC, at - start)
            if found < 0 or start + found >= stop:
                return
            at = start + found
        got = opened(at)
        if got is None:
            if sure:
                raise WarcError(f"no record at byte {at}")
            at += 1  # magic by chance inside of a member
            continue
        yield at, got[0]
        at, sure = got[1], True
    if sure and at < whole and opened(at, True) is None:
        raise WarcError(f"no record at byte {at}")


def parse(raw: bytes) -> dict:
    """Head fields (lower case) of a record, with its HTTP head's length and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().lower()] = v.strip().decode()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_length": told}


def _number(urn: str | None) -> int | None:
    own = (urn or "").strip("<>").rpartition(":")[2]
    return int(own) if own else None


#: Columns of records that are read.
_READ = {
    "page_id": pa.int64(), "url": pa.string(), "payload": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "path": pa.string(), "offset": pa.int64(),
}


def read(archives: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of archives (path, bytes): page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to, with path and offset."""
    ranges = archives.where("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))))
    n = max(1, ranges.count())
    ranges = ranges.repartition(n if n <= TASKS else max(TASKS, n // RANGES)) if n > 1 else ranges

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _READ.values(), strict=True)], names=list(_READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, whole, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                files, name = _fs(path)
                with files.open_input_file(name) as f:

                    def more(offset: int, n: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(n)

                    stop, rows, held = min(start + range_bytes, whole), [], 0
                    for at, raw in members(more(start, stop - start + 2), start, stop, more, whole):
                        x = parse(raw)
                        told = x["warc-payload-digest"][5:]
                        response = x["warc-type"] == "response"
                        if response and payload_digest(x["payload"]) != told:
                            raise WarcError(f"the digest of the record at byte {at} of {path} differs")
                        rows.append((_number(x["warc-record-id"]), x["warc-target-uri"], x["payload"].decode() if response else None, x["payload_length"], told, x["warc-type"], _number(x.get("warc-refers-to")), path, at))
                        held += len(raw)
                        if held >= 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)
        give_back()

    return ranges.mapInArrow(run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write(pages, scratch_path(spark, "warc"))
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP10_SQL = f"""
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM d),
g AS (SELECT hex, max(page_id) AS largest FROM h GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM h JOIN g USING (hex)
"""
