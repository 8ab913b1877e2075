"""WARC archives with a two-level capture index.

Pages become gzip-compressed WARC records, one member each, in archives that are kept in segments of about 4 MB (the
segments of an archive in order are its file; ``export_archive`` puts them together). Every capture gets an index line
under its reversed-host URL key. Lines are sorted, cut into compressed blocks, and a sparse directory holds the first
key of each block: a lookup bisects the directory, reads one block, bisects that, and reads a byte range of a segment.

Defined cases: a null html is an empty payload; a null or unparsable url has the key of its raw text (null: empty);
payloads under 100 bytes are always responses; of equal longer payloads every row with the smallest ``page_id`` is a
response (so exact row repeats stay responses) and the rest revisit it; a null ``page_id`` never counts as smallest
unless all are null; an empty table gives empty archives; columns besides ``page_id, url, html`` are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import common

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
_SEGMENT_BYTES, _SEGMENT_RECORDS = 4 << 20, 2000
_BLOCK_LINES = 1000


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.example/x`` becomes ``example,a)/x``."""
    raw = url or ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", raw)
    if not m:
        key = raw
    else:
        host = re.sub(r"^www\d*\.", "", m[1].lower().rstrip("."))
        port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
        key = f"{','.join(reversed(host.split('.')))}{port}){m[3] if m[3].startswith('/') else '/' + m[3]}".lower()
    return re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02x}", key)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, size: int | None = None) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head, with the payload's ``size``, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = re.sub(r"[\r\n]", "", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>")
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _number(urn: str | None) -> int | None:
    inside = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if re.fullmatch(r"-?\d+", inside) else None


def parse(member: bytes) -> dict:
    """Headers, payload facts and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    return {
        "page_id": _number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI", ""),
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("WARC-Refers-To")) if revisit else None,
    }


def typed(pages: DataFrame) -> DataFrame:
    """Pages with digest, record type and the page that a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    # the search for copies sees ids and digests only; a revisit record holds no payload, so payloads of copies go nowhere
    large = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes"))
    first = common.settle(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-copied")
    copies = common.settle(large.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))), "warc-revisits")
    done = copies.select(F.col("page_id").alias("done_id"), F.col("digest").alias("done_digest")).distinct()
    # by page and digest: a key that a page, not a payload, has
    rest = facts.join(done, F.col("page_id").eqNullSafe(F.col("done_id")) & (F.col("digest") == F.col("done_digest")), "left_anti")
    responses = rest.select("page_id", "url", "html", "digest", F.octet_length("html").alias("bytes"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    return responses.unionByName(copies.select("page_id", "url", F.lit("").alias("html"), "digest", "bytes", F.col("first").cast("long").alias("refers_to"), F.lit(True).alias("revisit")))


_CAPTURES = "array<struct<key:string,page_id:bigint,offset:bigint,length:bigint>>"


def _write(date: str):
    shape = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segment = f"archive-{TaskContext.get().partitionId():06d}", 0
        held: list[bytes] = []
        captures: list[dict] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, held, captures, size
            row = pa.RecordBatch.from_arrays(
                [pa.array([archive]), pa.array([segment], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([captures], shape)], ["archive", "segment", "content", "captures"]
            )
            segment, held, captures, size = segment + 1, [], [], 0
            return row

        for rows in batches:
            for i in range(0, rows.num_rows, 256):
                for r in rows.slice(i, 256).to_pylist():
                    member = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["revisit"], date, r["bytes"])
                    captures.append({"key": url_key(r["url"]), "page_id": r["page_id"], "offset": size, "length": len(member)})
                    held.append(member)
                    size += len(member)
                    if size >= _SEGMENT_BYTES or len(held) >= _SEGMENT_RECORDS:
                        yield close()
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; the table ``archive, segment, content, captures``, read back from the shared folder."""
    return common.settle(typed(pages).mapInArrow(_write(date), f"archive string, segment int, content binary, captures {_CAPTURES}"), "warc")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block = TaskContext.get().partitionId(), 0
    lines: list[str] = []

    def close() -> pa.RecordBatch:
        nonlocal block, lines
        keys = [x.split(" ", 1)[0] for x in (lines[0], lines[-1])]
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([keys[0]]), pa.array([keys[1]]), pa.array([len(lines)], pa.int64()), pa.array([zlib.compress("\n".join(lines).encode())], pa.binary())],
            ["part", "block", "first_key", "last_key", "n", "lines"],
        )
        block, lines = block + 1, []
        return row

    for rows in batches:
        for r in rows.to_pylist():
            lines.append(f"{r['key']} {'-' if r['page_id'] is None else r['page_id']} {r['archive']} {r['segment']} {r['offset']} {r['length']}")
            if len(lines) >= _BLOCK_LINES:
                yield close()
    if lines:
        yield close()


def build_index(archives: DataFrame) -> DataFrame:
    """Sorted, compressed blocks of capture lines with their first and last keys; read back from the shared folder.

    Without ``lines`` the same table is the sparse directory. Range partitioning also uses the position of a capture,
    so a very common URL or host spreads over partitions.
    """
    captures = archives.select("archive", "segment", F.explode("captures").alias("c")).select("c.*", "archive", "segment")
    order = ["key", "page_id", "archive", "segment", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.settle(ranged.mapInArrow(_blocks, "part int, block int, first_key string, last_key string, n long, lines binary"), "capture-index")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for blob in rows.column(0):
            cells = [x.split(" ") for x in zlib.decompress(blob.as_py()).decode().split("\n")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[2] for c in cells]), pa.array([int(c[3]) for c in cells], pa.int32()), pa.array([int(c[4]) for c in cells], pa.int64()), pa.array([int(c[5]) for c in cells], pa.int64())],
                ["archive", "segment", "offset", "length"],
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for content, ranges in zip(rows.column(0), rows.column(1), strict=True):
            data = memoryview(content.as_buffer())
            found = [parse(data[r["offset"] : r["offset"] + r["length"]]) for r in ranges.as_py()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f["page_id"] for f in found], pa.int64()),
                    pa.array([f["payload_bytes"] for f in found], pa.int64()),
                    pa.array([f["payload_digest"] for f in found], pa.string()),
                    pa.array([f["record_type"] for f in found], pa.string()),
                    pa.array([f["refers_to"] for f in found], pa.int64()),
                ],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def read_all(archives: DataFrame, index: DataFrame) -> DataFrame:
    """Every capture that the index lists, read by byte range from its segment.

    A segment has at most 2000 records, which bounds the list of ranges gathered for it.
    """
    entries = index.select("lines").mapInArrow(_entries, "archive string, segment int, offset long, length long")
    ranges = entries.groupBy("archive", "segment").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    placed = archives.select("archive", "segment", "content").join(ranges.hint("merge"), ["archive", "segment"]).select("content", "ranges")
    return placed.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(archives: DataFrame, index: DataFrame, urls: list[str]) -> list[dict]:
    """Captures of a bounded list of URLs, by bisection in the directory and range reads of segments.

    Three plans in all, however many captures there are: the directory rows whose keys span a wanted one, the blocks that
    the directory names, and the segments that those name, in which only the wanted ranges are read.
    """
    spark = index.sparkSession
    keys = sorted({url_key(u) for u in urls})
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    spans = index.select("part", "block", "first_key", "last_key").join(F.broadcast(wanted), (F.col("first_key") <= F.col("key")) & (F.col("key") <= F.col("last_key"))).select("part", "block").distinct()
    found = index.join(F.broadcast(spans), ["part", "block"]).select("lines").mapInArrow(_bisected(keys), "key string, archive string, segment int, offset long, length long")
    ranges = found.groupBy("archive", "segment").agg(F.collect_list(F.struct("key", "offset", "length")).alias("ranges"))
    placed = archives.select("archive", "segment", "content").join(ranges, ["archive", "segment"]).select("content", "ranges")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content, own in zip(rows.column(0), rows.column(1), strict=True):
                data = memoryview(content.as_buffer())
                for r in own.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([bytes(data[r["offset"] : r["offset"] + r["length"]])], pa.binary())], ["key", "member"])

    return sorted((parse(bytes(r["member"])) | {"key": r["key"]} for r in placed.mapInArrow(read, "key string, member binary").toLocalIterator()), key=lambda x: (x["key"], x["page_id"] is not None, x["page_id"] or 0))


def _bisected(keys: list[str]):
    """The captures of ``keys`` in blocks, each found by bisection of the block's sorted lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob in rows.column(0):
                lines = zlib.decompress(blob.as_py()).decode().split("\n")
                hits = []
                for key in keys:
                    i = bisect.bisect_left(lines, f"{key} ")
                    while i < len(lines) and lines[i].startswith(f"{key} "):
                        hits.append(lines[i].split(" "))
                        i += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string()), pa.array([int(h[3]) for h in hits], pa.int32()), pa.array([int(h[4]) for h in hits], pa.int64()), pa.array([int(h[5]) for h in hits], pa.int64())],
                    ["key", "archive", "segment", "offset", "length"],
                )

    return run


def export_archive(archives: DataFrame, archive: str, path: str) -> None:
    """Put the segments of one archive together as a ``.warc.gz`` file on a path that the driver can write."""
    with open(path, "wb") as f:
        for row in archives.where(F.col("archive") == archive).select("segment", "content").orderBy("segment").toLocalIterator():
            f.write(row["content"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(common.table(spark, sf_dir, "pages"))
    return read_all(archives, build_index(archives))


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.payload_digest IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
