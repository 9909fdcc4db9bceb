"""WARC archives: written with segments and revisits, read back, segments reassembled."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import small_batches, utf8
from storelens.session import stage, staging_root

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Bytes of records, before compression, after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that zlib is given at a time.
PIECE_BYTES = 16 << 10
#: Fixed values of the format.
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, origin_id string, segment int, total long, block binary"


def chunked(payload: bytes) -> bytes:
    """Payload in HTTP's chunked transfer framing."""
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """Inverse of the chunked framing; extensions after a size and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = framed[end + 2 : end + 2 + size]
        if len(part) < size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(
        line.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:]
    )
    return dechunked(body) if framed else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".replace("\r", " ").replace("\n", " ").encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records(record_id: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of a page: a revisit without payload, a response, or a response and its continuations."""
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
        yield _record([*own, *shared], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    numbered = len(parts) > 1
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", 1 if numbered else None), *shared], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{number}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", number)]
        yield _record([*own, last, *shared], part)


def _archived(batches):
    """Rows to archives: concatenated gzip members, one per record, closed at ARCHIVE_BYTES."""
    archive, held = [], 0
    for batch in batches:
        ids, uris, digests, refers = (batch.column(i).to_pylist() for i in range(4))
        for record_id, uri, digest, refers_to, payload in zip(ids, uris, digests, refers, utf8(batch.column(4)), strict=True):
            for record in records(record_id, uri, digest, refers_to, payload):
                packer = zlib.compressobj(1, wbits=31)
                archive.append(packer.compress(record) + packer.flush())
                held += len(record)
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["archive"])
                    archive, held = [], 0
    if archive:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["archive"])


def write_archives(rows: DataFrame, path: str) -> None:
    """Write (record_id, uri, digest, refers_to, payload) as gzip-compressed archives below ``path``.

    Each archive is one row of bytes and one file; Spark's text writer commits whole tasks, so a lost
    executor leaves no half archive. A record never spans two archives unless it is segmented.
    """
    held = small_batches(rows).select("record_id", "uri", "digest", "refers_to", "payload").mapInArrow(_archived, "archive binary")
    held.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _members(content: bytes) -> Iterator[bytes]:
    """Uncompressed records of an archive: gzip members, or the plain file. What lies between members is skipped.

    The archive goes to zlib in pieces, so the time is linear in it whatever the number of its members. Of a
    damaged member its readable beginning is returned.
    """
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at >= 0:
        begin, unpacker, out = at, zlib.decompressobj(wbits=31), []
        try:
            while not unpacker.eof and at < len(view):
                piece = view[at : at + PIECE_BYTES]
                out.append(unpacker.decompress(piece))
                at += len(piece) - len(unpacker.unused_data)
        except zlib.error:
            at = begin + 2
        yield b"".join(out)
        at = content.find(b"\x1f\x8b", at)


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of each record of an archive.

    A record without a valid length, or that is cut off, has None for its block; reading goes on with
    the next record that begins on a line of its own, or with the next gzip member.
    """
    for data in _members(content):
        at = 0
        while at < len(data):
            if not data.startswith(b"WARC/", at):
                at = data.find(b"\r\nWARC/", at) + 2
                if at < 2:
                    break
            end = data.find(b"\r\n\r\n", at)
            lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = _number(head.get("content-length"))
            if end < 0:
                yield head, None
                break
            if size is None or end + 4 + size > len(data):
                yield head, None
                at = end + 2
                continue
            yield head, data[end + 4 : end + 4 + size]
            at = end + 4 + size
            while data.startswith(b"\r\n", at):
                at += 2


def _plain(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _parsed(batches):
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for head, block in parse(content.as_py()):
                number, total = (head.get(f"warc-segment-{x}") for x in ("number", "total-length"))
                if number is not None and _number(number) is None:
                    block = None
                rows.append((
                    _plain(head.get("warc-record-id")), head.get("warc-type"), _plain(head.get("warc-target-uri")),
                    (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, _plain(head.get("warc-refers-to")),
                    _plain(head.get("warc-segment-origin-id")), _number(number), _number(total), block,
                ))
                held += len(block or b"")
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, segments apart; malformed ones have a null block.

    One task holds one archive at a time, which Spark's file source limits to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return small_batches(files).filter("length > 0").select("content").mapInArrow(_parsed, RECORDS)


def reassemble(found: DataFrame) -> DataFrame:
    """One row per record, segmented ones put together: (record_id, record_type, target_uri, payload_digest, refers_to, block, complete).

    Only segments are shuffled, by the id of the record they continue, and ordered by their number. A
    record is complete if its numbers run from 1 without a gap and its length is the total that the last
    segment states; the block of an incomplete one is null, as is that of a malformed record. A record's own
    segments are the largest group there is. A repeated segment counts once, with its block if any has one.
    """
    whole = found.filter("segment is null").select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "block", F.col("block").isNotNull().alias("complete"))
    parts = found.filter("segment is not null").withColumn("own", F.coalesce("origin_id", "record_id"))
    rest = [c for c in parts.columns if c not in ("own", "segment")]
    best = F.max_by(F.struct(*rest), F.coalesce(F.length("block"), F.lit(-1))).alias("best")
    parts = parts.groupBy("own", "segment").agg(best).select("own", "segment", "best.*")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("own").agg(
        *[first(c) for c in ("record_type", "target_uri", "payload_digest", "refers_to")],
        F.max("segment").alias("last"), F.count("*").alias("many"), F.count("block").alias("whole"), F.max("total").alias("total"), F.sum(F.length("block")).alias("held"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    whole_run = (F.col("last") == F.col("many")) & (F.col("total") == F.col("held")) & (F.col("whole") == F.col("many"))
    complete = F.coalesce(whole_run, F.lit(False))
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    return whole.unionByName(grouped.select(
        F.col("own").alias("record_id"), "record_type", "target_uri", "payload_digest", "refers_to",
        F.when(complete, joined).alias("block"), complete.alias("complete"),
    ))


def _body(block: bytes | None, kind: str | None) -> bytes | None:
    try:
        return payload_of(block) if block is not None and kind == "response" else None
    except ValueError:
        return None


def _payloads(batches):
    for batch in batches:
        blocks, kinds, whole = (batch.column(c).to_pylist() for c in ("block", "record_type", "complete"))
        payloads = [_body(b, k) for b, k in zip(blocks, kinds, strict=True)]
        complete = [w and (k != "response" or p is not None) for w, k, p in zip(whole, kinds, payloads, strict=True)]
        at = batch.schema.get_field_index("block")
        out = batch.set_column(at, "payload", pa.array(payloads, pa.binary()))
        yield out.set_column(batch.schema.get_field_index("complete"), "complete", pa.array(complete, pa.bool_()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records with their payloads, transfer framing decoded: (record_id, record_type, target_uri, payload_digest, refers_to, payload, complete).

    Revisits have no payload of their own; their digest names it. Incomplete records have none: those that are
    malformed or lack segments, and responses whose transfer framing is broken.
    """
    held = reassemble(read_records(spark, path))
    kinds = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary, complete boolean"
    return small_batches(held).mapInArrow(_payloads, kinds)


def planned(pages: DataFrame, least: int = LEAST_SHARED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records to write. Of equal payloads of ``least`` bytes and more, the one with the largest page_id is the response.

    Only digests and page_ids are grouped. The table of digests that occur with several page_ids is
    written, and Spark joins it by its size, splitting a digest that very many pages have.
    """
    held = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    long = held.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("times"))
    owners = stage(long.filter("times > 1").select("digest", "owner"), "owners")
    owned = held.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return owned.select(
        F.concat(name("page_id"), F.lit(":"), F.monotonically_increasing_id().cast("string")).alias("record_id"), "uri", "digest",
        F.when(revisit, name("owner")).alias("refers_to"), F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame) -> str:
    """Write every page as a record into new archives of the shared folder; returns their folder."""
    path = f"{staging_root(pages.sparkSession).rstrip('/')}/storelens/{uuid.uuid4().hex}/archives"
    write_archives(planned(pages), path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Digest and length come from the payloads read. A revisit has those of the response with its
    digest. Null and empty html are empty payloads. Rows that repeat a page_id and html are each a
    response, rows without a page_id are revisits if an equal payload has one. Null urls are left out
    of the record. Pages of any length are segmented.
    """
    found = stage(_digested(read_archives(pages.sparkSession, archive_pages(pages))), "read")
    sizes = found.filter("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload_bytes").alias("size"))
    sizes = stage(sizes.join(found.filter("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest"), "sizes")
    page = lambda c: F.split(F.col(c), ":")[2].try_cast("long")
    return found.join(sizes, "payload_digest", "left").select(
        page("record_id").alias("page_id"), F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )


def _digested(found: DataFrame) -> DataFrame:
    response = F.col("record_type") == "response"
    return found.select(
        "record_id", "record_type", "refers_to", F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(response, F.octet_length("payload").cast("long")).alias("payload_bytes"),
    )


#: The same in SQL, from the pages alone.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS n, sha1(t) AS d FROM p),
o AS (SELECT d, max(page_id) AS owner FROM h WHERE n >= {LEAST_SHARED} GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM h LEFT JOIN o USING (d)
"""
