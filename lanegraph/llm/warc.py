"""WARC archives: records from a table of pages, and a normaliser for archives compressed as one stream.

Writing: each task turns its pages into archives of about ARCHIVE_BYTES of payload, each one gzip
stream over all its records (what careless tools produce), stored as one row of a table in the shared
folder, because that is the only storage all executors share. A row is a whole file, so reading the
archives back needs no shuffle.

Normalising: a task inflates an archive's stream once, chunk by chunk, finds the records by their
Content-Length, and writes every record as a gzip member of its own, so that a reader can start at any
record. The sidecar index holds archive, offset, length, record id, type and target of each member.
Memory holds the compressed archives of one input split, one record and one chunk. ``normalise`` does
the same for any iterable of bytes, such as an open file.

Payloads: of the records with equal payloads of at least ``min_bytes`` the one with the largest page
id is a response, the others are revisits that refer to it; smaller ones are all responses. Leaders are
found on narrow rows (digest, page id). Payloads that more than one page in HEAVY has are at most HEAVY
in number, so their leaders are broadcast and their pages stay where they are; the others meet their
leader in a shuffle by digest, in which no key has more than one row in HEAVY.

Edge cases: null html is an empty payload. Rows without a page id never lead a group that has an id;
a group without any id has responses only. Rows that repeat the leader's id are responses too. A null
url is written as an empty target. Very large payloads make an archive of their own. Truncated or
malformed streams raise. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.shared import materialize

ARCHIVE_BYTES = 32 << 20
#: What a record's own header counts for.
HEAD_BYTES = 512
CHUNK_BYTES = 1 << 20
#: A payload is heavy if more than one page in so many has it.
HEAVY = 1024
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WARC_VERSION = b"WARC/1.1\r\n"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as WARC-Payload-Digest carries it after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header only, and the digest and size of the full payload."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id('none' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return WARC_VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.decode("utf-8", "replace").strip()
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("record is cut short")
    return fields, rest[:n]


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whether of one member or several, from its chunks."""
    z = zlib.decompressobj(31)
    fresh = True
    for chunk in chunks:
        while chunk:
            out = z.decompress(chunk, CHUNK_BYTES)
            fresh = False
            if out:
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, z, fresh = z.unused_data, zlib.decompressobj(31), True
    if not fresh:
        out = z.flush()
        if out:
            yield out
        if not z.eof:
            raise ValueError("gzip stream is cut short")


def records(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed WARC stream, found by Content-Length."""
    buffer = bytearray()
    need = None
    for piece in stream:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = [line for line in bytes(buffer[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:")]
                if not buffer.startswith(b"WARC/") or not length:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(length[0].split(b":", 1)[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("record is cut short")


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(chunks: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, member) of every record of a gzip file given by its chunks."""
    offset = 0
    for raw in records(inflated(chunks)):
        out = member(raw)
        yield offset, len(out), parse_record(raw)[0], out
        offset += len(out)


# --- tables -------------------------------------------------------------------------------


def _deflated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with the payload (the third) deflated, so that what moves to other tasks is smaller."""
    narrow = rows.select(*columns)

    def run(batches):
        for b in batches:
            small = pa.array([zlib.compress(p.as_buffer(), 1) for p in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), small, b.column(3)], names=columns)

    return narrow.mapInArrow(run, narrow.schema)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (deflated), refers_to of every page: who is a revisit of whom."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    counted = rows.groupBy("sha").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"), F.max("size").alias("bytes"))
    equal = materialize(counted.where("n > 1").where(F.col("bytes") >= min_bytes).select("sha", "leader", "n"), "equal_payloads")
    heavy = F.broadcast(equal.where(F.col("n") > max(1, pages.count() // HEAVY)).select("sha", "leader"))  # HEAVY rows at most
    near = _deflated(rows.join(heavy, "sha"), ["page_id", "url", "payload", "leader"])
    light = _deflated(rows.join(heavy, "sha", "left_anti"), ["page_id", "url", "payload", "sha"])
    far = light.join(equal.select("sha", "leader"), "sha", "left").select(near.columns)
    revisit = F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader"))
    return near.unionByName(far).select("page_id", "url", "payload", revisit.alias("refers_to"))


def write_archives(planned: DataFrame) -> DataFrame:
    """archive, data: monolithic gzip files, one a row, written to the shared folder."""

    def run(batches):
        task = TaskContext.get().partitionId()
        number, z, filled, held = 0, None, 0, []

        def row():
            data = b"".join(held) + z.flush()
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + number], pa.int64()), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, small, to = (batch.column(j)[i].as_py() for j in range(4))
                payload = zlib.decompress(small)
                if z is None:
                    z, filled, held = zlib.compressobj(6, zlib.DEFLATED, 31), 0, []
                held.append(z.compress(record_bytes(page, url, payload, to)))
                filled += HEAD_BYTES + (len(payload) if to is None else 0)
                if filled >= ARCHIVE_BYTES:
                    yield row()
                    z, number = None, number + 1
        if z is not None:
            yield row()

    return materialize(planned.mapInArrow(run, "archive long, data binary"), "archives")


def chunks_of(data: bytes | memoryview) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[at : at + CHUNK_BYTES]) for at in range(0, len(view), CHUNK_BYTES))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """archive, offset, length, record_id, warc_type, target_uri, member of every record, written to the shared folder.

    Without ``member`` this is the sidecar index; the members of an archive by offset are the normalised file.
    """
    names = ["archive", "offset", "length", "record_id", "warc_type", "target_uri", "member"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column(0)[i].as_py()
                rows, size = [], 0
                for offset, length, head, data in normalise(chunks_of(batch.column(1)[i].as_buffer())):
                    rows.append((archive, offset, length, head["warc-record-id"], head["warc-type"], head.get("warc-target-uri", ""), data))
                    size += length + HEAD_BYTES
                    if size >= 4 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    made = archives.select("archive", "data").mapInArrow(run, "archive long, offset long, length long, record_id string, warc_type string, target_uri string, member binary")
    return materialize(made, "members")


def sidecar_index(members: DataFrame) -> DataFrame:
    return members.drop("member")


def read_records(members: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the normalised archives say; responses are checked against their digest."""

    def number(urn: str | None):
        text = urn[len("<urn:page:") : -1] if urn else "none"
        return None if text == "none" else int(text)

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                head, block = parse_record(zlib.decompress(data, 31))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                size = int(head["x-payload-length"])
                if head["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if payload_digest(payload) != digest or len(payload) != size:
                        raise ValueError("payload differs from its digest")
                out.append((number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to"))))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return members.select("member").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives, normalise those, and read the records back."""
    return read_records(normalise_archives(write_archives(plan_records(pages, min_bytes))))
