"""WARC archives: one gzip member a record, written by tasks and read back sequentially.

Pages with equal payloads are stored once, as the response with the largest page_id; the others are revisits that
name its record. Tasks write archives of their own under names that no other attempt uses and report them in rows;
what a committed table of these rows lists is the archive set, so files of lost or repeated attempts don't count.

The reader goes through an archive member by member: incremental decompression in steps of STEP bytes, the header
up to its empty line, then as many bytes as Content-Length says, then the record's end and the member's. Digests
of block and payload are computed over what was read and compared with those in the header. A record that breaks
any of this is a row with its fault.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, join_groups, need, pieces, remove

#: Compressed bytes after which an archive is closed, bytes read at a time, and bytes of payload in a batch of rows.
ARCHIVE, STEP, BATCH = 1 << 26, 1 << 16, 1 << 22
#: A header longer than this is not one.
MOST_HEADER = 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, records long, bytes long"
RECORDS = "path string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, page_id long, payload binary, payload_bytes long, payload_digest string, fault string"


def _filesystem(uri: str):
    """(file system, path) of a URI; Hadoop's names of S3 are those of one S3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload in every attempt and run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A response holds the payload behind an HTTP header, a revisit the header alone."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        # Line ends and controls would break the header; a URI has none.
        ("WARC-Target-URI", url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches, folder: str, most: int):
    """FILES: the archives that this task wrote."""
    where, at = _filesystem(folder)
    where.create_dir(at, recursive=True)
    out, name, n, done = None, None, 0, []
    try:
        for batch in pieces(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{at}/{name}", compression=None)
                out.write(_member(record(row["page_id"], row["url"], row["payload"], row["keeper"], row["revisit"])))
                n += 1
                if out.tell() >= most:
                    done.append((f"{folder}/{name}", n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{name}", n, out.tell()))
    finally:
        if out is not None:
            out.close()
    types = (pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], ["path", "records", "bytes"])


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def write_pages(tmp: Scratch, pages: DataFrame, folder: str, most: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) below folder, a URI that all executors reach.

    Returns FILES as a saved table. Of rows with equal payloads those with the largest page_id are responses and
    the others revisits of it; where all ids are null, all are responses. A null html is an empty payload, a null
    url leaves the target out. Payloads are compared by sha-256; a row is shuffled once at most.
    """
    rows = need(pages, page_id="long", url="string", html="string").select("page_id", "url", _payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = tmp.save(rows.groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1"), "copies")
    total = rows.count()
    joined = join_groups(rows, groups, "same", "copies", total, "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    dealt = joined.select("page_id", "url", "payload", "keeper", revisit.alias("revisit"))
    return tmp.save(dealt.mapInArrow(functools.partial(_write, folder=folder, most=most), FILES), "archives")


class _Stream:
    """The decompressed bytes of one gzip member, read in steps; what follows the member stays for the next."""

    def __init__(self, source, rest: bytes):
        self.source, self.packed, self.unpacker, self.ready = source, rest, zlib.decompressobj(31), bytearray()
        self.used = 0

    def more(self) -> bool:
        """Decompresses a further step; whether there was any."""
        if self.unpacker.eof:
            return False
        data = self.packed or self.source.read(STEP)
        # Without further input there may still be output that a step left over.
        out = self.unpacker.decompress(data, 16 * STEP)
        if not data and not out:
            return False
        self.ready += out
        self.packed = self.unpacker.unconsumed_tail or self.unpacker.unused_data
        self.used += len(data) - len(self.packed)
        return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """The bytes before mark, which is passed over; None where there is none among the next most bytes."""
        seen = 0
        while True:
            at = self.ready.find(mark, max(0, seen - len(mark)))
            if at >= 0:
                out = bytes(self.ready[:at])
                del self.ready[: at + len(mark)]
                return out
            seen = len(self.ready)
            if seen > most or not self.more():
                return None

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer where the member ends before."""
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _parse(stream: _Stream) -> tuple[dict, bytes, str | None]:
    """(header, block, fault) of the record in a member."""
    head = stream.until(b"\r\n\r\n", MOST_HEADER)
    if head is None:
        return {}, b"", "header"
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not version.startswith("WARC/") or not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        return fields, b"", "header"
    block = stream.take(int(fields["content-length"]))
    if len(block) < int(fields["content-length"]):
        return fields, block, "truncated"
    if stream.take(5) != b"\r\n\r\n":
        return fields, block, "length"
    return fields, block, None if stream.unpacker.eof else "truncated"


def _records(source):
    """(offset, header, block, fault) of each record of an archive; a member that is broken ends it."""
    rest, offset = b"", 0
    while True:
        stream = _Stream(source, rest)
        try:
            if not stream.packed and not (first := source.read(STEP)):
                return
            elif not stream.packed:
                stream.packed = first
            fields, block, fault = _parse(stream)
            while not stream.unpacker.eof and stream.more():  # to the member's end, where its checksum is
                stream.ready.clear()
            fault = fault or (None if stream.unpacker.eof else "truncated")
        except zlib.error:
            fields, block, fault = {}, b"", "gzip"
        yield offset, fields, block, fault
        if not stream.unpacker.eof:
            return
        offset, rest = offset + stream.used, stream.packed


def _row(path, offset, fields, block, fault, payloads: bool) -> tuple:
    sha1 = lambda name: fields.get(name, "").removeprefix("sha1:") or None
    kind, digest, payload = fields.get("warc-type"), sha1("warc-payload-digest"), None
    if fault is None and sha1("warc-block-digest") not in (None, base32_sha1(block)):
        fault = "block digest"
    if fault is None and kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest not in (None, base32_sha1(payload)):
            fault = "payload digest"
        digest = digest or base32_sha1(payload)
    page = fields.get("page-id", "")
    size = None if payload is None else len(payload)
    ids = (fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), int(page) if re.fullmatch("-?[0-9]+", page) else None)
    return (path, offset, kind, *ids, payload if payloads else None, size, digest, fault)


def _read(batches, payloads: bool):
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            where, at = _filesystem(path)
            with where.open_input_stream(at, compression=None) as source:
                rows, held = [], 0
                for offset, fields, block, fault in _records(source):
                    rows.append(_row(path, offset, fields, block, fault, payloads))
                    held += len(block)
                    if len(rows) >= 1000 or held > BATCH:
                        yield pack(rows)
                        rows, held = [], 0
                yield pack(rows)


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of the archives that files lists in its column path, each read sequentially by one task.

    offset: where the record's member begins. payload is null for revisits, and everywhere without payloads; its
    size is known all the same. fault: null for a sound record, else header, truncated, length, gzip, block digest
    or payload digest; after a member that does not end, the rest of its archive is not read.
    """
    paths = files.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(functools.partial(_read, payloads=payloads), RECORDS)


def resolve(tmp: Scratch, records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of sound records; records: a saved table.

    A revisit has its response's payload. A faulty record, or a revisit without a response of its digest, fails
    the job: nothing is left out silently.
    """
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), F.col("path"), F.lit(" at "), F.col("offset").cast("string")))
    sound = records.withColumn("record_type", F.when(F.col("fault").isNull() & F.col("record_type").isin("response", "revisit"), F.col("record_type")).otherwise(fail("a faulty record").cast("string")))
    first = sound.filter("record_type = 'response'")
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = first.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    again = sound.filter("record_type = 'revisit'")
    asked = again.groupBy("refers_to_id").agg(F.count("*").alias("copies"))
    groups = tmp.save(asked.join(responses, asked["refers_to_id"] == responses["record_id"], "left").drop("record_id"), "responses")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    met = join_groups(again.drop("payload_bytes"), groups, "refers_to_id", "copies", total)
    full = F.when(F.col("digest") == F.col("payload_digest"), F.col("bytes")).otherwise(fail("a revisit without its response").cast("long"))
    return first.select(*kept, F.lit(None).cast("long").alias("refers_to")).unionByName(met.withColumn("payload_bytes", full).select(*kept, "refers_to"))


def warc_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archives.

    See write_pages for nulls and ties. Repeated rows are records of their own, other columns are ignored, an
    empty table gives no rows.
    """
    tmp = Scratch(pages.sparkSession, "warc")
    folder = tmp.folder("files")
    files = write_pages(tmp, pages, folder)
    records = tmp.save(read_archives(files, payloads=False), "records")
    remove(pages.sparkSession, folder)
    return resolve(tmp, records)
