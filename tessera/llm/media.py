"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic number in a byte string in one pass; a validator of each format then
checks its structure and computes its length. The outermost valid object at the start gives the true type, and
valid objects inside are carved. Validators read lengths from the format itself, never from the column's size.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, pieces

#: Samples of a frame; payloads are filled with 255 to whole frames.
FRAME = 576
RATE = 8000
#: The mark that ends a JPEG's coded data, and an object of a PDF.
CODED, OBJECT = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\s{0,4}[0-9]{1,10} [0-9]{1,5} obj")


def _png(b: bytes, at: int, memo: dict) -> int:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return 0
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return 0


def _chain(memo: dict[int, int], pos: int, step) -> int:
    """Where a walk from pos ends (0 for nowhere valid). step(pos) is the next place, or minus the end, or 0.

    Walks that meet go on alike, so each place is walked from once, however many starts lead there.
    """
    path = []
    while pos not in memo:
        path.append(pos)
        to = step(pos)
        if to <= 0:
            memo[pos] = -to
            break
        pos = to
    end = memo[pos]
    memo.update(dict.fromkeys(path, end))
    return end


def _gif(b: bytes, at: int, memo: dict) -> int:
    if at + 13 > len(b):
        return 0
    inner, outer = memo.setdefault("gif data", {}), memo.setdefault("gif", {})
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def data(p: int) -> int:
        return _chain(inner, p, lambda q: 0 if q >= len(b) else -(q + 1) if b[q] == 0 else q + b[q] + 1)

    def block(p: int) -> int:
        if p >= len(b):
            return 0
        if b[p] == 0x3B:
            return -(p + 1)
        if b[p] == 0x21:
            return data(p + 2)
        return data(p + 11 + table(b[p + 9])) if b[p] == 0x2C and p + 10 < len(b) else 0

    end = _chain(outer, at + 13 + table(b[at + 10]), block)
    return end and end - at


def _jpeg(b: bytes, at: int, memo: dict) -> int:
    def marker(p: int) -> int:
        if p + 2 > len(b) or b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xD9:
            return -(p + 2)
        n = struct.unpack_from(">H", b, p + 2)[0] if p + 4 <= len(b) else 0
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # coded data: up to a mark that is neither a fill byte nor a restart
            found = CODED.search(b, p)
            return found.start() if found else 0
        return p

    end = _chain(memo.setdefault("jpeg", {}), at + 2, marker)
    return end and end - at


def _bmp(b: bytes, at: int, memo: dict) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = zero == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (12, 40, 52, 56, 108, 124) and w > 0 and h and 14 + head <= offset <= size
    return size if good and at + size <= len(b) and size >= offset + (w * bits + 31) // 32 * 4 * abs(h) else 0


def _riff(b: bytes, at: int, memo: dict) -> int:
    if at + 12 > len(b):
        return 0
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos, kinds = at + 8 + size, at + 12, set()
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, pos)
        kinds.add(kind)
        pos += 8 + n + (n & 1)
    return end - at if pos == end and (form != b"WAVE" or {b"fmt ", b"data"} <= kinds) else 0


def _pdf_ends(b: bytes) -> dict[int, int]:
    """For each %PDF- that has one, the end of its last section.

    A file may have several sections (a first-page part, updates), each ended by %%EOF behind startxref and the
    place of its cross references, counted from the file's start. That place tells whose end it is, also where a
    file holds another: the start that lies so far before the table, or else has an object there. A first-page
    part names place 0 and belongs to the nearest start.
    """
    starts = [m.start() for m in re.finditer(b"%PDF-", b)]
    known, tables, out = set(starts), [m.start() for m in re.finditer(rb"(?<!start)xref", b)] if starts else [], {}
    for m in re.finditer(rb"startxref\s{1,4}([0-9]{1,12})\s{1,4}%%EOF", b) if starts else ():
        before = bisect.bisect_left(starts, m.start())
        if not before:
            continue
        place, near = int(m[1]), starts[before - 1]
        table = bisect.bisect_left(tables, m.start())
        if place and table and tables[table - 1] - place in known:
            near = tables[table - 1] - place
        elif place and not OBJECT.match(b, near + place):
            continue
        out[near] = m.end()
    return out


def _pdf(b: bytes, at: int, memo: dict) -> int:
    if "pdf" not in memo:
        memo["pdf"] = _pdf_ends(b)
    return memo["pdf"].get(at, at) - at


def _zip_ends(b: bytes) -> dict[int, int]:
    """For each archive its end. An end record names the directory's size and place, and with them the start."""
    out, end = {}, b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        start = end - size - offset
        if start >= 0 and size and b[start + offset : start + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            out[start] = max(out.get(start, 0), end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


def _zip(b: bytes, at: int, memo: dict) -> int:
    if "zip" not in memo:
        memo["zip"] = _zip_ends(b)
    return memo["zip"].get(at, at) - at


def _gzip(b: bytes, at: int, memo: dict) -> int:
    d = zlib.decompressobj(31)
    try:
        view, pos = memoryview(b)[at:], 0
        while not d.eof and pos < len(view):
            d.decompress(view[pos : pos + 65536], 1 << 16)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 16)
            pos += 65536
    except zlib.error:
        return 0
    return min(pos, len(view)) - len(d.unused_data) if d.eof else 0


def _ogg(b: bytes, at: int, memo: dict) -> int:
    """A stream begins at a page so marked; a page behind it begins none."""
    if at + 27 > len(b) or not b[at + 5] & 2:
        return 0

    def page(p: int) -> int:
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
            return 0
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        return 0 if end > len(b) else -end if b[p + 5] & 4 else end

    end = _chain(memo.setdefault("ogg", {}), at, page)
    return end and end - at


# Magic numbers of the formats, with type and validator.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(MAGIC):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of the valid media objects in data, outer ones first; parts of carved ones stay listed."""
    out, memo = [], {}
    for last, i in _automaton().iter(data.decode("latin-1")):
        magic, kind, size_of = MAGIC[i]
        at = last + 1 - len(magic)
        if n := size_of(data, at, memo):
            out.append((at, at + n, RIFF_TYPES.get(data[at + 8 : at + 12], kind) if magic == b"RIFF" else kind))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def describe(data: bytes | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """True type (None where nothing at the start is valid) and the objects carved from inside."""
    found = sniff(data or b"")
    outer = next((x for x in found if x[0] == 0), None)
    return (outer[2] if outer else None), [x for x in found if x is not outer]


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM, one sample a byte; whole frames are even, so no pad byte follows."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(data: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    if not _riff(data, 0, {}) or data[8:12] != b"WAVE":
        raise ValueError("no valid WAVE object")
    pos = 12
    while data[pos : pos + 4] != b"data":
        pos += 8 + (n := struct.unpack_from("<I", data, pos + 4)[0]) + (n & 1)
    n = struct.unpack_from("<I", data, pos + 4)[0]
    return data[pos + 8 : pos + 8 + n]


def features(samples: bytes) -> str:
    """Mean, deviation, zero crossings a frame and loudest frame, in whole numbers so that reruns agree."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x.astype(np.int64))) if len(x) <= 1 << 20 else sum(int(np.dot(c, c)) for i in range(0, len(x), 1 << 20) for c in [x[i : i + (1 << 20)].astype(np.int64)])
    n = len(x)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    loudest = int(x.reshape(-1, FRAME).sum(axis=1, dtype=np.int64).max())
    return f"mean={total * 1000 // n},var={(squares * n - total * total) // (n * n)},cross={crossings * 1000 * FRAME // n},peak={loudest}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _text_media(batches):
    for batch in pieces(batches):
        cols: list[list] = [[] for _ in range(7)]
        for t in batch.column("text").cast(pa.binary()):
            raw = t.as_py() or b""
            payload = raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)
            stored = to_wav(payload)
            kind, inside = describe(stored)
            back = from_wav(stored)
            seen = f"type={kind},carved={len(inside)}," + features(back)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), seen)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text as 8-bit WAVE, sniffs and reads the stored bytes back, and describes them.

    A null or empty text is one frame of 255. A null doc_id stays null. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives no rows. One text is in memory at a time beside its batch.
    """
    return need(docs, doc_id="long", text="string").mapInArrow(_text_media, MEDIA_SCHEMA)


def _sniff_batches(batches):
    for batch in pieces(batches, "blob"):
        kinds, carved = [], []
        for blob in batch.column("blob"):
            kind, inside = describe(blob.as_py())
            kinds.append(kind)
            carved.append([{"start": a, "end": b, "type": k} for a, b, k in inside])
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), pa.array(kinds, pa.string()), pa.array(carved, pa.list_(item))], ["id", "declared", "sniffed", "carved"])


def correct_types(blobs: DataFrame) -> DataFrame:
    """id, declared, type, corrected, carved for a table of id, declared, blob.

    type is the sniffed type, else the declared one; corrected says that they differ. carved lists the media
    objects inside as struct<start, end, type>. A null or empty blob has no sniffed type and carves nothing.
    """
    out = need(blobs, id="long", declared="string", blob="binary").mapInArrow(_sniff_batches, "id long, declared string, sniffed string, carved array<struct<start:long,end:long,type:string>>")
    kind = F.coalesce("sniffed", "declared")
    return out.select("id", "declared", kind.alias("type"), F.coalesce(F.col("sniffed").isNotNull() & ~F.col("sniffed").eqNullSafe(F.col("declared")), F.lit(False)).alias("corrected"), "carved")
