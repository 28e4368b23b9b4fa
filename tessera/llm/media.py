"""Media columns: signature sniffing, validation, and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob. Each
hit goes to its format's validator, which walks the structure (chunks, sub-blocks, segments,
declared lengths, checksums) and returns where the file ends, or rejects the hit: magic bytes
that merely occur in other data are not media. What is confirmed is carved out, the declared
type is corrected, and the search goes on behind it.

Null blobs hold no media; repeated rows give repeated rows. For the documents' payloads see
store_documents(): null and empty texts are one line of spaces, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, null_safe_bytes

#: The unit of a stored payload: one row of samples.
WIDTH = 192


class Found(NamedTuple):
    mime: str
    start: int
    end: int
    detail: str


# --- validators: (data, start) -> (end, detail), or None ---


def _png(data: bytes, at: int) -> tuple[int, str] | None:
    pos, first, seen_data = at + 8, True, False
    detail = ""
    while pos + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + n
        if end > len(data) or zlib.crc32(memoryview(data)[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if first:
            if kind != b"IHDR" or n != 13:
                return None
            w, h, depth, colour = struct.unpack_from(">IIBB", data, pos + 8)
            if not w or not h:
                return None
            detail, first = f"{w}x{h}x{depth}c{colour}", False
        seen_data |= kind == b"IDAT"
        pos = end
        if kind == b"IEND":
            return (pos, detail) if seen_data else None
    return None


def _wav(data: bytes, at: int) -> tuple[int, str] | None:
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    pos, form, samples = at + 12, None, None
    if end > len(data):
        return None
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + n > end:
            return None
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", data, pos + 8)
        elif kind == b"data":
            samples = n
        pos += 8 + n + n % 2
    if pos not in (end, end + 1) or form is None or samples is None:
        return None
    code, channels, rate, per_second, align, depth = form
    if code != 1 or align != channels * depth // 8 or per_second != rate * align or not align or samples % align:
        return None
    return end, f"{channels}ch{rate}Hz{depth}b{samples // align}n"


def _bmp(data: bytes, at: int) -> tuple[int, str] | None:
    if at + 54 > len(data):
        return None
    size, reserved, offset, header, w, h, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    if reserved or header < 40 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packing or w <= 0 or not h:
        return None
    if at + size > len(data) or offset + (w * depth + 31) // 32 * 4 * abs(h) != size or offset < 14 + header:
        return None
    return at + size, f"{w}x{abs(h)}x{depth}"


def _gif(data: bytes, at: int) -> tuple[int, str] | None:
    if at + 13 > len(data) or data[at + 4 : at + 6] not in (b"7a", b"9a"):
        return None
    w, h, flags = struct.unpack_from("<HHB", data, at + 6)
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while pos < len(data):
        kind = data[pos]
        if kind == 0x3B:
            return (pos + 1, f"{w}x{h}x{images}") if images and w and h else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos += 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1
            images += 1
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return None


def _jpeg(data: bytes, at: int) -> tuple[int, str] | None:
    pos, detail = at + 2, ""
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        kind, n = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(data):
            return None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            depth, h, w = struct.unpack_from(">BHH", data, pos + 4)
            detail = f"{w}x{h}x{depth}"
        pos += 2 + n
        if kind == 0xDA:
            end = pos
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data):
                if data[end + 1] == 0xD9:
                    return (end + 2, detail) if detail else None
                end += 2
            return None
    return None


#: Magic bytes, media type and validator.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _wav),
    (b"BM", "image/bmp", _bmp),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[Found]:
    """The confirmed media of a blob, in order, none within another."""
    found, behind = [], 0
    for last, i in automaton().iter(data.decode("latin-1")):
        magic, mime, validate = FORMATS[i]
        start = last + 1 - len(magic)
        if start >= behind and (hit := validate(data, start)):
            found.append(Found(mime, start, *hit))
            behind = hit[0]
    return found


def carve(blobs: DataFrame) -> DataFrame:
    """id, ordinal, declared, mime, corrected, start, length, detail, media of all media in blobs (id, blob, declared)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for key, blob, declared in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for k, m in enumerate(sniff(blob or b"")):
                rows.append({"id": key, "ordinal": k, "declared": declared, "mime": m.mime, "corrected": m.mime != declared, "start": m.start, "length": m.end - m.start, "detail": m.detail, "media": blob[m.start : m.end]})
        return pa.RecordBatch.from_pylist(rows, schema) if rows else None

    schema = pa.schema([("id", pa.int64()), ("ordinal", pa.int32()), ("declared", pa.string()), ("mime", pa.string()), ("corrected", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("detail", pa.string()), ("media", pa.binary())])
    return map_arrow(blobs.select(F.col("id").cast("long").alias("id"), F.col("blob").cast("binary").alias("blob"), "declared"), kernel, "id long, ordinal int, declared string, mime string, corrected boolean, start long, length long, detail string, media binary")


# --- payloads as 8-bit samples ---


def payload(text: bytes) -> bytes:
    """The text, filled with spaces to a positive multiple of WIDTH."""
    return text + b" " * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def to_wav(samples: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples)) + samples


def to_bmp(samples: bytes) -> bytes:
    """Grey, top row first; WIDTH is a multiple of 4, so rows need no filling."""
    offset = 54 + 1024
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", offset + len(samples), 0, offset, 40, WIDTH, -(len(samples) // WIDTH), 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey + samples


def to_png(samples: bytes) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_samples(mime: str, media: bytes) -> bytes:
    """The samples of a stored payload."""
    if mime == "audio/wav":
        return media[44:]
    if mime == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    body, pos = b"", 8
    while pos < len(media):
        n, kind = struct.unpack_from(">I4s", media, pos)
        if kind == b"IDAT":
            body += media[pos + 8 : pos + 8 + n]
        pos += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


WRITERS = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("image/png", to_png))


def wrapped(samples: bytes) -> tuple[bytes, str]:
    """A blob that holds the stored samples between other bytes, and the wrong type it is declared as.

    The format and the bytes before it follow from the samples, so equal texts give equal blobs.
    """
    which = zlib.crc32(samples)
    mime, write = WRITERS[which % 3]
    declared = WRITERS[(which + 1) % 3][0]
    return b"--part\r\nContent-Type: " + declared.encode() + b"\r\n" + b"\r\n" * (1 + which % 5) + write(samples) + b"\r\n--part--\r\n", declared


def feature(samples: bytes) -> str:
    """Mean, share of distinct values and histogram entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts[counts > 0] / len(samples)
    return f"mean={float(counts @ np.arange(256)) / len(samples):.4f};values={len(p)};bits={float(-(p * np.log2(p)).sum()):.4f}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, mime string, corrected boolean"


def store_documents(docs: DataFrame) -> DataFrame:
    """Every text as stored media, found again by sniff() in its blob, read back and described."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(9)]
        for text in null_safe_bytes(batch.column(1)):
            blob, declared = wrapped(payload(text))
            (m,) = sniff(blob)
            media = blob[m.start : m.end]
            samples = read_samples(m.mime, media)
            row = (len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{m.mime};{m.detail};at={m.start};{feature(samples)}", m.mime, m.mime != declared)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [c.split()[0] for c in COLUMNS.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, COLUMNS)
