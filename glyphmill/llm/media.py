"""Media columns: what bytes really are, found by magic numbers and confirmed by format validators.

One Aho-Corasick automaton locates the magic bytes of all formats in a value; a validator for each format
then walks its structure (chunks, segments, pages, headers with lengths, checksums) and returns where the
medium ends, or nothing. A value's own type is that of a valid medium at its start; valid media further in are
embedded, and can be carved out. A declared type is corrected where the bytes say otherwise.

Results in odd cases: null bytes have a null type and no media; empty or unknown bytes have type
application/octet-stream; a declared type stands where nothing valid starts the value and no format of that
type is known, and is application/octet-stream where its format is known but the bytes aren't valid; media
within a found medium are not reported again; ties at one place go to the longest medium; repeated rows
and other columns pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.shared import append_columns, fresh

UNKNOWN = "application/octet-stream"

# Magic bytes, how far before them the medium starts, and the media type.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"WAVE", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"AVI ", 8, "video/x-msvideo"),
    (b"OggS\x00", 0, "application/ogg"),
    (b"fLaC\x00\x00\x00\x22", 0, "audio/flac"),
    (b"fLaC\x80\x00\x00\x22", 0, "audio/flac"),
    (b"%PDF-", 0, "application/pdf"),
    (b"BM", 0, "image/bmp"),
]


#: Places that walks of this value have passed; a walk that comes upon one would end as the one before, that is, fail.
Passed = dict


def again(passed: Passed, *place) -> bool:
    """Whether a walk was here before; notes that it is here now."""
    if place in passed:
        return True
    passed[place] = True
    return False


def png_end(data: bytes, at: int, passed: Passed) -> int | None:
    p = at + 8
    first = True
    while p + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, p)
        if p + 12 + size > len(data) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p
    return None


def jpeg_end(data: bytes, at: int, passed: Passed) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(data):
        if again(passed, "jpeg", p, frame):
            return None
        if data[p] != 0xFF:
            return None
        marker = data[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        if marker == 0xD9:
            return p + 2 if frame else None
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2 or p + 2 + size > len(data):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if marker == 0xDA:  # entropy-coded data go to the next marker that is neither stuffing nor a restart
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    return None
                if data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 if frame and data[p : p + 2] == b"\xff\xd9" else None


def gif_end(data: bytes, at: int, passed: Passed) -> int | None:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    image = False
    while p < len(data):
        if again(passed, "gif", p, image):
            return None
        if data[p] == 0x3B:
            return p + 1 if image else None
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 <= len(data):
            p += 10 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 0x80 else 0)
            p, image = blocks(p + 1), True
        else:
            return None
    return None


def riff_end(data: bytes, at: int, passed: Passed) -> int | None:
    """RIFF: the size in the header and the chunks within must agree; WAVE needs fmt and data with whole frames."""
    if data[at : at + 4] != b"RIFF":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    p, seen, block = at + 12, set(), 0
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, p)
        if p + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            channels, _, _, block, bits = struct.unpack_from("<HIIHH", data, p + 10)
            if not channels or block != channels * ((bits + 7) // 8):
                return None
        if kind == b"data" and (not block or size % block):
            return None
        seen.add(kind)
        p += 8 + size + size % 2
    wave = data[at + 8 : at + 12] == b"WAVE"
    return end if p in (end, end + 1) and seen and (not wave or {b"fmt ", b"data"} <= seen) else None


def ogg_end(data: bytes, at: int, passed: Passed) -> int | None:
    p, last = at, None
    while data[p : p + 4] == b"OggS" and p + 27 <= len(data):
        if again(passed, "ogg", p):
            return None
        table = data[p + 27 : p + 27 + data[p + 26]]
        end = p + 27 + data[p + 26] + sum(table)
        if data[p + 4] or len(table) < data[p + 26] or end > len(data):
            return None
        p, last = end, data[p + 5]
    return p if last is not None and last & 4 else None


# Block sizes and the bytes that follow a FLAC frame's header for sizes and rates that have no code.
FLAC_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
FLAC_RATE_BYTES = {12: 1, 13: 2, 14: 2}


def crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for k in range(256):
        c = k << bits - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial) & mask if c & top else c << 1
        out.append(c)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def flac_frame(data: bytes, p: int) -> tuple[int, int] | None:
    """Length of a frame's header and samples of its block, if a header with the right checksum stands at p."""
    if p + 6 > len(data) or data[p] != 0xFF or data[p + 1] & 0xFE != 0xF8:
        return None
    code, rate = data[p + 2] >> 4, data[p + 2] & 15
    number = data[p + 4]
    size = 1 if number < 0x80 else 8 - (number ^ 0xFF).bit_length()
    if code == 0 or rate == 15 or size > 7 or 0x80 <= number < 0xC0:
        return None
    at = p + 4 + size
    extra = {6: 1, 7: 2}.get(code, 0)
    end = at + extra + FLAC_RATE_BYTES.get(rate, 0)
    if end >= len(data):
        return None
    crc = 0
    for b in data[p:end]:
        crc = CRC8[crc ^ b]
    if crc != data[end]:
        return None
    return end + 1 - p, FLAC_SIZES[code] if code in FLAC_SIZES else int.from_bytes(data[at : at + extra], "big") + 1


def flac_end(data: bytes, at: int, passed: Passed) -> int | None:
    """Frames carry no length: each ends where its checksum comes out and the next one begins, or all samples are there."""
    total = int.from_bytes(data[at + 21 : at + 26], "big") & (1 << 36) - 1
    p, last = at + 4, 0
    while p + 4 <= len(data) and not last:
        last, p = data[p] & 0x80, p + 4 + int.from_bytes(data[p + 1 : p + 4], "big")
    seen = 0
    while last and (frame := flac_frame(data, p)) and not again(passed, "flac", p, total - seen):
        seen, crc, start = seen + frame[1], 0, p
        for q in range(p, len(data)):
            crc = CRC16[crc >> 8 ^ data[q]] ^ (crc & 0xFF) << 8
            if crc == 0 and q >= start + frame[0]:
                if seen >= total > 0 or q + 1 == len(data):
                    return q + 1
                if flac_frame(data, q + 1):
                    p = q + 1
                    break
        else:
            return None
    return None


def pdf_end(data: bytes, at: int, passed: Passed) -> int | None:
    if not data[at + 5 : at + 8].replace(b".", b"0").isdigit():
        return None
    end = passed.get("eof", -1)
    if end < at:  # looked for once for all starts before it
        end = passed["eof"] = data.find(b"%%EOF", at) if end < len(data) else end
        end = passed["eof"] = len(data) if end < 0 else end
    return end + 5 if end < len(data) and b"startxref" in data[max(at, end - 64) : end] else None


def bmp_end(data: bytes, at: int, passed: Passed) -> int | None:
    if data[at : at + 2] != b"BM" or at + 54 > len(data):
        return None
    size, reserved, offset, _, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    if reserved:
        return None
    header = struct.unpack_from("<I", data, at + 14)[0]
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    sound = planes == 1 and width > 0 and height and bits in (1, 4, 8, 16, 24, 32) and header in (40, 52, 56, 108, 124) and offset >= 14 + header
    return at + size if sound and offset + rows <= size and at + size <= len(data) else None


ENDS = {
    "image/png": png_end, "image/jpeg": jpeg_end, "image/gif": gif_end, "audio/wav": riff_end, "image/webp": riff_end, "video/x-msvideo": riff_end,
    "application/ogg": ogg_end, "audio/flac": flac_end, "application/pdf": pdf_end, "image/bmp": bmp_end,
}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, back, kind in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic) + back, kind))
        self.automaton.make_automaton()

    def media(self, data: bytes) -> list[tuple[int, int, str]]:
        """Valid media from first to last, none within another: (start, end, type)."""
        found, free = [], 0
        hits = sorted((last + 1 - back, kind) for last, (back, kind) in self.automaton.iter(data.decode("latin-1")))
        spans = []
        passed: Passed = {}
        for at, kind in hits:
            if at >= free and (end := ENDS[kind](data, at, passed)):
                spans.append((at, -end, kind))
                free = max(free, at + 1)
        free = 0
        for at, end, kind in sorted(spans):
            if at >= free:
                found.append((at, -end, kind))
                free = -end
        return found


_sniffer: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _sniffer:
        _sniffer.append(Sniffer())
    return _sniffer[0]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())])


def sniff(df: DataFrame, content: str = "content", declared: str | None = "declared") -> DataFrame:
    """df with media_type (the corrected type), was_corrected and media (start, length and type of each valid medium)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def kernel(column, *names):
        types, corrected, media = [], [], []
        for data, said in zip(column.to_pylist(), names[0].to_pylist() if names else [None] * len(column), strict=True):
            found = sniffer().media(data) if data else []
            own = found[0][2] if found and found[0][0] == 0 else said if said and said not in ENDS else UNKNOWN
            types.append(None if data is None else own)
            corrected.append(None if data is None else said is not None and said != own)
            media.append(None if data is None else [(a, b - a, k) for a, b, k in found])
        return [types, corrected, pa.array(media, spans)]

    fields = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("was_corrected", T.BooleanType()), T.StructField("media", T.ArrayType(SPAN))])
    return append_columns(df, [content, *([declared] if declared else [])], fields, kernel)


def carve(df: DataFrame, content: str = "content") -> DataFrame:
    """A row for each valid medium of each row of sniff(): medium_start, medium_type and medium (bytes) beside the other columns, of which those of these names are replaced."""
    gone = {"media", "media_type", "was_corrected", "medium_start", "medium_type", "medium", content.lower()}
    (m,) = fresh(df, "m")
    one = df.withColumn(m, F.explode("media"))
    body = F.substring(F.col(f"`{content}`"), (F.col(f"{m}.start") + 1).cast("int"), F.col(f"{m}.length").cast("int"))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    return one.select(*kept, F.col(f"{m}.start").alias("medium_start"), F.col(f"{m}.type").alias("medium_type"), body.alias("medium"))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono samples as a RIFF WAVE file."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def wav_samples(data: bytes) -> bytes:
    """The bytes of a WAVE file's data chunk."""
    p = 12
    while p + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, p)
        if kind == b"data":
            return data[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def store_samples(df: DataFrame, payload: str = "payload", medium: str = "content") -> DataFrame:
    """df with the bytes of a column stored as 8-bit audio; null bytes as an empty recording."""
    return append_columns(df, [payload], T.StructType([T.StructField(medium, T.BinaryType())]), lambda c: [[wav(b or b"") for b in c.to_pylist()]])


def features(samples: bytes) -> str:
    """Mean, root mean square and crossings of the mid level of 8-bit samples, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    above = x >= 128
    return f"pcm_u8 n={len(x)} mean={x.mean():.4f} rms={np.sqrt((x * x).mean()):.4f} crossings={int((above[1:] != above[:-1]).sum())}" if len(x) else "pcm_u8 n=0"


def read_samples(df: DataFrame, medium: str = "medium") -> DataFrame:
    """df with samples (binary, read back from a WAVE column), tail_crc32 of their last 64 bytes, and feature."""

    def kernel(column):
        read: Iterator[bytes] = [wav_samples(b) for b in column.to_pylist()]
        return [pa.array(read, pa.binary()), [zlib.crc32(b[-64:]) for b in read], [features(b) for b in read]]

    fields = [T.StructField("samples", T.BinaryType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())]
    return append_columns(df, [medium], T.StructType(fields), kernel)
