"""Image sources: files through Spark's image reader, encoded bytes, raw pixels; and the dictionary reader."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.image import ImageSchema
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.schemas import IMAGE
from glyphmill.sources.jpeg import jpeg_pixels


def image_files(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """image_id (a hash of the place), origin and pixels of PNG, JPEG and other files. Unreadable ones have height -1 unless dropped."""
    images = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    return images.select(F.xxhash64("origin").alias("image_id"), "*")


def image_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files; the schema is fixed, as streams need."""
    images = spark.readStream.format("image").schema(ImageSchema.imageSchema).load(path).select("image.*")
    return images.select(F.xxhash64("origin").alias("image_id"), "*")


def raw_images(spark: SparkSession, images: list[tuple[int, np.ndarray]]) -> DataFrame:
    """In-memory 8-bit RGB arrays as image rows (blue first, as Spark stores them)."""
    rows = [(n, "", a.shape[0], a.shape[1], 3, 16, bytearray(np.ascontiguousarray(a[:, :, ::-1]).tobytes())) for n, a in images]
    return spark.createDataFrame(rows, "image_id long, origin string, height int, width int, nChannels int, mode int, data binary")


def image_bytes(df: DataFrame, key: str = "image_id", content: str = "content") -> DataFrame:
    """Image rows from a column of encoded bytes, such as spark.read.format("binaryFile") has, decoded where they stand.

    PNG and baseline JPEG are decoded here, other formats where Pillow is installed; what can't be decoded, null bytes included, has
    height -1, as in Spark's image source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                img = decoded(data) if data else None
                rows.append((-1, -1, -1, -1, b"") if img is None else (*img.shape[:2], 3, 16, img[:, :, ::-1].tobytes()))
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate([*[pa.int32()] * 4, pa.binary()])]
            origin = pa.array([""] * len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), origin, *columns], names=IMAGE.names)

    return df.select(F.col(key).cast("long").alias("image_id"), F.col(content).cast("binary")).mapInArrow(run, IMAGE)


def decoded(data: bytes) -> np.ndarray | None:
    """The pixels of an encoded image, red first; None if it can't be decoded."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        try:
            return png_pixels(data)
        except (ValueError, zlib.error, struct.error):
            return None
    try:
        from PIL import Image
    except ImportError:
        try:
            return jpeg_pixels(data) if data.startswith(b"\xff\xd8") else None
        except (ValueError, KeyError, IndexError, TypeError, struct.error):  # a broken file: sizes, tables or codes that aren't there
            return None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception:  # a broken image fails in as many ways as there are formats
        return None


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG of 8 or 16 bits a sample (or a palette of up to 8), interlaced or not; alpha is dropped, 16 bits become 8."""
    at, body, palette, header = 8, b"", None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or interlaced > 1 or not width or not height or (depth not in (8, 16) and channels > 1) or (colour == 3 and palette is None):
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if interlaced:
        pixels, at = np.zeros((height, width, channels), np.uint8), 0
        for y, x, down, across in PASSES:
            size = len(range(y, height, down)), len(range(x, width, across))
            if all(size):
                pixels[y::down, x::across], at = _samples(raw, at, *size, channels, depth)
    else:
        pixels, _ = _samples(raw, 0, height, width, channels, depth)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[pixels[:, :, 0]]
    if colour == 0 and depth < 8:
        pixels = (pixels.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(pixels[:, :, :1], 3, 2) if channels < 3 else pixels[:, :, :3]


# First row and column, and steps down and across, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _samples(raw: np.ndarray, at: int, height: int, width: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """The samples (8 bits of 16, or as they are) of filtered rows from a place on, and the place after them."""
    line, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    end = at + height * (line + 1)
    rows = raw[at:end].reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
    for y in range(height):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:].astype(np.int64), above, step)
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, :width]
        out = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
    elif depth == 16:
        out = out[:, ::2]
    return out.reshape(height, width, channels), end


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its differences to the left, to the row above, to their mean or to the nearest of three neighbours."""
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) & 255
    if kind == 1:
        padded = np.pad(row, (0, -len(row) % step)).reshape(-1, step)
        return (np.cumsum(padded, 0) & 255).ravel()[: len(row)]
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out = row.copy()
    for x in range(len(row)):
        left, up = int(out[x - step]) if x >= step else 0, int(above[x])
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = int(above[x - step]) if x >= step else 0
            far = [(abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)]
            guess = min(far)[2]
        out[x] = (int(row[x]) + guess) & 255
    return out


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An image row's pixels, red first, three channels; ValueError if sizes and data disagree."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def png(pixels: np.ndarray) -> bytes:
    """8-bit RGB pixels as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    header = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """class_id and ch: blank first, the file's lines in order, a space last."""
    lines = F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")
    whole = spark.read.text(path, wholetext=True)
    listed = F.concat(F.array(F.lit("blank")), lines, F.array(F.lit(" ")))
    return whole.select(F.posexplode(listed).alias("class_id", "ch"))


def dictionary_of(spark: SparkSession, characters: list[str]) -> DataFrame:
    rows = list(enumerate(["blank", *characters, " "]))
    return spark.createDataFrame(rows, "class_id int, ch string")
