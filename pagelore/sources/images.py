"""Images as rows: files by size and kind, dimensions from their headers before any pixel is decoded, and decoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("png", "jpg", "jpeg", "bmp", "webp")


def image_files(spark: SparkSession, folder: str, *, max_bytes: int, recursive: bool = False) -> DataFrame:
    """path, length, content of the images of a folder that are not too large. The size is metadata: larger files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where((F.col("length") <= max_bytes) & kind.isin(*KINDS)).select("path", "length", "content")


def dimensions_of(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, BMP, WebP or JPEG bytes; None if the header says neither."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def orientation_of(data: bytes) -> int | None:
    """The orientation tag of a JPEG's EXIF block."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return None
    tiff = data[at + 6 :]
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return None
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    start = number(4, 4)
    for k in range(number(start, 2)):
        entry = start + 2 + 12 * k
        if number(entry, 2) == 0x0112:
            return number(entry + 8, 2)
    return None


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of eight bits a channel, not interlaced: height x width x channels."""
    at, parts, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if not head or head[2] != 8 or head[6]:
        raise ValueError("only plain PNGs of eight bits a channel")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.int64)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            row = np.cumsum(row.reshape(w, n), axis=0).ravel() & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            for x in range(w * n):
                a, b, c = (row[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (row[x] + guess) & 255
        out[y] = above = row
    image = out.astype(np.uint8).reshape(h, w, n)
    return palette[image[..., 0]] if head[3] == 3 else image


def decode(data: bytes) -> np.ndarray:
    """Pixels, turned upright. PNG is decoded here; other kinds need Pillow, if it is installed."""
    from pagelore.functions.pixels import oriented

    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    try:
        import io

        from PIL import Image
    except ImportError:
        raise ValueError("only PNG can be decoded without Pillow") from None
    return oriented(np.asarray(Image.open(io.BytesIO(data))), orientation_of(data))


def with_dimensions(files: DataFrame, max_pixels: int) -> DataFrame:
    """files with w, h: those with a header and no more pixels than the limit. Only headers are looked at."""
    rows = T.StructType([*files.schema.fields, T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [dimensions_of(c) or (0, 0) for c in pdf["content"]]
            pdf = pdf.assign(w=[s[0] for s in sizes], h=[s[1] for s in sizes])
            yield pdf[(pdf["w"] > 0) & (pdf["h"] > 0) & (pdf["w"].astype("int64") * pdf["h"] <= max_pixels)]

    return files.mapInPandas(run, rows)


def decoded(files: DataFrame) -> DataFrame:
    """path, w, h, channels, data: tight rows of the decoded pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [decode(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "w": [i.shape[1] for i in images], "h": [i.shape[0] for i in images], "channels": [i.shape[2] for i in images], "data": [i.tobytes() for i in images]})

    return files.mapInPandas(run, "path string, w int, h int, channels int, data binary")
