"""Baseline TIFF frames by Spark's binary file source and a vectorised decoder.

Gray or RGB, 8 or 16 bits unsigned or 32 bits float, in strips or tiles, components together or apart, either byte order; plain, PackBits,
LZW or deflate, with or without horizontal differences. Spark's own image source is not used: it gives 8 bits a sample.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import ship
from stopwise.sources import tags
from stopwise.sources.blocks import assemble

def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(start), [], b""
    held = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        code = held >> (bits - width) & (1 << width) - 1
        bits -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("damaged LZW data")
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last and len(table) < 4096:
            table.append(last + now[:1])
        last = now
        width = min(max(9, (len(table) + 1).bit_length()), 12)


#: By the number that a file gives its compression.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def info(data) -> dict:
    """Width, height, components, bits: nothing of the pixels is read."""
    t = tags.directories(data)[1][0]
    get = lambda tag: t.get(tag, (1,))[0]
    return {"width": t[tags.WIDTH][0], "height": t[tags.HEIGHT][0], "components": get(tags.COMPONENTS), "bits": get(tags.BITS), "format": get(tags.FORMAT)}


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Information, and samples as doubles in 0..1 for integers, row-major with components together."""
    order, (t, *_) = tags.directories(data)
    i = info(data)
    kinds = {(8, 1): ("u1", 255), (16, 1): ("u2", 65535), (32, 3): ("f4", 1)}
    packed, differences = t.get(tags.COMPRESSION, (1,))[0], t.get(tags.PREDICTOR, (1,))[0]
    if (i["bits"], i["format"]) not in kinds or packed not in UNPACK or differences not in (1, 2) or i["components"] not in (1, 3):
        raise ValueError(f"unsupported TIFF: {i}")
    if differences == 2 and i["format"] != 1:
        raise ValueError("unsupported TIFF: differences of floats")
    kind, top = kinds[i["bits"], i["format"]]

    def samples(found: list[tuple]) -> list[np.ndarray]:
        out = []
        for _, _, _, rows, columns, a, n in found:
            block = np.frombuffer(UNPACK[packed](data[a : a + n]), order + kind)
            if differences == 2:
                block = np.cumsum(block.reshape(rows, columns, -1), axis=1, dtype=kind)
            out.append(block)
        return out

    return i, assemble(t, kind, samples).ravel().astype(float) / top


def encode(samples: np.ndarray, bits: int = 16, packed: int = 1, pack=bytes, differences: bool = False, tile: tuple[int, int] | None = None, planar: bool = False) -> bytes:
    """A little-endian TIFF of an (h, w) or (h, w, 3) array of integers, for fixtures; ``pack`` makes the compression ``packed``.

    One strip, or tiles of (rows, columns); with ``planar`` components lie apart.
    """
    image = np.ascontiguousarray(samples, "<u2" if bits == 16 else "u1")
    h, w = image.shape[:2]
    image = image.reshape(h, w, -1)
    parts = image.shape[2]
    rows, columns = tile or (h, w)
    image = np.pad(image, ((0, -h % rows), (0, -w % columns), (0, 0)), mode="edge")
    bodies = []
    for plane in [image[:, :, k : k + 1] for k in range(parts)] if planar else [image]:
        for y in range(0, h, rows):
            for x in range(0, w, columns):
                block = plane[y : y + rows, x : x + columns]
                if differences:
                    block = np.diff(block, axis=1, prepend=block.dtype.type(0)).astype(block.dtype)
                bodies.append(pack(np.ascontiguousarray(block).tobytes()))
    at = [8 + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    values = {256: [w], 257: [h], 258: [bits], 259: [packed], 262: [1 if parts == 1 else 2], 277: [parts], 284: [2 if planar else 1], 317: [2 if differences else 1], 339: [1]}
    values |= {322: [columns], 323: [rows], 324: at, 325: [len(b) for b in bodies]} if tile else {273: at, 278: [h], 279: [len(b) for b in bodies]}
    body = b"".join(bodies)
    body += bytes(len(body) % 2)
    free = 8 + len(body) + 6 + 12 * len(values)
    table, extra = struct.pack("<H", len(values)), b""
    for tag, v in sorted(values.items()):
        raw = struct.pack(f"<{len(v)}I", *v)
        table += struct.pack("<HHI", tag, 4, len(v)) + (raw if len(v) == 1 else struct.pack("<I", free + len(extra)))
        extra += raw if len(v) > 1 else b""
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + table + bytes(4) + extra


def preflight(paths: list[str]) -> None:
    """Each path is a regular file, checked before anything is decoded."""
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
        if not os.path.isfile(p):
            raise ValueError(f"not a regular file: {p}")


def files(spark: SparkSession, folder: str, names: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """A flat folder's TIFF files: path, content, length."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "content", "length")


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, components, bits."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [info(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], **{k: [r[k] for r in rows] for k in ("width", "height", "components", "bits")}})

    return files(spark, folder).mapInPandas(work, "path string, width int, height int, components int, bits int")


def strips(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded rows: path, y, width, height, components, samples."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                i, samples = decode(content)
                rows = samples.reshape(i["height"], -1)
                yield pd.DataFrame(
                    {"path": path, "y": np.arange(i["height"], dtype=np.int32), "width": i["width"], "height": i["height"], "components": i["components"], "samples": list(rows)}
                ).astype({"width": "int32", "height": "int32", "components": "int32"})

    return files(spark, folder).mapInPandas(work, "path string, y int, width int, height int, components int, samples array<double>")


def luma_planes(rows: DataFrame) -> DataFrame:
    """Rows of one component: path, y, width, height, samples."""
    from stopwise.operators.mosaic import luma

    return rows.select("path", "y", "width", "height", F.when(F.col("components") == 1, F.col("samples")).otherwise(luma(F.col("samples"), 3)).alias("samples"))
