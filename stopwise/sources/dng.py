"""Camera-raw DNG frames: sensor mosaics or linear colour and their metadata, uncompressed or lossless JPEG.

A DNG is a TIFF whose main directory or one of whose sub-directories is a colour filter array or linear raw colour. Samples keep their raw
numbers; black and white levels go beside them to ``operators.mosaic``. Lossless JPEG is decoded for all tiles at once (``ljpeg``). Other compressions are
told apart by ``inspect`` and raise in ``decode``; of sensors without a 2 x 2 pattern the samples are decoded, and ``operators.frames`` doesn't measure them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import ship
from stopwise.sources import ljpeg, tags
from stopwise.sources.blocks import assemble
from stopwise.sources.tags import BITS, COMPONENTS, COMPRESSION, HEIGHT, MAKE, MODEL, PHOTOMETRIC, WIDTH, directories

# Tags of the format.
PATTERN, BLACK, WHITE, OPCODES = 33422, 50714, 50717, (51008, 51009, 51022)
F_NUMBER, EXPOSURE, FOCAL, ISO, LENS, DNG_VERSION = 33437, 33434, 37386, 34855, 42036, 50706
MOSAIC, LINEAR = 32803, 34892


def text(value: object) -> str | None:
    """Without what follows a NUL and without blanks around it; None if nothing is left."""
    return (value.split(b"\0")[0].decode("latin-1").strip() or None) if isinstance(value, bytes) else None


def number(value: object) -> float | None:
    return float(value[0]) if isinstance(value, tuple) and value and np.isfinite(value[0]) else None


def raw_directory(found: list):
    """The directory of the sensor's samples; None if there is none."""
    kinds = [d.get(PHOTOMETRIC, (0,))[0] for d in found]
    return next((d for kind in (MOSAIC, LINEAR) for d, k in zip(found, kinds) if k == kind), None)


def info(data) -> dict:
    """Metadata of a frame, of bytes or ``tags.Ranged``; nothing of the pixels is read."""
    _, found = directories(data)
    raw = raw_directory(found)
    of = lambda tag: next((d[tag] for d in found if tag in d), None)
    shown = raw or found[0]
    cells = shown.get(PATTERN)
    pattern = "".join("RGB"[c] if c < 3 else "?" for c in cells) if isinstance(cells, (bytes, tuple)) else None
    iso = of(ISO)
    return {
        "source_kind": "cfa" if raw and raw[PHOTOMETRIC][0] == MOSAIC else "rgb",
        "camera_make": text(of(MAKE)), "camera_model": text(of(MODEL)), "lens_model": text(of(LENS)),
        "width": shown[WIDTH][0], "height": shown[HEIGHT][0], "components": shown.get(COMPONENTS, (1,))[0], "bits_per_sample": shown.get(BITS, (1,))[0],
        "cfa_pattern": pattern, "compression": shown.get(COMPRESSION, (1,))[0],
        "black_level": [float(x) for x in shown.get(BLACK, ())] or None, "white_level": [float(x) for x in shown.get(WHITE, ())] or None,
        "focal_length_mm": number(of(FOCAL)), "f_number": number(of(F_NUMBER)), "exposure_time_s": number(of(EXPOSURE)),
        "iso": int(iso[0]) if iso else None, "corrections": ",".join(f"OpcodeList{k}" for k, t in enumerate(OPCODES, 1) if any(t in d for d in found)), "is_dng": DNG_VERSION in found[0],
    }


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Metadata and the raw numbers: a mosaic's as (height, width), linear colour's as (height, width, 3)."""
    i = info(data)
    order, found = directories(data)
    raw = raw_directory(found)
    bits, packed = i["bits_per_sample"], i["compression"]
    if raw is None or packed not in (1, 7) or bits > 16 or packed == 1 and bits not in (8, 16) or i["components"] != (1 if i["source_kind"] == "cfa" else 3):
        raise ValueError(f"unsupported DNG: {i}")

    def samples(found: list[tuple]) -> list[np.ndarray]:
        parts = [data[a : a + n] for *_, a, n in found]
        return ljpeg.decode(parts) if packed == 7 else [np.frombuffer(p, order + "u2" if bits == 16 else "u1") for p in parts]

    out = assemble(raw, np.uint16, samples)
    return i, out[:, :, 0] if i["components"] == 1 else out


def encode(samples: np.ndarray, pattern: str = "RGGB", black: int = 0, white: int = 65535, lens: str = "", f_number: tuple[int, int] = (8, 1), focal: int = 50, exposure: tuple[int, int] = (1, 60), iso: int = 100, opcodes: int = 0) -> bytes:
    """A plain 16-bit DNG of a mosaic (h, w) or of linear colour (h, w, 3), for fixtures; ``opcodes``: how many of the opcode lists it has."""
    h, w = samples.shape[:2]
    parts = 1 if samples.ndim == 2 else 3
    raw = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [16]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [MOSAIC if parts == 1 else LINEAR]), (COMPONENTS, 3, [parts])]
    raw += [(tags.STRIPS, 4, None), (tags.STRIP_BYTES, 4, None), (tags.ROWS, 4, [h]), (BLACK, 4, [black]), (WHITE, 4, [white])]
    raw += [(PATTERN, 1, bytes("RGB".index(c) for c in pattern))] if parts == 1 else []
    raw += [(t, 7, b"list") for t in OPCODES[:opcodes]]
    exif = [(F_NUMBER, 5, f_number), (FOCAL, 5, (focal, 1)), (EXPOSURE, 5, exposure), (ISO, 3, [iso]), (LENS, 2, lens.encode() + b"\0")]
    main = [(WIDTH, 4, [1]), (HEIGHT, 4, [1]), (PHOTOMETRIC, 3, [2]), (MAKE, 2, b"maker\0"), (DNG_VERSION, 1, b"\1\4\0\0")]
    return tags.encode([np.ascontiguousarray(samples, "<u2").tobytes()], main, raw, exif)


def levels(info: dict) -> tuple[list[float], list[float]]:
    """Black and white levels of the four places of a cell, or of three components."""
    top, n = float((1 << info["bits_per_sample"]) - 1), 3 if info["components"] == 3 else 4
    four = lambda v: v * (n // len(v)) if n % len(v) == 0 else v[:n]
    return four(info["black_level"] or [0.0]), four(info["white_level"] or [top])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A flat folder's DNG files: path, content."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{dng,DNG}").load(folder).select("path", "content")


SCHEMA = (
    "source_kind string, camera_make string, camera_model string, lens_model string, width int, height int, components int, bits_per_sample int, cfa_pattern string,"
    " compression int, black_level array<double>, white_level array<double>, focal_length_mm double, f_number double, exposure_time_s double, iso int, corrections string, is_dng boolean"
)


def inspect(found: DataFrame) -> DataFrame:
    """path, metadata columns of SCHEMA and corrections_present (null if it can't be told) of files (path, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, **info(c)} for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, dtype=object)

    rows = found.select("path", "content").mapInPandas(work, f"path string, {SCHEMA}")
    return rows.withColumn("corrections_present", F.when(F.col("is_dng"), F.col("corrections") != ""))


def mosaics(found: DataFrame) -> DataFrame:
    """path, width, height, pattern, black, white, y and one row of raw numbers, of files (path, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                i, plane = decode(content)
                black, white = levels(i)
                for a in range(0, len(plane), 64):
                    some = plane[a : a + 64].astype(float)
                    n = len(some)
                    yield pd.DataFrame(
                        {"path": [path] * n, "width": [i["width"]] * n, "height": [i["height"]] * n, "pattern": [i["cfa_pattern"]] * n, "black": [black] * n, "white": [white] * n, "y": range(a, a + n), "samples": list(some)}
                    )

    return found.select("path", "content").mapInPandas(work, "path string, width int, height int, pattern string, black array<double>, white array<double>, y int, samples array<double>")
