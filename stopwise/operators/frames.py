"""From decoded frames to per-frame evidence: five zone patches, colour shift, falloff, bow and target squareness.

Frames are rows (path, content) of TIFF or DNG files. Of a mosaic the first green phase is measured, at half size, and red and
blue are filled in from their neighbours for the colour shift, only where a zone needs them. Each file is decoded once, one at a time in a task, and gives one
row: its metadata, what its zones measure, points of its candidate traces, and means of its rows and columns. That table is written, and all that
follows reads it. A frame of 40 million samples takes about 1 GB in its task.

Edge cases: a frame of one component has no colour shift (``unsupported_colour_channels``); a patch outside its plane, a
median that is not positive, an unreadable file and, in ``analyse``, corrections that are known to be there raise; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from stopwise.deploy import kept, tidied
from stopwise.operators import bow, capture, kernels, planes, target
from stopwise.operators.evidence import CORNERS, SHORT
from stopwise.operators.mosaic import BLUE, GREEN, LUMA, PATTERNS, RED
from stopwise.sources import dng, tiff

ZONES = ("centre", *CORNERS)


def zone_rects(width: int, height: int) -> dict[str, tuple[int, int, int, int]]:
    """(x, y, w, h) of the five zones, in integers as ``mosaic.zones``."""
    part = lambda n, num, den: min(max((n * num + den // 2) // den, 1), n)
    w, h, x, y = part(width, 13, 100), part(height, 13, 100), part(width, 45, 1000), part(height, 45, 1000)
    right, low = max(width - x - w, 0), max(height - y - h, 0)
    at = ((width - w) // 2, (height - h) // 2), (x, y), (right, y), (x, low), (right, low)
    return {zone: (*p, w, h) for zone, p in zip(ZONES, at)}


def cut(plane: np.ndarray, rect: tuple[int, int, int, int]) -> np.ndarray:
    """A patch of a plane; it must lie inside."""
    x, y, w, h = rect
    if min(rect) < 0 or not w or not h or y + h > plane.shape[0] or x + w > plane.shape[1]:
        raise ValueError(f"patch {rect} is not inside {plane.shape[1]} x {plane.shape[0]}")
    return plane[y : y + h, x : x + w]


class Picture:
    """A decoded frame of three components or one: the plane that is measured, and patches of red and blue."""

    def __init__(self, image: np.ndarray):
        self.size = image.shape[1], image.shape[0]
        self.image = image if image.shape[2] == 3 else None
        self.plane = image[:, :, 0] if self.image is None else image @ np.array(LUMA)

    def project(self, rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        """A rectangle of the frame on the plane."""
        return rect

    def colours(self, rect: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Red and blue there; None if the frame has none."""
        return None if self.image is None else (cut(self.image[:, :, 0], rect), cut(self.image[:, :, 2], rect))


def checked_levels(info: dict) -> tuple[np.ndarray, np.ndarray]:
    """Black levels, and what lies between black and white."""
    black, white = map(np.array, dng.levels(info))
    if not np.isfinite(black).all() or not (white > black).all():
        raise ValueError("levels are not finite or not in order")
    return black, white - black


class Mosaic:
    """A decoded sensor mosaic; its plane is the first green phase."""

    def __init__(self, info: dict, raw: np.ndarray):
        if info["cfa_pattern"] not in PATTERNS:
            raise ValueError(f"unsupported pattern: {info['cfa_pattern']}")
        self.size, self.raw, self.pattern = (info["width"], info["height"]), raw, info["cfa_pattern"]
        self.black, self.scale = (v.reshape(2, 2) for v in checked_levels(info))
        self.first = GREEN[self.pattern]
        x, y = self.first
        self.plane = (raw[y::2, x::2] - self.black[y, x]) / self.scale[y, x]

    def project(self, rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        """A rectangle of the frame on the grid of every second sample."""
        out = []
        for start, n, first in zip(rect[:2], rect[2:], self.first):
            at = max(start + (start - first) % 2, first)
            out.append(((at - first) // 2, (start + n - 1 - at) // 2 + 1))
        (x, w), (y, h) = out
        return x, y, w, h

    def colours(self, rect: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Red and blue at full size: own samples, else the mean of neighbours of the colour inside the frame."""
        x, y, w, h = rect
        x0, y0 = max(x - 1, 0), max(y - 1, 0)
        part = self.raw[y0 : y + h + 1, x0 : x + w + 1]
        out = []
        for px, py in (RED[self.pattern], BLUE[self.pattern]):
            on = np.zeros(part.shape)
            on[(py - y0) % 2 :: 2, (px - x0) % 2 :: 2] = 1
            value = on * (part - self.black[py, px]) / self.scale[py, px]
            total, count = (sum(np.pad(v, 1)[a : a + v.shape[0], b : b + v.shape[1]] for a in range(3) for b in range(3)) for v in (value, on))
            out.append(cut(total / np.maximum(count, 1), (x - x0, y - y0, w, h)))
        return out[0], out[1]


def opened(path: str, content: bytes) -> Picture | Mosaic:
    if capture.decoder_of(path) == "tiff":
        info, samples = tiff.decode(content)
        return Picture(samples.reshape(info["height"], info["width"], info["components"]))
    info, raw = dng.decode(content)
    if info["source_kind"] == "cfa":
        return Mosaic(info, raw)
    black, scale = checked_levels(info)
    return Picture((raw - black) / scale)


#: Metadata of a frame that go with its evidence.
KNOWN = ("source_kind", "camera_make", "camera_model", "lens_model", "focal_length_mm", "f_number", "corrections_present", "corrections")
SHORTS = ("centre", *SHORT)
MEASURED = (
    "path string, source_kind string, camera_make string, camera_model string, lens_model string, focal_length_mm double, f_number double, corrections_present boolean, corrections string, width int, height int, "
    + ", ".join(f"{v}_{c} double" for v in ("ac", "co", "lum") for c in SHORTS)
    + ", " + ", ".join(f"{v}_{c} {'string' if v == 'cb' else 'double'}" for v in ("cx", "cy", "cb") for c in SHORT)
    + f", points array<{planes.POINT_DDL}>, row_means array<double>, column_means array<double>"
)


def measured_row(path: str, content: bytes) -> dict:
    """One frame's row of MEASURED, but for its lists."""
    frame, info = opened(path, content), dng.info(content)
    row = {"path": path, "width": frame.plane.shape[1], "height": frame.plane.shape[0], **{k: info.get(k) for k in KNOWN}}
    row["corrections_present"] = info["corrections"] != "" if info["is_dng"] else None
    for c, (zone, rect) in zip(SHORTS, zone_rects(*frame.size).items()):
        row[f"ac_{c}"], row[f"co_{c}"], row[f"lum_{c}"] = kernels.measure(cut(frame.plane, frame.project(rect)))
        if zone != "centre":
            pair = frame.colours(rect)
            row[f"cx_{c}"], row[f"cy_{c}"], row[f"cb_{c}"] = kernels.shift(*pair) if pair is not None else (None, None, "unsupported_colour_channels")
    return row | {"points": planes.points(frame.plane), "row_means": pa.array(frame.plane.mean(1)), "column_means": pa.array(frame.plane.mean(0))}


def measured(files: DataFrame) -> DataFrame:
    """A row of MEASURED for each file; every file is decoded once."""
    lists = ("points", "row_means", "column_means")
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(MEASURED)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                row = measured_row(path, content.as_py())
                yield pa.RecordBatch.from_arrays([planes.listed([row[f.name]]) if f.name in lists else pa.array([row[f.name]], f.type) for f in schema], [f.name for f in schema])

    return files.select("path", "content").mapInArrow(tidied(work), MEASURED)


def frame_evidence(files: DataFrame) -> DataFrame:
    """One row a frame: path, its metadata (KNOWN) and what group evidence needs of it.

    ac_, co_ (centre and corners), lum_centre, fa_, cx_, cy_ and cb_ (corners), bow, bow_measured, bow_blocker, side, orientation, sagitta, span, residual, target_status, keystone_pct, target_axis, target_blockers.
    """
    m = kept(measured(files), "frames")
    whole = [c for c in m.columns if c not in ("width", "height", "points", "row_means", "column_means") and not c.startswith("lum_")]
    wide = m.select(*whole, "lum_centre", *[F.log2(F.col(f"lum_{c}") / F.col("lum_centre")).alias(f"fa_{c}") for c in SHORT])  # medians are positive, or their patch has raised
    bent = bow.point_bows(m.select(F.col("path").alias("run_id"), "width", "height", "points"))
    broken = F.array_contains(F.split("blockers", ","), "line_discontinuous")
    bent = bent.select(
        F.col("run_id").alias("path"), "bow", (F.col("method") == "measured_straight_line_bow").alias("bow_measured"), "side", "orientation", "sagitta", "span", "residual",
        F.when(F.col("method").isNull(), F.when(broken, "line_discontinuous").otherwise("no_straight_reference")).alias("bow_blocker"),
    )
    square = target.decide(target.keystones(target.profile_runs(target.profiles(m.select(F.col("path").alias("run_id"), "width", "height", "row_means", "column_means")))))
    square = square.select(F.col("run_id").alias("path"), F.col("status").alias("target_status"), F.col("keystone").alias("keystone_pct"), F.col("axis").alias("target_axis"), F.col("blockers").alias("target_blockers"))
    return wide.join(bent, "path").join(square, "path")


def analyse(files: DataFrame, captures: DataFrame) -> DataFrame:
    """Frames of runs, as the group operators take them.

    ``captures``: path, run_id, input_index, lens_model, focal_length_mm, f_number, corrections_present (null where unknown; true raises).
    """
    known = captures.select("path", "run_id", "input_index", "lens_model", "focal_length_mm", "f_number", capture.eligible(F.col("corrections_present")).alias("eligible"))
    return known.join(frame_evidence(files).drop(*KNOWN), "path")


def analyse_files(files: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """``analyse`` with what the files say of themselves; ``files``: path, content, run_id, input_index.

    ``captures`` (path, run_id, input_index), where they are known without the files, so that those are read or made once.
    """
    captures = files if captures is None else captures
    found = frame_evidence(files)
    return found.withColumn("eligible", capture.eligible(F.col("corrections_present"))).join(captures.select("path", "run_id", "input_index"), "path")
