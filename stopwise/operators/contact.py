"""Contact sheets: display samples, nearest thumbnails, tile places, labels, and the PNG writer."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.arrays import let, upto
from stopwise.operators.glyphs import raster

# The sheet's measures in pixels.
THUMB_W, THUMB_H, LABEL_H, PAD, MOST_COLUMNS = 96, 72, 12, 6, 4
TILE_W, TILE_H = THUMB_W + 2 * PAD, THUMB_H + LABEL_H + 2 * PAD
GLYPHS = THUMB_W // 4  # glyphs are 3 wide, with a gap of 1
LABEL_DROP = 3
#: Rows of tiles that a task draws at once.
BAND_ROWS = 64
#: Bands that a task draws, and reads back, about.
BANDS_DRAWN, BANDS_READ = 16, 64
BACKGROUND, TILE_BACKGROUND, TEXT = (18, 20, 22), (34, 37, 40), (226, 230, 232)


def to_byte(value: Column) -> Column:
    """0..1 to 0..255, rounding half up."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def thumbnail(samples: Column, width: int, height: int, to_w: int = THUMB_W, to_h: int = THUMB_H) -> Column:
    """Nearest samples as bytes, row-major."""

    def at(i: Column) -> Column:
        x = F.floor((i % to_w) * width / to_w).cast("int")
        y = F.floor(F.floor(i / to_w) * height / to_h).cast("int")
        return to_byte(F.get(samples, y * width + x))

    return F.transform(upto(to_w * to_h), at)


def places(n: Column, index: Column) -> tuple[Column, Column, Column, Column]:
    """Columns, rows, and the left and top of tile ``index`` of ``n``."""
    columns = F.least(n, F.lit(MOST_COLUMNS))
    rows = F.ceil(n / columns)
    return columns, rows, (index % columns) * TILE_W, F.floor(index / columns) * TILE_H


def label(path: Column, f_number: Column) -> Column:
    """Stem and aperture, cleaned: lower-case printable ASCII, others as '?', cut to what fits."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    stem = F.when(stem == "", "frame").otherwise(stem)
    usable = f_number.isNotNull() & ~F.isnan(f_number) & (F.abs(f_number) != float("inf"))
    text = F.when(usable, F.concat(stem, F.lit(" f/"), F.format_string("%.1f", f_number))).otherwise(stem)
    return F.substring(F.lower(F.regexp_replace(text, "[^ -~]", "?")), 1, GLYPHS)


def display(samples: Column, width: int, height: int, components: Column) -> Column:
    """Thumbnail bytes of a plane (gray, 96 x 72) or, of three components, of a picture (red, green, blue together)."""

    def part(k: int) -> Column:
        return let(F.transform(upto(width * height), lambda i: F.get(samples, i * 3 + k)), lambda s: thumbnail(s, width, height))

    zipped = F.zip_with(F.zip_with(part(0), part(1), lambda r, g: F.array(r, g)), part(2), lambda rg, b: F.concat(rg, F.array(b)))
    return F.when(components == 3, F.flatten(zipped)).otherwise(thumbnail(samples, width, height))


def draw(tiles: list[tuple[np.ndarray, str]], columns: int | None = None) -> np.ndarray:
    """Rows of tiles: thumbnails (gray or colour bytes) and their labels, in order."""
    columns = columns or min(len(tiles), MOST_COLUMNS)
    image = np.empty((-(-len(tiles) // columns) * TILE_H, columns * TILE_W, 3), np.uint8)
    image[:] = BACKGROUND
    for i, (thumb, text) in enumerate(tiles):
        y, x = i // columns * TILE_H, i % columns * TILE_W
        image[y : y + TILE_H, x : x + TILE_W] = TILE_BACKGROUND
        image[y + PAD : y + PAD + THUMB_H, x + PAD : x + PAD + THUMB_W] = thumb.reshape(THUMB_H, THUMB_W, -1)
        letters = raster(text[:GLYPHS])
        at = y + PAD + THUMB_H + LABEL_DROP
        image[at : at + letters.shape[0], x + PAD : x + PAD + letters.shape[1]][letters] = TEXT
    return image


# A sheet is drawn in bands of tile rows. Each band is compressed by itself, up to a byte; one after another they are the picture's data, and
# the checksum of the whole follows from those of the bands.


def packed(image: np.ndarray, last: bool) -> tuple[bytes, int, int]:
    """Compressed rows of a band, its Adler checksum and its length before compression."""
    rows = np.zeros((len(image), image[0].size + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = image.reshape(len(image), -1)
    raw = rows.tobytes()
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return pack.compress(raw) + pack.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH), zlib.adler32(raw), len(raw)


def joined_adler(first: int, second: int, n: int) -> int:
    """Of two texts one after another; ``n``: length of the second."""
    base = 65521
    a = ((first & 0xFFFF) + (second & 0xFFFF) - 1) % base
    b = ((first >> 16) + (second >> 16) + n * ((first & 0xFFFF) - 1)) % base
    return b << 16 | a


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


#: A last block of compressed data that holds nothing.
NO_ROWS = b"\x03\x00"


class Sheet:
    """A PNG file from its bands in order."""

    def __init__(self, out, width: int, height: int):
        self.out, self.adler, self.size = out, 1, 0
        self._write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c"))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes, adler: int, n: int) -> None:
        self._write(chunk(b"IDAT", data))
        self.adler = joined_adler(self.adler, adler, n)

    def close(self, ended: bool = True) -> None:
        """``ended``: the last band was packed as the last one; else an empty block ends the picture's data."""
        self._write(chunk(b"IDAT", (b"" if ended else NO_ROWS) + struct.pack(">I", self.adler)) + chunk(b"IEND", b""))


def pixels_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Pictures as bytes; a column of lists or of binary values."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [np.frombuffer(t.as_buffer(), np.uint8) for t in column]
    if any(c.null_count or c.flatten().null_count for c in column.chunks):
        raise ValueError("a picture or a sample of it is null")
    out = []
    for part in column.chunks:
        values, offsets = part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()
        if len(values) and not (values.min() >= 0 and values.max() <= 255):
            raise OverflowError("a sample is no byte")
        out += np.split(values.astype(np.uint8), offsets[1:-1])
    return out


def enlarged(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """``thumbnail`` of samples that are bytes already."""
    x, y = np.arange(THUMB_W) * width // THUMB_W, np.arange(THUMB_H) * height // THUMB_H
    return pixels.reshape(height, width, -1)[y[:, None], x]


BAND = "run_id {0}, band int, data binary, adler long, size long"


def bands(tiles: DataFrame, rows: int = BAND_ROWS, side: tuple[int, int] | None = None) -> DataFrame:
    """run_id, band, width and height of its sheet, and the compressed data of ``rows`` rows of tiles.

    ``tiles``: run_id, input_index (0, 1, ... in each run), thumb (bytes as ints or binary, gray or colour), label. A task draws a band and no more.
    ``side``: width and height of thumb where it isn't a thumbnail yet; small pictures travel as they are and become thumbnails where they are drawn.
    """
    # a run of fewer tiles than a row takes has one band, so that bands need not know the run's size
    placed = tiles.select("run_id", "input_index", "thumb", "label").withColumn("band", F.floor(F.col("input_index") / MOST_COLUMNS / rows).cast("int"))

    def work(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("input_index")
        columns = MOST_COLUMNS if key[1].as_py() else min(len(group), MOST_COLUMNS)
        thumbs = pixels_of(group.column("thumb"))
        if side:
            thumbs = [enlarged(t, *side) for t in thumbs]
        data, adler, size = packed(draw([(t, text or "") for t, text in zip(thumbs, group.column("label").to_pylist())], columns), False)
        made = [key[0].as_py(), key[1].as_py(), data, adler, size]
        return pa.table({c: pa.array([v], t or key[0].type) for c, v, t in zip(NAMES, made, KINDS)})

    kind = tiles.schema["run_id"].dataType.simpleString()
    parts = max(tiles.sparkSession.sparkContext.defaultParallelism, -(-tiles.count() // (rows * MOST_COLUMNS * BANDS_DRAWN)))  # the work goes by tiles and not by bytes of the rows
    made = placed.repartition(parts, "run_id", "band").groupBy("run_id", "band").applyInArrow(work, BAND.format(kind))
    n = tiles.groupBy(F.col("run_id").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    columns, tall, _, _ = places(F.col("n"), F.lit(0))
    sized = made.join(n, F.col("run_id").eqNullSafe(F.col("of")))
    return sized.select("run_id", "band", (columns * TILE_W).cast("int").alias("width"), (tall * TILE_H).cast("int").alias("height"), "data", "adler", "size")


NAMES = ("run_id", "band", "data", "adler", "size")
KINDS = (None, pa.int32(), pa.binary(), pa.int64(), pa.int64())


def sheets(tiles: DataFrame, folder: str, rows: int = BAND_ROWS, side: tuple[int, int] | None = None) -> DataFrame:
    """Write every run's sheet as a PNG file: run_id, uri, width, height, bands, bytes, starts (where in the file each band is).

    Bands come to a run's task in order and go to the file one by one. Files have fresh names, so a retried task leaves an unused one behind. A run without tiles
    has no sheet.
    """
    made = bands(tiles, rows, side)
    kind = tiles.schema["run_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = sheet = stream = uri = of = None
        done, starts = [], []

        def finish() -> None:
            sheet.close(ended=False)
            stream.close()
            done.append((run, uri, *size, len(starts), sheet.size, starts))

        for batch in batches:
            of = batch.schema.field("run_id").type
            for row in batch.to_pylist():
                if sheet is None or row["run_id"] != run:
                    if sheet is not None:
                        finish()
                    run, size, starts = row["run_id"], (row["width"], row["height"]), []
                    uri = f"{folder}/{uuid.uuid4().hex}.png"
                    fs, path = FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(path)
                    sheet = Sheet(stream, *size)
                starts.append(sheet.size)
                sheet.add(row["data"], row["adler"], row["size"])
        if sheet is not None:
            finish()
        names = ("run_id", "uri", "width", "height", "bands", "bytes", "starts")
        if done:
            kinds = (of, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], list(names))

    dealt = made.repartition("run_id").sortWithinPartitions("run_id", "band")
    return dealt.mapInArrow(work, f"run_id {kind}, uri string, width int, height int, bands int, bytes long, starts array<long>")


def _chunk_at(file, at: int) -> tuple[bytes, bytes]:
    n, kind = struct.unpack(">I4s", file.read_at(8, at))
    data = file.read_at(n + 4, at + 8)
    if zlib.crc32(kind + data[:n]) != int.from_bytes(data[n:]):
        raise ValueError("damaged chunk")
    return kind, data[:n]


def read_band(file, start: int, width: int) -> tuple[np.ndarray, int, int]:
    """Of an open sheet the rows of tiles, (n, 96, width, 3), of the band at ``start``, without reading the others; its Adler checksum and length before compression."""
    kind, data = _chunk_at(file, start)
    raw = zlib.decompressobj(-15).decompress(data)
    if kind != b"IDAT" or len(raw) % ((1 + 3 * width) * TILE_H):
        raise ValueError("a band ends amidst its rows")
    return np.frombuffer(raw, np.uint8).reshape(-1, 1 + 3 * width)[:, 1:].reshape(-1, TILE_H, width, 3), zlib.adler32(raw), len(raw)


def band_sums(made: DataFrame) -> DataFrame:
    """Sheets of ``sheets`` read back, band by band in tasks of their own: uri, and the sum of all bytes of all thumbnails. Checksums of chunks and of whole sheets are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fs, path = FileSystem.from_uri(row["uri"])
                with fs.open_input_file(path) as file:
                    rows, adler, size = read_band(file, row["start"], row["width"])
                grid = rows.reshape(-1, TILE_H, row["width"] // TILE_W, TILE_W, 3)
                used = (grid[:, 0, :, 0] != BACKGROUND).any(-1)  # a place behind the last tile has no tile's background
                total = grid[:, PAD : PAD + THUMB_H, :, PAD : PAD + THUMB_W].sum((1, 3, 4), dtype=np.int64)[used].sum()
                out.append((row["uri"], row["band"], int(total), adler, size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), *[pa.int64()] * 4))], ["uri", "band", "total", "adler", "size"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                adler = 1
                for part in row["parts"]:
                    adler = joined_adler(adler, part["adler"], part["size"])
                fs, path = FileSystem.from_uri(row["uri"])
                with fs.open_input_file(path) as file:
                    end = _chunk_at(file, row["bytes"] - 12)
                    kind, last = _chunk_at(file, row["bytes"] - 12 - 12 - len(NO_ROWS) - 4)
                if end != (b"IEND", b"") or (kind, last) != (b"IDAT", NO_ROWS + struct.pack(">I", adler)):
                    raise ValueError("a sheet isn't what was read of it")
            yield batch.select(["uri", "thumb_sum"])

    n = made.agg(F.coalesce(F.sum("bands"), F.lit(0))).first()[0]
    dealt = made.select("uri", "width", F.posexplode("starts").alias("band", "start")).repartition(max(made.sparkSession.sparkContext.defaultParallelism, -(-n // BANDS_READ)), "uri", "band")
    found = dealt.mapInArrow(read, "uri string, band long, total long, adler long, size long")
    sums = found.groupBy("uri").agg(F.sum("total").alias("thumb_sum"), F.array_sort(F.collect_list(F.struct("band", "adler", "size"))).alias("parts"))
    return sums.join(made.select("uri", "bytes"), "uri").select("uri", "bytes", "thumb_sum", "parts").mapInArrow(whole, "uri string, thumb_sum long")


def read_rows(uri: str) -> Iterator[np.ndarray]:
    """A written sheet's rows of tiles, (96, width, 3) each; all checksums are verified."""
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as file:
        if file.read(8) != b"\x89PNG\r\n\x1a\n":
            raise ValueError("not a PNG")
        unpack, held, width = zlib.decompressobj(), b"", 0
        while True:
            n, kind = struct.unpack(">I4s", file.read(8))
            data, (crc,) = file.read(n), struct.unpack(">I", file.read(4))
            if zlib.crc32(kind + data) != crc:
                raise ValueError("damaged chunk")
            if kind == b"IHDR":
                width = struct.unpack_from(">I", data)[0]
            elif kind == b"IDAT":
                held += unpack.decompress(data)
                step = (1 + 3 * width) * TILE_H
                for a in range(0, len(held) - step + 1, step):
                    yield np.frombuffer(held[a : a + step], np.uint8).reshape(TILE_H, -1)[:, 1:].reshape(TILE_H, width, 3)
                held = held[len(held) // step * step :]
            elif kind == b"IEND":
                break
        if held or not unpack.eof:
            raise ValueError("a sheet ends amidst its rows")


def check_output(out: str, inputs: list[str]) -> None:
    """Before any decoding: the output is none of the inputs, its folder is there, and it is no folder itself."""
    if os.path.isdir(out):
        raise ValueError(f"output is a folder: {out}")
    if not os.path.isdir(os.path.dirname(os.path.abspath(out))):
        raise ValueError(f"output folder is missing: {out}")
    if {os.path.abspath(out), os.path.realpath(out)} & {p for i in inputs for p in (os.path.abspath(i), os.path.realpath(i))}:
        raise ValueError(f"output would replace an input: {out}")


def write_atomic(out: str, data: bytes) -> None:
    """A temporary neighbour, then a rename; on failure the temporary file goes, if it was ours."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(out)), suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, out)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise
