"""DNG files made here: plain and lossless JPEG mosaics, strips and tiles."""

import struct

import numpy as np
import pytest

from stopwise.sources import dng
from stopwise.sources import ljpeg as ljpeg_

SIZES = (*range(15), 15, 16)


def ljpeg(rows, parts, precision=16):
    """Lossless JPEG with 17 codes of 5 bits and predictor 1."""
    h, w = rows.shape[0], rows.shape[1] // parts
    x = rows.reshape(h, w, parts).astype(np.int64)
    d = np.diff(x, axis=1, prepend=0)
    d[:, 0] = np.diff(x[:, 0], axis=0, prepend=1 << precision - 1)
    d = (d + 32768) % 65536 - 32768
    bits = []
    for v in d.ravel().tolist():
        v = 32768 if v == -32768 else v
        n = abs(v).bit_length()
        bits.append(f"{SIZES.index(n):05b}")
        if n and n < 16:
            bits.append(f"{v if v > 0 else v + (1 << n) - 1:0{n}b}")
    bits = "".join(bits)
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    table = bytes([0]) + bytes(17 if k == 5 else 0 for k in range(1, 17)) + bytes(SIZES)
    out = b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
    out += b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * parts, precision, h, w, parts) + b"".join(bytes([k, 0x11, 0]) for k in range(parts))
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * parts, parts) + b"".join(bytes([k, 0]) for k in range(parts)) + bytes([1, 0, 0])
    return out + body + b"\xff\xd9"


def make(mosaic, order="<", packed=1, tile=None, pattern=b"\0\1\1\2", opcodes=()):
    h, w = mosaic.shape
    body, places, sizes = b"", [], []
    parts = [mosaic] if tile is None else [np.pad(mosaic, ((0, -h % tile), (0, -w % tile)), mode="edge")[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    for p in parts:
        data = ljpeg(p, 2) if packed == 7 else p.astype(order + "u2").tobytes()
        places.append(8 + len(body))
        sizes.append(len(data))
        body += data + b"\0" * (len(data) % 2)

    def ifd(entries, at):
        head, extra = b"", b""
        free = at + 2 + 12 * len(entries) + 4
        for tag, kind, values in sorted(entries):
            code = {2: "s", 7: "s", 3: "H", 4: "I", 5: "I", 1: "s"}[kind]
            raw = values if code == "s" else b"".join(struct.pack(order + code, v) for v in values)
            n = len(values) // (2 if kind == 5 else 1)
            if len(raw) <= 4:
                field = raw.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", free + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            head += struct.pack(order + "HHI", tag, kind, n) + field
        return struct.pack(order + "H", len(entries)) + head + bytes(4) + extra

    raw = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16]), (259, 3, [packed]), (262, 3, [32803]), (33422, 1, pattern), (50714, 5, [64, 1] * 4), (50717, 4, [16316])]
    raw += [(324, 4, places), (325, 4, sizes), (322, 4, [tile]), (323, 4, [tile])] if tile else [(273, 4, places), (279, 4, sizes), (278, 4, [h])]
    raw += [(tag, 7, b"ops!ops!") for tag in opcodes]
    sub_at = 8 + len(body)
    sub = ifd(raw, sub_at)
    exif_at = sub_at + len(sub)
    exif = ifd([(33437, 5, [8, 1]), (37386, 5, [50, 1]), (33434, 5, [1, 0]), (34855, 3, [200]), (42036, 2, b" lens 50 \0")], exif_at)
    main_at = exif_at + len(exif)
    main = ifd([(256, 4, [9]), (257, 4, [9]), (262, 3, [2]), (271, 2, b"maker\0"), (330, 4, [sub_at]), (34665, 4, [exif_at]), (50706, 1, b"\1\4\0\0")], main_at)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, main_at) + body + sub + exif + main


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packed", [1, 7])
@pytest.mark.parametrize("tile", [None, 16])
def test_round_trip(order, packed, tile):
    rng = np.random.default_rng(4)
    for mosaic in (rng.integers(0, 65536, (23, 38)), np.full((16, 32), 500), np.indices((20, 40)).sum(0) * 7):
        i, got = dng.decode(make(mosaic, order, packed, tile))
        assert np.array_equal(got, mosaic)
        assert (i["source_kind"], i["cfa_pattern"], i["width"], i["lens_model"], i["f_number"], i["exposure_time_s"], i["iso"]) == ("cfa", "RGGB", mosaic.shape[1], "lens 50", 8.0, None, 200)


def test_rejects():
    plane = np.zeros((8, 8), int)
    with pytest.raises(ValueError):
        dng.decode(b"II*\0")
    with pytest.raises(ValueError, match="unsupported"):
        dng.decode(make(plane, packed=34892))
    with pytest.raises(ValueError, match="not a JPEG"):
        ljpeg_.decode([b"no"])
    whole = ljpeg(np.random.default_rng(1).integers(0, 65536, (40, 40)), 2)
    with pytest.raises(Exception):
        ljpeg_.decode([whole[:200]])


def test_files_to_green_planes(spark, tmp_path):
    from pyspark.sql import functions as F

    from stopwise.operators import mosaic as op

    plane = np.random.default_rng(5).integers(64, 16316, (12, 10))
    (tmp_path / "a.dng").write_bytes(make(plane, packed=7, opcodes=(51009, 51022)))
    (tmp_path / "b.DNG").write_bytes(make(plane, packed=1, pattern=b"\1\0\2\1"))
    found = dng.files(spark, str(tmp_path))
    seen = {r.path[-5]: r for r in dng.inspect(found).collect()}
    assert (seen["a"].corrections_present, seen["a"].corrections, seen["b"].corrections_present) == (True, "OpcodeList2,OpcodeList3", False)
    assert seen["b"].cfa_pattern == "GRBG" and seen["a"].camera_make == "maker" and seen["a"].black_level == [64.0] * 4
    rows = dng.mosaics(found)
    planes = rows.groupBy("path", "pattern", "black", "white").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "samples"))), lambda x: x["samples"])).alias("s"))
    for r in planes.select("path", op.green(F.col("s"), 10, 12, F.col("pattern"), F.col("black"), F.col("white")).alias("g")).collect():
        px, py = (1, 0) if "a.dng" in r.path else (0, 0)
        assert np.allclose(np.array(r.g).reshape(6, 5), (plane[py::2, px::2] - 64) / (16316 - 64))


@pytest.mark.parametrize(("pattern", "cells"), [("RGGB", b"\0\1\1\2"), ("BGGR", b"\2\1\1\0"), ("GBRG", b"\1\2\0\1"), ("GRBG", b"\1\0\2\1")])
def test_mosaic_like_the_expressions(spark, pattern, cells):
    from pyspark.sql import functions as F

    from stopwise.operators import frames
    from stopwise.operators import mosaic as op

    plane = np.random.default_rng(6).integers(64, 16316, (9, 12))
    m = frames.Mosaic(*dng.decode(make(plane, pattern=cells)))
    s, levels = F.array(*[F.lit(float(v)) for v in plane.ravel()]), (F.array(*[F.lit(64.0)] * 4), F.array(*[F.lit(16316.0)] * 4))
    want = spark.range(1).select(*[op.interpolate(s, 12, 9, F.lit(pattern), *levels, t).alias(n) for n, t in (("red", op.RED), ("blue", op.BLUE))]).first()
    for rect in ((0, 0, 12, 9), (3, 2, 5, 4), (7, 5, 5, 4)):
        red, blue = m.colours(rect)
        for got, all_ in ((red, want.red), (blue, want.blue)):
            assert np.allclose(got, frames.cut(np.array(all_).reshape(9, 12), rect))
    px, py = op.GREEN[pattern]
    (x, w), (y, h) = op.project(F.lit(3), F.lit(5), F.lit(px)), op.project(F.lit(2), F.lit(4), F.lit(py))
    assert m.project((3, 2, 5, 4)) == tuple(spark.range(1).select(x, y, w, h).first())


def test_raw_frames_are_measured(spark, tmp_path):
    """A mosaic with corners at half the centre's level, and one whose red lies two pixels aside."""
    from stopwise.operators import frames
    from stopwise.sources import tables

    y, x = np.indices((200, 200))
    dim = np.repeat(np.repeat(tables.painted("vignetting", 1)[:, :, 0], 2, 0), 2, 1) // 4
    texture = lambda x, y: 4000 + (np.sin(0.37 * x) + np.cos(0.23 * y)) * 1500
    moved = np.where((x % 2 == 0) & (y % 2 == 0), texture(x - 2, y), texture(x, y)).astype(int)
    for name, plane in (("dim", dim), ("moved", moved)):
        (tmp_path / f"{name}.dng").write_bytes(make(plane + 64, packed=7))
    from stopwise.sources import dng as source

    got = {r.path.rsplit("/", 1)[1]: r for r in frames.frame_evidence(source.files(spark, str(tmp_path))).collect()}
    assert all(got["dim.dng"][f"fa_{c}"] == pytest.approx(-1, abs=1e-6) for c in ("tl", "tr", "bl", "br"))
    assert all(got["moved.dng"][f"cx_{c}"] == pytest.approx(2, abs=0.5) for c in ("tl", "tr", "bl", "br"))
