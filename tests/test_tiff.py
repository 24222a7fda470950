import zlib

import numpy as np
import pytest

from stopwise.sources import tiff


def test_round_trip_and_inspect(spark, tmp_path):
    rng = np.random.default_rng(1)
    gray, rgb = rng.integers(0, 65536, (5, 7)), rng.integers(0, 65536, (4, 3, 3))
    (tmp_path / "a.tif").write_bytes(tiff.encode(gray))
    (tmp_path / "b.TIFF").write_bytes(tiff.encode(rgb))
    (tmp_path / "c.txt").write_text("no image")
    found = {r.path.rsplit("/", 1)[1]: r for r in tiff.inspect(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.tif", "b.TIFF"} and (found["b.TIFF"].width, found["b.TIFF"].components, found["b.TIFF"].bits) == (3, 3, 16)
    rows = tiff.strips(spark, str(tmp_path)).where("path LIKE '%a.tif'").orderBy("y").collect()
    assert np.allclose([r.samples for r in rows], gray / 65535)
    luma = tiff.luma_planes(tiff.strips(spark, str(tmp_path))).where("path LIKE '%b.TIFF'").orderBy("y").collect()
    assert np.allclose([r.samples for r in luma], (rgb / 65535) @ [0.2126, 0.7152, 0.0722])


def test_rejects(tmp_path):
    with pytest.raises(ValueError):
        tiff.decode(b"not a tiff at all")
    damaged = tiff.encode(np.zeros((4, 4), int))
    with pytest.raises(Exception):
        tiff.decode(damaged[:20])
    with pytest.raises(FileNotFoundError):
        tiff.preflight([str(tmp_path / "none.tif")])
    with pytest.raises(ValueError):
        tiff.preflight([str(tmp_path)])


def lzw(data, most=4094):
    """Textbook LZW with early change, for the fixture."""
    out, table, now, width = "", {bytes([i]): i for i in range(256)}, b"", 9
    size = 258
    out += f"{256:09b}"
    for b in data:
        c = bytes([b])
        if now + c in table:
            now += c
            continue
        out += f"{table[now]:0{width}b}"
        table[now + c] = size
        size += 1
        width = min(max(9, size.bit_length()), 12)
        if size >= most:
            out += f"{256:0{width}b}"
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        now = c
    out += f"{table[now]:0{width}b}"
    width = min(max(9, (size + 1).bit_length()), 12)
    out += f"{257:0{width}b}"
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def packbits(data):
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


@pytest.mark.parametrize(("packed", "pack"), [(5, lzw), (8, zlib.compress), (32946, zlib.compress), (32773, packbits)])
@pytest.mark.parametrize("differences", [False, True])
@pytest.mark.parametrize("bits", [8, 16])
def test_compressed(packed, pack, differences, bits):
    rng = np.random.default_rng(3)
    for image in (rng.integers(0, 1 << bits, (40, 61)), np.full((30, 50, 3), 77), np.indices((64, 64, 3)).sum(0) * 3 % (1 << bits)):
        found, samples = tiff.decode(tiff.encode(image, bits, packed, pack, differences))
        assert (found["height"], found["width"]) == image.shape[:2]
        assert np.array_equal(np.rint(samples * ((1 << bits) - 1)).astype(int), image.ravel())


def test_unsupported_compression_is_rejected():
    with pytest.raises(ValueError, match="unsupported"):
        tiff.decode(tiff.encode(np.zeros((4, 4), int), packed=7))


@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 16), (4, 32)])
@pytest.mark.parametrize(("packed", "pack"), [(1, bytes), (8, zlib.compress), (5, lzw)])
def test_tiles_and_planes(planar, tile, packed, pack):
    rng = np.random.default_rng(8)
    for image in (rng.integers(0, 256, (21, 37, 3)), rng.integers(0, 256, (21, 37))):
        for bits, differences in ((8, False), (16, False), (16, True)):
            i, got = tiff.decode(tiff.encode(image, bits, packed, pack, differences, tile, planar))
            assert (i["width"], i["height"]) == (37, 21) and np.allclose(got * (255 if bits == 8 else 65535), image.ravel())


def test_blocks_that_do_not_fit_are_rejected():
    whole = tiff.encode(np.zeros((40, 40), int), tile=(16, 16))
    with pytest.raises(ValueError, match="fit"):
        tiff.decode(whole.replace((16).to_bytes(4, "little") + b"\x43\x01", (8).to_bytes(4, "little") + b"\x43\x01", 1))
    with pytest.raises(Exception):
        tiff.decode(whole[:300])
