"""Lossless JPEG: every predictor, restart intervals, components with tables of their own, and speed."""

import struct
import time

import numpy as np
import pytest

from stopwise.sources import ljpeg

#: Widths of values by two tables; codes of one length each, and of many.
FLAT = ([0] * 4 + [17] + [0] * 11, [*range(17)])
STEEP = ([0, 1, 2, 2, 2, 2, 2, 2, 2, 2, 0, 0, 0, 0, 0, 0], [3, 2, 4, 1, 5, 0, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16])


def codes(table):
    counts, values = table
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = f"{code:0{length}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return out


def left_over(x, y, c, predictor, top, start):
    """What a sample's prediction leaves, from the definitions."""
    if c == 0 or y == top:
        if c == 0 and y == top:
            return x[y][c] - start
        return x[y][c] - (x[y - 1][c] if c == 0 else x[y][c - 1])
    a, b, o = x[y][c - 1], x[y - 1][c], x[y - 1][c - 1]
    return x[y][c] - {1: a, 2: b, 3: o, 4: a + b - o, 5: a + (b - o >> 1), 6: b + (a - o >> 1), 7: a + b >> 1}[predictor]


def encode(x, tables, predictor=1, interval=0, precision=16, shift=0):
    """x: (h, w, parts); ``interval``: rows."""
    h, w, parts = x.shape
    x = (x >> shift).astype(int)
    lists = [x[:, :, k].tolist() for k in range(parts)]
    book = [codes(t) for t in tables]
    rows, chunks = interval or h, []
    for top in range(0, h, rows):
        bits = []
        for y in range(top, min(top + rows, h)):
            for c in range(w):
                for k in range(parts):
                    d = (left_over(lists[k], y, c, predictor, top, 1 << precision - shift - 1) + 32767) % 65536 - 32767
                    n = abs(d).bit_length() if d != 32768 else 16
                    bits.append(book[k][n])
                    if 0 < n < 16:
                        bits.append(f"{d if d > 0 else d + (1 << n) - 1:0{n}b}")
        bits = "".join(bits)
        bits += "1" * (-len(bits) % 8)
        chunks.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b"")
    out = b"\xff\xd8"
    for k, (counts, values) in enumerate(tables):
        body = bytes([k]) + bytes(counts) + bytes(values)
        out += b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body
    out += b"\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * parts, precision, h, w, parts) + b"".join(bytes([k, 0x11, 0]) for k in range(parts))
    if interval:
        out += b"\xff\xdd" + struct.pack(">HH", 4, interval * w)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * parts, parts) + b"".join(bytes([k, k << 4]) for k in range(parts)) + bytes([predictor, 0, shift])
    for k, chunk in enumerate(chunks):
        out += chunk + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(chunks) else b"")
    return out + b"\xff\xd9"


def pictures(rng, h, w, parts):
    y, x = np.indices((h, w))
    smooth = (2000 + 900 * np.sin(x / 7) + 500 * np.cos(y / 5))[:, :, None] + rng.normal(0, 6, (h, w, parts))
    return rng.integers(0, 65536, (h, w, parts)), smooth.astype(int), np.full((h, w, parts), 7)


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_predictors_and_restarts(predictor, interval):
    rng = np.random.default_rng(predictor)
    for parts, tables in ((1, [STEEP]), (2, [STEEP, STEEP]), (2, [FLAT, STEEP]), (3, [STEEP, FLAT, STEEP])):
        for x in pictures(rng, 10, 23, parts):
            (got,) = ljpeg.decode([encode(x, tables, predictor, interval)])
            assert np.array_equal(got, x)


def test_streams_of_many_lanes_and_sizes():
    rng = np.random.default_rng(9)
    images = [x for h, w, parts in ((1, 1, 1), (1, 40, 2), (40, 1, 1), (60, 300, 2), (33, 47, 4)) for x in pictures(rng, h, w, parts)]
    tables = [[(STEEP, FLAT)[(i + k) % 2] for k in range(x.shape[2])] for i, x in enumerate(images)]
    got = ljpeg.decode([encode(x, t, 1 + i % 7, 20 * (i % 2)) for i, (x, t) in enumerate(zip(images, tables))])
    assert all(np.array_equal(a, b) for a, b in zip(got, images))


def test_smaller_precision_and_point_transform():
    x = np.random.default_rng(3).integers(0, 4096, (9, 12, 1))
    assert np.array_equal(ljpeg.decode([encode(x, [FLAT], 1, 0, 12)])[0], x)
    assert np.array_equal(ljpeg.decode([encode(x, [FLAT], 4, 0, 12, 2)])[0], x >> 2 << 2)


def test_damaged_data_raises():
    x = np.random.default_rng(5).integers(0, 65536, (30, 30, 1))
    whole = encode(x, [FLAT], 1, 3)
    for bad in (b"", b"no", whole[:40], whole[: len(whole) // 2], whole.replace(b"\xff\xd3", b"\xff\0"), whole[:-300] + b"\xff\xd9"):
        with pytest.raises(Exception):
            ljpeg.decode([bad])
    with pytest.raises(ValueError, match="damaged"):  # 31 is no code of the table
        ljpeg.decode([encode(x, [FLAT])[:200] + b"\xff\0" * 3000 + b"\xff\xd9"])


def test_speed():
    """A frame of 4 million samples in tiles; the threshold leaves room for a busy machine, the figure is in the README."""
    rng = np.random.default_rng(6)
    tile = encode((2000 + rng.normal(0, 9, (256, 128, 2))).astype(int), [STEEP, STEEP])
    ljpeg.decode([tile])
    began = time.time()
    ljpeg.decode([tile] * 64)
    rate = 64 * 256 * 256 / (time.time() - began) / 1e6
    print(f"{rate:.1f} million samples a second")
    assert rate > 2
