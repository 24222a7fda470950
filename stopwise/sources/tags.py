"""Directories of TIFF and DNG files, read by ranges.

``data`` is what a file's bytes can be sliced from: bytes, or ``Ranged``, which fetches only the blocks that slices touch. A directory holds its
entries' places and reads a value when it is asked for, so that a frame's metadata costs a few kilobytes, however large its
samples and its tables of strips are.
"""

from __future__ import annotations

import struct

# Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, COMPONENTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 277, 284, 317, 339
STRIPS, ROWS, STRIP_BYTES, TILE_W, TILE_H, TILES, TILE_BYTES = 273, 278, 279, 322, 323, 324, 325
MAKE, MODEL, SUB_IFDS, EXIF_IFD = 271, 272, 330, 34665
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}


class Ranged:
    """Bytes of an open file (``read_at``), fetched in blocks of ``block``; ``fetched`` counts them."""

    def __init__(self, file, size: int, block: int = 4096):
        self.file, self.size, self.block, self.fetched = file, size, block, 0
        self.held: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // self.block, (stop - 1) // self.block
        missing = [k for k in range(first, last + 1) if k not in self.held]
        if missing:  # one read from the first to the last of them
            a, b = missing[0] * self.block, min((missing[-1] + 1) * self.block, self.size)
            data = self.file.read_at(b - a, a)
            self.fetched += len(data)
            for k in range(missing[0], missing[-1] + 1):
                self.held[k] = data[k * self.block - a : (k + 1) * self.block - a]
        whole = b"".join(self.held[k] for k in range(first, last + 1))
        return whole[start - first * self.block : stop - first * self.block]


class Directory:
    """Values by tag: numbers as tuples (rationals as floats), texts and opaque values as bytes."""

    def __init__(self, data, at: int, order: str):
        self.data, self.order, self.entries = data, order, {}
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        listed = data[at + 2 : at + 2 + 12 * n]
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", listed, 12 * i)
            if kind in KINDS:
                size = struct.calcsize("=" + KINDS[kind]) * count
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", listed, 12 * i + 8)[0]
                self.entries[tag] = (kind, count, place, size)

    def __contains__(self, tag: int) -> bool:
        return tag in self.entries

    def __getitem__(self, tag: int):
        kind, count, place, size = self.entries[tag]
        raw = bytes(self.data[place : place + size])
        if KINDS[kind] == "s":
            return raw
        got = struct.unpack(self.order + KINDS[kind] * count, raw)
        if kind in (5, 10):
            got = tuple(a / b if b else float("nan") if a == 0 else float("inf") for a, b in zip(got[::2], got[1::2]))
        return got

    def get(self, tag: int, default=None):
        return self[tag] if tag in self.entries else default


def directories(data) -> tuple[str, list[Directory]]:
    """Byte order; the main directory, its sub-directories and that of the exposure."""
    head = bytes(data[:8])
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF")
    main = Directory(data, struct.unpack_from(order + "I", head, 4)[0], order)
    subs = [Directory(data, at, order) for tag in (SUB_IFDS, EXIF_IFD) for at in main.get(tag, ())]
    return order, [main, *subs]


def encode(bodies: list[bytes], main: list[tuple], sub: list[tuple] | None = None, exif: list[tuple] | None = None, order: str = "<") -> bytes:
    """A file of blocks of samples and directories of (tag, kind, values), for fixtures; rationals are pairs, texts bytes.

    The blocks' places and sizes go to the sub-directory, or to the main one if there is none, under the tags that have None for values.
    """
    at, body = [], b""
    for b in bodies:
        at.append(8 + len(body))
        body += b + bytes(len(b) % 2)
    filled = {STRIPS: at, TILES: at, STRIP_BYTES: [len(b) for b in bodies], TILE_BYTES: [len(b) for b in bodies]}

    def written(entries: list[tuple], place: int) -> bytes:
        head, extra = struct.pack(order + "H", len(entries)), b""
        free = place + 6 + 12 * len(entries)
        for tag, kind, values in sorted(entries, key=lambda e: e[0]):
            values = filled[tag] if values is None else values
            code = KINDS[kind]
            raw = values if code == "s" or isinstance(values, bytes) else b"".join(struct.pack(order + code[0], v) for v in values)
            field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(extra))
            extra += raw + bytes(len(raw) % 2) if len(raw) > 4 else b""
            head += struct.pack(order + "HHI", tag, kind, len(values) // len(code)) + field
        return head + bytes(4) + extra

    place, parts = 8 + len(body), b""
    for tag, entries in ((SUB_IFDS, sub), (EXIF_IFD, exif)):
        if entries is not None:
            main = [*main, (tag, 4, [place + len(parts)])]
            parts += written(entries, place + len(parts))
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, place + len(parts))
    return head + body + parts + written(main, place + len(parts))
