"""Lossless JPEG, vectorised: all tiles and restart intervals of a frame at once, and many places of each at a time.

Codes can be read from any bit: a reader that starts amidst one falls into step with the others after a few codes. So
every stream is cut into lanes of LANE bits, each lane is read from its first bit until the next one's, and where a lane ends is where the next one begins. Lanes whose begin has
moved are read again until none moves; what is right at the begin of a stream is right all along it in the end, whatever the data. With begins
and numbers of codes known, all lanes are read once more for their values. A step of NumPy takes one code of every lane.

Any of the predictors 1 to 7, up to four components with tables of their own, restart intervals of whole rows. Numbers are kept modulo 2^16.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a lane.
LANE = 2048


class Table:
    """Codes of at most 16 bits: for every 16 bits that may come, the code's length, the width of its value and both together; 0 where none fits."""

    def __init__(self, counts: bytes, values: bytes):
        self.size, self.width = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                span = slice(code << 16 - length, code + 1 << 16 - length)
                if span.stop > 1 << 16 or at >= len(values) or values[at] > 16:
                    raise ValueError("damaged JPEG table")
                self.size[span], self.width[span] = length, values[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.step = np.where(self.width == 16, self.size, self.size + self.width).astype(np.uint8)
        self.step[self.size == 0] = 0


class Scan:
    """What a JPEG's markers say: size, precision, tables by component, predictor, rows of a restart interval, and where its data begins."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at, tables, frame, interval = 2, {}, None, 0
        while True:
            if at + 4 > len(data):
                raise ValueError("damaged JPEG data")
            marker, length = struct.unpack_from(">HH", data, at)
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFFC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] & 15] = Table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xFFC3:
                frame = struct.unpack_from(">BHHB", body)
                if any(body[7 + 3 * k] != 0x11 for k in range(frame[3])):
                    raise ValueError("unsupported lossless JPEG: components of different sizes")
            elif marker == 0xFFDD:
                (interval,) = struct.unpack(">H", body)
            elif marker == 0xFFDA:
                break
            elif marker in (0xFFC0, 0xFFC1, 0xFFC2):
                raise ValueError("not a lossless JPEG")
        if frame is None or body[0] != frame[3]:
            raise ValueError("unsupported lossless JPEG")
        self.precision, self.height, self.width, self.parts = frame
        self.predictor, self.shift = body[1 + 2 * self.parts], body[3 + 2 * self.parts] & 15
        if self.predictor not in range(1, 8) or interval % max(self.width, 1) or not 1 <= self.parts <= 4:
            raise ValueError("unsupported lossless JPEG")
        self.rows = interval // self.width if interval else self.height
        self.tables = [tables[body[2 + 2 * k] >> 4] for k in range(self.parts)]
        self.at = at


def streams(data: bytes, at: int, wanted: int) -> list[bytes]:
    """The ``wanted`` restart intervals' data, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    ends = marks[(after >= 0xD0) & (after <= 0xD7)]
    last = marks[after == 0xD9]
    stop = int(last[0]) if len(last) else len(raw)
    ends = ends[ends < stop]
    if len(ends) + 1 != wanted:
        raise ValueError("damaged JPEG data")
    keep = np.ones(len(raw), bool)
    keep[marks[after == 0] + 1] = False
    out, begin = [], 0
    for end in [*ends.tolist(), stop]:
        out.append(raw[begin:end][keep[begin:end]].tobytes())
        begin = end + 2
    return out


def differences(parts: list[bytes], counts: list[int], tables: list[list[Table]]) -> list[np.ndarray]:
    """``counts`` coded differences of each stream, by its components' tables in turn; modulo 2^16."""
    # All streams one after another, each from a whole word and with room behind it.
    sizes = np.array([-(-len(p) // 4) * 4 + 8 for p in parts])
    start = np.cumsum(sizes) - sizes
    held = np.full(int(sizes.sum()), 0xFF, np.uint8)
    for a, p in zip(start.tolist(), parts):
        held[a : a + len(p)] = np.frombuffer(p, np.uint8)
    words = held.view(">u4").astype(np.uint32)
    # Streams that share tables share their numbers.
    known: dict[int, int] = {}
    order = []
    for own in tables:
        for t in own:
            if id(t) not in known:
                known[id(t)] = len(order)
                order.append(t)
    step, size, width = (np.concatenate([getattr(t, n) for t in order]) for n in ("step", "size", "width"))
    turns = max(len(own) if len(set(map(id, own))) > 1 else 1 for own in tables)
    turn = np.zeros((len(parts), 4), np.int64)  # table of each component
    for k, own in enumerate(tables):
        turn[k, : len(own)] = [known[id(t)] << 16 for t in own]
    cycle = np.array([len(own) if turns > 1 else 1 for own in tables])

    first, bits = start * 8, np.array([len(p) * 8 for p in parts])
    lanes = np.maximum(-(-bits // LANE), 1)
    stream = np.repeat(np.arange(len(parts)), lanes)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    end = np.minimum((number + 1) * LANE, bits[stream]) + first[stream]
    begin = number * LANE + first[stream]
    phase = np.zeros(len(stream), np.int64)  # the component whose turn it is

    def window(at: np.ndarray) -> np.ndarray:
        """The 32 bits from each place."""
        k, low = at >> 5, (at & 31).astype(np.uint64)
        two = words[k].astype(np.uint64) << np.uint64(32) | words[np.minimum(k + 1, len(words) - 1)]
        return (two << low >> np.uint64(32)).astype(np.uint32)

    def tables_of(which: np.ndarray, now: np.ndarray) -> np.ndarray:
        return turn[stream[which], now] if turns > 1 else turn[stream[which], 0]

    finish, left, codes = np.zeros_like(begin), np.zeros_like(phase), np.zeros_like(begin)
    todo = np.arange(len(stream))
    while len(todo):
        which, at, now, n = todo, begin[todo].copy(), phase[todo].copy(), np.zeros(len(todo), np.int64)
        fixed = tables_of(which, now)
        while len(which):
            on = at < end[which]
            if not on.all():
                off = ~on
                finish[which[off]], left[which[off]], codes[which[off]] = at[off], now[off], n[off]
                which, at, now, n, fixed = which[on], at[on], now[on], n[on], fixed[on]
                if not len(which):
                    break
            more = step[(fixed if turns == 1 else tables_of(which, now)) + (window(at) >> np.uint32(16))]
            at += np.maximum(more, 1)  # a place where no code fits is none of the right ones, or the data is damaged
            n += 1
            if turns > 1:
                now = (now + 1) % cycle[stream[which]]
        following = todo[(todo + 1 < len(stream))] + 1
        following = following[number[following] > 0]
        moved = (begin[following] != finish[following - 1]) | (phase[following] != left[following - 1])
        todo = following[moved]
        begin[todo], phase[todo] = finish[todo - 1], left[todo - 1]

    # Of a stream's codes the first ``counts`` are samples; the rest is padding.
    before = np.cumsum(codes) - codes
    before -= np.repeat(before[np.cumsum(lanes) - lanes], lanes)
    wanted = np.array(counts)[stream]
    take = np.clip(wanted - before, 0, codes)
    if (np.bincount(stream, take, len(parts)) < np.array(counts)).any():
        raise ValueError("damaged JPEG data")
    base = np.cumsum(counts) - np.array(counts)
    out = np.zeros(int(sum(counts)), np.uint16)
    which = np.flatnonzero(take)
    at, now, place, n = begin[which], phase[which], (base[stream] + before)[which], take[which]
    fixed = tables_of(which, now)
    while len(which):
        seen = window(at)
        code = (fixed if turns == 1 else tables_of(which, now)) + (seen >> np.uint32(16))
        used, wide = size[code].astype(np.uint32), width[code].astype(np.uint32)
        if not used.all():
            raise ValueError("damaged JPEG data")
        value = ((seen << used) >> (np.uint32(32) - np.maximum(wide, 1))).astype(np.int64)
        small = value >> np.maximum(wide.astype(np.int64) - 1, 0) == 0
        value = np.where(small, value - (1 << wide.astype(np.int64)) + 1, value)
        value[wide == 0], value[wide == 16] = 0, 32768
        out[place] = value & 0xFFFF
        at += step[code]
        place += 1
        n -= 1
        if turns > 1:
            now = (now + 1) % cycle[stream[which]]
        on = n > 0
        if not on.all():
            which, at, now, place, n, fixed = which[on], at[on], now[on], place[on], n[on], fixed[on]
    return np.split(out, np.cumsum(counts)[:-1])


def predicted(d: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Samples of a restart interval (rows, columns, components) from its differences, modulo 2^16."""
    x = d.astype(np.int64)
    x[0, 0] += start
    x[0] = np.cumsum(x[0], axis=0)  # the first row goes by what is on the left
    if predictor == 1:
        x[1:, 0] = np.cumsum(x[:, 0], axis=0)[1:]  # the first column by what is above
        x[1:] = np.cumsum(x[1:], axis=1)
        return x & 0xFFFF
    x[:, 0] = np.cumsum(x[:, 0], axis=0)
    x &= 0xFFFF
    h, w = x.shape[:2]
    if predictor == 2:
        return np.concatenate((x[:, :1], np.cumsum(x[:, 1:], axis=0)), 1) & 0xFFFF
    if predictor in (3, 4, 5):
        for y in range(1, h):
            above = x[y - 1]
            if predictor == 3:
                x[y, 1:] += above[:-1]
            else:
                x[y, 1:] += above[1:] - above[:-1] if predictor == 4 else above[1:] - above[:-1] >> 1
                x[y] = np.cumsum(x[y], axis=0)
            x[y] &= 0xFFFF
        return x
    # 6 and 7 take half of what is on the left: along diagonals, all of whose samples are known to depend on earlier ones only.
    for s in range(2, h + w - 1):
        y = np.arange(max(1, s - w + 1), min(h - 1, s - 1) + 1)
        c = s - y
        a, b = x[y, c - 1], x[y - 1, c]
        x[y, c] = (x[y, c] + (b + (a - x[y - 1, c - 1] >> 1) if predictor == 6 else a + b >> 1)) & 0xFFFF
    return x


def decode(parts: list[bytes]) -> list[np.ndarray]:
    """Each JPEG's samples, (rows, columns, components); all are decoded together."""
    scans = [Scan(p) for p in parts]
    same: dict[bytes, Table] = {}
    for s in scans:  # tiles mostly repeat one table
        s.tables = [same.setdefault(t.size.tobytes() + t.width.tobytes(), t) for t in s.tables]
    held, counts, tables, shapes = [], [], [], []
    for s, p in zip(scans, parts):
        n = -(-s.height // s.rows)
        held += streams(p, s.at, n)
        for k in range(n):
            rows = min(s.rows, s.height - k * s.rows)
            shapes.append((rows, s.width, s.parts))
            counts.append(rows * s.width * s.parts)
            tables.append(s.tables)
    found = iter(zip(differences(held, counts, tables), shapes))
    out = []
    for s in scans:
        made = [predicted(d.reshape(shape), s.predictor, 1 << s.precision - s.shift - 1) for d, shape in (next(found) for _ in range(-(-s.height // s.rows)))]
        out.append((np.concatenate(made) << s.shift & 0xFFFF).astype(np.uint16))
    return out
