"""Samples of a directory from its strips or tiles, for TIFF and DNG."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from stopwise.sources import tags


def places(d: tags.Directory) -> list[tuple[int, int, int, int, int, int, int]]:
    """(plane, y, x, rows, columns, offset, bytes) of every strip or tile; edge tiles are as large as the others, a last strip isn't."""
    width, height = d[tags.WIDTH][0], d[tags.HEIGHT][0]
    tiled = tags.TILES in d
    if not tiled and tags.STRIPS not in d:
        raise ValueError("neither strips nor tiles")
    at, size = (d[tags.TILES], d[tags.TILE_BYTES]) if tiled else (d[tags.STRIPS], d[tags.STRIP_BYTES])
    w, h = (d[tags.TILE_W][0], d[tags.TILE_H][0]) if tiled else (width, min(d.get(tags.ROWS, (height,))[0], height))
    across, down = -(-width // w), -(-height // h)
    planes = d.get(tags.COMPONENTS, (1,))[0] if d.get(tags.PLANAR, (1,))[0] == 2 else 1
    if len(at) != across * down * planes or len(size) != len(at):
        raise ValueError("strips or tiles do not fit the size")
    out = []
    for k, (a, n) in enumerate(zip(at, size)):
        plane, k = divmod(k, across * down)
        y, x = k // across * h, k % across * w
        out.append((plane, y, x, h if tiled else min(h, height - y), w, a, n))
    return out


def assemble(d: tags.Directory, kind, decode: Callable[[list[tuple]], list[np.ndarray]]) -> np.ndarray:
    """(height, width, components) of samples; ``decode`` gives the samples of all ``places``, as (rows, columns, components of the block)."""
    width, height, parts = d[tags.WIDTH][0], d[tags.HEIGHT][0], d.get(tags.COMPONENTS, (1,))[0]
    planar = d.get(tags.PLANAR, (1,))[0]
    if planar not in (1, 2):
        raise ValueError(f"unsupported arrangement of planes: {planar}")
    found = places(d)
    out = np.zeros((height, width, parts), kind)
    for (plane, y, x, rows, columns, _, _), samples in zip(found, decode(found)):
        if samples.size != rows * columns * (1 if planar == 2 else parts):
            raise ValueError("sample count does not fit the size")
        samples = samples.reshape(rows, columns, -1)[: height - y, : width - x]
        if planar == 2:
            out[y : y + rows, x : x + columns, plane] = samples[:, :, 0]
        else:
            out[y : y + rows, x : x + columns] = samples
    return out
