"""Labels of contact sheets: a bitmap font of 3 x 5 pixels."""

from __future__ import annotations

from functools import cache

import numpy as np

# The five rows of each glyph, leftmost pixel first; what has none is drawn as "?".
GLYPHS = {
    "0": (0b111, 0b101, 0b101, 0b101, 0b111),
    "1": (0b010, 0b110, 0b010, 0b010, 0b111),
    "2": (0b111, 0b001, 0b111, 0b100, 0b111),
    "3": (0b111, 0b001, 0b111, 0b001, 0b111),
    "4": (0b101, 0b101, 0b111, 0b001, 0b001),
    "5": (0b111, 0b100, 0b111, 0b001, 0b111),
    "6": (0b111, 0b100, 0b111, 0b101, 0b111),
    "7": (0b111, 0b001, 0b010, 0b010, 0b010),
    "8": (0b111, 0b101, 0b111, 0b101, 0b111),
    "9": (0b111, 0b101, 0b111, 0b001, 0b111),
    "a": (0b010, 0b101, 0b111, 0b101, 0b101),
    "b": (0b110, 0b101, 0b110, 0b101, 0b110),
    "c": (0b011, 0b100, 0b100, 0b100, 0b011),
    "d": (0b110, 0b101, 0b101, 0b101, 0b110),
    "e": (0b111, 0b100, 0b110, 0b100, 0b111),
    "f": (0b111, 0b100, 0b110, 0b100, 0b100),
    "g": (0b011, 0b100, 0b101, 0b101, 0b011),
    "h": (0b101, 0b101, 0b111, 0b101, 0b101),
    "i": (0b111, 0b010, 0b010, 0b010, 0b111),
    "j": (0b001, 0b001, 0b001, 0b101, 0b010),
    "k": (0b101, 0b101, 0b110, 0b101, 0b101),
    "l": (0b100, 0b100, 0b100, 0b100, 0b111),
    "m": (0b101, 0b111, 0b111, 0b101, 0b101),
    "n": (0b110, 0b101, 0b101, 0b101, 0b101),
    "o": (0b010, 0b101, 0b101, 0b101, 0b010),
    "p": (0b110, 0b101, 0b110, 0b100, 0b100),
    "q": (0b010, 0b101, 0b101, 0b011, 0b001),
    "r": (0b110, 0b101, 0b110, 0b101, 0b101),
    "s": (0b011, 0b100, 0b010, 0b001, 0b110),
    "t": (0b111, 0b010, 0b010, 0b010, 0b010),
    "u": (0b101, 0b101, 0b101, 0b101, 0b111),
    "v": (0b101, 0b101, 0b101, 0b101, 0b010),
    "w": (0b101, 0b101, 0b111, 0b111, 0b101),
    "x": (0b101, 0b101, 0b010, 0b101, 0b101),
    "y": (0b101, 0b101, 0b010, 0b010, 0b010),
    "z": (0b111, 0b001, 0b010, 0b100, 0b111),
    "-": (0b000, 0b000, 0b111, 0b000, 0b000),
    "_": (0b000, 0b000, 0b000, 0b000, 0b111),
    ".": (0b000, 0b000, 0b000, 0b000, 0b010),
    "/": (0b001, 0b001, 0b010, 0b100, 0b100),
    " ": (0b000, 0b000, 0b000, 0b000, 0b000),
    "?": (0b111, 0b001, 0b010, 0b000, 0b010),
}
WIDTH, HEIGHT, GAP = 3, 5, 1


@cache
def glyph(c: str) -> np.ndarray:
    return np.array(GLYPHS[c])[:, None] >> np.arange(WIDTH)[::-1] & 1 == 1


def raster(text: str) -> np.ndarray:
    """Which pixels of a line of text are set: 5 rows, 4 columns a glyph."""
    out = np.zeros((HEIGHT, (WIDTH + GAP) * len(text)), bool)
    for i, c in enumerate(text):
        out[:, i * (WIDTH + GAP) : i * (WIDTH + GAP) + WIDTH] = glyph(c if c in GLYPHS else "?")
    return out
