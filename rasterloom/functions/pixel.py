"""Column expressions on pixels: depth, luminance, rounding, borders, orientation, hashed texture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights, in floating point and as 14-bit integers.
RED, GREEN, BLUE = 0.299, 0.587, 0.114
RED14, GREEN14, BLUE14 = 4899, 9617, 1868


def expand8(v: Column) -> Column:
    """8 to 16 bits: 255 becomes 65535."""
    return v * 257


def reduce16(v: Column) -> Column:
    return F.shiftright(v, 8)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * RED + g * GREEN + b * BLUE


def luminance8(r: Column, g: Column, b: Column) -> Column:
    """Of 8-bit channels, in whole numbers."""
    return F.shiftright(r * RED14 + g * GREEN14 + b * BLUE14 + (1 << 13), 14)


def to_u16(v: Column) -> Column:
    """Half to even, then clipped."""
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(65535.0)).cast("int")


def reflect101(i: Column, n: int) -> Column:
    """Mirrored about the first and last place, which are not repeated; over any number of mirrors."""
    if n == 1:
        return i * 0
    period = 2 * (n - 1)
    m = F.pmod(i, F.lit(period))
    return F.least(m, period - m)


def replicate(i: Column, n: int) -> Column:
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def oriented(y: Column, x: Column, h: int, w: int, orientation: int) -> tuple[Column, Column]:
    """Where a stored pixel is shown, by the orientation tag 1 to 8 (from 5 on rows and columns change places)."""
    mirrored_y, mirrored_x = (h - 1) - y, (w - 1) - x
    return {
        1: (y, x), 2: (y, mirrored_x), 3: (mirrored_y, mirrored_x), 4: (mirrored_y, x),
        5: (x, y), 6: (x, mirrored_y), 7: (mirrored_x, mirrored_y), 8: (mirrored_x, y),
    }[orientation]


def texture(x: Column, y: Column, channel: int) -> Column:
    """A hashed texture of 32-bit unsigned words, 5000 to 59999 (fixed multipliers)."""
    word = F.lit(0xFFFFFFFF).cast("long")
    h = (x.cast("long") * 374761393 + y.cast("long") * 668265263).bitwiseAND(word)
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * 1274126177).bitwiseAND(word)
    h = h.bitwiseXOR(F.shiftright(h, 16))
    return F.lit(5000) + F.shiftright(h, 5 * channel) % 55000
