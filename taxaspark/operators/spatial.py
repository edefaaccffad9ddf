"""Points stored in the order of a space-filling key, and boxes as ranges of it.

The key interleaves the bits of latitude and longitude, so that neighbours on the map lie near each
other in the files. A box is taken apart into few ranges of keys, which prune files and row groups;
the coordinates themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.functions import exprs

#: Bits of an axis, and ranges that a box is taken apart into at most.
BITS, RANGES = 16, 32
KEY = "_place"
#: What spreads 16 bits so that a free bit follows each: shift and mask, in order.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _cell(c: Column, low: float, extent: float) -> Column:
    """Number of a coordinate's cell on its axis; those outside belong to the outermost."""
    at = F.floor((c - low) / extent * (1 << BITS))
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), at)).cast("long")


def _spread(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def place_key(lat: Column, lon: Column) -> Column:
    """Null where a coordinate is null or not a number."""
    key = F.shiftleft(_spread(_cell(lat, -90, 180)), 1).bitwiseOR(_spread(_cell(lon, -180, 360)))
    return F.when(~F.isnan(lat) & ~F.isnan(lon), key)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write ``df(lat, lon, ...)`` in key order and read it; rows without a place come last."""
    keyed = df.withColumn(KEY, place_key(F.col("lat"), F.col("lon")))
    order = [F.col(KEY).asc_nulls_last(), *[F.col(f"`{c}`") for c in df.columns[:1]]]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _number(x: float, low: float, extent: float) -> int:
    return max(0, min((1 << BITS) - 1, int((x - low) / extent * (1 << BITS) // 1)))


def key_ranges(lat0: float, lat1: float, lon0: float, lon1: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, ends included, that cover a box; at most ``most``, so some cover more than it."""
    if lat0 > lat1 or lon0 > lon1:
        return []
    y0, y1, x0, x1 = _number(lat0, -90, 180), _number(lat1, -90, 180), _number(lon0, -180, 360), _number(lon1, -180, 360)
    squares, found = [(0, 0, 0)], []  # (bits of the side that are fixed, y, x): squares that may hold a part, widest first
    while squares:
        level, y, x = squares.pop(0)
        side = 1 << (BITS - level)
        if y > y1 or y + side <= y0 or x > x1 or x + side <= x0:
            continue
        whole = y >= y0 and y + side <= y1 + 1 and x >= x0 and x + side <= x1 + 1
        if whole or level == BITS or len(squares) + len(found) + 4 > 4 * most:
            key = sum(((y >> b & 1) << 1 | (x >> b & 1)) << 2 * b for b in range(BITS))
            found.append((key, key + side * side - 1))
        else:
            half = side // 2
            squares += [(level + 1, y + dy, x + dx) for dy in (0, half) for dx in (0, half)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    while len(out) > most:  # close the narrowest gap
        k = min(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
        out[k - 1 : k + 1] = [(out[k - 1][0], out[k][1])]
    return out


def in_box(lat0: float, lat1: float, lon0: float, lon1: float) -> Column:
    """As :func:`exprs.bbox`, for a table that :func:`store` wrote: the ranges reach its scan."""
    near = F.lit(False)
    for a, b in key_ranges(lat0, lat1, lon0, lon1):
        near = near | F.col(KEY).between(a, b)
    return near & exprs.bbox(lat0, lat1, lon0, lon1)
