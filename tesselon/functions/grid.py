"""The grid that entities are filed in: levels 0 to 14, 2^level columns, half as many rows, ids row by row from the south-west.

Coordinates are integers of 1e-7 degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 14
UNIT = 10_000_000
HALF, QUARTER = 180 * UNIT, 90 * UNIT


def width(level: int) -> float:
    return 2 * HALF / 2**level


def to_units(degrees: float) -> int:
    """Fixed-point degrees, cut off towards zero."""
    return int(degrees * UNIT)


def cell_id(level: int, lon: int, lat: int) -> int:
    """The cell of a point; -1 off the earth. The antimeridian belongs to column 0, the pole to the last row."""
    if not (-HALF <= lon <= HALF and -QUARTER <= lat <= QUARTER):
        return -1
    x, y = (lon + HALF) % (2 * HALF), min(lat + QUARTER, 2 * QUARTER - 1)
    return int(y / width(level)) * 2**level + int(x / width(level))


def cell_id_column(level: int | Column, lon: Column, lat: Column) -> Column:
    lon, lat = lon.cast("long"), lat.cast("long")
    n = F.lit(2**level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    w = F.lit(2.0 * HALF) / n
    x, y = F.pmod(lon + HALF, F.lit(2 * HALF)), F.least(lat + QUARTER, F.lit(2 * QUARTER - 1))
    cell = F.floor(y / w) * n.cast("long") + F.floor(x / w)
    return F.when(lon.between(-HALF, HALF) & lat.between(-QUARTER, QUARTER), cell).otherwise(F.lit(-1)).cast("long")


def cell_box(level: int, cell: int, enlarge: bool = False) -> tuple[int, int, int, int]:
    """min lon, min lat, max lon, max lat of a cell; enlarged by a cell to the east and north, as far as there is one."""
    n, w = 2**level, width(level)
    y, x = divmod(cell, n)
    lon, lat = int(x * w - HALF), int(y * w - QUARTER)
    if level == 0:
        box = lon, -QUARTER, int(lon + w) - 1, QUARTER
    else:
        box = lon, lat, int(lon + w) - 1, QUARTER if lat == QUARTER - w else int(lat + w) - 1
    if enlarge:
        far = cell_box(level, cell + (x < n - 1) + n * (y < n // 2 - 1))
        box = *map(min, box[:2], far[:2]), *map(max, box[2:], far[2:])
    return box


def span(level: int, box) -> int:
    """Cells that a box may span along its longer side."""
    w = width(level)
    return max(math.ceil(box[2] / w) - math.floor(box[0] / w), math.ceil(box[3] / w) - math.floor(box[1] / w))


def insert_level(box) -> tuple[int, int]:
    """Level and cell an entity of that box is filed under: the deepest level where it spans two cells at most, the cell of its south-west corner."""
    level = next(z for z in range(MAX_LEVEL, -1, -1) if span(z, box) <= 2)
    return level, cell_id(level, box[0], box[1])


def insert_level_column(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    def fits(z: Column) -> Column:
        w = F.lit(2.0 * HALF) / F.pow(F.lit(2.0), z)
        return F.greatest(F.ceil(max_lon / w) - F.floor(min_lon / w), F.ceil(max_lat / w) - F.floor(min_lat / w)) <= 2

    return F.element_at(F.filter(F.array(*[F.lit(z) for z in range(MAX_LEVEL + 1)]), fits), -1)


def ranges(level: int, box, enlarge: bool = True) -> list[tuple[int, int]]:
    """Cell id ranges, a row each, of a box (min lon, min lat, max lon, max lat); (-1, -1) stands for what lies off the earth."""
    a, b, c, d = box
    if b > d:
        return []
    out = set()
    if not (-HALF <= a <= HALF and -HALF <= c <= HALF and -QUARTER <= b <= QUARTER and -QUARTER <= d <= QUARTER):
        out.add((-1, -1))
    a, c = (a if -HALF <= a <= HALF else -HALF), (c if -HALF <= c <= HALF else HALF)
    b, d = (b if -QUARTER <= b <= QUARTER else -QUARTER), (d if -QUARTER <= d <= QUARTER else QUARTER)
    a, c, b, d = min(a, HALF - 1), min(c, HALF - 1), min(b, QUARTER - 1), min(d, QUARTER - 1)
    if a > c:  # across the antimeridian
        out.update(ranges(level, (a, b, HALF - 1, d), enlarge))
        a = -HALF
    w, n = width(level), 2**level
    x1, x2, y1, y2 = (int((v + o) / w) for v, o in ((a, HALF), (c, HALF), (b, QUARTER), (d, QUARTER)))
    if enlarge:
        x1, y1 = max(0, x1 - 1), max(0, y1 - 1)
    out.update((y * n + x1, y * n + x2) for y in range(y1, y2 + 1))
    return sorted(out)


def pruned(level: Column, cell: Column, box, most: int = 8) -> Column:
    """A predicate that scans push down: the cells of each level that a box may touch; at levels of more than `most` rows one hull of them."""
    out = F.lit(False)
    for z in range(MAX_LEVEL + 1):
        rows = ranges(z, box)
        if len(rows) > most:
            rows = [(rows[0][0], rows[-1][1])]
        cells = F.lit(False)
        for lo, hi in rows:
            cells |= cell.between(lo, hi)
        out |= (level == z) & cells
    return out


def touching(box) -> Column:
    """A predicate that scans push down: histories, by level, cell_id and their boxes, that may touch a box."""
    lon = (F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) if box[0] <= box[2] else (F.col("min_lon") <= box[2]) | (F.col("max_lon") >= box[0])
    return pruned(F.col("level"), F.col("cell_id"), box) & lon & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1])


def neighbours(level: int, cell: int) -> list[tuple[int, int]]:
    """Id ranges of a cell and the cells around it; (-1, -1) is among them at the grid's edge."""
    a, b, c, d = cell_box(level, cell)
    return ranges(level, (a - 1, b - 1, c + 1, d + 1), enlarge=False)
