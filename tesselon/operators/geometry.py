"""Geometries of entities: lines and rings from members, assembly of multipolygons, clipping, and regions.

Coordinates here are floats of whatever unit the caller uses; lines and rings are arrays of shape (n, 2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import areas, geo
from tesselon.operators.members import ENTITY, asof_join

COORDS = "array<struct<lon: double, lat: double>>"


def way_coords(ways: DataFrame, nodes: DataFrame, ts: str = "ts", of: str | None = None) -> DataFrame:
    """ways (each row at its own time `ts`) with coords: its nodes' places then, in order; nodes missing or deleted are left out. of: the type whose rows alone have coords."""
    mine = F.size("members") > 0
    if of:
        mine &= F.col("osm_type") == of
    refs = ways.where(mine).select(F.col("osm_type").alias("w_type"), F.col("osm_id").alias("w_id"), F.col(ts).alias("ts"), F.posexplode("members").alias("pos", "m"))
    refs = refs.where("m.type = 'node'").select("w_type", "w_id", "ts", "pos", F.lit("node").alias("osm_type"), F.col("m.id").alias("osm_id"))
    at = asof_join(refs, nodes.where("osm_type = 'node'").select(*ENTITY, "ts", "version", "visible", "lon_e7", "lat_e7"), ENTITY)
    at = at.where("m_visible and m_lon_e7 is not null")
    point = F.struct("pos", (F.col("m_lon_e7") / 1e7).alias("lon"), (F.col("m_lat_e7") / 1e7).alias("lat"))
    # a set: rows of the same way and time, of which there may be several, have the same places
    lines = at.groupBy("w_type", "w_id", "ts").agg(F.transform(F.array_sort(F.collect_set(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))
    lines = lines.select(F.col("w_type").alias("osm_type"), F.col("w_id").alias("osm_id"), F.col("ts").alias(ts), "coords")
    return ways.join(lines, [*ENTITY, ts], "left").withColumn("coords", F.coalesce("coords", F.array().cast(COORDS)))


def way_geometry_column(coords: Column, tags: Column, compat: bool = True) -> Column:
    """point, line or polygon (closed, four points or more, and an area by its tags); null without points."""
    n = F.size(coords)
    closed = (n >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))
    return F.when(n == 0, None).when(n == 1, "point").when(closed & areas.way_is_area_column(tags, compat), "polygon").otherwise("line")


def join_rings(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings from lines that share end points, in either direction; what does not close is left out. Pinched rings are split."""
    return [np.array(r) for r in _closed([[tuple(p) for p in x] for x in lines])]


def _closed(lines: list[list[tuple]]) -> list[list[tuple]]:
    left = [list(x) for x in lines if len(x) > 1]
    out = []
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            k = next((k for k, x in enumerate(left) if ring[-1] in (x[0], x[-1])), None)
            if k is None:
                break
            piece = left.pop(k)
            ring += piece[1:] if piece[0] == ring[-1] else piece[-2::-1]
        if ring[0] == ring[-1] and len(ring) > 3:
            out += _unpinched(ring)
    return out


def _unpinched(ring: list) -> list[list]:
    """A ring that meets itself in a point, as simple rings."""
    seen, out, path = {}, [], []
    for p in ring:
        if p in seen and len(path) > seen[p]:
            loop = [*path[seen[p] :], p]
            if len(loop) > 3:
                out.append(loop)
            for q in path[seen[p] + 1 :]:
                seen.pop(q, None)
            path = path[: seen[p] + 1]
        else:
            seen[p] = len(path)
            path.append(p)
    return out


def merge_touching(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Inner rings that share edges, joined along them: shared edges cancel out."""
    edges: dict = {}
    for r in rings:
        for a, b in zip(map(tuple, r), map(tuple, r[1:]), strict=False):
            edges[frozenset((a, b))] = edges.get(frozenset((a, b)), 0) + 1
    if all(n == 1 for n in edges.values()):
        return rings
    return join_rings([np.array(sorted(e)) for e, n in edges.items() if n % 2 and len(e) == 2])


def assemble(outer_lines: list[np.ndarray], inner_lines: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Polygons (outer, inners) of a multipolygon relation.

    With one outer ring all inner rings are its holes; with more, each goes to the smallest outer that holds it, and one
    that none holds is dropped. Outer rings come clockwise, inner ones counter-clockwise.
    """
    outers, inners = join_rings(outer_lines), merge_touching(join_rings(inner_lines))
    turned = lambda r, sign: r if geo.ring_area(r) * sign >= 0 else r[::-1]
    holes: list[list[np.ndarray]] = [[] for _ in outers]
    order = sorted(range(len(outers)), key=lambda k: abs(geo.ring_area(outers[k])))
    for r in inners:
        k = 0 if len(outers) == 1 else next((k for k in order if geo.inside(r, [outers[k]]).all()), None)
        if outers and k is not None:
            holes[k].append(turned(r, -1))
    return [(turned(o, 1), h) for o, h in zip(outers, holes, strict=True)]


def assemble_tuples(outer_lines: list[list[tuple]], inner_lines: list[list[tuple]]) -> list[tuple[list[tuple], list[list[tuple]]]]:
    """assemble of lists of tuples; rings without inner ones are not worth arrays."""
    if not inner_lines:
        return [(r if geo.turns(r) >= 0 else r[::-1], []) for r in _closed(outer_lines)]
    arrays = lambda lines: [np.array(x, float) for x in lines]
    plain = lambda r: list(map(tuple, r.tolist()))
    return [(plain(outer), [plain(r) for r in inners]) for outer, inners in assemble(arrays(outer_lines), arrays(inner_lines))]


def clipped_length_column(coords: Column, box: tuple[float, float, float, float]) -> Column:
    """Metres of the parts of lines that lie in a box; lines wholly inside or outside are measured in the JVM, and go to Python as null."""

    @F.pandas_udf("double")
    def cut(c: pd.Series) -> pd.Series:
        return c.map(lambda line: sum(map(geo.length, geo.clip_line(np.array([(p["lon"], p["lat"]) for p in line], float), box))) if line is not None and len(line) else 0.0)

    lons, lats = F.transform(coords, lambda p: p["lon"]), F.transform(coords, lambda p: p["lat"])
    a, b, c, d = box
    within = (F.array_min(lons) >= a) & (F.array_max(lons) <= c) & (F.array_min(lats) >= b) & (F.array_max(lats) <= d)
    apart = (F.array_max(lons) < a) | (F.array_min(lons) > c) | (F.array_max(lats) < b) | (F.array_min(lats) > d)
    from tesselon.functions.geo import length_column

    none = apart | (F.size(coords) < 2)
    return F.when(within, length_column(coords)).when(none, F.lit(0.0)).otherwise(cut(F.when(~(within | none), coords)))
