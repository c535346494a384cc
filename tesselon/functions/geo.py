"""Metrics of geometries.

Column functions work on arrays of struct(lon, lat) in degrees and stay in the JVM; the numpy functions beneath serve
grouped Python operators and tests. A line is an array of coordinates, a ring a closed one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: radii in metres, flattening of WGS84
RADIUS_MEAN, RADIUS_EQUATOR, INVERSE_FLATTENING = 6371000.0, 6378137.0, 298.257223563
POLAR_SHARE = 1.0 - 1.0 / INVERSE_FLATTENING
LENGTH_SHARE = POLAR_SHARE**1.5


def length_column(coords: Column) -> Column:
    """Metres along a line: equirectangular, with latitudes corrected for the flattening."""
    points = F.transform(coords, lambda c: F.struct(F.radians(c["lon"]).alias("x"), F.atan(F.lit(LENGTH_SHARE) * F.tan(F.radians(c["lat"]))).alias("y")))
    n = F.size(points)
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.sqrt(F.pow((b["x"] - a["x"]) * F.cos((a["y"] + b["y"]) / 2), F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0))),
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * RADIUS_MEAN


def ring_area_column(ring: Column) -> Column:
    """Square metres in a ring, signed: positive if clockwise."""
    n = F.size(ring)
    sine = lambda c: (lambda x: x / F.sqrt(x * x + 1))(F.lit(POLAR_SHARE) * F.tan(F.radians(c["lat"])))
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(n - 1, F.lit(0))))
    parts = F.zip_with(F.arrays_zip(ring.alias("c"), previous.alias("p")), following, lambda a, b: F.radians(b["lon"] - a["p"]["lon"]) * sine(a["c"]))
    lats = F.transform(ring, lambda c: c["lat"])
    middle = (F.array_max(lats) + F.array_min(lats)) / 2
    scale = F.lit(0.5 * RADIUS_EQUATOR**2) * (1 - F.pow(F.cos(F.radians(middle)), F.lit(2.0)) / INVERSE_FLATTENING)
    return F.when(n > 2, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) * scale).otherwise(F.lit(0.0))


def polygon_area_column(outer: Column, inners: Column | None = None) -> Column:
    area = F.abs(ring_area_column(outer))
    if inners is not None:
        area -= F.aggregate(F.transform(inners, lambda r: F.abs(ring_area_column(r))), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(area, F.lit(0.0))


def roundness_column(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(0.0))


def bearing_column(a: Column, b: Column) -> Column:
    """Radians from north, clockwise, along the great circle from a to b; within [0, 2 pi)."""
    x1, x2, y1, y2 = F.radians(a["lon"]), F.radians(b["lon"]), F.radians(a["lat"]), F.radians(b["lat"])
    angle = F.atan2(F.sin(x2 - x1) * F.cos(y2), F.cos(y1) * F.sin(y2) - F.sin(y1) * F.cos(y2) * F.cos(x2 - x1))
    return F.pmod(angle + 2 * math.pi, F.lit(2 * math.pi))


# -- numpy: arrays of shape (n, 2) with lon, lat


def length(coords: np.ndarray) -> float:
    if len(coords) < 2:
        return 0.0
    x, y = np.radians(coords[:, 0]), np.arctan(LENGTH_SHARE * np.tan(np.radians(coords[:, 1])))
    return float(np.hypot(np.diff(x) * np.cos((y[1:] + y[:-1]) / 2), np.diff(y)).sum() * RADIUS_MEAN)


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    t = POLAR_SHARE * np.tan(np.radians(ring[:, 1]))
    total = (np.radians(np.roll(ring[:, 0], -1) - np.roll(ring[:, 0], 1)) * t / np.sqrt(t * t + 1)).sum()
    middle = math.radians((ring[:, 1].max() + ring[:, 1].min()) / 2)
    return float(total * 0.5 * RADIUS_EQUATOR**2 * (1 - math.cos(middle) ** 2 / INVERSE_FLATTENING))


def turns(ring: list[tuple]) -> float:
    """A number of the sign of ring_area, of a list of pairs."""
    if len(ring) > 64:
        return ring_area(np.array(ring, float))
    total, n = 0.0, len(ring)
    for k, (_, y) in enumerate(ring):
        t = POLAR_SHARE * math.tan(math.radians(y))
        total += (ring[k + 1 - n][0] - ring[k - 1][0]) * t / math.sqrt(t * t + 1)
    return total


def polygon_area(outer: np.ndarray, inners: list[np.ndarray] = ()) -> float:
    return max(0.0, abs(ring_area(outer)) - sum(abs(ring_area(r)) for r in inners))


def bearing(a, b) -> float:
    x1, y1, x2, y2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    return (math.atan2(math.sin(x2 - x1) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(x2 - x1)) + 2 * math.pi) % (2 * math.pi)


def _centroid(line: np.ndarray) -> np.ndarray:
    """Mean of the segments' middles, weighted by their planar length."""
    d = np.hypot(*np.diff(line, axis=0).T)
    return (line[1:] + line[:-1]).T @ d / (2 * d.sum()) if d.sum() else line[0]


def _planar(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.radians(line)
    return np.diff(r[:, 0]) * np.cos((r[1:, 1] + r[:-1, 1]) / 2), np.diff(r[:, 1])


def squareness(lines: list[np.ndarray]) -> float:
    """Rectilinearity of lines or rings: the least L1 length over turns that align an edge with the grid, against the L2 length; 1 for right angles only."""
    lines = [x for x in lines if len(x) > 1]
    least = math.inf
    centers = [_centroid(x) for x in lines]
    for edge_line in lines:
        for a, b in zip(edge_line, edge_line[1:], strict=False):
            angle, total = bearing(a, b), 0.0
            for line, center in zip(lines, centers, strict=True):
                squeeze = math.cos(math.radians(center[1]))
                p = (line - center) * (squeeze, 1.0)
                turned = np.stack([p[:, 0] * math.cos(angle) - p[:, 1] * math.sin(angle), p[:, 0] * math.sin(angle) + p[:, 1] * math.cos(angle)], axis=1)
                dx, dy = _planar(turned / (squeeze, 1.0) + center)
                total += float(np.abs(dx).sum() + np.abs(dy).sum())
            least = min(least, total)
    straight = sum(float(np.hypot(*_planar(x)).sum()) for x in lines)
    return 4 / (4 - math.pi) * (straight / least - math.pi / 4) if least and math.isfinite(least) else 0.0


def squareness_of_many(lines: np.ndarray) -> np.ndarray:
    """squareness of lines of equally many places, each by itself; lines: of shape (how many, places, 2)."""
    step = np.diff(lines, axis=1)
    size = np.hypot(step[..., 0], step[..., 1])
    total = size.sum(1)
    middle = lines[:, 1:] + lines[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        center = np.where(total[:, None] > 0, (middle * size[..., None]).sum(1) / (2 * total[:, None]), lines[:, 0])
    x, y = np.radians(lines[..., 0]), np.radians(lines[..., 1])
    dx = x[:, 1:] - x[:, :-1]
    angle = np.arctan2(np.sin(dx) * np.cos(y[:, 1:]), np.cos(y[:, :-1]) * np.sin(y[:, 1:]) - np.sin(y[:, :-1]) * np.cos(y[:, 1:]) * np.cos(dx))
    angle = (angle + 2 * math.pi) % (2 * math.pi)
    squeeze = np.cos(np.radians(center[:, 1]))
    p, q = (lines[..., 0] - center[:, :1]) * squeeze[:, None], lines[..., 1] - center[:, 1:]
    c, s = np.cos(angle)[..., None], np.sin(angle)[..., None]
    u = (p[:, None] * c - q[:, None] * s) / squeeze[:, None, None] + center[:, 0, None, None]
    v = p[:, None] * s + q[:, None] * c + center[:, 1, None, None]
    flat = lambda a, b: (np.diff(np.radians(a), axis=-1) * np.cos((np.radians(b)[..., 1:] + np.radians(b)[..., :-1]) / 2), np.diff(np.radians(b), axis=-1))
    east, north = flat(u, v)
    least = (np.abs(east) + np.abs(north)).sum(-1).min(1)
    straight = np.hypot(*flat(lines[..., 0], lines[..., 1])).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((least > 0) & np.isfinite(least), 4 / (4 - math.pi) * (straight / least - math.pi / 4), 0.0)


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Which points lie in the polygon of these rings (outer and holes alike), by crossings to the right; on an edge counts as inside."""
    odd, edge = np.zeros(len(points), bool), np.zeros(len(points), bool)
    x, y = points[:, :1], points[:, 1:]
    for ring in rings:
        (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        edge |= ((side == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any(1)
        spans = (y1 > y) != (y2 > y)
        odd ^= (spans & ((side > 0) == (y2 > y1))).sum(1) % 2 == 1
    return odd | edge


def box_in_polygon(box, rings: list[np.ndarray]) -> bool:
    """Whether a box lies in the polygon for sure: its corners do and no edge of the polygon meets it."""
    a, b, c, d = box
    corners = np.array([(a, b), (c, b), (c, d), (a, d)], float)
    return bool(inside(corners, rings).all()) and not any(len(clip_line(r[i : i + 2], box)) for r in rings for i in range(len(r) - 1))


def box_outside_polygon(box, rings: list[np.ndarray]) -> bool:
    """Whether a box lies outside the polygon for sure."""
    a, b, c, d = box
    corners = np.array([(a, b), (c, b), (c, d), (a, d)], float)
    return not inside(corners, rings).any() and not any(len(clip_line(r[i : i + 2], box)) for r in rings for i in range(len(r) - 1))


def clip_line(line: np.ndarray, box) -> list[np.ndarray]:
    """Parts of a line in a box (min lon, min lat, max lon, max lat): Liang-Barsky by segment."""
    out, part = [], []
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        t0, t1, dx, dy = 0.0, 1.0, x2 - x1, y2 - y1
        for p, q in ((-dx, x1 - box[0]), (dx, box[2] - x1), (-dy, y1 - box[1]), (dy, box[3] - y1)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 > t1:
            continue
        start, end = (x1 + t0 * dx, y1 + t0 * dy), (x1 + t1 * dx, y1 + t1 * dy)
        if part and part[-1] == start:
            part.append(end)
        else:
            if len(part) > 1:
                out.append(np.array(part))
            part = [start, end]
    if len(part) > 1:
        out.append(np.array(part))
    return [p for p in out if len(np.unique(p, axis=0)) > 1]


def box_shares(x, y, dx, dy, box) -> tuple[np.ndarray, np.ndarray]:
    """From which to which share of each step (dx, dy) from (x, y) a box holds it; they meet it only in a point, or not at all, where the first is not less."""
    a, b, c, d = box

    def along(start, step, low, high):
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = (low - start) / step, (high - start) / step
        still = step == 0
        return np.where(still, np.where((low <= start) & (start <= high), 0.0, 2.0), np.minimum(s, t)), np.where(still, 1.0, np.maximum(s, t))

    (x0, x1), (y0, y1) = along(x, dx, a, c), along(y, dy, b, d)
    return np.maximum(0.0, np.maximum(x0, y0)), np.minimum(1.0, np.minimum(x1, y1))


def clip_lines(x: np.ndarray, y: np.ndarray, of: np.ndarray, box) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of many lines in a box at once. x, y, of: all their places and of which line each is. Gives the places of the parts, how many each has, and its line.

    A line that meets the box in single points alone has no part.
    """
    first = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, int)
    dx, dy = x[first + 1] - x[first], y[first + 1] - y[first]
    t0, t1 = box_shares(x[first], y[first], dx, dy, box)
    kept = np.flatnonzero(t0 < t1)
    first, dx, dy, t0, t1 = first[kept], dx[kept], dy[kept], t0[kept], t1[kept]
    if not len(first):
        return np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    new = np.ones(len(first), bool)
    new[1:] = (of[first[1:]] != of[first[:-1]]) | (first[1:] != first[:-1] + 1) | (t1[:-1] < 1) | (t0[1:] > 0)
    starts = np.flatnonzero(new)
    part = np.cumsum(new) - 1
    xs, ys = np.empty(len(first) + len(starts)), np.empty(len(first) + len(starts))
    begins, ends = starts + np.arange(len(starts)), np.arange(len(first)) + part + 1
    xs[begins], ys[begins] = (x[first] + t0 * dx)[starts], (y[first] + t0 * dy)[starts]
    xs[ends], ys[ends] = np.where(t1 < 1, x[first] + t1 * dx, x[first + 1]), np.where(t1 < 1, y[first] + t1 * dy, y[first + 1])
    sizes, lines = np.bincount(part, minlength=len(starts)) + 1, of[first[starts]]
    moves = np.logical_or.reduceat((dx != 0) | (dy != 0), starts)
    if not moves.all():  # places said twice are no part
        some = np.repeat(moves, sizes)
        xs, ys, sizes, lines = xs[some], ys[some], sizes[moves], lines[moves]
    return xs, ys, sizes, lines


def _cuts(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places t in [0, 1] of a segment at which it meets edges (n, 2, 2), with those of their ends that lie on it; sorted, 0 and 1 among them."""
    d, e, w = b - a, edges[:, 1] - edges[:, 0], edges[:, 0] - a
    cross = d[0] * e[:, 1] - d[1] * e[:, 0]
    found = [0.0, 1.0]
    some = cross != 0
    if some.any():
        t = (w[some, 0] * e[some, 1] - w[some, 1] * e[some, 0]) / cross[some]
        u = (w[some, 0] * d[1] - w[some, 1] * d[0]) / cross[some]
        found += t[(t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()
    size = float(d @ d)
    if size and not some.all():  # edges along the segment
        along = ~some & (np.abs(w[:, 0] * d[1] - w[:, 1] * d[0]) <= 1e-12 * size**0.5)
        t = ((edges[along] - a) @ d / size).ravel()
        found += t[(t > 0) & (t < 1)].tolist()
    return np.unique(found)


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.stack([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 1]) if any(len(r) > 1 for r in rings) else np.zeros((0, 2, 2))


def _near(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Edges whose box meets that of a segment."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return edges[(edges.max(1) >= lo).all(1) & (edges.min(1) <= hi).all(1)]


def line_in_polygon(line: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """Parts of a line in the polygon of these rings; edges of the polygon belong to it."""
    edges, out, part = _edges(rings), [], []
    for a, b in zip(line, line[1:], strict=False):
        t = _cuts(a, b, _near(a, b, edges))
        within = inside(a + (b - a) * ((t[1:] + t[:-1]) / 2)[:, None], rings)
        for lo, hi, ok in zip(t, t[1:], within, strict=False):
            start, end = a + (b - a) * lo if lo else a, a + (b - a) * hi if hi < 1 else b
            if not ok:
                part = []
            elif part and (part[-1] == start).all():
                part.append(end)
            else:
                part = [start, end]
                out.append(part)
    return [np.array(p) for p in out]


def _oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings with the polygon's inside to their right: turned where the place just right of the first long edge lies outside."""
    out = []
    for r in rings:
        steps = np.hypot(*np.diff(r, axis=0).T)
        k = int(steps.argmax())
        (x1, y1), (x2, y2) = r[k], r[k + 1]
        shift = 1e-7 * np.array([y2 - y1, x1 - x2])
        out.append(r if inside(((r[k] + r[k + 1]) / 2 + shift)[None], rings)[0] else r[::-1])
    return out


def polygon_in_polygon(polygon: list[np.ndarray], region: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The common part of two polygons (rings each: outer and holes), as polygons (outer first, clockwise; holes the other way).

    The edges of each are cut where they meet the other; those that lie in the other (of edges both have, once, if the
    insides are on the same side) are strung together to rings, sharpest turn to the inside first.
    """
    sides = [_oriented([r for r in rings if len(r) > 3 and ring_area(r)]) for rings in (polygon, region)]
    if not sides[0] or not sides[1]:
        return []
    key = lambda p: (round(float(p[0]), 10), round(float(p[1]), 10))
    follow: dict[tuple, list[tuple]] = {}
    seen = set()
    for mine, other in (sides, sides[::-1]):
        edges = _edges(other)
        for ring in mine:
            for a, b in zip(ring, ring[1:], strict=False):
                t = _cuts(a, b, _near(a, b, edges))
                points = [a, *(a + (b - a) * x for x in t[1:-1]), b]
                d = b - a
                shift = 1e-7 * np.array([d[1], -d[0]]) * np.diff(t)[:, None]
                middles = a + d * ((t[1:] + t[:-1]) / 2)[:, None]
                # in the closed other, and the strip to the right in it too: so of edges both have, those of one direction
                ok = inside(middles, other) & inside(middles + shift, other)
                for p, q, yes in zip(points, points[1:], ok, strict=False):
                    edge = key(p), key(q)
                    if yes and edge[0] != edge[1] and edge not in seen:
                        seen.add(edge)
                        follow.setdefault(edge[0], []).append(edge[1])
    rings = []
    while follow:
        start = next(iter(follow))
        path = [start]
        while True:
            here = path[-1]
            nexts = follow.get(here)
            if not nexts:
                path = []
                break
            pick = 0
            if len(nexts) > 1 and len(path) > 1:
                back = math.atan2(path[-2][1] - here[1], path[-2][0] - here[0])
                turn = [(math.atan2(q[1] - here[1], q[0] - here[0]) - back) % (2 * math.pi) for q in nexts]
                pick = turn.index(min(turn))  # the first to the right of where it came from, counter-clockwise from there
            q = nexts.pop(pick)
            if not nexts:
                del follow[here]
            if q == start:
                break
            path.append(q)
        if len(path) > 2:
            rings.append(np.array([*path, path[0]]))
    outers = [[r] for r in rings if ring_area(r) > 0]
    for hole in (r for r in rings if ring_area(r) < 0):
        home = [o for o in outers if inside(hole, o[:1]).all()]
        if home:
            min(home, key=lambda o: ring_area(o[0])).append(hole)
    return outers


def clip_ring(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """A ring cut to a convex ring (counter-clockwise or not), by Sutherland-Hodgman; empty if nothing is left."""
    edge = convex[:-1] if (convex[0] == convex[-1]).all() else convex
    if ((np.roll(edge[:, 0], -1) - edge[:, 0]) * (np.roll(edge[:, 1], -1) + edge[:, 1])).sum() > 0:
        edge = edge[::-1]
    out = [tuple(p) for p in (ring[:-1] if (ring[0] == ring[-1]).all() else ring)]
    for (ax, ay), (bx, by) in zip(edge, np.roll(edge, -1, axis=0), strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return np.zeros((0, 2))
    return np.array([*out, out[0]]) if len(out) > 2 else np.zeros((0, 2))
