"""Geometries of the views' rows, as columns.

A shape is a struct: its kind (one of filters.GEOMETRIES, null without any place), points, lines and polygons (each a list of
rings, the outer one first). Shapes of nodes and ways are built in the JVM; relations, whose rings must be joined, and
clipping at an edge go through Arrow batches, whole ones where lines are cut by boxes. Members are looked up by the time for
which a version of theirs holds, once for all the rows that show one version of an entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import areas, geo
from tesselon.functions.filters import TYPES
from tesselon.operators.geometry import COORDS, assemble, assemble_tuples
from tesselon.operators.members import lifetimes

SHAPE = f"struct<kind: string, points: {COORDS}, lines: array<{COORDS}>, polygons: array<array<{COORDS}>>>"
_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_ARROW = pa.struct([("kind", pa.string()), ("points", pa.list_(_POINT)), ("lines", pa.list_(pa.list_(_POINT))), ("polygons", pa.list_(pa.list_(pa.list_(_POINT))))])
#: Metrics of a shape that filters and mappers may name.
METRICS = ("geometry", "area", "length", "perimeter", "vertices", "outers", "inners", "roundness", "squareness")


@dataclass(frozen=True)
class AreaRules:
    """Which ways (closed ones) and relations are areas, by their tags; give others to override the usual rules."""

    way_is_area: Callable[[Column], Column] = areas.way_is_area_column
    relation_is_area: Callable[[Column], Column] = areas.relation_is_area_column


def _struct(kind: Column | None, points: Column | None = None, lines: Column | None = None, polygons: Column | None = None) -> Column:
    none = lambda x: F.array() if x is None else x
    return F.struct((F.lit(None) if kind is None else kind).alias("kind"), none(points).alias("points"), none(lines).alias("lines"), none(polygons).alias("polygons")).cast(SHAPE)


def point_shape() -> Column:
    """The shape of a row's own place, where it has one."""
    point = F.struct((F.col("lon_e7") / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat"))
    return F.when(F.col("lon_e7").isNotNull() & F.col("lat_e7").isNotNull(), _struct(F.lit("point"), F.array(point))).otherwise(_struct(None))


def way_shape(coords: Column, area: Column) -> Column:
    """Of a way's places, in order: a polygon if they close (four or more) and it is an area, else a line; one place is a point."""
    n = F.size(coords)
    closed = (n >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))
    return (
        F.when(n == 0, _struct(None))
        .when(n == 1, _struct(F.lit("point"), coords))
        .when(closed & area, _struct(F.lit("polygon"), polygons=F.array(F.array(coords))))
        .otherwise(_struct(F.lit("line"), lines=F.array(coords)))
    )


#: Columns of rows that stand for one version of their entity: the first and the last time at which any of them does, and the times of the row itself.
SPAN = ("__first", "__last")
TIMES = "__times"


def _alive(members: DataFrame, kind: str, instants: list | None, *columns) -> DataFrame:
    """osm_id, since, until, columns of the visible versions of a type; of those that hold at one of the instants, if these are given."""
    v = lifetimes(members.where(F.col("osm_type") == kind), "visible", *columns).where("visible").drop("visible")
    if instants is None:
        return v
    times = F.array(*[F.lit(t) for t in instants]).cast("array<timestamp_ntz>")
    return v.where(F.exists(times, lambda t: _holds(F.col("since"), F.col("until"), t)))


def _holds(since: Column, until: Column, t: Column) -> Column:
    return (since <= t) & (until.isNull() | (t < until))


def _met(refs: DataFrame, states: DataFrame) -> DataFrame:
    """refs (osm_id: a member, wanted from lo to hi) with each of its states within that time: one row for each state, not for each time."""
    return refs.join(states, "osm_id").where((F.col("since") <= F.col("hi")) & (F.col("until").isNull() | (F.col("until") > F.col("lo"))))


def _references(rows: DataFrame) -> DataFrame:
    """of, at, lo, hi, pos, role, type, osm_id: the members of each version that rows stand for, once."""
    first = rows.where((F.array_min(TIMES) == F.col(SPAN[0])) & (F.size("members") > 0))
    refs = first.select(F.col("osm_id").alias("of"), F.col(SPAN[0]).alias("at"), F.col(SPAN[0]).alias("lo"), F.col(SPAN[1]).alias("hi"), F.posexplode("members").alias("pos", "m"))
    return refs.select("of", "at", "lo", "hi", "pos", F.col("m.role").alias("role"), F.col("m.type").alias("type"), F.col("m.id").alias("osm_id"))


def _joined(rows: DataFrame, found: DataFrame, place: Column, ts: str, kept: tuple[str, ...]) -> DataFrame:
    """A row for each time `ts` of rows, with `found`: what was found for their version and holds then, sorted; of that `kept`.

    All stays with the entity, so that windows over it need no shuffle; what a generator gives is worked out once (of one that is
    not outer, the optimizer also asks for the size, and works all out again).
    """
    lists = found.select("of", "at", place.alias("x")).repartition("of").groupBy("of", "at").agg(F.sort_array(F.collect_list("x")).alias("found"))  # one version's members
    lists = lists.select(F.col("of").alias("osm_id"), F.col("at").alias(SPAN[0]), "found")
    out = rows.drop(ts).repartition("osm_id").join(lists, ["osm_id", SPAN[0]], "left")
    then = lambda t: F.transform(F.filter("found", lambda x: _holds(x["since"], x["until"], t)), lambda x: F.struct(*[x[c].alias(c) for c in kept]))
    return out.select(*[c for c in rows.columns if c != ts], F.inline_outer(F.transform(TIMES, lambda t: F.struct(t.alias(ts), then(t).alias("found")))))


def _ways(rows: DataFrame, nodes: DataFrame, ts: str, rules: AreaRules) -> DataFrame:
    met = _met(_references(rows).where("type = 'node'").drop("role", "type"), nodes)
    rows = _joined(rows, met, F.struct("pos", "since", "until", "lon", "lat"), ts, ("lon", "lat"))
    return rows.withColumn("shape", way_shape(F.coalesce("found", F.array().cast(COORDS)), rules.way_is_area(F.col("tags")))).drop("found")


def _relations(rows: DataFrame, nodes: DataFrame, ways: DataFrame, ts: str, rules: AreaRules) -> DataFrame:
    refs = _references(rows)
    place = ("of", "at", "pos", "mpos", "since", "until", "role", "area", "lon", "lat")
    own = _met(refs.where("type = 'node'"), nodes).withColumn("mpos", F.lit(0)).withColumn("area", F.lit(False)).select(*place)
    met = _met(refs.where("type = 'way'"), ways)  # a way's nodes are wanted while the way's version holds
    inner = met.select("of", "at", F.greatest("lo", "since").alias("lo"), "hi", F.col("since").alias("w_since"), F.col("until").alias("w_until"), "pos", "role", "area", F.posexplode("members").alias("mpos", "m"))
    inner = inner.where("m.type = 'node'").select("of", "at", "lo", "hi", "w_since", "w_until", "pos", "role", "area", "mpos", F.col("m.id").alias("osm_id"))
    inner = _met(inner, nodes).where("w_until is null or since < w_until")
    inner = inner.withColumn("since", F.greatest("since", "w_since")).withColumn("until", F.least("until", "w_until")).select(*place)
    rows = _joined(rows, own.union(inner), F.struct(*place[2:]), ts, ("pos", "role", "area", "lon", "lat"))

    @F.arrow_udf(SHAPE)
    def build(area: pa.Array, parts: pa.Array) -> pa.Array:
        return relation_shapes(area.to_pylist(), parts)

    build = build.asNondeterministic()  # else each use of the shape builds it anew
    return rows.withColumn("shape", build(rules.relation_is_area(F.col("tags")), F.col("found"))).drop("found")


def _pairs(line) -> np.ndarray:
    return np.array([(p["lon"], p["lat"]) for p in line], float).reshape(-1, 2)


def _plain(line) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for x, y in line]


def relation_shape(area: bool, parts: list[dict]) -> dict:
    """A multipolygon of the ways by their roles, if it is an area and an outer ring closes; else the collection of the members' own shapes."""
    if area:
        ways = [(p["role"], _pairs(p["coords"])) for p in parts if len(p["coords"]) > 1]
        polygons = assemble([c for role, c in ways if role in ("outer", "", None)], [c for role, c in ways if role == "inner"])
        if polygons:
            return {"kind": "polygon", "points": [], "lines": [], "polygons": [[_plain(r) for r in (outer, *inners)] for outer, inners in polygons]}
    out = {"kind": "other" if parts else None, "points": [], "lines": [], "polygons": []}
    for p in parts:
        c = p["coords"]
        if len(c) == 1:
            out["points"].append(c[0])
        elif p["area"] and len(c) >= 4 and c[0] == c[-1]:
            out["polygons"].append([c])
        else:
            out["lines"].append(c)
    return out


def _nested(sizes, values: pa.Array, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)


def _points(x, y) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], fields=list(_POINT))


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def relation_shapes(area: list[bool], parts: pa.ListArray) -> pa.StructArray:
    """relation_shape of each row of parts: the places (pos, role, area, lon, lat) of its members, those of one member together."""
    sizes, flat = _sizes(parts), parts.flatten()
    places = list(zip(flat.field("lon").to_pylist(), flat.field("lat").to_pylist(), strict=True))
    pos, row = flat.field("pos").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    roles, areas_of = flat.field("role").take(pa.array(starts)).to_pylist(), flat.field("area").take(pa.array(starts)).to_pylist()
    bounds, at = [*starts.tolist(), len(pos)], np.searchsorted(row[starts], np.arange(len(sizes) + 1)).tolist()
    kinds: list[str | None] = []
    points: list[list] = []
    lines: list[list] = []
    polygons: list[list] = []
    for r in range(len(sizes)):
        mine = [(roles[k], areas_of[k], places[bounds[k] : bounds[k + 1]]) for k in range(at[r], at[r + 1])]
        found = []
        if area[r]:
            ways = [(role, c) for role, _, c in mine if len(c) > 1]
            found = assemble_tuples([c for role, c in ways if role in ("outer", "", None)], [c for role, c in ways if role == "inner"])
        if found:
            kinds.append("polygon")
            points.append([])
            lines.append([])
            polygons.append([[outer, *inners] for outer, inners in found])
            continue
        ring = [a and len(c) >= 4 and c[0] == c[-1] for _, a, c in mine]
        kinds.append("other" if mine else None)
        points.append([c[0] for _, _, c in mine if len(c) == 1])
        lines.append([c for (_, _, c), closed in zip(mine, ring, strict=True) if len(c) > 1 and not closed])
        polygons.append([[c] for (_, _, c), closed in zip(mine, ring, strict=True) if closed])
    return _shapes(kinds, points, lines, polygons)


def _shapes(kinds: list, points: list, lines: list, polygons: list) -> pa.StructArray:
    """Shapes from lists of pairs."""
    level = lambda x: [z for y in x for z in y]
    pairs = lambda x: _points([p[0] for p in x], [p[1] for p in x])
    kind = [_ARROW.field(k).type for k in range(4)]
    flat_lines, flat_polygons = level(lines), level(polygons)
    rings = level(flat_polygons)
    p = _nested([*map(len, points)], pairs(level(points)), kind[1])
    li = _nested([*map(len, lines)], _nested([*map(len, flat_lines)], pairs(level(flat_lines)), kind[2].value_type), kind[2])
    inner = _nested([*map(len, flat_polygons)], _nested([*map(len, rings)], pairs(level(rings)), kind[3].value_type.value_type), kind[3].value_type)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), p, li, _nested([*map(len, polygons)], inner, kind[3])], fields=list(_ARROW))


def with_shapes(rows: DataFrame, members: DataFrame | None, ts: str = "ts", rules: AreaRules | None = None, instants: list | None = None, types=TYPES) -> DataFrame:
    """rows (one for each entity and time `ts`) with `shape`. Without members' versions rows have their own places alone.

    Rows may share versions (columns of SPAN), and stand for several times (a list of them in TIMES, `ts` being no column yet):
    the members of a version are looked up once for all its times. instants: all times there are, if few; types: those of rows.
    """
    rules = rules or AreaRules()
    if TIMES not in rows.columns:
        rows = rows.withColumn(TIMES, F.array(ts))
    if SPAN[0] not in rows.columns:
        rows = rows.withColumn(SPAN[0], F.array_min(TIMES)).withColumn(SPAN[1], F.array_max(TIMES))
    columns = [c for c in rows.columns if c not in (*SPAN, TIMES, ts)]
    each = lambda df: df.select(*columns, F.explode(TIMES).alias(ts))
    if members is None:
        return each(rows).withColumn("shape", point_shape())
    nodes = _alive(members, "node", instants, (F.col("lon_e7") / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat")).where("lon is not null and lat is not null")
    of = {t: rows.where(F.col("osm_type") == t) for t in TYPES if t in types}
    parts = []
    if "node" in of:
        parts.append(each(of["node"]).withColumn("shape", point_shape()))
    if "way" in of:
        parts.append(_ways(of["way"], nodes, ts, rules))
    if "relation" in of:
        ways = _alive(members, "way", instants, rules.way_is_area(F.col("tags")).alias("area"), "members")
        parts.append(_relations(of["relation"], nodes, ways, ts, rules))
    shown = [*columns, ts, "shape"]
    return reduce(DataFrame.union, [p.select(*shown) for p in parts]) if parts else each(rows).withColumn("shape", _struct(None))


# -- metrics


def _rings(shape: Column) -> Column:
    return F.flatten(shape["polygons"])


def all_points(shape: Column) -> Column:
    return F.concat(shape["points"], F.flatten(shape["lines"]), F.flatten(_rings(shape)))


def is_empty(shape: Column) -> Column:
    return shape.isNull() | (F.size(all_points(shape)) == 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def area_of(shape: Column) -> Column:
    return _total(F.transform(shape["polygons"], lambda p: geo.polygon_area_column(p[0], F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))))


def length_of(shape: Column) -> Column:
    return _total(F.transform(shape["lines"], geo.length_column))


def perimeter_of(shape: Column) -> Column:
    return F.when(shape["kind"] == "polygon", _total(F.transform(_rings(shape), geo.length_column))).otherwise(F.lit(0.0))


def squareness_of(shape: Column) -> Column:
    """In Arrow batches: it tries every edge's direction, which no built-in function can express."""

    @F.arrow_udf("double")
    def measure(shapes: pa.Array) -> pa.Array:
        return pa.array(squareness_array(shapes), pa.float64())

    return measure(shape)


def squareness_array(shapes: pa.StructArray) -> np.ndarray:
    """geo.squareness of each shape's lines and rings; shapes of one line or ring all at once, by its number of places."""
    lines, rings = shapes.field("lines"), shapes.field("polygons").flatten()
    n_lines, per_shape = _sizes(lines), _sizes(shapes.field("polygons"))
    n_rings = np.bincount(np.repeat(np.arange(len(shapes)), per_shape), _sizes(rings), minlength=len(shapes)).astype(int)
    out = np.zeros(len(shapes))
    one = n_lines + n_rings == 1
    for of, count in ((lines.flatten(), n_lines), (rings.flatten(), n_rings)):
        sizes, points = _sizes(of), of.flatten()
        xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")], axis=1) if len(points) else np.zeros((0, 2))
        row, begin = np.repeat(np.arange(len(shapes)), count), np.cumsum(sizes) - sizes
        mine = one[row] if len(row) else np.zeros(0, bool)
        for n in np.unique(sizes[mine]):
            if n > 1:
                at = np.flatnonzero(mine & (sizes == n))
                step = max(1, 4_000_000 // (n * n))  # bounds the memory
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    out[row[some]] = geo.squareness_of_many(xy[begin[some][:, None] + np.arange(n)])
    for k in np.flatnonzero(n_lines + n_rings > 1).tolist():
        s = shapes[k].as_py()
        out[k] = geo.squareness([_pairs(x) for x in [*s["lines"], *(r for p in s["polygons"] for r in p)]]) if s else 0.0
    return out


def metric(shape: Column, name: str) -> Column:
    """A metric of a shape; of none at all, null."""
    polygonal = shape["kind"] == "polygon"
    if name == "geometry":
        return shape["kind"]
    if name == "area":
        return area_of(shape)
    if name == "length":
        return length_of(shape)
    if name == "perimeter":
        return perimeter_of(shape)
    if name == "vertices":
        return F.size(all_points(shape))
    if name == "outers":
        return F.when(polygonal, F.size(shape["polygons"])).otherwise(F.lit(-1))
    if name == "inners":
        return F.when(polygonal, F.size(_rings(shape)) - F.size(shape["polygons"])).otherwise(F.lit(-1))
    if name == "roundness":
        return F.when(polygonal, geo.roundness_column(area_of(shape), perimeter_of(shape))).otherwise(F.lit(0.0))
    if name == "squareness":
        return squareness_of(shape)
    raise ValueError(f"not a metric: {name}")


# -- clipping


def box_rings(box) -> list[np.ndarray]:
    a, b, c, d = box
    return [np.array([(a, b), (a, d), (c, d), (c, b), (a, b)], float)]


def region_rings(region) -> list[np.ndarray]:
    """Rings, in degrees, of a box (a tuple of numbers) or of a polygon's rings in units of the grid."""
    if isinstance(region[0], (int, float)):
        return box_rings([v / 1e7 for v in region])
    return [np.array(r, float) / 1e7 for r in region]


def clip_shape(shape: dict, rings: list[np.ndarray], box: bool = False) -> dict | None:
    """What of a shape lies in a polygon (box: its one ring is a box); None if nothing does. Places on an edge are inside."""
    points = [p for p in shape["points"] if geo.inside(_pairs([p]), rings)[0]]
    bounds = (*rings[0].min(0), *rings[0].max(0)) if box else None
    lines = [part for line in shape["lines"] for part in (geo.clip_line(_pairs(line), bounds) if box else geo.line_in_polygon(_pairs(line), rings))]
    polygons = [p for rings_of in shape["polygons"] for p in geo.polygon_in_polygon([_pairs(r) for r in rings_of], rings)]
    if not points and not lines and not polygons:
        return None
    return {"kind": shape["kind"], "points": points, "lines": [_plain(x) for x in lines], "polygons": [[_plain(r) for r in p] for p in polygons]}


def clip_shapes(values: list[dict | None], rings: list[np.ndarray], box: bool = False) -> list[dict | None]:
    """clip_shape of each; single points all at once."""
    out: list[dict | None] = [None] * len(values)
    single = [k for k, s in enumerate(values) if s is not None and len(s["points"]) == 1 and not s["lines"] and not s["polygons"]]
    if single:
        for k, ok in zip(single, geo.inside(_pairs([values[k]["points"][0] for k in single]), rings).tolist(), strict=True):
            out[k] = values[k] if ok else None
    for k in set(range(len(values))) - set(single):
        if values[k] is not None:
            out[k] = clip_shape(values[k], rings, box)
    return out


def clip_array(shapes: pa.StructArray, rings: list[np.ndarray], box: bool = False) -> pa.StructArray:
    """clip_shape of each, null where nothing is left. Whole batches: only shapes with more than lines that an edge cuts, or polygons that do the cutting, are taken one by one."""
    n = len(shapes)
    lines = shapes.field("lines")
    of_lines = lines.flatten()
    row_of_line = np.repeat(np.arange(n), _sizes(lines))
    line = np.repeat(np.arange(len(of_lines)), _sizes(of_lines))
    of_points = of_lines.flatten()
    single = shapes.field("points")
    rings_of = shapes.field("polygons").flatten()
    row_of_ring = np.repeat(np.repeat(np.arange(n), _sizes(shapes.field("polygons"))), _sizes(rings_of))
    of_rings = rings_of.flatten()
    numbers = lambda p, name: p.field(name).to_numpy(zero_copy_only=False)
    sources = [(np.repeat(np.arange(n), _sizes(single)), single.flatten()), (row_of_line[line], of_points), (np.repeat(row_of_ring, _sizes(of_rings)), of_rings.flatten())]
    low, high = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    for row, p in sources:
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            for k, name in enumerate(("lon", "lat")):
                v = numbers(p, name)
                low[k, row[starts]] = np.minimum(low[k, row[starts]], np.minimum.reduceat(v, starts))
                high[k, row[starts]] = np.maximum(high[k, row[starts]], np.maximum.reduceat(v, starts))
    (a, b), (c, d) = rings[0].min(0), rings[0].max(0)
    apart = ~((high[0] >= a) & (low[0] <= c) & (high[1] >= b) & (low[1] <= d)) | np.isinf(low[0])
    if shapes.null_count:
        apart |= ~shapes.is_valid().to_numpy(zero_copy_only=False)
    within = ~apart & (low[0] >= a) & (high[0] <= c) & (low[1] >= b) & (high[1] <= d) & box
    edge = ~apart & ~within
    linear = edge & box
    linear[sources[0][0]] = linear[sources[2][0]] = False
    pool, index = [shapes], np.where(within, np.arange(n), -1)
    some = linear[sources[1][0]] if len(line) else np.zeros(0, bool)
    if some.any():
        xs, ys, sizes, cut = geo.clip_lines(numbers(of_points, "lon")[some], numbers(of_points, "lat")[some], line[some], (a, b, c, d))
        row = row_of_line[cut]
        left, parts = np.unique(row, return_counts=True)
        if len(left):
            none = np.zeros(len(left), int)
            kind = [_ARROW.field(k).type for k in range(4)]
            cuts = _nested(parts, _nested(sizes, _points(xs, ys), kind[2].value_type), kind[2])
            columns = [shapes.field("kind").take(pa.array(left)), _nested(none, pa.array([], _POINT), kind[1]), cuts, _nested(none, pa.array([], kind[3].value_type), kind[3])]
            index[left] = n + np.arange(len(left))
            pool.append(pa.StructArray.from_arrays(columns, fields=list(_ARROW)))
    rest = np.flatnonzero(edge & ~linear)
    if len(rest):
        index[rest] = sum(map(len, pool)) + np.arange(len(rest))
        pool.append(pa.array(clip_shapes(shapes.take(pa.array(rest)).to_pylist(), rings, box), _ARROW))
    return pa.concat_arrays([x.cast(_ARROW) for x in pool]).take(pa.array(index, mask=index < 0))


def clipped(shape: Column, region) -> Column:
    """A shape cut to a box or polygon; null if they do not meet."""
    rings, box = region_rings(region), isinstance(region[0], (int, float))

    @F.arrow_udf(SHAPE)
    def cut(shapes: pa.Array) -> pa.Array:
        return clip_array(shapes, rings, box)

    return cut.asNondeterministic()(shape)  # else each use of the result cuts anew


def boxes_of(box) -> list[tuple]:
    """A box; across the antimeridian its two parts."""
    half = 1_800_000_000
    return [box] if box[0] <= box[2] else [(box[0], box[1], half, box[3]), (-half, box[1], box[2], box[3])]


def merged(a: Column, b: Column) -> Column:
    """Two parts of one shape together; null if both are."""
    both = F.struct(a["kind"].alias("kind"), *[F.concat(a[c], b[c]).alias(c) for c in ("points", "lines", "polygons")]).cast(SHAPE)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def clip_to_area(df: DataFrame, box, polygons, name: str = "shape") -> DataFrame:
    """df with the shape cut to an area of interest: a box and any number of polygons (their rings)."""
    parts = boxes_of(box)
    if polygons:
        for rings in polygons:  # the box is around the polygons, or cuts them
            df = df.withColumn(name, clipped(F.col(name), rings))
    if len(parts) == 1:
        return df.withColumn(name, clipped(F.col(name), parts[0]))
    df = df.withColumn("__west", clipped(F.col(name), parts[0])).withColumn("__east", clipped(F.col(name), parts[1]))
    return df.withColumn(name, merged(F.col("__west"), F.col("__east"))).drop("__west", "__east")



def _together(parts) -> dict | None:
    """Parts of one shape in one."""
    found = [x for x in parts if x is not None]
    return {"kind": found[0]["kind"], **{c: [y for x in found for y in x[c]] for c in ("points", "lines", "polygons")}} if found else None


def split_by_regions(df: DataFrame, regions: dict[str, tuple], name: str, sides: tuple[str, ...] = ()) -> DataFrame:
    """Each row once for every region that its shape meets, with the shape cut to it; name: the region's column.

    sides: structs whose shapes are cut instead, a row staying if one of them is left. Regions (boxes, or rings of polygons)
    come from the caller and are literals of the plan.
    """
    pieces = {n: [region_rings(part) for part in (boxes_of(r) if isinstance(r[0], (int, float)) else [r])] for n, r in regions.items()}
    whole = {n: isinstance(r[0], (int, float)) and r[0] <= r[2] for n, r in regions.items()}
    edges = {n: np.concatenate([x[0] for x in parts]) for n, parts in pieces.items()}
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(whole[n]).alias("box"), *[F.lit(float(v)).alias(k) for k, v in zip("abcd", (*e.min(0), *e.max(0)), strict=True)]) for n, e in edges.items()])

    @F.arrow_udf(SHAPE)
    def cut(shapes: pa.Array, names: pa.Array) -> pa.Array:
        of = np.array(names.to_pylist(), object)
        pool, index, size = [], np.full(len(of), -1), 0
        for n in regions:
            mine = np.flatnonzero(of == n)
            cuts = [clip_array(shapes.take(pa.array(mine)), part, isinstance(regions[n][0], (int, float))) for part in pieces[n]]
            index[mine] = size + np.arange(len(mine))
            size += len(mine)
            pool.append(cuts[0] if len(cuts) == 1 else pa.array([_together(found) for found in zip(*[x.to_pylist() for x in cuts], strict=True)], _ARROW))
        return pa.concat_arrays(pool).take(pa.array(index, mask=index < 0))

    cut = cut.asNondeterministic()  # else each use of the result cuts anew

    places = [F.col(f"{side}.shape") for side in sides] or [F.col("shape")]
    points = F.concat(*[F.when(is_empty(p), F.array().cast(COORDS)).otherwise(all_points(p)) for p in places])
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    box = F.struct(F.array_min(lons).alias("a"), F.array_min(lats).alias("b"), F.array_max(lons).alias("c"), F.array_max(lats).alias("d"))
    meets = lambda r: (r["a"] <= F.col("box.c")) & (r["c"] >= F.col("box.a")) & (r["b"] <= F.col("box.d")) & (r["d"] >= F.col("box.b"))
    inner = df.select(F.struct(*df.columns).alias("row"), box.alias("box"))
    inner = inner.withColumn("region", F.explode(F.filter(listed, meets)))
    within = F.col("region.box") & (F.col("box.a") >= F.col("region.a")) & (F.col("box.c") <= F.col("region.c")) & (F.col("box.b") >= F.col("region.b")) & (F.col("box.d") <= F.col("region.d"))
    out = inner.withColumn("within", within)
    for k, side in enumerate(sides or ("",)):
        shape = F.col(f"row.{side}.shape") if side else F.col("row.shape")
        out = out.withColumn(f"cut{k}", F.when(F.col("within"), shape).otherwise(cut(F.when(~F.col("within"), shape), F.col("region.n"))))
    cuts = [F.col(f"cut{k}") for k in range(len(sides) or 1)]
    out = out.where(reduce(lambda a, b: a | b, [c.isNotNull() for c in cuts]))
    columns = []
    for c in df.columns:
        if c in sides:
            columns.append(F.when(F.col(f"row.{c}").isNotNull(), F.col(f"row.{c}").withField("shape", cuts[sides.index(c)])).alias(c))
        elif c == "shape" and not sides:
            columns.append(cuts[0].alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return out.select(*columns, F.col("region.n").alias(name))
