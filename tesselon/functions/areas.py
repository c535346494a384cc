"""Which ways and relations are areas or lines, by their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: way tags that make a closed way an area; all values but "no"
AREA_KEYS = ("building", "landuse", "amenity", "leisure", "area", "boundary", "place", "shop", "tourism", "historic", "public_transport", "office", "building:part", "military", "ruins", "area:highway", "craft", "golf", "indoor")
# fixed values: only these values
AREA_ONLY = {
    "highway": ("services", "rest_area", "escape", "elevator"),
    "waterway": ("riverbank", "dock", "boatyard", "dam"),
    "barrier": ("city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"),
    "railway": ("station", "turntable", "roundhouse", "platform"),
    "power": ("plant", "substation", "generator", "transformer"),
}
# fixed values: all values but these
AREA_EXCEPT = {"natural": ("coastline", "cliff", "ridge", "arete", "tree_row"), "man_made": ("cutline", "embankment", "pipeline"), "aeroway": ("taxiway",)}
# fixed values: tag keys that say nothing about an object
UNINTERESTING = ("source", "source_ref", "source:ref", "history", "attribution", "created_by", "tiger:county", "tiger:tlid", "tiger:upload_uuid")
# fixed values: relation types
AREA_RELATIONS, LINE_RELATIONS = ("multipolygon", "boundary"), ("route",)


def way_is_area(tags: dict[str, str], compat: bool = True) -> bool:
    """Whether a closed way of these tags is an area. compat: "no" counts for keys with a list of values (an oddity worth keeping for equal results)."""
    if tags.get("area") == "no":
        return False
    return (
        any(tags[k] != "no" for k in AREA_KEYS if k in tags)
        or any(tags.get(k) in v or compat and tags.get(k) == "no" for k, v in AREA_ONLY.items())
        or any(tags[k] not in v for k, v in AREA_EXCEPT.items() if k in tags)
    )


def way_is_area_column(tags: Column, compat: bool = True) -> Column:
    """The same over a map column, without Python at run time."""
    value = lambda k: F.element_at(tags, F.lit(k))
    out = F.lit(False)
    for k in AREA_KEYS:
        out |= F.coalesce(value(k) != "no", F.lit(False))
    for k, v in AREA_ONLY.items():
        out |= F.coalesce(value(k).isin(*v, *(["no"] if compat else [])), F.lit(False))
    for k, v in AREA_EXCEPT.items():
        out |= F.coalesce(~value(k).isin(*v), F.lit(False))
    return out & ~F.coalesce(value("area") == "no", F.lit(False))


def relation_is_area_column(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, F.lit("type")).isin(*AREA_RELATIONS), F.lit(False))


def relation_is_line_column(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, F.lit("type")).isin(*LINE_RELATIONS), F.lit(False))


def has_interesting_tag_column(tags: Column) -> Column:
    return F.size(F.array_except(F.map_keys(tags), F.array(*map(F.lit, UNINTERESTING)))) > 0
