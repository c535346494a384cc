"""Histories in OSM XML: several elements of one id with rising versions."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tesselon import model


def rows(data: bytes):
    """Version rows of a document; longitudes and latitudes are rounded to 1e-7 degrees."""
    for _, e in ET.iterparse(io.BytesIO(data), events=("end",)):
        if e.tag not in ("node", "way", "relation"):
            continue
        a = e.attrib
        units = lambda k: round(float(a[k]) * 1e7) if k in a else None  # noqa: B023, E731
        if e.tag == "way":
            members = [{"type": "node", "id": int(x.attrib["ref"]), "role": ""} for x in e.iter("nd")]
        elif e.tag == "relation":
            members = [{"type": x.attrib["type"], "id": int(x.attrib["ref"]), "role": x.attrib.get("role", "")} for x in e.iter("member")]
        else:
            members = None
        yield (
            e.tag,
            int(a["id"]),
            int(a.get("version", 1)),
            a.get("visible", "true") == "true",
            datetime.fromisoformat(a.get("timestamp", "1970-01-01T00:00:00Z").replace("Z", "")),
            int(a.get("changeset", 0)),
            int(a.get("uid", 0)),
            {x.attrib["k"]: x.attrib["v"] for x in e.iter("tag")},
            units("lon"),
            units("lat"),
            members,
        )
        e.clear()


COLUMNS = ["osm_type", "osm_id", "version", "visible", "ts", "changeset_id", "user_id", "tags", "lon_e7", "lat_e7", "members"]


def frames(found, size: int = 20_000):
    """Rows in pandas frames of bounded size."""
    held = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(held: list) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=COLUMNS)
    for c in ("lon_e7", "lat_e7"):
        out[c] = out[c].astype("Int32")
    return out


def read_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Versions of all files under a path (anything Spark can list); a file is read by one task."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield from frames(rows(data))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, model.VERSIONS)
