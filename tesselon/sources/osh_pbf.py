"""Histories in PBF: a Spark data source that reads byte ranges of a file in parallel.

    spark.dataSource.register(PbfSource)
    spark.read.format("osh_pbf").option("split", str(64 << 20)).load("/shared/history.osh.pbf")

A range's task looks for the first blob header at or after its start and reads the blobs whose headers begin in its
range. The path must be readable as a file on all executors. Entities need no order: histories are put together by later
groupings.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesselon import model

HEADER = re.compile(rb"\x00\x00[\x00-\xff]{2}\x0a\x07OSM(?:Data)", re.S)
MOST_HEADER = 64 << 10
TYPES = ("node", "way", "relation")


def varints(data: bytes, at: int = 0, end: int | None = None) -> Iterator[int]:
    end = len(data) if end is None else end
    while at < end:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
        yield value


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, or bytes of what has a length."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, int.from_bytes(data[at : at + n], "little")
            at += n


def zigzag(x: int) -> int:
    return x >> 1 ^ -(x & 1)


def plain(x: int) -> int:
    """A signed number that is not zig-zag coded."""
    return x - (1 << 64) if x >> 63 else x


def deltas(data: bytes) -> Iterator[int]:
    total = 0
    for x in varints(data):
        total += zigzag(x)
        yield total


def packed(value: int | bytes) -> Iterator[int]:
    return iter((value,)) if isinstance(value, int) else varints(value)


def blobs(f, start: int, end: int) -> Iterator[bytes]:
    """Payloads of data blobs whose header begins in [start, end)."""
    f.seek(0, os.SEEK_END)
    size = f.tell()
    at = start
    if start:  # a header of another's blob may lie ahead
        overlap, found = 32, None
        while found is None and at < min(size, end + overlap):
            f.seek(at)
            chunk = f.read(1 << 20)
            for m in HEADER.finditer(chunk):
                if _is_header(f, at + m.start(), size):
                    found = at + m.start()
                    break
            if found is None:
                at += max(1, len(chunk) - overlap)
                if len(chunk) <= overlap:
                    return
        if found is None:
            return
        at = found
    while at < min(end, size):
        f.seek(at)
        (n,) = struct.unpack(">I", f.read(4))
        head = dict(fields(f.read(n)))
        body = f.read(head[3])
        if head[1] == b"OSMData":
            blob = dict(fields(body))
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])
        at += 4 + n + head[3]


def _is_header(f, at: int, size: int) -> bool:
    f.seek(at)
    (n,) = struct.unpack(">I", f.read(4))
    if n > MOST_HEADER:
        return False
    try:
        head = dict(fields(f.read(n)))
        return head.get(1) == b"OSMData" and isinstance(head.get(3), int) and at + 4 + n + head[3] <= size
    except (IndexError, ValueError):
        return False


def _info(data: bytes | None, stamp: int) -> tuple:
    x = dict(fields(data)) if data else {}
    return x.get(1, 1), bool(x.get(6, 1)), _time(x.get(2, 0), stamp), plain(x.get(3, 0)), plain(x.get(4, 0))


def _time(t: int, stamp: int) -> datetime:
    return datetime.fromtimestamp(t * stamp / 1000, UTC).replace(tzinfo=None)


def entities(block: bytes) -> Iterator[tuple]:
    """Version rows of a primitive block, in the order of model.VERSIONS."""
    strings, groups, granularity, stamp, lat0, lon0 = [], [], 100, 1000, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [x.decode() for n, x in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 18:
            stamp = v
        elif k == 19:
            lat0 = plain(v)
        elif k == 20:
            lon0 = plain(v)
    units = lambda x, offset: (offset + granularity * x) // 100

    def common(message: bytes):
        out: dict = {}
        for k, v in fields(message):
            out[k] = v
        tags = {strings[a]: strings[b] for a, b in zip(packed(out.get(2, b"")), packed(out.get(3, b"")), strict=True)}
        return out, tags, _info(out.get(4), stamp)

    for group in groups:
        for k, v in fields(group):
            if k == 1:
                m, tags, (version, visible, ts, changeset, user) = common(v)
                yield "node", zigzag(m[1]), version, visible, ts, changeset, user, tags, units(zigzag(m[9]), lon0) if visible else None, units(zigzag(m[8]), lat0) if visible else None, None
            elif k == 2:
                yield from _dense(v, strings, stamp, units, lat0, lon0)
            elif k == 3:
                m, tags, (version, visible, ts, changeset, user) = common(v)
                members = [{"type": "node", "id": r, "role": ""} for r in deltas(m.get(8, b""))]
                yield "way", plain(m[1]), version, visible, ts, changeset, user, tags, None, None, members
            elif k == 4:
                m, tags, (version, visible, ts, changeset, user) = common(v)
                members = [{"type": TYPES[t], "id": r, "role": strings[s]} for s, r, t in zip(packed(m.get(8, b"")), deltas(m.get(9, b"")), packed(m.get(10, b"")), strict=True)]
                yield "relation", plain(m[1]), version, visible, ts, changeset, user, tags, None, None, members


def _dense(message: bytes, strings, stamp, units, lat0, lon0):
    m = dict(fields(message))
    info = dict(fields(m[5])) if 5 in m else {}
    ids, lats, lons = list(deltas(m[1])), list(deltas(m[8])), list(deltas(m[9]))
    n = len(ids)
    versions = list(varints(info[1])) if 1 in info else [1] * n
    times = list(deltas(info[2])) if 2 in info else [0] * n
    changesets = list(deltas(info[3])) if 3 in info else [0] * n
    users = list(deltas(info[4])) if 4 in info else [0] * n
    seen = [bool(x) for x in varints(info[6])] if 6 in info else [True] * n
    keys = varints(m.get(10, b""))
    for k in range(n):
        tags = {}
        for a in keys:
            if a == 0:
                break
            tags[strings[a]] = strings[next(keys)]
        yield "node", ids[k], versions[k], seen[k], _time(times[k], stamp), changesets[k], users[k], tags, units(lons[k], lon0) if seen[k] else None, units(lats[k], lat0) if seen[k] else None, None


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path.removeprefix("file://"), split

    def partitions(self):
        size = os.path.getsize(self.path)
        return [Range(self.path, a, min(size, a + self.split)) for a in range(0, max(size, 1), self.split)]

    def read(self, partition: Range):
        with open(partition.path, "rb") as f:
            for block in blobs(f, partition.start, partition.end):
                yield from entities(block)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osh_pbf"

    def schema(self) -> str:
        return model.VERSIONS

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("split", 64 << 20)))
