"""The lazy builder: settings and an ordered list of steps; nothing runs before a terminal operation.

    view(store).area_of_interest(box).timestamps("2024-01-01", "2024-01-30", "P1D").filter("type:way").map(F.lit(1))
        .aggregate_by_timestamp().sum()

`map` takes a Column over the view's columns (or over `value`, once mapped); `flat_map` a Column of arrays; `where` a
predicate, at its place in the chain. `geometries()` adds a column `shape` to snapshots, and to both sides of contributions:
cut to the area of interest and to the regions of `aggregate_by_geometry`; `metric` gives its figures. Textual filters hold from wherever they stand for the whole chain. Terminals give a
DataFrame: one row with `result`, or one row per key. Each call gives a new builder.
"""

from __future__ import annotations

import json
import pickle
import threading
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tesselon.functions import filters, grid, timeline
from tesselon.operators import shapes, views
from tesselon.operators.members import ENTITY

#: Accuracy of sketched quantiles: ranks are off by 1 / SKETCH at most.
SKETCH = 10_000
NUMBERS = ("byte", "short", "integer", "long", "float", "double", "tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Key:
    name: str
    column: Column
    declared: tuple = ()
    kind: str | None = None


@dataclass(frozen=True)
class Store:
    """Versions, members' versions (by default the versions themselves, if they have members) and metadata."""

    versions: DataFrame
    members: DataFrame | None = None
    metadata: DataFrame | None = None

    def snapshots(self) -> Builder:
        return Builder(self, "snapshots")

    def contributions(self) -> Builder:
        return Builder(self, "contributions")

    def metadata_value(self, key: str) -> str | None:
        row = self.metadata.where(F.col("key") == key).select("value").first() if self.metadata is not None else None
        return row and row["value"]


def intersect_boxes(a, b):
    """The common part of two boxes (None: the whole globe); None, False for no common part."""
    if a is None:
        return b, True
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out, out[0] <= out[2] and out[1] <= out[3]


@dataclass(frozen=True)
class Builder:
    store: Store
    kind: str
    box: tuple | None = None
    polygon: tuple | None = None
    empty: bool = False
    instants: tuple[datetime, ...] | None = None
    flt: filters.Node = filters.Constant(True)
    steps: tuple = ()
    keys: tuple[Key, ...] = ()
    grouped: bool = False
    mapped: bool = False
    seconds: float | None = field(default=None)
    shaped: bool = False
    rules: shapes.AreaRules | None = None

    # -- settings

    def area_of_interest(self, area) -> Builder:
        """A box (min lon, min lat, max lon, max lat; integers of 1e-7 degrees) or a polygon: a list of rings of such points. Areas intersect."""
        if isinstance(area[0], (int, float)):
            box, some = intersect_boxes(self.box, tuple(area))
            return replace(self, box=box, empty=self.empty or not some)
        rings = tuple(tuple(map(tuple, r)) for r in area)
        xs, ys = zip(*rings[0], strict=True)
        box, some = intersect_boxes(self.box, (min(xs), min(ys), max(xs), max(ys)))
        return replace(self, box=box, polygon=(*(self.polygon or ()), rings), empty=self.empty or not some)

    def timestamps(self, *args, **named) -> Builder:
        """An instant, several, or start, end, period. A list is taken as it is."""
        given = args[0] if len(args) == 1 and isinstance(args[0], (list, tuple)) else timeline.instants(*args, **named)
        return replace(self, instants=tuple(given))

    def filter(self, what: str | filters.Node) -> Builder:
        node = filters.parse(what) if isinstance(what, str) else what
        return replace(self, flt=node if isinstance(self.flt, filters.Constant) and self.flt.value else filters.And(self.flt, node))

    def timeout(self, seconds: float | None) -> Builder:
        """Terminals then run at once, and fail with TimeoutError if they take longer."""
        return replace(self, seconds=seconds)

    def geometries(self) -> Builder:
        """Rows have shapes (clipped ones, within an area of interest; whole ones are in `full_shape` there)."""
        return replace(self, shaped=True)

    def area_rules(self, rules: shapes.AreaRules) -> Builder:
        """Other rules for what closed ways and relations are areas."""
        return replace(self, rules=rules)

    def metric(self, name: str, side: str = "after") -> Column:
        """A metric of the rows' shapes (see shapes.METRICS), for maps and keys; of contributions, of one side."""
        return shapes.metric(F.col("shape") if self.kind == "snapshots" else F.col(f"{side}.shape"), name)

    # -- steps

    def map(self, value: Column) -> Builder:
        return replace(self, steps=(*self.steps, ("map", value)), mapped=True)

    def flat_map(self, values: Column) -> Builder:
        return replace(self, steps=(*self.steps, ("flat_map", values)), mapped=True)

    def map_python(self, f: Callable, kind: str) -> Builder:
        """A Python function of the value (or, unmapped, of the row as a dict), in Arrow batches."""
        return replace(self, steps=(*self.steps, ("python", f, kind)), mapped=True)

    def where(self, predicate: Column) -> Builder:
        return replace(self, steps=(*self.steps, ("where", predicate)))

    def group_by_entity(self) -> Builder:
        """From here on one row per entity with `rows`, its rows in order of time."""
        if self.grouped:
            raise ValueError("the rows are grouped by entity already")
        if self.keys:
            raise ValueError("group by entity before aggregating")
        return replace(self, steps=(*self.steps, ("group",)), grouped=True, mapped=False)

    # -- keys

    def aggregate_by(self, column: Column, declared: Iterable = (), name: str | None = None) -> Builder:
        """declared: keys that the result has in any case."""
        name = name or f"key{len(self.keys) + 1}"
        return replace(self, keys=(*self.keys, Key(name, column, tuple(declared))), steps=(*self.steps, ("key", name, column)))

    def aggregate_by_timestamp(self, column: Column | None = None, name: str = "timestamp") -> Builder:
        """By the row's instant; contributions by the latest instant not after them. A column of other times must lie within the instants."""
        times = list(self._instants())
        shown = times if self.kind == "snapshots" and column is None else times[:-1] if self.kind == "contributions" else times
        if column is None:
            key = F.col("snapshot_ts") if self.kind == "snapshots" else views.floor_column(F.col("ts"), times)
        else:
            ts = column.cast("timestamp_ntz")
            out_of_range = ts.isNull() | (ts < F.lit(times[0]).cast("timestamp_ntz")) | (ts > F.lit(times[-1]).cast("timestamp_ntz"))
            key = F.when(out_of_range, F.raise_error(F.lit("the time of a row lies outside the query's times")).cast("timestamp_ntz")).otherwise(views.floor_column(ts, times))
        return replace(self, keys=(*self.keys, Key(name, key, tuple(shown), "timestamp_ntz")), steps=(*self.steps, ("key", name, key)))

    def aggregate_by_geometry(self, regions: dict[str, tuple], name: str = "region") -> Builder:
        """By regions (name -> box or polygon rings, as in area_of_interest); a row counts in each it touches, with its shape cut to it."""
        if self.mapped or self.grouped:
            raise ValueError("aggregate by geometry before mapping or grouping: rows are split first")
        return replace(self, shaped=True, keys=(*self.keys, Key(name, F.col(name), tuple(regions))), steps=(*self.steps, ("regions", name, regions)))

    # -- evaluation

    def _instants(self) -> tuple[datetime, ...]:
        return self.instants or tuple(timeline.default_instants())

    def rows(self) -> DataFrame:
        """The view's rows after the steps: key columns, `value` if mapped."""
        store = self.store
        versions = store.versions.where(F.lit(False)) if self.empty else self._pruned(store.versions)
        times = list(self._instants())
        if self.kind == "snapshots":
            df = views.snapshots(versions, times, self.flt, store.members, shaped=self.shaped or self.box is not None, rules=self.rules)
            if self.box is not None:
                df = self._clip(df.withColumn("full_shape", F.col("shape"))).where("shape is not null")
                df = df if self.shaped else df.drop("shape", "full_shape")
        else:
            clip = None if self.box is None else self._clip
            df = views.contributions(versions, times, self.flt, store.members, clip=clip, shaped=self.shaped, rules=self.rules)
        carried: list[str] = []
        for step in self.steps:
            if step[0] == "map":
                df = df.withColumn("value", step[1])
            elif step[0] == "flat_map":
                df = df.withColumn("value", F.explode(step[1]))
            elif step[0] == "where":
                df = df.where(step[1])
            elif step[0] == "key":
                df = df.withColumn(step[1], step[2])
                carried.append(step[1])
            elif step[0] == "regions":
                df = shapes.split_by_regions(df, step[2], step[1], () if self.kind == "snapshots" else ("before", "after"))
                carried.append(step[1])
            elif step[0] == "group":
                order = "snapshot_ts" if self.kind == "snapshots" else "ts"
                rest = [c for c in df.columns if c not in ENTITY and c != order]
                earlier = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)  # noqa: B023, E731
                df = df.groupBy(*ENTITY).agg(F.array_sort(F.collect_list(F.struct(order, *rest)), earlier).alias("rows"))
            else:
                df = self._python(df, step[1], step[2])
        return df

    def ordered(self) -> DataFrame:
        """The rows in their natural order: by type, id and time."""
        return self.rows().orderBy(F.expr("array_position(array('node', 'way', 'relation'), osm_type)"), "osm_id", "snapshot_ts" if self.kind == "snapshots" else "ts")

    def _pruned(self, versions: DataFrame) -> DataFrame:
        """Of a table filed by the grid, the histories that the area of interest may touch: cells and boxes reach the scan. Histories without a place stay."""
        if self.box is None or not {"level", "cell_id", "min_lon", "min_lat", "max_lon", "max_lat"} <= set(versions.columns):
            return versions
        return versions.where(grid.touching(self.box) | F.col("min_lon").isNull())

    def _clip(self, df: DataFrame) -> DataFrame:
        return shapes.clip_to_area(df, self.box, self.polygon or ())

    def _python(self, df: DataFrame, f: Callable, kind: str) -> DataFrame:
        of = F.col("value") if "value" in df.columns else F.struct(*df.columns)
        plain = python_value(df.schema["value"].dataType if "value" in df.columns else df.schema)
        out = to_arrow_type(DataType.fromDDL(kind))

        @F.arrow_udf(kind)
        def call(x: pa.Array) -> pa.Array:
            return pa.array([f(plain(v)) for v in x.to_pylist()], out)

        return df.withColumn("value", call(of))

    # -- terminals

    def aggregate(self, column: Callable[[str | None], Column], empty: Column | None) -> DataFrame:
        """One aggregate over the rows; missing keys get `empty`."""
        df = self.rows()
        names = [k.name for k in self.keys]
        if not names:
            out = df.agg(column(None).alias("result"))
            return self._run(out if empty is None else out.select(F.coalesce("result", empty).alias("result")))
        found = df.groupBy(*names).agg(column(None).alias("result"))
        return self._run(self._filled(found, empty))

    def _filled(self, found: DataFrame, empty: Column | None) -> DataFrame:
        """Groups with the keys that have none: the declared ones; of several keys every level with every level of the others."""
        names = [k.name for k in self.keys]
        found = found.withColumn("found__", F.lit(True))
        spark = found.sparkSession
        declared = {k.name: spark.createDataFrame([(x,) for x in k.declared], f"`{k.name}` {k.kind or found.schema[k.name].dataType.simpleString()}") for k in self.keys if k.declared}
        # levels and cells come from the same groups: as all columns are used on each side, Spark plans them once and reuses their exchange
        whole = F.struct(*found.columns)
        if len(names) == 1:  # declared keys join the groups as rows without a result
            out = found
            if declared:
                more = declared[names[0]].select(names[0], F.lit(None).cast(found.schema["result"].dataType).alias("result"), F.lit(False).alias("found__"))
                out = found.union(more).groupBy(*names).agg(F.first("result", ignorenulls=True).alias("result"), F.max("found__").alias("found__"))
        else:
            full = None
            for n in names:
                levels = found.groupBy(n).agg(F.count(whole).alias("n")).where("n > 0").select(n)
                levels = (levels.union(declared[n]).distinct() if n in declared else levels).select(F.col(n).alias(f"level__{n}"))
                full = levels if full is None else full.crossJoin(levels)  # the result itself: every key of a level with every key of the others
            on = F.lit(True)
            for n in names:
                on &= F.col(f"level__{n}").eqNullSafe(F.col(n))
            out = full.join(found, on, "left").select(*[F.col(f"level__{n}").alias(n) for n in names], "result", F.coalesce("found__", F.lit(False)).alias("found__"))
        result = F.when(F.col("found__"), F.col("result")) if empty is None else F.when(F.col("found__"), F.coalesce("result", empty)).otherwise(empty)
        return out.select(*names, result.alias("result")).orderBy(*names)

    def _run(self, df: DataFrame) -> DataFrame:
        """A terminal's result; under a timeout it is computed here and now."""
        if not self.seconds:
            return df
        with self.within():
            rows = df.collect()  # not toArrow, whose jobs run in another thread, without the tag
        return df.sparkSession.createDataFrame(rows, df.schema)

    def _value(self, f: Column | None) -> Builder:
        return self if f is None else self.map(f)

    def _numeric(self) -> None:
        if not self.mapped:
            raise ValueError("numbers are needed: map the rows first")
        kind = self.rows().schema["value"].dataType.typeName()
        if kind not in NUMBERS and not kind.startswith("decimal"):
            raise ValueError(f"numbers are needed, not {kind}")

    def count(self) -> DataFrame:
        return self.aggregate(lambda _: F.count(F.lit(1)), F.lit(0).cast("long"))

    def sum(self, f: Column | None = None) -> DataFrame:
        """Whole numbers add up to a long, others to a double; 0 over nothing."""
        b = self._value(f)
        b._numeric()
        whole = b.rows().schema["value"].dataType.typeName() in ("byte", "short", "integer", "long")
        return b.aggregate(lambda _: F.sum("value" if whole else F.col("value").cast("double")), F.lit(0).cast("long") if whole else F.lit(0.0))

    def average(self, f: Column | None = None) -> DataFrame:
        b = self._value(f)
        b._numeric()
        return b.aggregate(lambda _: F.avg("value"), F.lit(float("nan")))

    def weighted_average(self, value: Column, weight: Column) -> DataFrame:
        b = self.map(F.struct(value.cast("double").alias("v"), weight.cast("double").alias("w")))
        return b.aggregate(lambda _: F.when(F.sum("value.w") == 0, F.lit(float("nan"))).otherwise(F.sum(F.col("value.v") * F.col("value.w")) / F.nullif(F.sum("value.w"), F.lit(0.0))), F.lit(float("nan")))

    def uniq(self, f: Column | None = None) -> DataFrame:
        """Sorted distinct values."""
        b = self._value(f)
        kind = b.rows().schema["value"].dataType.simpleString()
        return b.aggregate(lambda _: F.array_sort(F.collect_set("value")), F.array().cast(f"array<{kind}>"))

    def count_uniq(self, f: Column | None = None) -> DataFrame:
        return self._value(f).aggregate(lambda _: F.count_distinct(F.struct("value")), F.lit(0).cast("long"))

    def quantile(self, q: float = 0.5, f: Column | None = None, exact: bool = True) -> DataFrame:
        """Exact and interpolated, or from a sketch of bounded size (exact keeps a count for each distinct value of a key); NaN over nothing."""
        b = self._value(f)
        b._numeric()
        of = F.percentile("value", F.lit(q)) if exact else F.percentile_approx(F.col("value").cast("double"), F.lit(q), F.lit(SKETCH))
        return b.aggregate(lambda _: of, F.lit(float("nan")))

    def median(self, f: Column | None = None, exact: bool = True) -> DataFrame:
        return self.quantile(0.5, f, exact)

    def quantiles(self, qs: list[float], f: Column | None = None, exact: bool = True) -> DataFrame:
        b = self._value(f)
        b._numeric()
        wanted = F.array(*map(F.lit, qs))
        of = F.percentile("value", wanted) if exact else F.percentile_approx(F.col("value").cast("double"), wanted, F.lit(SKETCH))
        return b.aggregate(lambda _: of, F.array(*[F.lit(float("nan"))] * len(qs)))

    def quantile_function(self, f: Column | None = None) -> Callable[[float], float]:
        """q -> value, estimated from a sketch of bounded size; the sketch stays a column until it is asked."""
        b = self._value(f)
        b._numeric()
        sketch = b.rows().agg(F.expr("kll_sketch_agg_double(cast(value as double))").alias("s"))

        def quantile(q: float) -> float:
            return sketch.select(F.expr(f"kll_sketch_get_quantile_double(s, {float(q)}D)")).first()[0]

        return quantile

    def collect_values(self, f: Column | None = None) -> DataFrame:
        """One row per key with the list of its values, in no order."""
        b = self._value(f)
        kind = b.rows().schema["value"].dataType.simpleString()
        return b.aggregate(lambda _: F.collect_list("value"), F.array().cast(f"array<{kind}>"))

    def stream(self):
        """The rows one after the other, a partition at a time."""
        with self.within():
            yield from self.rows().toLocalIterator()

    def for_each(self, f: Callable) -> None:
        with self.within():
            self.rows().foreach(f)

    def reduce(self, identity: Callable, accumulate: Callable, combine: Callable | None = None, kind: str = "double") -> DataFrame:
        """A reduction of the user: each batch of a task is folded by key, and the folded states are combined by key in a tree of two levels."""
        combine = combine or accumulate
        names = [k.name for k in self.keys]
        df = self.rows().select(*names, "value")
        key_schema = "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)

        kinds = [df.schema[n].dataType for n in names]

        def fold(batches):
            states: dict = {}
            for batch in batches:
                *keys, values = (c.to_pylist() for c in batch.columns)
                for key, v in zip(zip(*keys, strict=True) if keys else [()] * len(values), values, strict=True):
                    states[key] = accumulate(states[key] if key in states else identity(), v)
            columns = [pa.array([k[i] for k in states], to_arrow_type(kind)) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(x) for x in states.values()], pa.binary())], names=[*names, "state"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            out = identity()
            for s in pdf["state"]:
                out = combine(out, pickle.loads(s))
            return pd.DataFrame([(*(pdf[n].iloc[0] for n in names), out)], columns=[*names, "result"])

        parts = df.mapInArrow(fold, f"{key_schema}state binary")
        done = parts.groupBy(*names).applyInPandas(merge, f"{key_schema}result {kind}")
        if not names:
            empty = df.sparkSession.createDataFrame([(identity(),)], f"e {kind}")
            return self._run(empty.join(done, F.lit(True), "left").select(F.coalesce("result", "e").alias("result")))
        # the identity as a literal of the plan, whatever its type
        literal = F.from_json(F.lit(json.dumps({"e": identity()}, default=str)), f"e {kind}")["e"]
        return self._run(self._filled(done, literal))

    @contextmanager
    def within(self):
        """Jobs in this block are cancelled once the builder's timeout has passed, those that begin later too."""
        if not self.seconds:
            yield self
            return
        spark: SparkContext = self.store.versions.sparkSession.sparkContext
        tag = f"tesselon-{id(self)}-{threading.get_ident()}"
        done, late = threading.Event(), threading.Event()

        def watch() -> None:
            wait = self.seconds
            while not done.wait(wait):
                late.set()
                spark.cancelJobsWithTag(tag)  # of those that run just now
                wait = 0.2

        spark.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield self
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"more than {self.seconds} s") from e
            raise
        finally:
            done.set()
            watcher.join()
            spark.removeJobTag(tag)


def python_value(kind: DataType) -> Callable:
    """A function from what Arrow gives for a value of that type to plain Python: maps as dictionaries, at any depth."""
    if isinstance(kind, MapType):
        key, value = python_value(kind.keyType), python_value(kind.valueType)
        return lambda x: None if x is None else {key(k): value(v) for k, v in x}
    if isinstance(kind, ArrayType):
        item = python_value(kind.elementType)
        return lambda x: None if x is None else [item(v) for v in x]
    if isinstance(kind, StructType):
        parts = {f.name: python_value(f.dataType) for f in kind.fields}
        return lambda x: None if x is None else {n: part(x[n]) for n, part in parts.items()}
    return lambda x: x


def nest(rows: list, names: list[str]) -> dict:
    """A flat keyed result as nested dictionaries."""
    out: dict = {}
    for r in rows:
        at = out
        for n in names[:-1]:
            at = at.setdefault(r[n], {})
        at[r[names[-1]]] = r["result"]
    return out
