"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised in double precision; equal vectors of one label form a class, represented by its least vec_id and
weighted by its size. Cosine 0.98 is a distance of 0.2 on the unit sphere. A table's hash is the tuple of k quantised
Gaussian projections floor((a.x + b) / width); k follows the number of vectors, so that buckets of unrelated vectors stay
small, and the number of tables follows from k and the share of pairs right at the threshold that may be missed.
In each bucket pairs are checked exactly; a pair counts in the first table in which its vectors meet. Buckets of more
than PART classes are cut into blocks that meet two by two; a block is one row, so vectors travel once for each table and
what meets is rows of blocks. A check gives sums of weights and the edges of a spanning forest, so the output is linear
however many pairs are linked. `exact` compares all vectors of a label so, without hashing: nothing is missed, at a cost
that grows with the square of a label's vectors.

Rows: null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; so are vectors of another length than the label's others (they meet none). Rows that repeat a
vec_id count as vectors of their own. An empty table gives no rows; extra columns are ignored, whatever their names. Ties
(cosines equal to the bound) are links; sums are in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common, graph
from tesselon.llm.minhash import groups

WIDTH = 1.2
#: Share of pairs right at the threshold that all tables together may miss.
MISS = 0.0005
PART = 512
SEED = 7


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for two points at that distance."""
    u = width / distance
    tail = 0.5 * math.erfc(u / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Projections for a table and number of tables, for n vectors."""
    k = max(8, math.ceil(math.log(max(n, 2)) / -math.log(collision(math.sqrt(2)))))
    near = collision(math.sqrt(2 - 2 * cosine)) ** k
    return k, math.ceil(math.log(MISS) / math.log(1 - near))


def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim))
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)


def hashed(vectors: DataFrame, k: int, tables: int, exact: bool) -> DataFrame:
    """vec_id, label, digest (null if the vector links with nothing), unit (its doubles), keys (a hash for each table; exact: one for all vectors of a length)."""

    def run(batches):
        known: dict[int, tuple] = {}
        odd = np.random.default_rng(SEED + 1).integers(1, 1 << 63, k).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            digests, units, keys = [], [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = None if label is None or not v or None in v else np.array(v, np.float64)
                norm = 0.0 if x is None or not np.isfinite(x).all() else float(np.linalg.norm(x))
                if norm == 0 or not math.isfinite(norm):
                    digests.append(None), units.append(None), keys.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()))
                units.append((x / norm).tobytes())
                if exact:
                    keys.append([len(x)])
                    continue
                if len(x) not in known:
                    known[len(x)] = projections(len(x), k, tables)
                a, b = known[len(x)]
                cells = np.floor(((x / norm) @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(tables, k)
                keys.append(common.signed(common.mix((common.mix(cells + np.uint64(0x1234567)) * odd).sum(1, dtype=np.uint64) + np.uint64(len(x)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "label", "digest", "unit", "keys"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(common.lean(run), "vec_id long, label long, digest binary, unit binary, keys array<long>")


BLOCK = "label long, table int, key long, part int, ids binary, weights binary, units binary, keys binary"


def packed(batches):
    """mapInArrow over sorted (label, table, key, part, id, weight, unit, keys): a row for each block, with its members' values one after the other."""
    for key, rows in groups(batches, 4):
        longs = lambda c: np.array([r[c] for r in rows], "<i8").tobytes()  # noqa: B023, E731
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        values = (*key, longs(0), longs(1), b"".join([r[2] for r in rows]), longs(3))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])


def check_blocks(cosine: float):
    """mapInArrow over (table, i, j, ids, weights, units and keys of block i, then of block j): rows (id, null, sum of linked weights) and forest edges (a, b, null)."""

    def run(batches):
        for batch in batches:
            for table, i, j, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = []
                for ids, weights, units, keys in (sides[:4], sides[4:]) if i != j else (sides[:4],):
                    ids = np.frombuffer(ids, "<i8")
                    parts.append((ids, np.frombuffer(weights, "<i8"), np.frombuffer(units, np.float64).reshape(len(ids), -1), np.frombuffer(keys, "<i8").reshape(len(ids), table)))
                (ids, weight, x, own), (others, weights, y, theirs) = parts[0], parts[-1]
                linked = x @ y.T >= cosine
                if i == j:
                    np.fill_diagonal(linked, False)
                for t in range(table):
                    linked &= own[:, t, None] != theirs[:, t]
                if not linked.any():
                    continue
                a, b, n = [], [], []
                for names, sums in ((ids, linked @ weights), *(((others, weight @ linked),) if i != j else ())):
                    at = np.flatnonzero(sums)
                    a += names[at].tolist()
                    n += sums[at].tolist()
                b += [None] * len(a)
                # a spanning forest, breadth first; rows and columns are nodes, of one block the same ones
                shift = len(ids) if i != j else 0
                left = {*np.flatnonzero(linked.any(1)).tolist(), *(np.flatnonzero(linked.any(0)) + shift).tolist()}
                names = np.concatenate([ids, others]) if shift else ids
                while left:
                    edge = [left.pop()]
                    while edge:
                        v = edge.pop()
                        near = np.flatnonzero(linked[:, v - shift]) if shift and v >= shift else np.flatnonzero(linked[v]) + shift
                        for w in near.tolist():
                            if w in left:
                                left.discard(w)
                                edge.append(w)
                                a.append(int(names[v])), b.append(int(names[w])), n.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, exact: bool = False) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    common.tune(vectors.sparkSession)
    before = common.written()
    k, tables = (0, 1) if exact else plan(vectors.count(), cosine)
    rows = common.save(hashed(vectors, k, tables, exact), "vectors")
    reps = rows.where("digest is not null and vec_id is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    # the number of a class: equal vec_ids may stand for several
    reps = common.save(reps.withColumn("id", F.xxhash64("label", "digest")), "vector-classes")
    posted = reps.select("label", "id", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "table", "key"]
    # counts are saved before they are joined: then Spark can split the partitions of very large buckets
    full = common.save(posted.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket-sizes")
    part = F.pmod(F.xxhash64("id", "table"), F.ceil(F.col("m") / PART)).cast("int")
    members = posted.join(full, bucket).select(*bucket, part.alias("part"), "id").join(reps.select("id", "weight", "unit", "keys"), "id")
    keys = [*bucket, "part"]
    # a pair counts in the first table where it meets: the keys of the tables before tell
    members = members.select(*keys, "id", "weight", "unit", F.slice("keys", 1, F.col("table")).alias("keys")).repartition(*keys).sortWithinPartitions(*keys)
    packs = common.save(members.mapInArrow(common.lean(packed), BLOCK), "vector-blocks", "lz4")
    values = ["ids", "weights", "units", "keys"]
    one = packs.select(*bucket, F.col("part").alias("i"), *values)
    two = packs.select(*bucket, F.col("part").alias("j"), *[F.col(c).alias(f"{c}2") for c in values])
    met = one.join(two, bucket).where("i <= j").select("table", "i", "j", *values, *[f"{c}2" for c in values])
    found = met.mapInArrow(common.lean(check_blocks(cosine)), "a long, b long, n long")
    found = common.save(found, "vector-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    labels = graph.components(found.where("b is not null").select("a", "b"))
    classes = reps.select("label", "digest", "rep", "weight", "id").join(links.withColumnRenamed("a", "id"), "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    classes = common.save(classes.withColumn("component", F.coalesce("component", "id")), "class-links")
    common.tidy(before, rows, classes)
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = classes.join(least, "component").select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("component_id").alias("c"))
    out = rows.select("vec_id", "label", "digest").join(done, ["label", "digest"], "left")
    component = F.when(F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label; the hashing above may miss 1 in 2000 of those right at the threshold.
OP3_SQL = r"""
with recursive unit as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings
), good as (
  select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from unit
  where label is not null and vec_id is not null and len(v) > 0 and list_count(v) = len(v) and len(list_filter(v, lambda x: not isfinite(x))) = 0
), links as (
  select a.r, b.r as s, a.vec_id, b.vec_id as other from good a join good b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
  where a.n > 0 and b.n > 0 and list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach as (
  select r, r as s from unit union select reach.r, links.s from reach join links on links.r = reach.s
), component as (select reach.r, min(u.vec_id) as c from reach join unit u on u.r = reach.s group by reach.r)
select u.vec_id, count(l.s)::bigint as n_links, any_value(c.c) as component_id, u.vec_id = any_value(c.c) as kept
from unit u join component c on c.r = u.r left join links l on l.r = u.r group by u.r, u.vec_id
"""
