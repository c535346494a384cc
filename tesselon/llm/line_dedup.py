"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys long enough that stand in enough
documents are indexed: shards by the key's hash, in each shard a minimal perfect hash whose slot leads to compact
arrays with the key's fingerprint (64 bits, from a second hash), document count and largest doc_id. Documents probe
these arrays line by line; lines are never joined. Where the whole index is small (its size is checked) every task gets
it and documents are rewritten in one pass; beyond that, packs of line hashes travel to the shard they belong to, which
goes there once for each of SALTS, and what is to be dropped comes back to the document. Keys of one 64-bit hash stand in
the shard's list of collisions.

Rows: a null or empty text is one empty line. Rows that repeat a doc_id count as one document. Rows with a null doc_id
count for nothing and keep all their lines. Extra columns are kept by `drop_lines` as they are, whatever their names.
Empty tables stay empty. Texts of any length are split whole. Ties: of equal lines in the largest doc_id all stay.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of the whole index up to which it is sent to every task.
SEND_BYTES = 48 << 20
#: Keys a shard is meant to hold, line hashes that a pack holds and that a task holds before it sends packs, and the
#: numbers that the packs of one shard are dealt to, so that no task gets all lines of a common one.
SHARD_KEYS = 50_000
PACK, HELD = 4096, 1_000_000
SALTS = 8
#: Shards whose numbers are sent to every task to leave out packs of shards that hold nothing.
SEND_SHARDS = 100_000
GAMMA = 2.0


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether the key has that many code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or n - len(re.findall(rb"[\x80-\xbf]", key)) >= least)


def hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & (1 << 64) - 1, h >> 64


def as_signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def build_shard(h: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray) -> bytes:
    """Minimal perfect hash over distinct h (uint64) and its arrays; of several keys of one h the first, the others in a list after it. Keys that meet on one level's bit array go on to the next."""
    _, first = np.unique(h, return_index=True)
    more = np.setdiff1d(np.arange(len(h)), first)
    arrays = lambda at: fingerprint[at].astype("<u8").tobytes() + last[at].astype("<i8").tobytes() + np.minimum(count[at], 0xFFFFFFFF).astype("<u4").tobytes()
    levels, left, level = [], h[first], 0
    while len(left):
        m = max(64, int(len(left) * GAMMA) + 63 & ~63)
        at = (common.mix(left ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)
        hits = np.bincount(at, minlength=m)
        levels.append(np.packbits(hits == 1, bitorder="little"))
        left, level = left[hits[at] > 1], level + 1
    shard = struct.pack("<III", len(first), len(more), len(levels)) + b"".join(struct.pack("<I", 8 * len(b)) + b.tobytes() for b in levels)
    slots = Shard(shard + bytes(20 * len(first) + 28 * len(more))).slots(h[first])
    order = np.empty(len(first), np.int64)
    order[slots] = first
    return shard + arrays(order) + h[more].astype("<u8").tobytes() + arrays(more)


class Shard:
    def __init__(self, data: bytes):
        self.n, n_more, n_levels = struct.unpack_from("<III", data)
        at, self.levels, before = 12, [], 0
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<I", data, at)
            bits = np.frombuffer(data, np.uint8, m // 8, at + 4)
            ones = np.bitwise_count(bits.view("<u8")).astype(np.int64)
            self.levels.append((m, bits, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            at += 4 + m // 8
        self.fingerprint = np.frombuffer(data, "<u8", self.n, at)
        self.last = np.frombuffer(data, "<i8", self.n, at + 8 * self.n)
        self.count = np.frombuffer(data, "<u4", self.n, at + 16 * self.n)
        at += 20 * self.n
        h, f, last = (np.frombuffer(data, kind, n_more, at + 8 * k * n_more).tolist() for k, kind in enumerate(("<u8", "<u8", "<i8")))
        self.more = dict(zip(zip(h, f, strict=True), zip(np.frombuffer(data, "<u4", n_more, at + 24 * n_more).tolist(), last, strict=True), strict=True))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """A slot for each hash; -1 where no key can be."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (m, bits, rank) in enumerate(self.levels):
            at = (common.mix(h[todo] ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)
            on = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            here = at[on]
            words = bits.view("<u8")[here >> 6]
            out[todo[on]] = rank[here >> 6] + np.bitwise_count(words & ((np.uint64(1) << (here & 63).astype(np.uint64)) - np.uint64(1)))
            todo = todo[~on]
        return out

    def probe(self, h: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, count, largest doc_id for each key hash."""
        slot = self.slots(h)
        found = slot >= 0
        if not self.n or not found.any():
            return np.zeros(len(h), bool), np.zeros(len(h), np.uint32), np.zeros(len(h), np.int64)
        safe = np.where(found, slot, 0)
        found &= self.fingerprint[safe] == fingerprint
        count, last = self.count[safe], self.last[safe]
        if self.more:
            for k in np.flatnonzero(~found).tolist():
                if (x := self.more.get((int(h[k]), int(fingerprint[k])))) is not None:
                    found[k], (count[k], last[k]) = True, x
        return found, count, last


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.int64) % n


def postings(docs: DataFrame, least: int) -> DataFrame:
    """Distinct (h, f, doc_id) of every line that is long enough."""

    def run(batches):
        for batch in batches:
            h, f, d = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                for key in {k for x in text.split(b"\n") if len(x) >= least and long_enough(k := key_of(x), least)}:
                    a, b = hashes(key)
                    h.append(as_signed(a))
                    f.append(as_signed(b))
                    d.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, f, d)], names=["h", "f", "doc_id"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(common.lean(run), "h long, f long, doc_id long").distinct()


def build_index(docs: DataFrame, least: int, min_docs: int) -> tuple[DataFrame, int, int]:
    """The saved index (shard, payload), its number of shards and its bytes."""
    keys = common.save(postings(docs, least).groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs), "line-keys")
    total = keys.count()
    n_shards = max(1, -(-total // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        h, f, n, last = (group.column(c).to_numpy() for c in ("h", "f", "n", "last"))
        payload = build_shard(h.astype(np.int64).view(np.uint64), f.astype(np.int64).view(np.uint64), n, last)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    number = F.pmod(F.shiftrightunsigned("h", 33), F.lit(n_shards)).cast("int")
    index = common.save(keys.withColumn("shard", number).groupBy("shard").applyInArrow(build, "shard int, payload binary"), "line-index")
    return index, n_shards, index.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]


def rewrite(text: bytes | None, drop) -> tuple[bytes, int, int]:
    """The kept text, the number of lines and of dropped lines; drop(keys' hashes) says which go."""
    lines = (text or b"").split(b"\n")
    gone = drop(lines)
    return (b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g]) if any(gone) else text or b"", len(lines), sum(gone))


def drop_lines(docs: DataFrame, least: int = 20, min_docs: int = 3, send_bytes: int = SEND_BYTES, columns: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text rewritten (whole lines gone) and two columns more, lines before and lines dropped (in the place of columns so named); all others as they are."""
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.drop(*columns)
    index, n_shards, size = build_index(docs, least, min_docs)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at_text, at_doc = names.index("text"), names.index("doc_id")

    def rows(batch, gone_of, extra=()):
        texts, n_lines, n_dropped = [], [], []
        for doc, text, gone in zip(batch.column(at_doc).to_pylist(), common.raw(batch.column(at_text)), gone_of, strict=True):
            new, n, k = rewrite(text, lambda lines, doc=doc, gone=gone: gone(doc, lines))
            texts.append(None if text is None else new)
            n_lines.append(n)
            n_dropped.append(k)
        cols = [batch.column(k) for k in range(len(names))]
        cols[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, *columns])

    def hashed(lines):
        at, h, f = [], [], []
        for k, x in enumerate(lines):
            if len(x) >= least and long_enough(key := key_of(x), least):
                a, b = hashes(key)
                at.append(k)
                h.append(a)
                f.append(b)
        return at, np.array(h, np.uint64), np.array(f, np.uint64)

    if size <= send_bytes:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.payload) for r in index.collect()})  # at most send_bytes, checked above

        def run(batches):
            shards = {k: Shard(v) for k, v in sent.value.items()}

            def gone(doc, lines):
                out = [False] * len(lines)
                if doc is None or not shards:
                    return out
                at, h, f = hashed(lines)
                if at:
                    number, at = shard_of(h, n_shards), np.array(at)
                    for s in np.unique(number).tolist() if n_shards > 1 else [0]:
                        mine = number == s
                        if s in shards:
                            found, count, last = shards[s].probe(h[mine], f[mine])
                            for k in at[mine][found & (count >= min_docs) & (last != doc)].tolist():
                                out[k] = True
                return out

            for batch in batches:
                yield rows(batch, [gone] * batch.num_rows)

        return docs.mapInArrow(common.lean(run), f"{schema}, `{columns[0]}` long, `{columns[1]}` long")

    def packs(batches):
        held: dict[int, list] = {}
        n_held = 0

        def out(s):
            h, f, d = (np.concatenate(x) for x in zip(*held.pop(s), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in (h.view(np.int64), f.view(np.int64), d))], names=["shard", "h", "f", "d"])

        sizes: dict[int, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                _, h, f = hashed(list(dict.fromkeys(text.split(b"\n"))))
                number = shard_of(h, n_shards)
                for s in np.unique(number).tolist():
                    mine = number == s
                    n = int(mine.sum())
                    held.setdefault(s, []).append((h[mine], f[mine], np.full(n, doc, np.int64)))
                    sizes[s], n_held = sizes.get(s, 0) + n, n_held + n
                    if sizes[s] >= PACK:
                        n_held -= sizes.pop(s)
                        yield out(s)
                if n_held >= HELD:
                    for s in list(held):
                        yield out(s)
                    sizes.clear()
                    n_held = 0
        for s in list(held):
            yield out(s)

    def probe(batches):
        shard = None
        for batch in batches:
            docs_of, hs, fs = [], [], []
            for payload, h, f, d in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if payload is not None:  # a shard stands ahead of its packs
                    shard = Shard(payload)
                    continue
                h, f, d = np.array(h, np.int64), np.array(f, np.int64), np.array(d, np.int64)
                found, count, last = shard.probe(h.view(np.uint64), f.view(np.uint64))
                go = found & (count >= min_docs) & (last != d)
                docs_of.append(d[go])
                hs.append(h[go])
                fs.append(f[go])
            if docs_of:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs_of, hs, fs)], names=["doc", "h", "f"])

    longs = "array<long>"
    packed = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(common.lean(packs), "shard int, h array<long>, f array<long>, d array<long>")
    packed = packed.join(F.broadcast(index.select("shard")), "shard", "left_semi") if n_shards <= SEND_SHARDS else packed.join(index.select("shard"), "shard", "left_semi")
    packed = packed.select("shard", F.pmod(F.xxhash64("h", "d"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("payload"), "h", "f", "d")
    sent_to = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "payload", *[F.lit(None).cast(longs).alias(c) for c in "hfd"])
    met = sent_to.union(packed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("payload").isNull())
    going = met.mapInArrow(common.lean(probe), "doc long, h long, f long")
    going = going.distinct().groupBy("doc").agg(F.collect_list(F.struct("h", "f")).alias("gone"))  # at most the lines of one document
    inner = [f"column{k}" for k in range(len(names))]  # inner names, so that none can clash
    plain = docs.toDF(*inner)
    joined = plain.join(going, plain[inner[at_doc]] == going["doc"], "left").select(*inner, "gone").toDF(*names, common.fresh(names, "gone")[0])

    def apply(batches):
        for batch in batches:

            def gone_of(pairs):
                drop = {(x["h"], x["f"]) for x in pairs or ()}

                def gone(doc, lines):
                    out = [False] * len(lines)
                    at, h, f = hashed(lines) if drop else ((), (), ())
                    for k, a, b in zip(at, h, f, strict=True):
                        out[k] = (as_signed(int(a)), as_signed(int(b))) in drop
                    return out

                return gone

            yield rows(batch, [gone_of(x) for x in batch.column(len(names)).to_pylist()])

    return joined.mapInArrow(common.lean(apply), f"{schema}, `{columns[0]}` long, `{columns[1]}` long")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")), 256).alias("kept_sha256"))


OP6_SQL = r"""
with split as (
  select doc_id, rid, generate_subscripts(ls, 1) as i, unnest(ls) as line
  from (select doc_id, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as ls from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split
), frequent as (
  select key, max(doc_id) as last_doc from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.rid, k.i, k.line, f.key is not null and k.doc_id <> f.last_doc as dropped
  from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id, rid
"""
