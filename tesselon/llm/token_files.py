"""Token files of directly addressable codes.

Ids are split into chunks of 8 bits. Level k holds the k-th chunk of every id that reaches it, with a bitmap that says
which ids go on and a rank directory over the bitmap (ones before every 512th bit), so the place of an id on the next
level is a rank and any single id is read without decoding its neighbours.

A file is a Parquet table of segments (part, segment, before, n_docs, n_tokens, payload); a payload is one segment of
whole documents in the layout of `Segment`. Payloads are not compressed again, so `token_at` reads one id from the bytes of
its segment's page as they lie in the file. Parts are ranges of doc_id in ascending order, `before` counts the ids
of the part ahead of the segment, and part totals (one row per part) give the place of the part itself.

Rows: null or empty text is the end id alone. Null doc_ids come first. Rows that repeat a doc_id follow each other,
ordered by text (equal texts in any order: their ids are the same). A text of any length stays in one segment, whose
counts are 64 bits wide. An empty table gives an empty file. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import common, tokens

MAGIC = b"DACT"
HEAD = struct.Struct("<4sHHIQ")  # magic, version, levels, documents, ids
RANK_EVERY = 512
#: Ids after which a segment ends with its document.
SEGMENT_IDS = 250_000
SEGMENTS = "part int, segment int, before long, n_docs int, n_tokens long, payload binary"


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """For each level: count, chunks, continuation bitmap, rank directory."""
    out, left = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (left & 0xFF).astype(np.uint8), left >> 8
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on.astype(np.uint32), np.arange(0, len(on), RANK_EVERY)) if len(on) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        out.append(struct.pack("<Q", len(left)) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        left = rest[on]
        if not len(left):
            return out


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return HEAD.pack(MAGIC, 1, len(levels), len(doc_ids), len(ids)) + known.tobytes() + names.tobytes() + offsets.tobytes() + b"".join(levels)


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, data: bytes):
        magic, version, n_levels, n_docs, self.n = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a

        known = take(np.uint8, n_docs)
        self.doc_ids = [d if k else None for d, k in zip(take("<i8", n_docs).tolist(), known, strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            self.levels.append((take(np.uint8, n), take(np.uint8, -(-n // 8)), take("<u4", -(-n // RANK_EVERY))))

    def __getitem__(self, i: int) -> int:
        """The i-th id alone, in a step for each of its chunks."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            before = bits[block * RANK_EVERY // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        upper = None
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype("<u4")
            if upper is not None:
                ids[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= upper << 8
            upper = ids
        return upper


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order into the token file at path."""
    common.tune(docs.sparkSession)
    vocabulary = tokenizer or tokens.default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        names, bodies, held, segment, before = [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(bodies), "<u4")
            payload = encode_segment(names, [len(b) // 4 for b in bodies], ids)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (segment, pa.int32()), (before, pa.int64()), (len(names), pa.int32()), (len(ids), pa.int64()), (payload, pa.binary()))], names=["part", "segment", "before", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), common.raw(batch.column(1))
            for at in range(0, len(ids), 100):
                for doc, body in zip(ids[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
                    names.append(doc)
                    bodies.append(body + end)
                    held += len(body) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        before, segment, held, names, bodies = before + held, segment + 1, 0, [], []
        if names:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(common.lean(run, "encoders"), SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _bases(segments: DataFrame) -> tuple[dict[int, int], int]:
    """Ids ahead of each part of a token file, and of all: a row for each part."""
    base, total = {}, 0
    for part, n in sorted(map(tuple, segments.groupBy("part").agg(F.sum("n_tokens")).collect())):
        base[part], total = total, total + n
    return base, total


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """The i-th id of a token file alone: one segment is read, none of its blocks is decoded."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    base, total = _bases(segments)
    if not 0 <= i < total:
        raise IndexError(i)
    part = max((p for p, b in base.items() if b <= i), key=lambda p: (base[p], p))
    at = i - base[part]
    row = segments.where((F.col("part") == part) & (F.col("before") <= at) & (F.col("before") + F.col("n_tokens") > at)).select("before", "payload").first()
    return Segment(bytes(row["payload"]))[at - row["before"]]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start (ids before it in the file), n_tokens, ids (little-endian unsigned 32-bit)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    base, _ = _bases(segments)

    def run(batches):
        for batch in batches:
            for part, before, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Segment(payload)
                data, o = s.all().tobytes(), s.offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, pa.int64()),
                        pa.array([base[part] + before + a for a in o[:-1]], pa.int64()),
                        pa.array([b - a for a, b in zip(o, o[1:], strict=False)], pa.int64()),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(o, o[1:], strict=False)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.select("part", "before", "payload").mapInArrow(common.lean(run, "encoders"), "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    common._written.append((spark, path))
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
