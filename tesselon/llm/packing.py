"""Packing by power-of-two decomposition.

A document of n ids is cut into n // longest pieces of the longest length and then one piece for each bit set in the
rest, longest first. Every piece is a sequence of its own, of a power-of-two length: sequences of equal length form a
bucket (batches are drawn from one bucket), no sequence crosses documents, and nothing is padded.

It is one pass over the documents without a shuffle: a sequence's number is the number of its input split and its place
within that split, so tasks number their sequences without knowing of each other.

Rows: null or empty text is a document of the end id alone. A null doc_id keeps its rows, with null. Repeated rows are
packed as often as they stand there. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common, tokens

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"
#: Sequences a split may number: 2^33 of each of 2^30 splits.
SPLIT_BITS = 33
#: Bytes of ids in an outgoing batch.
OUT_BYTES = 8 << 20


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket (log2 of the length), ids (little-endian unsigned 32-bit)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    common.tune(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = tokens.encoder(path)
        number = TaskContext.get().partitionId() << SPLIT_BITS
        cols, size = [[] for _ in range(8)], 0

        def flush():
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = common.raw(batch.column(1))
            for at in range(0, len(ids), 100):
                for doc, body in zip(ids[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
                    body += end
                    n, start = len(body) // 4, 0
                    for length in cuts(n, longest):
                        for c, v in zip(cols, (doc, start, length, n, number, 0, length.bit_length() - 1, body[4 * start : 4 * (start + length)]), strict=True):
                            c.append(v)
                        start, number, size = start + length, number + 1, size + 4 * length
                    if size > OUT_BYTES:
                        yield flush()
                        cols, size = [[] for _ in range(8)], 0
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(common.lean(run, "encoders"), SCHEMA)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
