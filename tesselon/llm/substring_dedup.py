"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the collection itself, cut into blocks at places that its content names: of the stretches of 8 words
within each window of 50, the one with the least hash is the window's anchor; all windows in a row with one anchor, as
far as they begin 21 or more words ahead of it, form a block, and those that begin nearer form another. A block is indexed
by the words that all its windows hold (29 or 30 of them, with the anchor at one end), and by the hash of all its words.

1. Factors of whole blocks: a block that also stands in an earlier document is a factor of all its words, with the
   earliest such document as its source.
2. At the boundaries, where a match begins or ends within a block: for blocks whose common words other documents share
   but that no earlier document has as a whole, each of their windows is looked up among such windows.
   (Blocks that step 1 found are not needed as sources: the earliest block of the same words is one. Where all blocks of
   the same common words are equal, step 1 has found all there is.)
3. Per document the matches found so are strung together where source and document go on in step, and the document is
   parsed from left to right: at each position the match that reaches farthest becomes the next factor (start, n_words,
   source, source_start), the parse goes on behind it, and words without a match are passed over. A factor that begins
   within its match is checked at that boundary: it counts with the words before it that its source has too, and is a
   duplicate span if these make `window` words. What all factors cover is what the document repeats.

The lookups are joins on hashes, as no task could hold the reference: a match of `window` words or more holds a whole
block of an earlier document or windows of its edge blocks, since equal windows have equal anchors. So every such match is
found, and nothing shorter. Stretches are compared by two hashes of 64 bits over words that are hashed to 64 bits each.

Rows: null text has no words. Rows with a null doc_id have no place in the order: they keep all words and are nobody's
source. Rows that repeat a doc_id are no sources of each other. Empty tables stay empty; extra columns are ignored. Texts of
any length are parsed whole. Ties: of matches that reach equally far the one with the least source counts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common

ANCHOR_WORDS = 8
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
ROW = ("doc_id", "rid")


class Parser:
    """Hashes of one document's stretches."""

    def __init__(self, window: int):
        self.window, self.anchor = window, min(ANCHOR_WORDS, window)
        self.words, self.powers = common.WordHash(), [common.Powers(b) for b in BASES]

    def read(self, text: bytes) -> np.ndarray:
        return self.words.of(text.split())

    def prefixes(self, h: np.ndarray) -> list[np.ndarray]:
        return [p.prefix(h if k == 0 else common.mix(h ^ np.uint64(0x5851F42D4C957F2D))) for k, p in enumerate(self.powers)]

    def stretches(self, prefixes, start, end) -> list[np.ndarray]:
        return [common.signed(p.stretch(x, start, end)) for p, x in zip(self.powers, prefixes, strict=True)]

    def blocks(self, h: np.ndarray, prefixes) -> tuple[np.ndarray, ...]:
        """key (hash of what all its windows hold), first window, number of windows of every block."""
        grams = self.powers[0].stretch(prefixes[0], at := np.arange(len(h) - self.anchor + 1), at + self.anchor)
        place, width, want = at, 1, self.window - self.anchor + 1
        while width < want:
            step = min(width, want - width)
            a, b = place[: len(place) - step], place[step:]
            place, width = np.where(grams[a] <= grams[b], a, b), width + step
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end, anchor = np.append(first[1:], len(place)), place[first]
        half = (self.window - self.anchor) // 2
        cut = np.clip(anchor - half + 1, first, end)  # windows from here on begin nearer to the anchor
        ahead, near = cut > first, end > cut
        left = self.powers[0].stretch(prefixes[0], anchor[ahead] - half, anchor[ahead] + self.anchor)
        right = common.mix(self.powers[0].stretch(prefixes[0], anchor[near], anchor[near] + self.window - half + 1))
        return np.concatenate([left, right]), np.concatenate([first[ahead], cut[near]]), np.concatenate([(cut - first)[ahead], (end - cut)[near]])


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, rid (a hash of doc_id and text), found: array of (start, n_words, source, source_start) of windows and blocks found in earlier documents, not yet joined."""
    common.tune(docs.sparkSession)
    rows = _identified(docs)

    def parse(batches):
        parser = Parser(window)
        for batch in batches:
            cols = [[] for _ in range(7)]
            for doc, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.raw(batch.column(2)), strict=True):
                h = parser.read(text)
                if len(h) < window:
                    continue
                prefixes = parser.prefixes(h)
                key, first, count = parser.blocks(h, prefixes)
                one, two = parser.stretches(prefixes, first, first + count + window - 1)
                for c, v in zip(cols, (np.full(len(first), doc), np.full(len(first), rid), common.signed(key), one, two, first.astype(np.int32), count.astype(np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc_id", "rid", "key", "one", "two", "first", "count"])

    usable = rows.where("doc_id is not null and text is not null")
    blocks = common.save(usable.mapInArrow(common.lean(parse), "doc_id long, rid long, key long, one long, two long, first int, count int"), "blocks", "lz4")
    varied = (F.min("one") < F.max("one")) | (F.min("two") < F.max("two"))
    shared = blocks.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), varied.alias("varied")).where("lo < hi").select("key", "varied")
    # grouped tables are saved before they are joined: then Spark can split the partitions of very common keys
    shared = common.save(shared, "shared-keys", "lz4")
    met = common.save(blocks.join(shared, "key").drop("key"), "met-blocks", "lz4")
    common.drop(blocks)
    sources = common.save(met.groupBy("one", "two").agg(F.min(F.struct("doc_id", "first")).alias("s")), "block-sources", "lz4")
    judged = common.save(met.join(sources, ["one", "two"]).select(*ROW, "first", "count", "varied", F.col("s.doc_id").alias("source"), F.col("s.first").alias("source_start")), "judged-blocks", "lz4")
    common.drop(met)
    whole = judged.where("source < doc_id").select(*ROW, F.col("first").alias("start"), (F.col("count") + window - 1).alias("n_words"), "source", "source_start")

    def look(batches):
        parser = Parser(window)
        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc, rid, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.raw(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                prefixes = parser.prefixes(parser.read(text))
                pos = np.concatenate([np.arange(x["first"], x["first"] + x["count"]) for x in at])
                one, two = parser.stretches(prefixes, pos, pos + window)
                for c, v in zip(cols, (np.full(len(pos), doc), np.full(len(pos), rid), one, two, pos.astype(np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc_id", "rid", "one", "two", "start"])

    edges = judged.where("source = doc_id and varied").groupBy(*ROW).agg(F.collect_list(F.struct("first", "count")).alias("at"))  # at most one document's blocks
    windows = usable.join(edges, [*ROW]).select("doc_id", "rid", "text", "at").mapInArrow(common.lean(look), "doc_id long, rid long, one long, two long, start int")
    windows = common.save(windows, "windows", "lz4")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("s"), F.max("doc_id").alias("hi")).where("s.doc_id < hi").select("one", "two", "s")
    first = common.save(first, "window-sources", "lz4")
    single = windows.join(first, ["one", "two"]).where("s.doc_id < doc_id").select(*ROW, "start", F.lit(window).alias("n_words"), F.col("s.doc_id").alias("source"), F.col("s.start").alias("source_start"))
    return whole.union(single).groupBy(*ROW).agg(F.collect_list(F.struct("start", "n_words", "source", "source_start")).alias("found"))


def factorize(found: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """The factors (start, n_words, source, source_start) of a document, in order and apart, from the matches found."""
    matches: list[list[int]] = []  # source, shift, start, end
    for source, shift, start, end in sorted((x["source"], x["source_start"] - x["start"], x["start"], x["start"] + x["n_words"]) for x in found):
        if matches and matches[-1][:2] == [source, shift] and start <= matches[-1][3]:
            matches[-1][3] = max(matches[-1][3], end)
        else:
            matches.append([source, shift, start, end])
    matches.sort(key=lambda m: m[2])
    out: list[tuple[int, int, int, int]] = []
    open_: list[tuple[int, ...]] = []
    at = k = 0
    while k < len(matches) or open_:
        while k < len(matches) and matches[k][2] <= at:
            heapq.heappush(open_, (-matches[k][3], *matches[k]))
            k += 1
        if open_ and open_[0][4] > at:
            _, source, shift, start, end = open_[0]
            if end - start >= window:  # with the words before the boundary
                out.append((at, end - at, source, at + shift))
            at = end
        elif open_:
            open_.clear()  # none reaches beyond
        else:
            at = matches[k][2]
    return out


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per document: doc_id, kept_text (kept words joined by a space), n_words, n_removed, spans array of (start, n_words, source, source_start)."""

    def cut(batches):
        for batch in batches:
            texts, n_words, n_removed, spans = [], [], [], []
            for text, found in zip(common.raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                parts = factorize(found or (), window)
                gone = np.zeros(len(words), bool)
                for start, n, _, _ in parts:
                    gone[start : start + n] = True
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if parts else words))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append([dict(zip(("start", "n_words", "source", "source_start"), p, strict=True)) for p in parts])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)], names=["doc_id", "kept_text", "n_words", "n_removed", "spans"])

    found = factors(docs, window)
    joined = _identified(docs).join(found, [*ROW], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(common.lean(cut), "doc_id long, kept_text string, n_words long, n_removed long, spans array<struct<start: int, n_words: int, source: long, source_start: int>>")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with w as (
  select rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from (select row_number() over () as rid, doc_id, text from documents)
), win as (
  select rid, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as h
  from (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)
), first_doc as (select h, min(doc_id) as d from win group by h),
gone as (
  select distinct rid, i + k as p from win join first_doc using (h), range(0, 50) t(k) where d < doc_id
), word as (select rid, doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join (select rid, count(*) as n from gone group by rid) g using (rid)
left join (select word.rid, string_agg(word, ' ' order by word.p) as kept from word anti join gone
  on word.rid = gone.rid and word.p = gone.p group by word.rid) k using (rid)
"""
