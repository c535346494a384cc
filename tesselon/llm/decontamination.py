"""Benchmark decontamination by random-walk embedding of edit distance (CGK) and bit-sampling hashing.

A document is contaminated by an item of m words if some window of m of its words (the whole document, if it is shorter)
is within floor(tolerance * m) word edits of the item. Words are lower-cased and parted by white space and by the marks
in MARKS.

Windows of every item length slide over the whole text. With e edits a window keeps at least m - e of the item's words
and m - 2 - 3 e of its runs of three; windows with fewer words and runs that the benchmark has cannot match and are not
embedded. The rest are embedded: a walk
of 3 m steps that repeats the current word and goes on to the next one by a random bit of (step, word), the same for all,
which turns k edits into a Hamming distance that is small with good odds. Each of WALKS walks is sampled at SAMPLES places
for TABLES_OF_WALK hash tables; windows that meet an item of their length in a table are checked by the exact edit
distance. The three constants were set by measurement: items with the share TOLERANCE of their words replaced are found
with a chance of 0.99 (a test holds it to 0.97); closer windows more often, and other tolerances need other constants.

The benchmark is taken in blocks of at most BLOCK items and BLOCK_BYTES of text; a block's tables are all that is sent to
the executors, and the documents are passed once for each block. No document is shuffled.

Rows: null texts and items without words match nothing. Repeated items each match. A null doc_id or item_id stays null.
An empty benchmark or documents table gives no rows (or removes none); extra columns are kept by `remove_contaminated`,
whatever their names. Texts of any length are searched whole. Ties: of windows equally near to an item the first counts.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselon.llm import common

BLOCK, BLOCK_BYTES = 20_000, 8 << 20
TOLERANCE = 0.2
WALKS, TABLES_OF_WALK, SAMPLES = 6, 6, 3
#: Text that is searched at a time: equal windows in it are looked up once.
LOT_BYTES = 16 << 20
SEED = 5
MARKS = b".,;:!?\"'()[]{}<>|*#%&$-_/\\"
BLANKS = bytes.maketrans(MARKS, b" " * len(MARKS))


def words_of(text: bytes | None) -> list[bytes]:
    text = text or b""
    lower = text.lower() if text.isascii() else text.decode().lower().encode()
    return lower.translate(BLANKS).split()


def edits(a: list[int], b: list[int]) -> int:
    """Edit distance of two word sequences, bit-parallel; 0 equals nothing."""
    if not b:
        return len(a)
    masks: dict[int, int] = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    masks.pop(0, None)
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score = full, 0, len(b)
    for x in a:
        same = masks.get(x, 0)
        below, across = same | down, (((same & up) + up) ^ up) | same
        plus, minus = down | (~(across | up) & full), up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (~(below | plus) & full), plus & below
    return score


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """Rows of m words (as 32-bit hashes, 0 for none) to rows of 3 m, one walk for all; 0 after the end."""
    n, m = windows.shape
    flat = np.concatenate([windows, np.zeros((n, 1), np.uint32)], axis=1).ravel()
    at, out = np.arange(n) * (m + 1), np.zeros((3 * m, n), np.uint32)
    step_hash = (common.mix(np.arange(1, 3 * m + 1, dtype=np.uint64) + np.uint64(walk << 32)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for step in range(3 * m):
        word = flat[at]
        out[step] = word
        at += word * step_hash[step] >> np.uint32(31)
    return out


def table_keys(windows: np.ndarray) -> np.ndarray:
    """A row of WALKS * TABLES_OF_WALK keys for each window of word numbers (0: a word that no item has)."""
    n, m = windows.shape
    # words of no item differ from all words: from each other too, so that they rarely keep walks in step by chance
    hashed = (common.mix(windows.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    hashed[windows < 0] = 0
    out = np.empty((n, WALKS * TABLES_OF_WALK), np.uint64)
    for walk in range(WALKS):
        e, rng = embed(hashed, walk), np.random.default_rng((SEED, m, walk))
        for table in range(TABLES_OF_WALK):
            h = np.full(n, m * 1009 + walk * TABLES_OF_WALK + table, np.uint64)
            for k in rng.choice(2 * m, min(SAMPLES, 2 * m), replace=False).tolist():
                h = common.mix(h ^ (e[k] + np.uint64(k * 0xA0761D6478BD642F & (1 << 64) - 1)))
            out[:, walk * TABLES_OF_WALK + table] = h
    return out


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


class Index:
    """The tables of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], tolerance: float = TOLERANCE):
        self.tolerance = tolerance
        self.numbers: dict[bytes, int] = {}  # of the benchmark's words, from 1
        self.items: list[tuple[int | None, list[int]]] = []
        for item, text in items:
            if words := words_of((text or "").encode()):
                self.items.append((item, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.lengths = sorted({len(w) for _, w in self.items})
        self.runs = np.unique(np.concatenate([self.runs_of(np.array(w, np.int64)) for _, w in self.items])) if self.items else np.zeros(0, np.uint64)
        self.tables: dict[int, dict[int, list[int]]] = {m: {} for m in self.lengths}
        for m in self.lengths:
            same = [k for k, (_, w) in enumerate(self.items) if len(w) == m]
            for k, row in zip(same, table_keys(np.array([self.items[k][1] for k in same], np.int32)).tolist(), strict=True):
                for key in row:
                    self.tables[m].setdefault(key, []).append(k)

    @staticmethod
    def runs_of(ids: np.ndarray) -> np.ndarray:
        x = ids.astype(np.uint64)
        return common.mix(common.mix(x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) + x[2:]) if len(x) > 2 else np.zeros(0, np.uint64)

    def slack(self, m: int) -> int:
        return int(self.tolerance * m + 1e-9)

    def windows(self, text: bytes | None):
        """(length, starts, windows) that may match; words past the end of a short document are -1."""
        words = words_of(text)
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))
        if not len(ids) or not self.lengths:
            return
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        place = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)) if len(ids) > 2 else np.zeros(0, np.int64)
        place = place[among(self.runs_of(ids)[place], self.runs)] if len(place) else place
        whole = np.zeros(len(ids) + 1, np.int64)
        whole[place + 1] = 1
        whole = np.cumsum(whole)
        for m in self.lengths:
            n, least, runs = min(m, len(ids)), m - self.slack(m), m - 2 - 3 * self.slack(m)
            if len(place) < runs:
                continue
            ok = known[n:] - known[:-n] >= least
            if n > 2:
                ok &= whole[n - 2 :][: len(ok)] - whole[: len(ok)] >= runs
            starts = np.flatnonzero(ok)
            if len(starts):
                found = np.full((len(starts), m), -1, np.int32)
                found[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)[starts]
                yield m, starts, found

    def match(self, m: int, windows: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window the items of that length that it is near to, with the edits."""
        table, out = self.tables[m], [[] for _ in range(len(windows))]
        all_keys = np.sort(np.fromiter(table, np.uint64, len(table)))
        for block in range(0, len(windows), 8192):
            part = windows[block : block + 8192]
            keys = table_keys(part)
            met = among(keys, all_keys)
            for r in np.flatnonzero(met.any(1)).tolist():
                words = [w for w in part[r].tolist() if w >= 0]
                for k in {k for key in keys[r, met[r]].tolist() for k in table[key]}:
                    if (e := edits(words, self.items[k][1])) <= self.slack(m):
                        out[block + r].append((k, e))
        return out

    def find(self, texts: list[bytes | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text (item, start, n_words, edits) of the nearest window of each item that contaminates it. Equal windows are looked up once."""
        held: dict[int, list] = {}
        for d, text in enumerate(texts):
            for m, starts, windows in self.windows(text):
                held.setdefault(m, []).append((np.full(len(starts), d), starts, windows))
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for m, parts in held.items():
            doc, start, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            weight = common.mix(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
            _, one, of = np.unique((common.mix(windows.astype(np.int64).astype(np.uint64)) * weight).sum(1, dtype=np.uint64), return_index=True, return_inverse=True)
            found = self.match(m, windows[one])
            some = np.array([bool(x) for x in found])
            for r in np.flatnonzero(some[of]).tolist():
                n = int((windows[r] >= 0).sum())
                for k, e in found[of[r]]:
                    new, at = (e, int(start[r]), n), best[doc[r]]
                    at[k] = min(at.get(k, new), new)
        return [[(self.items[k][0], start, n, e) for k, (e, start, n) in sorted(x.items())] for x in best]


def in_lots(batches, column: int):
    """Batches with the bytes of their texts, several at a time: as many as make LOT_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        texts = common.raw(batch.column(column))
        held.append((batch, texts))
        size += sum(len(t) for t in texts if t)
        if size > LOT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def blocks(benchmark: DataFrame, tolerance: float):
    """Indexes of blocks of the benchmark, a block at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if len(held) == BLOCK or size >= BLOCK_BYTES:
            yield Index(held, tolerance)
            held, size = [], 0
    if held:
        yield Index(held, tolerance)


def contaminations(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, start_word, n_words, edits."""
    spark = docs.sparkSession
    common.tune(spark)
    schema, out = "doc_id long, item_id long, start_word long, n_words long, edits long", None
    for index in blocks(benchmark, tolerance):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for lot in in_lots(batches, 1):
                hits = sent.value.find([t for _, texts in lot for t in texts])
                docs_of = [d for batch, _ in lot for d in batch.column(0).to_pylist()]
                found = [(doc, *x) for doc, xs in zip(docs_of, hits, strict=True) for x in xs]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "start_word", "n_words", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(common.lean(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """docs without the contaminated ones."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    common.tune(spark)
    for index in blocks(benchmark, tolerance):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for lot in in_lots(batches, at):
                clean = iter([not x for x in sent.value.find([t for _, texts in lot for t in texts])])
                for batch, texts in lot:
                    yield batch.filter(pa.array([next(clean) for _ in texts], pa.bool_()))

        docs = docs.mapInArrow(common.lean(run), docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
