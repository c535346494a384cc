"""What the corpus operators share: intermediate tables, text access and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch, and bytes: however long texts are, a batch ends with the row that passes them.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20
#: Entries a worker's word cache may hold before it starts anew.
CACHE_WORDS = 100_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, since texts are long. The session's own limits stay where they are lower."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(str(spark.conf.get(name)).rstrip("bB")) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of its own on a local master, where it may be unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_written: list[tuple[SparkSession, str]] = []


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to a table in the shared folder and read it from there, so a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a saved table that nothing will read again."""
    path = getattr(df, "_saved_at", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def written() -> set[str]:
    """The paths of all saved tables that are still there."""
    return {path for _, path in _written}


def tidy(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables saved since `before`, but for those that something will read again."""
    keep_paths = {getattr(df, "_saved_at", None) for df in keep}
    for spark, path in list(_written):
        if path not in before and path not in keep_paths:
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


#: What workers keep from task to task, by name.
_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary of the worker process that lasts while tasks ask for it by name (see `lean`)."""
    return _caches.setdefault(name, {})


def lean(run, *keep: str):
    """run, for mapInArrow, so that the reused worker is as small after the task as before: caches of other operators go when
    it starts, and freed memory is given back when it ends."""

    def lean_run(batches):
        for name in _caches.keys() - set(keep):
            _caches[name].clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return lean_run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it unlike all that are taken."""
    lower, out = {n.lower() for n in taken}, []
    for n in names:
        while n.lower() in lower:
            n += "_"
        lower.add(n.lower())
        out.append(n)
    return out


def raw(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHash(dict):
    """64-bit hashes of words, remembered; the same in every process."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, for hashes of any stretch of a sequence."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(1, np.uint64)
        self.need(4096)

    def need(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = 1 << (n - 1).bit_length()
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)])) for b in (self.base, self.inverse))

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.need(len(h) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])

    def stretch(self, prefix: np.ndarray, start, end) -> np.ndarray:
        """Hashes of [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.down[start])


def ngrams(h: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hashes of all stretches of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return powers.stretch(powers.prefix(h), at, at + n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
