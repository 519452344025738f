"""What the corpus operators share: tables in the shared folder, Arrow batches, 64-bit hashing.

Texts travel as Arrow batches and are handled as UTF-8 bytes.  Intermediate results go to
tables in the folder named by ``spark.checkpoint.dir``: a table can be read again after any
executor is lost, and it cuts lineage.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_OWN: dict[str, str] = {}
#: What a worker keeps between tasks can be let go by these; the operator that it ran last.
_RELEASES: list[Callable[[], None]] = []
_LAST: list[str] = []


def kept(f):
    """A cache of a worker, emptied when the worker goes over to another operator."""
    found = functools.cache(f)
    _RELEASES.append(found.cache_clear)
    return found


def begin(operator: str) -> None:
    """Called first in a worker's task: workers are used again, and what each operator of a job
    keeps in them would otherwise add up."""
    if _LAST == [operator]:
        return
    if _LAST:
        for release in _RELEASES:
            release()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
    _LAST[:] = [operator]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weft-"))
    return base.rstrip("/")


class Scratch:
    """Tables of one operator call.  Leaving it removes all of them but those that a lazy result
    still reads (``keep``), which go when the session's file systems are closed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        if keep:
            where, files = self._place(path)
            files.deleteOnExit(where)
        else:
            self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        if path in self.paths:
            self.paths.remove(path)
            self._delete(path)

    def _place(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        where, files = self._place(path)
        files.delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        for p in self.paths:
            self._delete(p)
        self.tables, self.paths = [], []


class Rows:
    """A table with a number for each row, written once so that a task that runs again sees the same
    numbers; its columns have names of their own, whatever the table calls them."""

    def __init__(self, documents: DataFrame, scratch: Scratch):
        self.names = documents.columns
        numbered = documents.toDF(*(f"c{i}" for i in range(len(self.names)))).withColumn("row", F.monotonically_increasing_id())
        self.scratch, self.table = scratch, scratch.write(numbered, "rows", keep=True)

    def column(self, name: str):
        return F.col(f"c{self.names.index(name)}")

    def without(self, gone: DataFrame) -> DataFrame:
        """The table's rows, under its own names, but those numbered in ``gone`` (column row)."""
        gone = self.scratch.write(gone, "gone", keep=True)
        left = self.table.join(gone.hint("merge"), "row", "left_anti").drop("row")
        return left.toDF(*self.names)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, so that arrays over their bytes stay small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of ranges of a sequence, from one running sum.  For ranges of
    up to a hundred values: long self-similar sequences can cancel out under any odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.release()
        _RELEASES.append(self.release)

    def release(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.base))])
                self.down = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, self.inverse))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The hash of k values from each position on."""
        n = max(0, len(sums) - k)
        return (sums[k : k + n] - sums[:n]) * self.down[:n]


BYTES_A, BYTES_B = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
ITEMS_A, ITEMS_B = Rolling(0xC2B2AE3D27D4EB4F | 5), Rolling(0xA0761D6478BD642D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts laid end to end: the bytes, each word's start
    and end there, and for each text the number of words before it (one entry more)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    return data, starts, ends, np.searchsorted(starts, first)


#: Bytes of a run from which on a library hash takes over.
LONG = 256


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of ranges of bytes.  Eight bytes at a time are mixed in, each time by a
    bijection that is not linear, so no arrangement of equal parts cancels out as it can in a
    polynomial; other seeds give independent hashes."""
    left = ends - starts
    h = mix(left.astype(U64) + U64(seed))
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    long = np.flatnonzero(left > LONG)
    live = np.flatnonzero((left > 0) & (left <= LONG)) if len(long) else np.flatnonzero(left > 0)
    at, left = starts[live], left[live]
    while len(live):
        part = eight[at]
        short = left < 8
        part[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        h[live] = mix((h[live] ^ part) * U64(0x9E3779B97F4A7C15))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    key = seed.to_bytes(8, "little")
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


#: Seeds of two independent word hashes.
FIRST, SECOND = 0x243F6A8885A308D3, 0x13198A2E03707344


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = FIRST) -> np.ndarray:
    return run_hashes(data, starts, ends, seed)
