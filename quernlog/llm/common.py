"""Shared helpers: scratch tables in the cluster's shared folder, and text batches as flat arrays."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files

#: Text bytes that one vectorised step works on; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 4 << 20
BATCH_ROWS = 2000

#: The separators of the word pattern [^\x20\x09-\x0D]+
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (local runs only) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="quernlog-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


#: Scratch tables of the work at hand (see ``tidied``), and all that are left of this process.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)
_LEFT: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder; it is removed when the process ends, if not before."""
    path = f"{shared_root(spark)}/quernlog/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT[path] = spark
    return path


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        Files(spark).delete(path)
        _LEFT.pop(path, None)


def _sweep() -> None:
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            Files(spark).delete(path)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.  A table with a row for a source or a language is given a few ``files``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def tidied(spark: SparkSession, name: str, run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` gives, stored; the scratch tables that it made on its way are removed."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        result = stored(run(), name)
    finally:
        _MADE.reset(token)
    removed(spark, made[:-1])
    outer = _MADE.get()
    if outer is not None:
        outer.append(made[-1])
    return result


#: Rows that a broadcast may hold.
BROADCAST_ROWS = 500_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, total: int, weight: str, how: str = "inner") -> DataFrame:
    """Join ``left`` (``total`` rows) with ``right``: ``rows`` rows, one a key, ``weight`` of left's rows have it.

    A small ``right`` is broadcast.  Else keys with very many rows, of which there can only be few,
    are, and those rows stay where they are; all others are shuffled.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), on, how)
    most = max(10_000, total // 100_000)  # so at most 100,000 keys have more
    hot, cold = right.where(F.col(weight) > most).drop(weight), right.where(F.col(weight) <= most).drop(weight)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, which bounds what a worker and its executor hold of texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release_memory() -> None:
    """Give what a task has freed back to the system; workers live on and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # other C libraries
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def steady_memory() -> None:
    """For a task that makes and drops the same arrays over and over: the C library keeps some of what is freed (32 MB), and takes arrays of up to 4 MB from it."""
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            for option, size in ((-3, 4 << 20), (-1, 32 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
                ctypes.CDLL("libc.so.6").mallopt(option, size)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and each text's offset in them; a null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        _, offsets = flat_text(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def slices_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over consecutive slices of ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each slice's code, and the distinct slices by code."""
    if len(offsets) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    coded = slices_array(data, offsets).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), coded.dictionary


def word_slices(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: their bytes end to end, each word's offset there, and each text's first word."""
    keep = ~_IS_SPACE[data]
    n = len(data)
    if not n or not keep.any():
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    start[inner] = keep[inner]
    end = keep.copy()
    end[:-1] &= ~keep[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = keep[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    kept = data[keep]
    return (_LOWER[kept] if lower else kept), where, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1 of every range, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def binary_parts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive parts of ``data``; ``ends``: n + 1 places in it."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def worker_setup() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
