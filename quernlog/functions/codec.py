"""The binary record layout: three little-endian 16-bit lengths, the record type, key, value and the time as a varint.

Encoding is an expression.  Decoding a file is sequential by nature, so it is one Arrow function over
whole files; files are read in parallel.  On disk, log files are rows of a few large files: they are small
and as many as the records, and a file of the file system for each costs more than all else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the layout.
WRITE, DELETE = 0, 1
HEADER_BYTES, TIME_LENGTH, MOST_BYTES = 7, 8, 65535
_HEADER = struct.Struct("<HHHB")


def varint_length(n: Column) -> Column:
    return F.when(n < 128, 1).otherwise(F.ceil((F.length(F.bin(n))) / 7)).cast("int")


def record_bytes(key: Column, value: Column, ts: Column) -> Column:
    """The encoded size of a record."""
    return (F.lit(HEADER_BYTES) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + varint_length(ts)).cast("long")


def _high_first(values: list[Column], n: int) -> Column:
    """Hexadecimal digits of bytes, at most eight, put into one long: plain arithmetic, as this is worked out for each record."""
    whole = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(v.cast("long"), 8 * (n - 1 - i)) for i, v in enumerate(values)))
    return F.lpad(F.hex(whole), 2 * n, "0")


def _two_bytes(n: Column) -> list[Column]:
    return [n.bitwiseAND(255), F.shiftright(n, 8)]


def _varint(n: Column) -> Column:
    """Seven bits a byte, lowest first; all bytes but the last have their high bit set."""
    each = [F.shiftright(n, 7 * i).bitwiseAND(127).bitwiseOR(F.when(n >= 1 << 7 * (i + 1), 128).otherwise(0)) for i in range(8)]
    first = F.substring(_high_first(each, 8), F.lit(1), 2 * F.least(varint_length(n), F.lit(8)))
    last = F.when(n >= 1 << 56, F.lpad(F.hex(F.shiftright(n, 56)), 2, "0")).otherwise("")
    return F.unhex(F.concat(first, last))


def encode(rec_type: Column, key: Column, value: Column, ts: Column) -> Column:
    """The record's bytes; null if a key or value is longer than its length field can tell."""
    k, v, n = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b"")), ts.cast("long")
    fits = (F.octet_length(k) <= MOST_BYTES) & (F.octet_length(v) <= MOST_BYTES)
    header = _high_first([*_two_bytes(F.octet_length(k)), *_two_bytes(F.octet_length(v)), *_two_bytes(F.lit(TIME_LENGTH)), rec_type], HEADER_BYTES)
    return F.when(fits, F.concat(F.unhex(header), k, v, _varint(n)))


def decode_all(raw: bytes | memoryview) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """All whole records of a file: offset, type, key, value, time.  A torn tail ends it."""
    raw, at = memoryview(raw).cast("B"), 0
    while at + HEADER_BYTES <= len(raw):
        n_key, n_value, _, kind = _HEADER.unpack_from(raw, at)
        k = at + HEADER_BYTES
        t = k + n_key + n_value
        ts = shift = 0
        while t < len(raw):
            b = raw[t]
            t += 1
            ts |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        else:
            return
        yield at, kind, bytes(raw[k : k + n_key]), bytes(raw[k + n_key : k + n_key + n_value]), ts
        at = t


RECORD = "offset long, rec_type int, key binary, value binary, ts long"
#: Records that a batch of decoded ones is meant to hold; bytes of files that are walked at a time, unless one has more; files from which on they are walked side by side.
_BATCH_RECORDS, _BATCH_BYTES, _ABREAST = 200_000, 16 << 20, 32
#: Bytes of log files in a row group: readers share these.
_GROUP_BYTES = 16 << 20


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes, and where its values begin in them and the last one ends."""
    column = column.cast(pa.large_binary())
    raw = column.buffers()[2]
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), ends


def _slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of parts of ``data``."""
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    places = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[places])]).cast(pa.binary())


def _step(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records at places ``at`` of ``data``, each within its file's ``end``: lengths of key and value, the time, and where the next one is; -1 for no whole record."""
    two = lambda i: data[i].astype(np.int64) | data[i + 1].astype(np.int64) << 8
    whole = at + HEADER_BYTES <= end
    own = np.where(whole, at, 0)
    n_key, n_value = two(own), two(own + 2)
    place = own + HEADER_BYTES + n_key + n_value
    ts, more = np.zeros(len(at), np.int64), whole.copy()
    for shift in range(0, 63, 7):
        inside = more & (place < end)
        whole &= ~more | inside  # a torn time
        b = data[np.where(inside, place, 0)].astype(np.int64)
        ts |= np.where(inside, (b & 127) << shift, 0)
        place += inside
        more = inside & (b >= 128)
        if not more.any():
            break
    return n_key, n_value, ts, np.where(whole & ~more, place, -1)


def _walk(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """All records of the files ``data[start:end]``: file, place, lengths of key and value, time; a file's records in order."""
    parts, at, live = [], start.copy(), np.arange(len(start))
    while len(live) >= _ABREAST:  # one record of every file at a time
        n_key, n_value, ts, after = _step(data, at[live], end[live])
        good = after >= 0
        live = live[good]
        parts.append((live, at[live], n_key[good], n_value[good], ts[good]))
        at[live] = after[good]
    raw = memoryview(data)
    for f in live.tolist():  # few files: one after the other
        rows = []
        base, stop = int(at[f]), int(end[f])
        while base + HEADER_BYTES <= stop:
            n_key, n_value, _, _ = _HEADER.unpack_from(raw, base)
            t = base + HEADER_BYTES + n_key + n_value
            ts = shift = 0
            b = 128
            while t < stop and b > 127:
                b = raw[t]
                t += 1
                ts |= (b & 127) << shift
                shift += 7
            if b > 127:
                break
            rows.append((base, n_key, n_value, ts))
            base = t
        if rows:
            r = np.array(rows, np.int64)
            parts.append((np.full(len(r), f), r[:, 0], r[:, 1], r[:, 2], r[:, 3]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    out = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(out[1], kind="stable")  # files lie one after the other
    return tuple(c[order] for c in out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files, whose content is the last column; with the other columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, bounds = buffer_of(batch.column(batch.num_columns - 1))
        names = [*batch.schema.names[:-1], *(c.split()[0] for c in RECORD.split(", "))]
        first = 0
        while first < batch.num_rows:
            after = max(int(np.searchsorted(bounds, bounds[first] + _BATCH_BYTES, side="right")) - 1, first + 1)
            ends = bounds[first : after + 1] - bounds[first]
            # A header can be looked at beyond the last byte; what is there belongs to no record.
            data = np.concatenate([raw[bounds[first] : bounds[after]], np.zeros(HEADER_BYTES, np.uint8)])
            file, at, n_key, n_value, ts = _walk(data, ends[:-1], ends[1:])
            for a in range(0, len(file), _BATCH_RECORDS):
                s = slice(a, a + _BATCH_RECORDS)
                keys, own = at[s] + HEADER_BYTES, pa.array(file[s] + first)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(own) for c in batch.columns[:-1]), pa.array(at[s] - ends[file[s]]), pa.array(data[at[s] + 6].astype(np.int32)), _slices(data, keys, n_key[s]), _slices(data, keys + n_key[s], n_value[s]), pa.array(ts[s])],
                    names=names,
                )
            first = after


def decode_files(files: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Records of ``files`` (``by``, content), with the columns ``by`` of their file."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*by).schema)
    return files.select(*by, "content").mapInArrow(_decode, f"{own}, {RECORD}")


def write_logs(files: DataFrame, path: str) -> None:
    """Write log files (p, file, content; ``runs.log_files``) as rows of a few Parquet files: as many as there are tasks, however many log files."""
    files.write.option("parquet.block.size", _GROUP_BYTES).option("parquet.block.size.row.check.min", 1).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all log files under ``path``: p, file, offset and a record's columns."""
    return decode_files(spark.read.parquet(path), ("p", "file"))
