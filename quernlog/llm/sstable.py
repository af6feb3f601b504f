"""Sorted-string-table shards of token ids, keyed by document id.

A shard file, in this order (every part is followed by one line feed, which the text sink writes):

* data blocks: entries ``shared, unshared, key suffix, count, ids``; keys share prefixes with the
  entry before, but for a restart every 16 entries; then the restarts' offsets and their number;
* index: per block its first key, offset, length and number of documents;
* Bloom filter of all keys;
* footer of fixed size, with a checksum of index and filter.

A key is one byte (0 for a null id) and eight bytes of the id, big-endian with its sign flipped, so
bytes sort as ids do.  A shard is written by one task through Spark's own writer, so commits,
retries and any Hadoop file system are Spark's business; shards are read as binary files.

Defined results: rows go in ascending doc_id order, nulls first; rows of one doc_id in the order of
their text's hash (equal texts are alike); a null or empty text holds the end id alone; an empty
table gives no shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, text_chunks
from .tokens import text_tokenizer, tokenizer_path

MAGIC = b"QSST0001"
RESTART = 16
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Text bytes that one shard is meant to hold.
SHARD_BYTES = 8 << 20
_INDEX = struct.Struct("<9sQII")
_FOOTER = struct.Struct("<QIQIQQHI8s")  # index offset and length, filter offset and length, documents, ids, id width, checksum, magic


def key_bytes(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], n_bits: int) -> np.ndarray:
    """Bit positions of every key, by double hashing."""
    raw = np.frombuffer(b"".join(k[1:] for k in keys), ">u8").astype(np.uint64) + np.array([not k[0] for k in keys], np.uint64)
    one = mixed(raw)
    two = mixed(one ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return ((one[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(n_bits)).astype(np.int64)


class ShardWriter:
    """Turns documents in key order into the parts of one shard."""

    def __init__(self, width: int):
        self.width, self.at, self.total = width, 0, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._clear()

    def _clear(self) -> None:
        self.block, self.restarts, self.count, self.first, self.last = bytearray(), [], 0, b"", b""

    def _part(self, raw: bytes) -> bytes:
        self.at += len(raw) + 1
        return raw

    def add(self, key: bytes, ids: bytes, n: int) -> bytes | None:
        """The block that this document filled, if it did."""
        shared = 0
        if self.count % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.first = self.first or key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(n) + ids
        self.count, self.last, self.total = self.count + 1, key, self.total + n
        self.keys.append(key)
        return self.flush() if len(self.block) >= BLOCK_BYTES else None

    def flush(self) -> bytes:
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        self.index.append(_INDEX.pack(self.first, self.at, len(raw), self.count))
        self._clear()
        return self._part(raw)

    def close(self) -> list[bytes]:
        out = [self.flush()] if self.count else []
        n_bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        for a in range(0, len(self.keys), 65536):
            bits[_probes(self.keys[a : a + 65536], n_bits).ravel()] = 1
        index, bloom = b"".join(self.index), np.packbits(bits, bitorder="little").tobytes()
        places = []
        for raw in (index, bloom):
            places += [self.at, len(raw)]
            out.append(self._part(raw))
        return [*out, _FOOTER.pack(*places, len(self.keys), self.total, self.width, zlib.crc32(bloom, zlib.crc32(index)), MAGIC)]


class ShardReader:
    """Reads a shard held in memory (or mapped): footer first, blocks when asked for."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = memoryview(raw).cast("B")
        foot = self.raw[-_FOOTER.size - 1 : -1]
        ia, il, ba, bl, self.n_docs, self.n_ids, self.width, crc, magic = _FOOTER.unpack(foot)
        if magic != MAGIC or crc != zlib.crc32(self.raw[ba : ba + bl], zlib.crc32(self.raw[ia : ia + il])):
            raise ValueError("not a whole shard")
        self.index = list(_INDEX.iter_unpack(self.raw[ia : ia + il]))
        self.bits = self.raw[ba : ba + bl]

    def _entries(self, at: int, length: int, start: int = 0) -> Iterator[tuple[bytes, memoryview, int]]:
        block = self.raw[at : at + length]
        (n,) = struct.unpack_from("<I", block, length - 4)
        end, key = length - 4 * (n + 1), b""
        while start < end:
            shared, start = _read_varint(block, start)
            rest, start = _read_varint(block, start)
            key = key[:shared] + bytes(block[start : start + rest])
            count, start = _read_varint(block, start + rest)
            yield key, block[start : start + count * self.width], count
            start += count * self.width

    def documents(self) -> Iterator[tuple[bytes, memoryview, int]]:
        for _, at, length, _ in self.index:
            yield from self._entries(at, length)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        at = _probes(keys, len(self.bits) * 8)
        return (np.frombuffer(self.bits, np.uint8)[at >> 3] >> (at & 7) & 1).all(1)

    def find(self, key: bytes) -> list[tuple[memoryview, int]]:
        """All documents of a key: binary search over blocks, then over the block's restarts."""
        low, high = 0, len(self.index)
        while low < high:  # the last block that begins before the key; later ones may go on with it
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for first, at, length, _ in self.index[max(0, low - 1) :]:
            if first > key:
                break
            block = self.raw[at : at + length]
            (n,) = struct.unpack_from("<I", block, length - 4)
            restarts = struct.unpack_from(f"<{n}I", block, length - 4 * (n + 1))
            a, b = 0, n
            while a < b:
                mid = (a + b) // 2
                own = next(self._entries(at, length, restarts[mid]))[0]
                a, b = (mid + 1, b) if own < key else (a, mid)
            for own, ids, count in self._entries(at, length, restarts[max(0, a - 1)]):
                if own > key:
                    break
                if own == key:
                    found.append((ids, count))
        return found


def _writer(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = text_tokenizer(path, space_led=False, remembered=300_000)
        width = 2 if len(tokenizer.weight) <= 1 << 16 else 4
        shard, any_ = ShardWriter(width), False
        for chunk in text_chunks(batches):
            ids, offsets = tokenizer.encode(chunk.column("text"))
            raw = np.insert(ids, offsets[1:], end_id).astype(f"<u{width}").tobytes()
            ends = ((offsets[1:] + np.arange(1, len(offsets))) * width).tolist()
            parts, at, any_ = [], 0, True
            for doc_id, end in zip(chunk.column("doc_id").to_pylist(), ends, strict=True):
                if (block := shard.add(key_bytes(doc_id), raw[at:end], (end - at) // width)) is not None:
                    parts.append(block)
                at = end
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["value"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(shard.close(), pa.binary())], names=["value"])

    return write


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Write all ``docs`` (doc_id, text) as shards under ``path``; a shard's number gives its place in the order."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(_writer(tokenizer or tokenizer_path("word_bpe_49k.json"), end_id), "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 0).text(path)


def _shards(spark: SparkSession, *paths: str) -> DataFrame:
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).where("length > 0").select(number.alias("shard"), "content", "path")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the shards: shard, place in it, doc_id and ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(content.as_buffer())
                rows: list[tuple[int | None, np.ndarray]] = []
                place = size = 0
                for key, ids, count in reader.documents():
                    rows.append((key_value(key), np.frombuffer(ids, f"<u{reader.width}").astype(np.int32)))
                    size += count
                    if size >= 1_000_000:
                        yield _read_batch(shard, place, rows)
                        place, rows, size = place + len(rows), [], 0
                if rows:
                    yield _read_batch(shard, place, rows)

    return _shards(spark, path).mapInArrow(read, "shard long, place long, doc_id long, ids array<int>")


def _read_batch(shard: int, place: int, rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[1] for r in rows])))
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array(np.arange(place, place + len(rows))), pa.array([r[0] for r in rows], pa.int64()), ids], names=["shard", "place", "doc_id", "ids"])


def key_ranges(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard: path, first and last key.  Found in one pass over the shards; keep it as a table beside them for ``lookup``."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                reader = ShardReader(content.as_buffer())
                _, at, length, _ = reader.index[-1]
                last = max(key for key, _, _ in reader._entries(at, length))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([reader.index[0][0]], pa.binary()), pa.array([last], pa.binary())], names=["path", "first", "last"])

    return _shards(spark, path).mapInArrow(ends, "path string, first binary, last binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], ranges: DataFrame | None = None) -> DataFrame:
    """The documents of some ids (a list that the caller holds): Bloom filter, then binary search in each shard.  With ``ranges`` (see ``key_ranges``) only shards are read whose keys enclose an asked one; the driver gets their paths."""
    keys = [key_bytes(i) for i in dict.fromkeys(doc_ids)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(content.as_buffer())
                rows = [(key_value(keys[i]), np.frombuffer(ids, f"<u{reader.width}").astype(np.int32)) for i in np.flatnonzero(reader.may_hold(keys)) for ids, _ in reader.find(keys[i])] if keys else []
                if rows:
                    yield _read_batch(shard, 0, rows)

    paths = [path]
    if ranges is not None:
        asked = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
        paths = sorted(r.path for r in ranges.join(F.broadcast(asked), F.col("key").between(F.col("first"), F.col("last")), "left_semi").select("path").collect())
        if not paths:
            return spark.createDataFrame([], "doc_id long, ids array<int>")
    return _shards(spark, *paths).mapInArrow(search, "shard long, place long, doc_id long, ids array<int>").select("doc_id", "ids")


def digest_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: its ids' start in the whole order, their number and checksum."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(content.as_buffer())
                names, counts, crcs = [], [], []
                for key, ids, count in reader.documents():
                    names.append(key_value(key))
                    counts.append(count)
                    crcs.append(zlib.crc32(ids if reader.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
                n = np.array(counts, np.int64)
                if n.sum() != reader.n_ids or len(n) != reader.n_docs:
                    raise ValueError("a shard holds other documents than its footer says")
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array(names, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    from .common import stored

    read = stored(_shards(spark, path).mapInArrow(digest, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"), "digest")
    # One row a shard of some MB.
    before = read.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    return read.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
