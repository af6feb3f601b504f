"""Cost-balanced packing of token documents into fixed-length sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n`` (attention stays within a
document).  Pieces go, longest first, to the sequence of least cost with room for them; a piece
that fits nowhere is cut at the room of the emptiest sequence.  Each task packs blocks of its own
rows, so there is no shuffle and a block's size bounds the memory.

Defined results: a null or empty text is the end id alone; repeated rows (also with one doc_id or a
null one) are packed each for itself, in the order read; ``start`` counts from that row's first id;
an empty table gives no rows; extra columns are ignored.  Sequence ids are unique in the table and
depend on how its rows are split into tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, text_chunks
from .tokens import text_tokenizer, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_lengths(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block, and the number of sequences.

    All sequences are full but those of the last ``sum(lengths) % size`` ids, which are cut at
    powers of two, so that none needs padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    whole = lengths // size
    sequence = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            pieces.append((int(d), k * size, size, sequence, 0))
            sequence += 1
    rest = lengths - whole * size
    order = np.argsort(-rest, kind="stable")
    todo = [(-int(rest[d]), int(d), int(whole[d]) * size) for d in order if rest[d]]
    total = -sum(t[0] for t in todo)
    rooms = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (total % size) >> b & 1]
    room = dict(enumerate(rooms, sequence))
    cap = dict(room)
    open_ = [(0.0, s) for s in room]  # by cost: sequences with room for the piece at hand
    heapq.heapify(open_)
    cost = dict.fromkeys(room, 0.0)
    waiting: dict[int, list[int]] = defaultdict(list)  # by room: sequences with less room than that
    roomiest: list[int] = []  # of waiting, largest first, as a heap of negatives
    cut: list[tuple[int, int, int]] = []  # what is left of pieces that were cut, longest first
    at = 0

    def wait(s: int) -> None:
        if not waiting[room[s]]:
            heapq.heappush(roomiest, -room[s])
        waiting[room[s]].append(s)

    while at < len(todo) or cut:
        if cut and (at >= len(todo) or cut[0] <= todo[at]):
            need, d, start = heapq.heappop(cut)
        else:
            need, d, start = todo[at]
            at += 1
        need = -need
        while roomiest and -roomiest[0] >= need:
            for s in waiting.pop(-heapq.heappop(roomiest)):
                heapq.heappush(open_, (cost[s], s))
        s = -1
        while open_:
            _, s = heapq.heappop(open_)
            if room[s] >= need:
                break
            wait(s)
            s = -1
        if s < 0:  # it fits nowhere: fill the emptiest
            r = -roomiest[0]
            s = waiting[r].pop()
            if not waiting[r]:
                heapq.heappop(roomiest)
                del waiting[r]
            heapq.heappush(cut, (-(need - r), d, start + r))
            need = r
        pieces.append((d, start, need, s, cap[s] - room[s]))
        room[s] -= need
        cost[s] += linear * need + quadratic * need * need
        if room[s]:
            wait(s)
    return pieces, sequence + len(rooms)


def packer(path: str, size: int, end_id: int, linear: float, quadratic: float, block_tokens: int, remembered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = text_tokenizer(path, space_led=True, remembered=remembered)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        used = 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        count = 0

        def emit() -> pa.RecordBatch:
            nonlocal used, held, count
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            names = [n for h in held for n in h[0]]
            first = np.cumsum(lengths) - lengths
            pieces, n = pack_lengths(lengths, size, linear, quadratic)
            p = np.array(pieces, np.int64).reshape(-1, 5)
            raw = ids.astype("<u4").tobytes()
            at = (first[p[:, 0]] + p[:, 1]) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + p[:, 2] * 4).tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()).take(pa.array(p[:, 0])), *map(pa.array, (p[:, 1], p[:, 2])), pa.array(crc, pa.int64()), *map(pa.array, (lengths[p[:, 0]], base + used + p[:, 3], p[:, 4]))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )
            used, held, count = used + n, [], 0
            return out

        for chunk in text_chunks(batches):
            ids, offsets = tokenizer.encode(chunk.column("text"))
            lengths = np.diff(offsets) + 1
            held.append((chunk.column("doc_id").to_pylist(), np.insert(ids, offsets[1:], end_id), lengths))
            count += int(lengths.sum())
            if count >= block_tokens:
                yield emit()
        if held:
            yield emit()

    return pack


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 4_000_000, remembered: int = 500_000) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of ``size`` ids; see the module for what they hold.  A worker holds a block and the ids of ``remembered`` pieces of text, which bounds its memory."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(packer(path or tokenizer_path("byte_bpe_50k.json"), size, end_id, linear, quadratic, block_tokens, remembered), SCHEMA)
