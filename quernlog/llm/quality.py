"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each text are standardised, mapped to ``cos(W x + b)`` with Gaussian ``W`` (whose inner
products approximate a Gaussian kernel), and a ridge regression on them is solved from normal
equations summed over partitions.  Its output is calibrated by isotonic regression on the counts of a
fixed number of bins.

Defined results: a null or empty text has the statistics of no text and gets their score; repeated
rows get equal scores; labels that repeat a doc_id are averaged, null ones are left out; without any
label every score is 0.5; a null doc_id counts as an empty id text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, encode_slices, flat_text, mixed, stored, text_chunks, word_slices
from .sums import partition_sum

FEATURES, BINS, RIDGE, SEED = 192, 1024, 1e-3, 7
#: Share of the ridge output in a score beside the calibrated rate, so that texts of one rate are told apart.
RANKING = 0.01
#: Labelled rows that a fit uses at most, chosen by the hash of doc_id; so they can be broadcast.
MOST_LABELS = 1_000_000

#: Symbols that mark-up and junk are made of.
SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 symbol, 6 exclamation, 7 other ASCII, 8 first byte of another character, 0 the rest of it
_CLASS[33:127] = 7
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[33] = 6
_CLASS[0xC2:0xF5] = 8
N_STATISTICS = 18


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(codes: np.ndarray, first: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct codes, and the count of its commonest one."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    keys, counts = np.unique(owner * max(n_codes, 1) + codes, return_counts=True)
    text = keys // max(n_codes, 1)
    most = np.zeros(n)
    np.maximum.at(most, text, counts)
    return np.bincount(text, minlength=n).astype(np.float64), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text, whatever its language."""
    data, offsets = flat_text(column)
    n = len(offsets) - 1
    kind = _CLASS[data]
    counts = [_per_text(kind == k, offsets) for k in range(1, 9)]
    if len(data) > 1:  # capital letters of Latin-1
        high = np.concatenate([(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E), [False]])
        capitals = _per_text(high, offsets)
        counts[0] += capitals
        counts[7] -= capitals
    chars = sum(counts)
    raw, words, first = word_slices(data, offsets, lower=True)
    codes, distinct = encode_slices(raw, words)
    n_words = np.diff(first).astype(np.float64)
    kinds, most = _distinct(codes.astype(np.int64), first, len(distinct))
    same = np.concatenate([[False], codes[1:] == codes[:-1]]) if len(codes) else np.zeros(0, bool)
    inner = first[:-1][first[:-1] < len(codes)]
    same[inner] = False
    windows = np.zeros(len(codes), np.uint64)
    for j in range(min(5, len(codes))):
        windows[: len(codes) - j] += mixed(codes[j:].astype(np.uint64) + np.uint64(j << 40))
    span = np.maximum(np.diff(first) - 4, 0)
    at = np.concatenate([np.arange(a, a + s) for a, s in zip(first[:-1], span, strict=True)]) if n else np.zeros(0, np.int64)
    _, as_code = np.unique(windows[at], return_inverse=True)
    own = np.concatenate([[0], np.cumsum(span)])
    new_windows, _ = _distinct(as_code.astype(np.int64), own, len(as_code))
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    breaks[np.flatnonzero(data == 10) + 1] = True
    lines = np.flatnonzero(breaks)
    line_codes, line_kinds = encode_slices(data, lines)
    line_first = np.searchsorted(lines, offsets)
    n_lines = np.diff(line_first).astype(np.float64)
    new_lines, _ = _distinct(line_codes.astype(np.int64), line_first, len(line_kinds))
    c, w, ls = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    letters = np.maximum(counts[0] + counts[1] + counts[7], 1)
    out = [
        np.log1p(n_words), np.log1p(chars) - np.log1p(n_words), counts[0] / letters, counts[2] / c, counts[3] / c, counts[4] / c,
        np.minimum(counts[5] / w, 2), counts[6] / c, counts[7] / c, np.log1p(n_lines), kinds / w, most / w,
        _per_text(same, first) / w, new_windows / np.maximum(span, 1), new_lines / ls, np.log1p(n_words / ls), np.minimum(counts[4] / w, 3), (n_words == 0).astype(np.float64),
    ]
    return np.stack(out, 1)


def statistics_table(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and x, its statistics."""

    bounded_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            x = statistics(chunk.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, x array<double>")


def remainder(column: str, of: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(of))


def training_labels(labels: DataFrame, name: str, learn: F.Column, most: int = MOST_LABELS) -> DataFrame:
    """doc_id and y of the rows to learn from; of more than ``most`` those of smallest hash."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & learn).groupBy("doc_id").agg(F.avg(name).alias("y"))
    n = own.count()
    return own if n <= most else own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def _xy(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy().reshape(b.num_rows, N_STATISTICS), b.column("y").to_numpy()


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of consecutive bins by pooling adjacent violators; empty bins join their neighbours."""
    blocks: list[list[float]] = []
    for p, t, in zip(positive.tolist(), total.tolist(), strict=True):
        blocks.append([p, t, 1])
        while len(blocks) > 1 and (not blocks[-1][1] or not blocks[-2][1] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), p / t if t else 0.5) for p, t, n in blocks])


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(size=(N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.rates: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Place of the raw output among the bins, with fractions."""
        return np.clip((self.features(x) @ self.beta + 0.5) / 2, 0, 1) * (BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.rates is None:
            return np.full(len(x), 0.5)
        place = self.bin(x)
        return np.clip((1 - RANKING) * np.interp(place, np.arange(BINS), self.rates) + RANKING * place / (BINS - 1), 0, 1)


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """``table``: doc_id, x; ``labels``: doc_id, y."""
    train = stored(table.join(F.broadcast(labels), "doc_id").select("x", "y"), "train")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for x, _ in _xy(batches):
            own = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            total = own if total is None else total + own
        return total

    m = partition_sum(train, moments)
    if m is None:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    mean = m[1 : N_STATISTICS + 1] / m[0]
    model = Model(mean, np.sqrt(np.maximum(m[N_STATISTICS + 1 :] / m[0] - mean * mean, 0)) + 1e-3)

    def normal(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for x, y in _xy(batches):
            z = model.features(x)
            own = np.concatenate([(z.T @ z).ravel(), z.T @ y])
            total = own if total is None else total + own
        return total

    sums, d = partition_sum(train, normal), FEATURES + 1
    model.beta = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * m[0] * np.eye(d) / d, sums[d * d :])

    def histogram(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for x, y in _xy(batches):
            k = np.rint(model.bin(x)).astype(int)
            own = np.concatenate([np.bincount(k, y, BINS), np.bincount(k, minlength=BINS)])
            total = own if total is None else total + own
        return total

    sums = partition_sum(train, histogram)
    model.rates = isotonic(sums[:BINS], sums[BINS:])
    return model


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted; learns from ``labels`` (doc_id, quality) outside the held-out fold."""
    table = stored(statistics_table(docs), "statistics")
    model = fit(table, training_labels(labels, "quality", remainder("doc_id", fold) != held))
    return table.mapInArrow(_scorer(model), "doc_id long, score double").select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at or above the threshold."""
    own = training_labels(labels, "quality", remainder("doc_id", fold) != held)
    # Only labelled texts are read twice; labels are bounded, see MOST_LABELS.
    labelled = docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")
    model = fit(statistics_table(labelled), own)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield chunk.filter(pa.array(model.score(statistics(chunk.column(at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
