"""Toxicity scores: character n-grams scaled by naive Bayes log-count ratios, then a linear classifier.

Words are put between marks and cut into character n-grams, hashed to a fixed number of features; a
text holds a feature or not.  Over the labelled texts each feature's log ratio of smoothed shares in
the two classes is summed by partitions.  The most telling features, scaled by their ratios, feed a
logistic regression with an L2 penalty.

Defined results: a null or empty text holds no feature and gets the score of none; repeated rows get
equal scores; labels that repeat a doc_id are averaged and count as toxic from one half, null ones are
left out; without labels of both classes every score is 0; a null doc_id counts as an empty id text;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, encode_slices, flat_text, mixed, ranges, stored, text_chunks, word_slices
from .quality import remainder, training_labels
from .sums import partition_sum

SIZES, BITS = (3, 4, 5), 18
#: Features that the classifier uses at most.
KEPT = 4096
#: Labelled rows for the log-count ratios, and of those the rows for the classifier's weights, at most; chosen by the hash of doc_id.
RATIO_ROWS, WEIGHT_ROWS = 1_000_000, 30_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every word's n-grams end to end, and the word of each."""
    text = " " + " ".join(w.decode().lower() for w in words) + " "
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = c == 32
    word = np.cumsum(space) - 1  # of the space before a word, and of its characters
    features, owners = [], []
    for size in SIZES:
        n = len(c) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + c[j : j + n]
        inside = np.cumsum(np.concatenate([[0], space[1:]]))  # spaces up to here
        last = np.arange(n) + size - 1
        fits = inside[np.maximum(last - 1, 0)] == inside[:n]  # no space within but at the ends
        features.append((mixed(h[fits]) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[:n][fits])
    return (np.concatenate(features), np.concatenate(owners)) if features else (np.zeros(0, np.int64),) * 2


def text_features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; of ``wanted`` features only, where given."""
    data, offsets = flat_text(column)
    raw, words, first = word_slices(data, offsets)
    codes, distinct = encode_slices(raw, words)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feature, owner = word_features(distinct.to_pylist())
    if wanted is not None:
        some = wanted[feature]
        feature, owner = feature[some], owner[some]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    start = np.searchsorted(owner, np.arange(len(distinct) + 1))
    size = np.diff(start)
    n = np.int64(len(distinct))
    pairs = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * n + codes)  # each text's distinct words
    text, code = pairs // n, pairs % n
    used = np.unique((np.repeat(text, size[code]) << BITS) | feature[ranges(start[code], size[code])])
    return used >> BITS, used & ((1 << BITS) - 1)


class Model:
    def __init__(self) -> None:
        self.weight = np.zeros(1 << BITS)
        self.bias, self.wanted = -np.inf, np.zeros(1 << BITS, bool)

    def score(self, column: pa.Array) -> np.ndarray:
        text, feature = text_features(column, self.wanted)
        total = np.bincount(text, self.weight[feature], len(column)) if len(text) else np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50)))


def _logistic(text: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, d: int, penalty: float = 1e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on sparse rows; a power iteration bounds the step."""
    n = len(y)
    rows = lambda w, b: np.bincount(text, value * w[column], n) + b
    columns = lambda r: (np.bincount(column, value * r[text], d) / n, r.mean())
    v, v_b = np.ones(d), 1.0
    for _ in range(15):
        norm = np.sqrt(v @ v + v_b * v_b)
        v, v_b = columns(rows(v / norm, v_b / norm))
    step = 1 / (0.26 * np.sqrt(v @ v + v_b * v_b) + penalty)
    w, b, look, look_b = np.zeros(d), 0.0, np.zeros(d), 0.0
    for k in range(rounds):
        g, g_b = columns(1 / (1 + np.exp(-np.clip(rows(look, look_b), -50, 50))) - y)
        new, new_b = look - step * (g + penalty * look), look_b - step * g_b
        speed = k / (k + 3)
        look, look_b, w, b = new + speed * (new - w), new_b + speed * (new_b - b), new, new_b
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column) -> Model:
    own = training_labels(labels, "toxic", learn, RATIO_ROWS)
    train = docs.join(F.broadcast(own.withColumn("y", (F.col("y") >= 0.5).cast("int"))), "doc_id").select("doc_id", "text", "y")

    def ratios(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((2, (1 << BITS) + 1))
        for chunk in text_chunks(batches):
            y = chunk.column("y").to_numpy()
            text, feature = text_features(chunk.column("text"))
            for k in (0, 1):
                total[k, :-1] += np.bincount(feature[y[text] == k], minlength=1 << BITS)
                total[k, -1] += (y == k).sum()
        return total.ravel() if total[:, -1].any() else None

    model = Model()
    counts = partition_sum(train, ratios)
    if counts is None:
        return model
    counts = counts.reshape(2, -1)
    rows, counts = counts[:, -1], counts[:, :-1]
    if not rows.all():
        return model
    share = (counts + 0.5) / (rows[:, None] + 1)
    ratio = np.log(share[1] / share[0])
    spread = np.sqrt(share[0] * (1 - share[0]) / rows[0] + share[1] * (1 - share[1]) / rows[1])
    telling = np.argsort(-np.abs(share[1] - share[0]) / spread, kind="stable")[:KEPT]
    telling = telling[counts[:, telling].sum(0) >= 3]
    model.wanted[telling] = True
    place = np.zeros(1 << BITS, np.int32)
    place[telling] = np.arange(len(telling))
    wanted = model.wanted

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            text, feature = text_features(chunk.column("text"), wanted)
            ends = np.searchsorted(text, np.arange(chunk.num_rows + 1))
            column = place[feature].astype("<u2")
            yield pa.RecordBatch.from_arrays([chunk.column("y"), pa.array([column[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["y", "x"])

    n = int(rows.sum())
    some = train if n <= WEIGHT_ROWS else train.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) < int(WEIGHT_ROWS / n * (1 << 30)))
    held = stored(some.mapInArrow(sparse, "y int, x binary"), "sparse").toArrow()
    y = held.column("y").to_numpy().astype(np.float64)
    x = [np.frombuffer(v, "<u2") for v in held.column("x").to_pylist()]
    text = np.repeat(np.arange(len(x)), [len(v) for v in x])
    column = np.concatenate([*x, np.zeros(0, "<u2")]).astype(np.int64)
    w, model.bias = _logistic(text, column, ratio[telling][column], y, len(telling))
    model.weight[telling] = w * ratio[telling]
    return model


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(model.score(chunk.column("text")))], names=["doc_id", "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted; learns from ``labels`` (doc_id, toxic) outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    model = fit(docs.select("doc_id", "text"), labels, remainder("doc_id", fold) != held)
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
