"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors are one class.  Classes are dealt by hash into blocks of bounded size, and each block is
quantised once: a unit vector is ``u = s q + e`` (q: integers of at most 127, one byte each; s: the
vector's step; e: what is left, its norm computed per vector).  Every pair of blocks is one tile, and a
tile is one row of bytes, so tiles spread evenly whatever the data.  As

    |u.v - s_u s_v q_u.q_v| <= |e_u| |s_v q_v| + |s_u q_u| |e_v| + |e_u| |e_v|,

a pair whose integer product plus this bound stays below the threshold can't link, and one whose
product less the bound reaches it does.  A tile returns, per vector with such links, their number and
a representative that it is connected to, never these pairs.  Only pairs in between are named, and
computed again in double precision from the vectors themselves.  The integer products run as float32
matrix products, which are exact below 2**24.  No pair is left out, so the result is exact; work is
quadratic in the number of distinct vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do rows with a null vec_id and vectors of different lengths; copies link with each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored, tidied
from .components import connected_components

#: Vectors that a block is meant to hold, and columns of a tile that are worked on at a time.
BLOCK, STRIP = 8192, 512
_SLACK = 1e-6


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _up(x: np.ndarray) -> np.ndarray:
    """As float32, not below."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors ``x`` (rows): int8 codes, steps, and upper bounds of the error's and the coded vector's norms."""
    unit = unit_vectors(x)
    step = _up(np.abs(unit).max(1) / 127)
    q = np.rint(unit / step[:, None].astype(np.float64))
    own = q * step[:, None].astype(np.float64)
    return q.astype(np.int8), step, _up(np.sqrt(((unit - own) ** 2).sum(1)) + _SLACK), _up(np.sqrt((own * own).sum(1)) + _SLACK)


class Quantised:
    """A block as it is stored: ids, copies, steps, bounds and codes."""

    def __init__(self, raw: bytes, n: int, dim: int):
        head = np.frombuffer(raw, np.int64, 2 * n)
        self.ids, self.copies = head[:n], head[n:]
        self.step, self.error, self.norm = np.frombuffer(raw, np.float32, 3 * n, offset=16 * n).astype(np.float64).reshape(3, n)
        self.q = np.frombuffer(raw, np.int8, offset=28 * n).reshape(n, dim).astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the nodes ``a`` and ``b`` (pairwise) were connected; a label is the smallest node of its component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, np.concatenate([x, y]), np.concatenate([low, low]))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def judged_pairs(one: Quantised, two: Quantised, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row and column numbers of a tile's pairs that may have a cosine at or above the threshold, strip by strip, and whether they have it for certain."""
    for c0 in range(0, len(two.ids), STRIP):
        c = slice(c0, c0 + STRIP)
        product = one.q @ two.q[c].T
        bound = one.error * two.norm[c].max() + one.norm * two.error[c].max() + one.error * two.error[c].max()
        least = threshold - bound - _SLACK
        least /= one.step * np.where(least >= 0, two.step[c].max(), two.step[c].min())
        hits = np.flatnonzero(product >= least.astype(product.dtype)[:, None] - 1)
        if not len(hits):
            continue
        i, j = np.divmod(hits, product.shape[1])
        if same:
            i, j = i[i < j + c0], j[i < j + c0]
        k = j + c0
        bound = one.error[i] * two.norm[k] + one.norm[i] * two.error[k] + one.error[i] * two.error[k] + _SLACK
        cosine = product[i, j] * (one.step[i] * two.step[k])
        maybe = cosine + bound >= threshold
        if maybe.any():
            yield i[maybe], k[maybe], (cosine - bound >= threshold)[maybe]


def _tile(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with links: a, its representative b, number of links.  Rows without: pairs (a, b) to be computed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("i", "j", "dim", "n", "m", "x", "y")}
                n, m, dim, same = (row["n"].as_py(), row["m"].as_py(), row["dim"].as_py(), row["i"].as_py() == row["j"].as_py())
                one = Quantised(row["x"].as_buffer(), n, dim)
                two = one if same else Quantised(row["y"].as_buffer(), m, dim)
                links = [np.zeros(n, np.int64), np.zeros(m, np.int64)]
                labels = np.arange(n if same else n + m)
                shift = 0 if same else n
                for a, b, sure in judged_pairs(one, two, same, threshold):
                    if not sure.all():
                        open_ = ~sure
                        yield pa.RecordBatch.from_arrays([pa.array(one.ids[a[open_]]), pa.array(two.ids[b[open_]]), pa.nulls(int(open_.sum()), pa.int64())], names=["a", "b", "links"])
                        a, b = a[sure], b[sure]
                    links[0] += np.bincount(a, two.copies[b], n).astype(np.int64)
                    links[1] += np.bincount(b, one.copies[a], m).astype(np.int64)
                    labels = joined(labels, a, b + shift)
                ids = one.ids if same else np.concatenate([one.ids, two.ids])
                count = links[0] + links[1] if same else np.concatenate(links)
                used = np.flatnonzero(count)
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(ids[labels[used]]), pa.array(count[used])], names=["a", "b", "links"])

    return work


def _computed(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs with a cosine at or above the threshold, in double precision; both ways, with the other's copies as links."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x, y = (unit_vectors(own.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)) for c in ("x", "y"))
                near = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= threshold)
                a, b, n, m = (own.column(c).to_numpy()[near] for c in ("a", "b", "n", "m"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((a, b), (b, a), (m, n))], names=["a", "b", "links"])

    return compute


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    q, step, error, norm = quantised(vectors.reshape(len(ids), -1))
    raw = np.concatenate([ids, copies]).astype(np.int64).tobytes() + np.concatenate([step, error, norm]).tobytes() + q.tobytes()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "x": pa.array([raw], pa.binary())})


def near_vectors(table: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    return tidied(table.sparkSession, "near", lambda: _near(table, threshold, block))


def _near(table: DataFrame, threshold: float, block: int) -> DataFrame:
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.col("embedding")).alias("embedding"))
    keyed = rows.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("k1"), F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding")).alias("k2"))
    names = stored(keyed.select("vec_id", "k1", "k2"), "names")
    classes = stored(keyed.where("embedding is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    sizes = stored(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("w"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "sizes", 4)
    n_sizes, distinct, everything = sizes.count(), classes.count(), names.count()
    dealt = spread_join(classes, sizes, ["dim"], n_sizes, distinct, "w").withColumn("b", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")))
    packed = stored(dealt.select("dim", "b", "rep", "copies", "embedding").groupBy("dim", "b").applyInArrow(_pack, "dim int, b long, n long, x binary").join(sizes.drop("w"), "dim"), "blocks")
    left = packed.select("dim", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("j"), "n", "x")
    right = packed.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("i"), F.col("b").alias("j"), F.col("n").alias("m"), F.col("x").alias("y"))
    found = stored(left.join(right, ["dim", "i", "j"]).mapInArrow(_tile(threshold), "a long, b long, links long"), "links")
    asked = found.where("links is null").select("a", "b")
    vector = lambda end, n, x: classes.select(F.col("rep").alias(end), F.col("copies").alias(n), F.col("embedding").alias(x), *(["dim"] if end == "a" else []))
    computed = stored(asked.join(vector("a", "n", "x"), "a").join(vector("b", "m", "y"), "b").mapInArrow(_computed(threshold), "a long, b long, links long"), "computed")
    found = found.where("links is not null").union(computed)
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    groups = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left").where("copies > 1 or links is not null")
    named = stored(named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.col("copies").alias("w")), "named")
    linked = spread_join(names.where("k1 is not null"), named, ["k1", "k2"], named.count(), everything, "w", "left").select("vec_id", "n_links", "component_id")
    alone = names.where("k1 is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return linked.unionByName(alone).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
