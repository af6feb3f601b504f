"""Similarity join on word shingles by a token-group matrix.

1. Every text becomes its set of shingles; equal sets are one class, named by its smallest doc_id.
2. Prune: a set can have a partner only if enough of its tokens occur elsewhere.  Over the tokens of
   smallest hash this is counted exactly, token by token, in packed arrays dealt by token.
3. Groups: sets left are partitioned into groups of similar ones, by their minimum hash (later by
   that of the tokens that may still link); a group of many is cut into bounded ones.  Each group is one row with its members and, once, the union of
   their tokens: its row of the token-group matrix.  Members are compared with each other there.
4. Prune again: only tokens held by sets that are not yet connected count now.
5. Matrix: a set's rarest tokens, looked up in the groups that hold them, tell which groups may have
   a partner.  The set's overlap with such a group's union bounds its similarity to all members;
   first only unions are looked at, and a group's members are opened, as a product of 0/1 matrices,
   for the sets that qualify.  Of two components the smaller one's sets ask.  For each of its tokens a
   set first asks the group with the largest component, which connects large families; what is then
   still apart (4 once more) asks every group.

Steps 2 and 4 drop only what provably has no (further) partner, and the last pass of 5 asks every
group that may hold one, so all links between different components are found and components are
exact.  Links inside a component need not be enumerated, and opened groups return links that connect
what is similar, never all pairs.

Why 2 is safe: if A and B hold ``overlap >= t * union`` then ``|A - B| <= |A| - ceil(t |A|)``.  Take
each set's first ``|X| - ceil(t |X|) + l(X)`` tokens in hash order.  The one of A, B whose run ends
at the smaller hash has at least ``l`` of its tokens in the other, within the other's run as well; so
both have at least ``min(l(A), l(B))`` tokens there that occur elsewhere, and ``|B| >= t |A|``.

Why 5 is safe: order all tokens alike, rare ones first.  A and B share ``ceil(t |A|)`` tokens at
least, so the first that they share is among A's first ``|A| - ceil(t |A|) + 1``, and B's likewise.

Defined results: a null or empty text has no shingles and links with nothing; fewer words than
``width`` make one shingle; rows with a null doc_id link with nothing and have a null component; rows
that repeat a doc_id are one node; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, binary_parts, bounded_batches, encode_slices, flat_text, mixed, ranges, release_memory, spread_join, stored, text_chunks, tidied, word_slices
from .components import connected_components
from .embeddings import joined

#: Entries that one bucket of the prune is meant to hold; entries that a task deals at a time.
BUCKET_ENTRIES, DEAL_ENTRIES = 1_000_000, 200_000
#: Tokens that a group is meant to hold; sets that ask a group at a time; salts of a lookup.
GROUP_TOKENS, ASKING, SALTS = 100_000, 64, 8
#: Tokens whose sets a file of the matrix' tables is meant to hold, and the fewest files.
FILE_TOKENS, LEAST_FILES = 500_000, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = 65535


def _word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and each text's offset in them."""
    data, offsets = flat_text(column)
    data, words, first = word_slices(data, offsets, lower=True)
    codes, distinct = encode_slices(data, words)
    n = np.diff(first)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h = _word_hashes(distinct)[codes]
    total = np.zeros(len(h), np.uint64)
    factor = np.uint64(1)
    for j in range(width):
        if j < len(h):
            total[: len(h) - j] += h[j:] * factor
        factor = np.uint64((int(factor) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    total = mixed(total)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(total[a : b - width + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:  # as one: length, then words in order
            x = b - a
            for w in h[a:b].tolist():
                x = ((x ^ w) * int(_STEP) + 1) & 0xFFFFFFFFFFFFFFFF
            sets.append(mixed(np.array([x], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    out = []
    for seed in (0x1234567, 0x89ABCDEF01):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def set_keys(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles and the two names of its set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            tokens, offsets = shingle_sets(chunk.column("text"), width)
            a, b = _keys(tokens, offsets)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(a), pa.array(b)], names=["doc_id", "n_shingles", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n_shingles long, k1 long, k2 long")


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row with a token: doc, n, family (its minimum hash), tokens (sorted by unsigned value)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            tokens, offsets = shingle_sets(chunk.column("text"), width)
            some = np.flatnonzero(np.diff(offsets))
            family = np.minimum.reduceat(mixed(tokens ^ _STEP), offsets[some]) if len(some) else np.zeros(0, np.uint64)
            starts = np.append(offsets[some], offsets[-1]).astype(np.int32)  # empty sets hold nothing between
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").cast(pa.int64()).take(pa.array(some)), pa.array(np.diff(starts).astype(np.int64)), pa.array(family.view(np.int64)), pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens.view(np.int64)))],
                names=["doc", "n", "family", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(read, "doc long, n long, family long, tokens array<long>")


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap that a set of ``n`` tokens has with a partner."""
    return -(-n * percent // 100)


def _run_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of smallest hash the first prune looks at."""
    return np.minimum(n, n - _needed(n, percent) + np.maximum(1, n // 5))


def _least_repeats(n: F.Column, percent: int) -> F.Column:
    """How many of those must occur elsewhere: l of the smallest partner."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / 5))


_PACKED = "bucket int, docs binary, groups binary, owner binary, print binary, local boolean"
_Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _gathered(chunks: Iterator[_Chunk]) -> Iterator[_Chunk]:
    """Chunks (docs, groups, offsets, tokens) put together to DEAL_ENTRIES tokens or so, and to fewer than _MARK sets."""
    held: list[_Chunk] = []
    for chunk in chunks:
        if held and (sum(len(c[0]) for c in held) + len(chunk[0]) >= _MARK or sum(len(c[3]) for c in held) >= DEAL_ENTRIES):
            yield _together(held)
            held = []
        held.append(chunk)
    if held:
        yield _together(held)


def _together(held: list[_Chunk]) -> _Chunk:
    docs, groups, tokens = (np.concatenate([c[i] for c in held]) for i in (0, 1, 3))
    sizes = np.concatenate([np.diff(c[2]) for c in held])
    return docs, groups, np.concatenate([[0], np.cumsum(sizes)]), tokens


def _packed(chunks: Iterator[_Chunk], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries (token's print, set) by bucket, for the buckets that have any.  A token of several groups within the chunk is settled here: its sets are counted and one mark goes out for it, so a token has at most one such entry a chunk."""
    for docs, groups, offsets, tokens in _gathered(chunks):
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), np.diff(offsets))
        order = np.argsort(tokens)
        t, o = tokens[order], owner[order]
        if not len(t):
            continue
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(starts, len(t)))
        g = groups[o]
        several = np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)
        settled = np.repeat(several, size)
        local = np.bincount(o[settled], minlength=len(docs))
        t = np.concatenate([t[~settled], t[starts[several]]])
        o = np.concatenate([o[~settled], np.full(int(several.sum()), _MARK)])
        bucket = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        t, o, bucket = t[order], o[order], bucket[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(t))
        names = bucket[edges[:-1]]
        real = o != _MARK
        used, short = np.unique(bucket[real] << 16 | o[real], return_inverse=True)  # each bucket's sets, in order
        sets = used & _MARK
        ends = np.append(np.searchsorted(used >> 16, names), len(used))
        who = np.full(len(o), _MARK, np.uint16)
        who[real] = short - ends[np.searchsorted(names, bucket[real])]
        same = bool((docs == groups).all())  # then groups needn't be told
        yield pa.RecordBatch.from_arrays(
            [pa.array(names.astype(np.int32)), binary_parts(docs[sets], ends), binary_parts(groups[sets], ends * (not same)), binary_parts(who, edges), binary_parts(t.astype(np.uint32), edges), pa.array(np.zeros(len(names), bool))],
            names=["bucket", "docs", "groups", "owner", "print", "local"],
        )
        used = np.flatnonzero(local)
        if len(used):
            row = (int(docs[used[0]] % buckets), docs[used].tobytes(), local[used].astype(np.int64).tobytes(), b"", b"", True)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["bucket", "docs", "groups", "owner", "print", "local"])


def _counted(table: pa.Table) -> pa.Table:
    """For one bucket: per set, how many of its tokens there occur in another group.  Prints that agree by chance only raise a count."""
    docs, counts, groups, owners, prints, base = [], [], [], [], [], 0
    for row in table.to_pylist():
        d = np.frombuffer(row["docs"], np.int64)
        g = np.frombuffer(row["groups"], np.int64) if row["groups"] else d
        if row["local"]:
            docs.append(d)
            counts.append(g)
            continue
        o = np.frombuffer(row["owner"], np.uint16).astype(np.int64)
        owners.append(np.where(o == _MARK, -1, o + base))
        prints.append(np.frombuffer(row["print"], np.uint32))
        groups.append((d, g))
        base += len(d)
    if owners:
        o, p = np.concatenate(owners), np.concatenate(prints)
        d, g = (np.concatenate([x[i] for x in groups]) for i in (0, 1))
        order = np.argsort(p)
        o, p = o[order], p[order]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        marked = np.add.reduceat((o < 0).astype(np.int64), starts) > 0
        own = np.append(g, 0)[o]
        real = o >= 0
        low = np.minimum.reduceat(np.where(real, own, np.iinfo(np.int64).max), starts)
        high = np.maximum.reduceat(np.where(real, own, np.iinfo(np.int64).min), starts)
        hit = np.repeat(marked | (low < high), np.diff(np.append(starts, len(p)))) & real
        n = np.bincount(o[hit], minlength=len(d))
        docs.append(d[n > 0])
        counts.append(n[n > 0])
    release_memory()
    return pa.table({"doc": pa.array(np.concatenate(docs), pa.int64()), "hits": pa.array(np.concatenate(counts), pa.int64())})


def _repeats(packed: DataFrame) -> DataFrame:
    return packed.groupBy("bucket").applyInArrow(_counted, "doc long, hits long").groupBy("doc").agg(F.sum("hits").alias("hits"))


def _text_chunks_packed(width: int, percent: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for chunk in text_chunks(batches):
                for at in range(0, chunk.num_rows, 30_000):
                    part = chunk.slice(at, 30_000)
                    docs = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                    tokens, offsets = shingle_sets(part.column("text"), width)
                    run = _run_length(np.diff(offsets), percent)
                    yield docs, docs, np.concatenate([[0], np.cumsum(run)]), tokens[ranges(offsets[:-1], run)]

        yield from _packed(chunks(), buckets)

    return read


def _set_chunks_packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for batch in batches:
                lists = batch.column("tokens")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                yield batch.column("doc").to_numpy(), batch.column("comp").to_numpy(), offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)

        yield from _packed(chunks(), buckets)

    return read


def _small(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast where its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by keys."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, z - a)
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def _members(table: pa.Table) -> bytes:
    """Sets (doc, comp, n, tokens) as one value."""
    head = [table.column(c).to_numpy() for c in ("doc", "comp", "n")]
    return np.concatenate(head).astype(np.int64).tobytes() + table.column("tokens").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()


class _Group:
    """Sets that are compared as one; ``union`` is a group's row of the token-group matrix."""

    def __init__(self, raw: bytes, sets: int, union: np.ndarray | None = None):
        head = np.frombuffer(raw, np.int64, 3 * sets)
        self.docs, self.groups, self.n = head[:sets], head[sets : 2 * sets], head[2 * sets :]
        self.tokens = np.frombuffer(raw, np.uint64, offset=24 * sets)
        self.owner = np.repeat(np.arange(sets), self.n)
        self.union = np.unique(self.tokens) if union is None else union

    def only(self, which: np.ndarray) -> bytes:
        """Some of the sets, packed again."""
        own = np.zeros(len(self.n), bool)
        own[which] = True
        return np.concatenate([self.docs[own], self.groups[own], self.n[own]]).tobytes() + self.tokens[own[self.owner]].tobytes()

    def overlap(self, union: np.ndarray) -> np.ndarray:
        """Each set's overlap with a union: no member of that group can share more."""
        at = np.minimum(np.searchsorted(union, self.tokens), max(len(union) - 1, 0))
        return np.bincount(self.owner[union[at] == self.tokens] if len(union) else [], minlength=len(self.n))


def open_groups(one: _Group, two: _Group, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Similar pairs of sets in different groups: members of ``one`` and of ``two``."""
    rows, cols = (np.flatnonzero(a.overlap(b.union) * 100 >= a.n * percent) for a, b in ((one, two), (two, one)))
    if not len(rows) or not len(cols):
        return
    if one is two:  # tokens that several members hold
        both, held = np.unique(one.tokens, return_counts=True)
        both = both[held > 1]
    else:
        both = np.intersect1d(one.union, two.union, assume_unique=True)
    if not len(both):
        return
    shared = np.zeros((len(rows), len(cols)), np.float32)
    places = []
    for g, chosen in ((one, rows), (two, cols)):
        at = np.minimum(np.searchsorted(both, g.tokens), len(both) - 1)
        place = np.full(len(g.n), -1)
        place[chosen] = np.arange(len(chosen))
        use = (both[at] == g.tokens) & (place[g.owner] >= 0)
        places.append((place[g.owner[use]], at[use]))
    for t in range(0, len(both), 8192):
        parts = []
        for (row, at), chosen in zip(places, (rows, cols), strict=True):
            use = (at >= t) & (at < t + 8192)
            m = np.zeros((len(chosen), min(8192, len(both) - t)), np.float32)
            m[row[use], at[use] - t] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    total = one.n[rows][:, None] + two.n[cols][None, :] - shared
    i, j = np.nonzero((shared * 100 >= total * percent) & (one.groups[rows][:, None] != two.groups[cols][None, :]))
    if len(i):
        yield rows[i], cols[j]


def _connected(docs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return docs[moved], docs[labels[moved]]


def _built(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["grp"]):
            raw = _members(table)
            group = _Group(raw, table.num_rows)
            labels = np.arange(table.num_rows)
            if table.num_rows > 1:
                for a, b in open_groups(group, group, percent):
                    labels = joined(labels, a, b)
            la, lb = _connected(group.docs, labels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([table.column("grp")[0].as_py()], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([raw], pa.binary()), pa.array([group.union.tobytes()], pa.binary()), pa.array([la], pa.list_(pa.int64())), pa.array([lb], pa.list_(pa.int64()))],
                names=["grp", "sets", "x", "u", "la", "lb"],
            )
        release_memory()

    return build


def token_groups(sets: DataFrame, percent: int) -> DataFrame:
    """The groups of ``sets`` (doc, comp, grp, n, tokens): grp, sets, x (members), u (union), and links la, lb between members of different components."""
    dealt = sets.select("grp", "doc", "comp", "n", "tokens").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(_built(percent), "grp long, sets long, x binary, u binary, la array<long>, lb array<long>")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, ["grp", "blk"]):
        yield pa.RecordBatch.from_arrays([pa.array([table.column("grp")[0].as_py()], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([_members(table)], pa.binary())], names=["grp", "asking", "q"])


def _bounded(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the sets that ask a group those that its union lets qualify."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = _Group(batch.column("q")[k].as_buffer(), batch.column("asking")[k].as_py(), np.zeros(0, np.uint64))
                fits = np.flatnonzero(own.overlap(np.frombuffer(batch.column("u")[k].as_buffer(), np.uint64)) * 100 >= own.n * percent)
                if len(fits):
                    yield pa.RecordBatch.from_arrays([batch.column("grp").slice(k, 1), pa.array([len(fits)], pa.int64()), pa.array([own.only(fits)], pa.binary())], names=["grp", "asking", "q"])

    return bound


def _opened(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = _Group(batch.column("q")[k].as_buffer(), batch.column("asking")[k].as_py())
                two = _Group(batch.column("x")[k].as_buffer(), batch.column("sets")[k].as_py(), np.frombuffer(batch.column("u")[k].as_buffer(), np.uint64))
                labels = np.arange(len(one.n) + len(two.n))
                for a, b in open_groups(one, two, percent):
                    labels = joined(labels, a, b + len(one.n))
                la, lb = _connected(np.concatenate([one.docs, two.docs]), labels)
                if len(la):
                    yield pa.RecordBatch.from_arrays([pa.array(la), pa.array(lb)], names=["a", "b"])
        release_memory()

    return open_


def _parted(sets: DataFrame) -> DataFrame:
    """``sets`` (family, doc, n and more) with the group ``grp`` instead of the family, which is cut where it is large."""
    large = stored(sets.groupBy("family").agg(F.sum("n").alias("s")).where(F.col("s") > GROUP_TOKENS).select("family", F.ceil(F.col("s") / GROUP_TOKENS).alias("blocks")), "large", LEAST_FILES)
    part = F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1)))
    return sets.join(_small(large, large.count()), "family", "left").withColumn("grp", F.xxhash64("family", part)).drop("family", "blocks")


def matrix_links(sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (a, b) that the token-group matrix finds between ``sets`` (doc, comp, n, tokens) of different components.

    Groups are made anew, by the minimum hash of the tokens that several components hold, so that sets
    with a common passage meet in few groups.  Of two components the smaller one's sets ask the larger
    one's groups: ``every`` group that may hold a partner, or of each token only the group with the
    largest component.
    """
    total, n_sets = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    files = max(LEAST_FILES, total // FILE_TOKENS)
    sizes = stored(sets.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("w")), "sizes", files)
    sized = spread_join(sets.select("doc", "comp", "n", "tokens"), sizes, ["comp"], sizes.count(), n_sets, "w")
    own = ["doc", "comp", "size", "n"]
    flat = sized.select(*own, F.explode("tokens").alias("t"))
    shared = stored(flat.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("t", "df", F.col("df").alias("w")), "shared", files)
    found = spread_join(flat, shared, ["t"], shared.count(), total, "w").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    found = stored(found.withColumn("family", F.array_min(F.transform("s", lambda x: F.xxhash64(x["t"], F.lit(3))))), "found", files)
    n_found, found = found.count(), _parted(found)
    sets = sets.select("doc", "comp", "n", "tokens").join(_small(found.select("doc", "grp"), n_found), "doc")
    groups = stored(token_groups(sets, percent), "groups", files)
    # Tokens that no other component holds come first, and find nothing.
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("s"))
    rare = stored(found.where(spare > 0).select("doc", "grp", "comp", "size", F.explode(F.slice("s", F.lit(1), spare.cast("int"))).alias("x")).select("doc", "grp", "comp", "size", F.col("x.t").alias("t")), "rare", files)
    if every:
        index = rare.groupBy("t", F.col("grp").alias("other")).agg(F.max(F.struct("size", "comp")).alias("top")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = rare.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(index, ["t", "salt"])
    else:
        tops = stored(rare.groupBy("t").agg(F.max(F.struct("size", "comp", "grp")).alias("top"), F.count(F.lit(1)).alias("w")).where("w > 1"), "tops", files)
        pairs = spread_join(rare, tops, ["t"], tops.count(), rare.count(), "w").withColumn("other", F.col("top.grp"))
    smaller = (F.col("size") < F.col("top.size")) | ((F.col("size") == F.col("top.size")) & (F.col("comp") < F.col("top.comp")))
    pairs = pairs.where(smaller)
    pairs = stored(pairs.where("other <> grp").select("doc", "other").distinct(), "pairs", files)
    many = stored(pairs.groupBy("other").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > ASKING).select("other", F.ceil(F.col("w") / ASKING).alias("blocks")), "many", LEAST_FILES)
    dealt = pairs.join(_small(many, many.count()), "other", "left").select("doc", F.col("other").alias("grp"), F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))).alias("blk"))
    asking = _small(dealt, pairs.count()).join(sets.select("doc", "comp", "n", "tokens"), "doc").repartition("grp", "blk").sortWithinPartitions("grp", "blk").select("grp", "blk", "doc", "comp", "n", "tokens")
    asking = asking.mapInArrow(_asked, "grp long, asking long, q binary")
    fits = asking.join(groups.select("grp", "u"), "grp").mapInArrow(_bounded(percent), "grp long, asking long, q binary")
    opened = fits.join(groups.select("grp", "sets", "x", "u"), "grp").mapInArrow(_opened(percent), "a long, b long")
    inside = groups.select(F.explode(F.arrays_zip("la", "lb")).alias("z")).select(F.col("z.la").alias("a"), F.col("z.lb").alias("b"))
    return opened.union(inside)


def _apart(sets: DataFrame, links: DataFrame | None, percent: int) -> DataFrame:
    """The ``sets`` that may have a partner in another component of ``links``, with their component."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    files = max(LEAST_FILES, total // FILE_TOKENS)
    if links is not None:
        groups = connected_components(links)
        n_nodes = groups.count()
        sets = sets.drop("comp").join(_small(groups.withColumnRenamed("node", "doc"), n_nodes), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
        if n_nodes > BROADCAST_ROWS:
            sets = stored(sets, "grouped", files)
    buckets = max(32, int(total) // BUCKET_ENTRIES + 1)
    foreign = _repeats(sets.select("doc", "comp", "tokens").mapInArrow(_set_chunks_packed(buckets), _PACKED))
    # Which sets stay is told without their tokens.
    kept = stored(sets.select("doc", "n").join(foreign, "doc").where(F.col("hits") * 100 >= F.col("n") * percent).select("doc", "n").distinct(), "kept", files)
    return stored(sets.join(_small(kept, kept.count()), ["doc", "n"], "left_semi"), "apart", files)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect ``sets`` (doc, n, family, tokens) wherever they are similar."""
    sets = _parted(sets).withColumn("comp", F.col("doc"))
    inside = token_groups(sets, percent).select(F.explode(F.arrays_zip("la", "lb")).alias("z")).select(F.col("z.la").alias("a"), F.col("z.lb").alias("b"))
    links = stored(inside, "inside")
    for every in (False, True):
        sets = _apart(sets, links, percent)
        if sets.isEmpty():
            break
        links = links.union(stored(matrix_links(sets, percent, every), "links"))
    return links


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable over pairs with Jaccard similarity of at least ``percent``)."""
    bounded_batches(docs.sparkSession)
    return tidied(docs.sparkSession, "similar", lambda: _similar(docs, width, percent))


def _similar(docs: DataFrame, width: int, percent: int) -> DataFrame:
    keyed = stored(set_keys(docs, width), "keys")
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(32, int(total * 0.4) // BUCKET_ENTRIES + 1)
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = stored(keyed.where(linked).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    hits = _repeats(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_text_chunks_packed(width, percent, buckets), _PACKED))
    left = stored(classes.join(hits, "doc").where(F.col("hits") >= _least_repeats(F.col("n"), percent)).select(F.col("doc").alias("doc_id")).distinct(), "left")
    # Rows that repeat a doc_id with other texts are other sets of one node.
    sets = stored(token_sets(docs.join(_small(left, left.count()), "doc_id", "left_semi"), width), "sets")
    component = connected_components(_links(sets, percent))
    named = classes.join(component, F.col("doc") == F.col("node"), "left").where("copies > 1 or node is not null")
    named = stored(named.select("k1", "k2", F.coalesce("component", "doc").alias("c"), F.col("copies").alias("w")), "named")
    alone = keyed.where(~linked).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("c"))
    rest = spread_join(keyed.where(linked), named, ["k1", "k2"], named.count(), rows, "w", "left").select("doc_id", "n_shingles", "c")
    return rest.unionByName(alone).select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those of similar documents with a smaller doc_id.  Rows with a null doc_id stay."""
    gone = tidied(docs.sparkSession, "gone", lambda: similar_documents(docs, width, percent).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(_small(gone, gone.count()), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
