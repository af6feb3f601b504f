"""Sorted runs: flush, metadata, offsets, rollover, compaction and the choice of its inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codec import DELETE, WRITE, buffer_of, encode, record_bytes
from .versions import latest, live

#: Files that a level may hold before it is compacted, by level; the last has no limit.
LEVEL_LIMITS = (4, 100, 1000, 10_000, 100_000, 1_000_000)
LEVELS = 7
MOST_OVERLAP = 32


def flushed(log: DataFrame, epoch: Column) -> DataFrame:
    """The records of each shard's memtable per epoch, tombstones included, as they go to level 0: one run for each (p, epoch)."""
    return latest(log.withColumn("epoch", epoch), keys=("p", "epoch", "key"))


def run_metadata(records: DataFrame, by: tuple[str, ...] = ("p", "run")) -> DataFrame:
    """Per run its key range, its writes, deletes and bytes, and its newest time."""
    return records.groupBy(*by).agg(
        F.min("key").alias("start_key"), F.max("key").alias("end_key"), F.count_if(F.col("rec_type") == WRITE).alias("n_write"),
        F.count_if(F.col("rec_type") == DELETE).alias("n_del"), F.sum(record_bytes(F.col("key"), F.col("value"), F.col("ts"))).alias("bytes"), F.max("ts").alias("max_ts"),
    )


def record_offsets(records: DataFrame, by: tuple[str, ...] = ("p", "run")) -> DataFrame:
    """Where each record begins in its run's file, in key order."""
    before = Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(record_bytes(F.col("key"), F.col("value"), F.col("ts"))).over(before), F.lit(0)))


def _file_numbers(used: int, sizes: np.ndarray, most_bytes: int) -> tuple[np.ndarray, int]:
    """How many files were opened up to each record, for records that follow ``used`` bytes of a file; and the bytes of the last one.  Work is a binary search for each file."""
    ends = np.cumsum(sizes) + used
    opens = np.zeros(len(sizes), np.int64)
    begin, least = 0, 0 if used else 1  # bytes before the open file; the first record that may open another
    while (at := max(int(np.searchsorted(ends, begin + most_bytes)), least)) < len(ends):
        opens[at] = 1
        begin, least = int(ends[at - 1]) if at else used, at + 1
    return np.cumsum(opens), int(ends[-1]) - begin


def _numbered(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], most_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of records (``by``, size), sorted by shard and arrival, with the file of each record and whether it begins that file.  Only the open file's bytes are carried on."""
    last, file, used = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        change[0] = last != tuple(k[0] for k in keys)
        last = tuple(k[-1] for k in keys)
        sizes = batch.column("size").to_numpy()
        edges = np.unique(np.concatenate([[0], np.flatnonzero(change), [n]]))
        out, before = np.empty(n, np.int64), file
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if change[a]:
                file, used = 0, 0
            opened, used = _file_numbers(used, sizes[a:z], most_bytes)
            out[a:z] = file + opened
            file = int(out[z - 1])
        yield batch, out, change | (np.diff(out, prepend=before) != 0)


def rollover(log: DataFrame, most_bytes: int, by: tuple[str, ...] = ("p",)) -> DataFrame:
    """The log file (from 0) that each record goes to: a record that would make its file as large as ``most_bytes`` opens the next.

    The rule runs over a shard's records in order of arrival, so a shard is one task; its sizes stream
    through in batches, and only the open file's bytes are carried on.
    """
    rows = log.select(*by, "seq", record_bytes(F.col("key"), F.col("value"), F.col("ts")).alias("size"))
    names = [*by, "seq", "file"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, file, _ in _numbered(batches, by, most_bytes):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "seq")), pa.array(file.astype(np.int32))], names=names)

    schema = T.StructType([*rows.select(*by, "seq").schema.fields, T.StructField("file", T.IntegerType())])
    return rows.repartition(*by).sortWithinPartitions(*by, "seq").mapInArrow(number, schema)


def log_files(log: DataFrame, most_bytes: int, by: tuple[str, ...] = ("p",)) -> DataFrame:
    """The log files that ``rollover`` cuts, whole: one row (``by``, file, content) each, its records in order of arrival.

    Records are encoded where they are read and shuffled once, to their shard's task; there they lie one after
    the other, so that a file is a slice of the batch, and only the open file is carried on.  Null keys are left
    out; a record that cannot be encoded is an error.
    """
    coded = encode(F.col("rec_type"), F.col("key"), F.col("value"), F.col("ts"))
    lost = F.raise_error(F.concat(F.lit("no log record can hold "), F.coalesce(F.substring(F.col("key").cast("string"), 1, 100), F.lit("")))).cast("binary")
    rows = log.where(F.col("key").isNotNull()).select(*by, "seq", record_bytes(F.col("key"), F.col("value"), F.col("ts")).alias("size"), F.coalesce(coded, lost).alias("record"))
    names = [*by, "file", "content"]
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("file", T.IntegerType()), T.StructField("content", T.BinaryType())])
    types = [f.type for f in to_arrow_schema(schema)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []  # the open file's shard and number, and its bytes so far

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*own, b"".join(held)), types, strict=True)], names=names)

        for batch, file, begins in _numbered(batches, by, most_bytes):
            data, ends = buffer_of(batch.column("record"))
            at = np.flatnonzero(begins)
            places = ends[np.append(at, batch.num_rows)]  # where files begin; the batch's end
            held.append(data[ends[0] : places[0]].tobytes())
            if not len(at):
                continue
            if own is not None:
                yield closed()
            if len(at) > 1:
                done = pa.array(at[:-1])
                content = pa.Array.from_buffers(pa.large_binary(), len(done), [None, pa.py_buffer(places[:-1].copy()), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(done) for c in by), pa.array(file[at[:-1]].astype(np.int32)), content], names=names)
            own, held = (*(batch.column(c)[int(at[-1])].as_py() for c in by), int(file[at[-1]])), [data[places[-2] : places[-1]].tobytes()]
        if own is not None:
            yield closed()

    return rows.repartition(*by).sortWithinPartitions(*by, "seq").mapInArrow(join, schema)


def merged(records: DataFrame, bottom: bool) -> DataFrame:
    """A compaction's output: each key's newest version.  At the bottom, where no older run is left out, tombstones go too."""
    return live(records) if bottom else latest(records)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of runs of one shard (p, run, start_key, end_key) whose closed key ranges meet."""
    a = left.select("p", F.col("run").alias("left_run"), F.col("start_key").alias("s"), F.col("end_key").alias("e"))
    b = right.select("p", F.col("run").alias("right_run"), F.col("start_key").alias("s2"), F.col("end_key").alias("e2"))
    return a.join(b, "p").where("s <= e2 and s2 <= e").select("p", "left_run", "right_run")


def movable(runs: DataFrame) -> DataFrame:
    """Runs above level 0 that meet no run of the next level: they move down by a change of metadata alone."""
    low = runs.select("p", (F.col("level") - 1).alias("level"), F.col("start_key").alias("s2"), F.col("end_key").alias("e2"))
    r, w = runs.alias("r"), low.alias("w")
    meets = (F.col("r.p") == F.col("w.p")) & (F.col("r.level") == F.col("w.level")) & (F.col("r.start_key") <= F.col("w.e2")) & (F.col("w.s2") <= F.col("r.end_key"))
    return r.where("r.level > 0").join(w, meets, "left_anti").withColumn("new_level", F.col("level") + 1)


def delete_ratio(n_del: Column, n_write: Column) -> Column:
    """1 for runs of deletes only, else 0; null for an empty run."""
    return F.when(n_del + n_write > 0, F.floor(n_del / (n_del + n_write)))


def picked(runs: DataFrame, limit: int) -> DataFrame:
    """Runs to compact of each (p, level): those beyond ``limit - 1``, deletes first, then the oldest."""
    own = Window.partitionBy("p", "level")
    ranked = runs.withColumn("ratio", delete_ratio(F.col("n_del"), F.col("n_write"))).withColumn("files", F.count(F.lit(1)).over(own))
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.col("ratio").desc(), "run")))
    return ranked.where((F.col("files") >= limit) & (F.col("rank") <= F.col("files") - limit + 1)).drop("files")


def level_limits(runs: DataFrame) -> DataFrame:
    rows = ", ".join(f"({i}, {n})" for i, n in enumerate(LEVEL_LIMITS))
    return runs.sparkSession.sql(f"select * from values {rows} as limits(level, most)")


def eligible_levels(runs: DataFrame) -> DataFrame:
    """Levels with enough files for a compaction: level 0 at its limit, others above theirs, the last never."""
    counts = runs.groupBy("p", "level").agg(F.count(F.lit(1)).alias("files"))
    full = F.when(F.col("level") == 0, F.col("files") >= F.col("most")).otherwise(F.col("files") > F.col("most"))
    return counts.join(F.broadcast(level_limits(runs)), "level").where(full).select("p", "level", "files")  # one row a level


def meets(run: dict, start: str, end: str) -> bool:
    """Whether a run's closed key range meets another."""
    return run["start_key"] <= end and start <= run["end_key"]


def span(runs: list[dict]) -> tuple[str, str]:
    return min(r["start_key"] for r in runs), max(r["end_key"] for r in runs)


def _deletes_first(runs: list[dict]) -> list[dict]:
    """Runs of deletes only, then the others; both from the oldest."""
    return sorted(runs, key=lambda r: (not (r.get("n_del", 0) > 0 and not r.get("n_write", 0)), r["run"]))


def pick_deeper(runs: list[dict], limit: int) -> list[int]:
    """As ``picked``, of one shard and level, over metadata that the driver holds."""
    return [r["run"] for r in _deletes_first(runs)[: max(0, len(runs) - limit + 1)]]


def pick_level0(runs: list[dict], next_runs: list[dict]) -> tuple[list[int], list[int]]:
    """Inputs of a level-0 compaction of one shard, over its metadata: runs of level 0, and those of level 1 that meet their common range.

    Runs are tried with deletes first, then from the oldest.  The first that meets level 1 starts a
    range; another that meets level 1 joins if neither it nor the range that it makes meets more than
    MOST_OVERLAP runs there.  If none meets level 1, all of level 0 goes.
    """
    below = lambda s, e: sum(meets(n, s, e) for n in next_runs)
    taken: list[dict] = []
    for r in _deletes_first(runs):
        own = below(r["start_key"], r["end_key"])
        if own and (not taken or (own <= MOST_OVERLAP and below(*span([*taken, r])) <= MOST_OVERLAP)):
            taken.append(r)
    taken = taken or runs
    start, end = span(taken)
    return sorted(r["run"] for r in taken), sorted(n["run"] for n in next_runs if meets(n, start, end))


def level0_picks(runs: DataFrame) -> DataFrame:
    """``pick_level0`` for every shard of ``runs`` (p, run, level, start_key, end_key, n_write, n_del): the runs picked, with their level.  A shard's metadata is one group; records are not looked at."""

    def pick(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chosen = pick_level0([r for r in rows if r["level"] == 0], [r for r in rows if r["level"] == 1]) if any(r["level"] == 0 for r in rows) else ([], [])
        n = [len(c) for c in chosen]
        return pa.table({"p": pa.array([key[0].as_py()] * sum(n), pa.int32()), "run": pa.array([*chosen[0], *chosen[1]], pa.int64()), "level": pa.array([0] * n[0] + [1] * n[1], pa.int32())})

    own = runs.where("level < 2").select("p", "run", "level", "start_key", "end_key", "n_write", "n_del")
    return own.groupBy("p").applyInArrow(pick, "p int, run long, level int")


def replayed(manifest: DataFrame) -> DataFrame:
    """The last operation of each (file_type, p, run) in commit order."""
    last = Window.partitionBy("file_type", "p", "run").orderBy(F.col("commit").desc())
    return manifest.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def current_runs(manifest: DataFrame) -> DataFrame:
    """Data files that exist: their last operation created them."""
    return replayed(manifest).where("file_type = 1 and fop = 0")


def level_stats(records: DataFrame) -> DataFrame:
    """Files, writes and deletes of every level of every shard, empty levels too."""
    own = records.groupBy("p", "level").agg(F.countDistinct("run").alias("files"), F.count_if(F.col("rec_type") == WRITE).alias("n_write"), F.count_if(F.col("rec_type") == DELETE).alias("n_del"))
    grid = records.select("p").distinct().crossJoin(records.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level")))  # seven rows
    return grid.join(own, ["p", "level"], "left").na.fill(0, ["files", "n_write", "n_del"])


def level_runs(runs: DataFrame) -> DataFrame:
    """Per shard and level the numbers of its runs, in order."""
    return runs.groupBy("p", "level").agg(F.array_join(F.sort_array(F.collect_set("run")), ",").alias("runs"))


def partition_stats(index: DataFrame, active: DataFrame, inactive: DataFrame, runs: DataFrame, n_partitions: int) -> DataFrame:
    """Per shard, empty ones too: keys (those of the index, the active and the inactive memtables, added up), inactive memtables and runs."""
    count = lambda d, **cols: d.groupBy("p").agg(*(c.alias(n) for n, c in cols.items()))
    one = F.count(F.lit(1))
    out = index.sparkSession.range(n_partitions).select(F.col("id").cast("int").alias("p"))
    for d in (count(index, k=one), count(active, k=one), count(inactive, k=one, inactive_memtables=F.countDistinct("epoch")), count(runs, sst_count=F.countDistinct("run"))):
        out = out.unionByName(d, allowMissingColumns=True)
    return out.groupBy("p").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("k", "keys"), ("inactive_memtables", "inactive_memtables"), ("sst_count", "sst_count"))))


def write_delete_totals(records: DataFrame) -> DataFrame:
    """Writes and deletes by run, by shard and in all."""
    return records.rollup("p", "run").agg(F.count_if(F.col("rec_type") == WRITE).alias("n_write"), F.count_if(F.col("rec_type") == DELETE).alias("n_del"))
