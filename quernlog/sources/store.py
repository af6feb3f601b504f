"""A persistent store: an append-only change log in Parquet runs, published by a manifest.

``data/w=<folder>/run=<n>/p=<shard>/`` holds a shard's part of a run, sorted by key; ``logs/`` holds batches
that wait for a flush, in the same layout but as they came.  Every write has a folder of its own, so what
a writer that died left behind is in nobody's way: it is not listed, and ``vacuum`` removes it.
``manifest/<folder>`` is what one commit created and deleted; it counts from the moment its marker
``manifest/<number>.add.<folder>`` exists, which is one operation of the file system.  Every
CHECKPOINT_COMMITS commits the state is written whole (``.all.``), and readers go on from there.

Readers list the runs of the last commit and so see a fixed snapshot; compaction writes new runs
and never touches those in use.  One writer at a time.

Late data.  Batches may come in any order of ts, also between compactions: a tombstone is kept until the
store's watermark has passed it.  ``advance`` declares that watermark; records at or below it are
refused from then on (or dropped, if the caller says so), so a tombstone that is gone had nothing left to hide.

Reads never need all shards: a point lookup names its shard, and files are sorted by key.  Metadata
that reaches the driver is per run and shard, never per record.
"""

from __future__ import annotations

import dataclasses
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import DELETE, MOST_BYTES, WRITE
from ..functions.routing import literal_partition, partition_of
from ..operators import runs as R
from ..operators import versions as V
from .files import Files

COLUMNS = "key string, value string, ts long, seq long, rec_type int"
MANIFEST = "p int, run long, level int, fop int, file_type int, commit long, start_key string, end_key string, n_write long, n_del long, bytes long, max_ts long, folder string"
_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
#: File types of the manifest; a watermark is its max_ts, a counter keeps the largest run number.
LOG, DATA, WATERMARK, COUNTER = 0, 1, 2, 3
_ROOTS = {LOG: "logs", DATA: "data"}
CHECKPOINT_COMMITS = 64
#: Files that one write may make without a further shuffle by shard.
MOST_FILES = 1024
_MARKER = re.compile(r"(\d{12})\.(add|all)\.(\w+)")


@dataclass(frozen=True)
class Config:
    """Options of a store; unknown or senseless ones are refused."""

    partitions: int = 64
    level0_files: int = R.LEVEL_LIMITS[0]
    records_per_file: int = 1_000_000
    #: Bytes of a run that a compaction writes, a shard's part of it at most.
    run_bytes: int = 1 << 28

    def __post_init__(self) -> None:
        if not 1 <= self.partitions <= 65535 or self.level0_files < 2 or self.records_per_file < 1 or self.run_bytes < 1:
            raise ValueError(f"invalid configuration: {self}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """From a file of lines ``name: value``; blank lines and comments are skipped, a missing file or bad line is an error."""
        known = {f.name for f in dataclasses.fields(cls)}
        values: dict[str, int] = {}
        for line in Files(spark).text(path).splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            name, _, value = (x.strip() for x in line.partition(":"))
            if name not in known or not re.fullmatch(r"-?\d+", value):
                raise ValueError(f"{path}: can't read {line!r}")
            values[name] = int(value)
        return cls(**values)


@dataclass
class _State:
    """What the manifest says now."""

    commit: int = 0
    next_run: int = 1
    watermark: int | None = None
    last_ts: int = 0
    #: Files of logs and data that are part of the store, and (folder, run) of which some shards are gone.
    files: list[dict] = field(default_factory=list)
    partial: set[tuple[str, int]] = field(default_factory=set)

    def of(self, file_type: int) -> list[dict]:
        return [f for f in self.files if f["file_type"] == file_type]


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        """Open the store at ``path``; what is there stays and is found through the manifest, logs that wait for a flush too."""
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.files = Files(spark)
        self.is_open = True
        self.streams: list = []
        self._known: tuple[tuple, _State] | None = None

    def _checked(self) -> None:
        if not self.is_open:
            raise RuntimeError("the store is closed")

    # Manifest.

    def _marks(self) -> list[tuple[int, str, str]]:
        found = map(_MARKER.fullmatch, self.files.names(f"{self.path}/manifest"))
        return sorted((int(m[1]), m[2], m[3]) for m in found if m)

    def _manifest_of(self, marks: list[tuple[int, str, str]]) -> DataFrame:
        since = max((n for n, kind, _ in marks if kind == "all"), default=0)
        folders = [f for n, kind, f in marks if (n > since if kind == "add" else n == since)]
        if not folders:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*(f"{self.path}/manifest/{f}" for f in folders))

    def manifest(self) -> DataFrame:
        return self._manifest_of(self._marks())

    def runs(self) -> DataFrame:
        """Metadata of the runs that are part of the store now."""
        return R.current_runs(self.manifest())

    def _state(self) -> _State:
        marks = self._marks()
        last = marks[-1] if marks else ()
        if self._known is None or self._known[0] != last:
            rows = [r.asDict() for r in R.replayed(self._manifest_of(marks)).collect()]
            state = _State(commit=max((n for n, _, _ in marks), default=0), next_run=1 + max((r["run"] for r in rows), default=0))
            for r in rows:
                if r["file_type"] == WATERMARK:
                    state.watermark = r["max_ts"]
                elif r["file_type"] in _ROOTS and r["fop"] == 0:
                    state.files.append(r)
                elif r["file_type"] in _ROOTS:
                    state.partial.add((r["folder"], r["run"]))
                state.last_ts = max(state.last_ts, r["max_ts"] or 0)
            state.files.sort(key=lambda r: (r["file_type"], r["run"], r["p"]))
            self._known = (last, state)
        return self._known[1]

    def _publish(self, rows: list[dict], number: int, kind: str) -> None:
        folder = uuid.uuid4().hex
        table = self.spark.createDataFrame([tuple(r.get(c) for c in _NAMES) for r in rows], MANIFEST)
        table.coalesce(1).write.parquet(f"{self.path}/manifest/{folder}")
        self.files.touch(f"{self.path}/manifest/{number:012d}.{kind}.{folder}")

    def _commit(self, rows: list[dict]) -> None:
        number = self._state().commit + 1
        self._publish([{**r, "commit": number} for r in rows], number, "add")
        if number % CHECKPOINT_COMMITS == 0:
            self.checkpoint()

    def checkpoint(self) -> None:
        """Write the manifest's state whole: readers need no older commit."""
        state = self._state()
        if not state.commit:
            return
        live = {(f["file_type"], f["folder"]) for f in state.files}
        rows = [r.asDict() for r in R.replayed(self.manifest()).collect()]
        # Deleted parts of runs that live on must be known, others not.
        rows = [r for r in rows if r["file_type"] not in _ROOTS or (r["file_type"], r["folder"]) in live]
        self._publish([*rows, {"p": -1, "run": state.next_run - 1, "level": 0, "fop": 0, "file_type": COUNTER, "commit": state.commit, "max_ts": state.last_ts}], state.commit, "all")

    # Files.

    def _records(self, files: list[dict], file_type: int = DATA) -> DataFrame:
        """Records of files, with p and run from their folders."""
        root = f"{self.path}/{_ROOTS[file_type]}"
        if not files:
            return self.spark.createDataFrame([], f"{COLUMNS}, run long, p int")
        by_run: dict[tuple[str, int], list[int]] = {}
        for f in files:
            by_run.setdefault((f["folder"], f["run"]), []).append(f["p"])
        every: dict[tuple[str, int], int] = {}
        for f in self._state().files:
            every[f["folder"], f["run"]] = every.get((f["folder"], f["run"]), 0) + 1
        paths = []
        for (folder, run), shards in by_run.items():
            whole = (folder, run) not in self._state().partial and every.get((folder, run)) == len(shards)
            paths += [f"{root}/w={folder}/run={run}"] if whole else [f"{root}/w={folder}/run={run}/p={p}" for p in shards]
        return self.spark.read.schema(f"{COLUMNS}, w string, run long, p int").option("basePath", root).parquet(*paths).drop("w")

    def log(self) -> DataFrame:
        """All records of the store, flushed or not."""
        self._checked()
        state = self._state()
        data, logs = state.of(DATA), state.of(LOG)
        return self._records(data) if not logs else self._records(data).unionByName(self._records(logs, LOG))

    def _added(self, folder: str, file_type: int, level: int) -> list[dict]:
        """Manifest rows of what was just written to a folder: none where that is empty."""
        root = f"{self.path}/{_ROOTS[file_type]}"
        written = self.spark.read.schema(f"{COLUMNS}, w string, run long, p int").option("basePath", root).parquet(f"{root}/w={folder}")
        rows = [r.asDict() for r in R.run_metadata(written).collect()]
        if not rows:
            self.files.delete(f"{root}/w={folder}")
        return [{**r, "level": level, "fop": 0, "file_type": file_type, "folder": folder} for r in rows]

    def _write_run(self, records: DataFrame, replaced: list[dict] | None = None) -> None:
        """``records`` (with p; newest of each key) as one level-0 run; the files ``replaced`` go in the same commit."""
        folder, run = uuid.uuid4().hex, self._state().next_run
        own = records.select("key", "value", "ts", "seq", "rec_type", "p")
        if self.config.partitions * int(self.spark.conf.get("spark.sql.shuffle.partitions")) > MOST_FILES:
            own = own.hint("rebalance", "p")  # also splits a shard that is much larger than others over several tasks
        own.sortWithinPartitions("p", "key").write.option("maxRecordsPerFile", self.config.records_per_file).partitionBy("p").parquet(f"{self.path}/data/w={folder}/run={run}")
        rows = self._added(folder, DATA, 0) + [{**r, "fop": 1} for r in replaced or []]
        if rows:
            self._commit(rows)

    # Writes.

    def _sound(self, records: DataFrame, late: str) -> DataFrame:
        """Records with a key, in their shards; too long ones are an error, and so are late ones unless they are to be dropped."""
        if late not in ("refuse", "drop"):
            raise ValueError(f"late records are refused or dropped, not {late!r}")
        too_long = (F.octet_length("key") > MOST_BYTES) | (F.octet_length("value") > MOST_BYTES)
        key = F.when(too_long, F.raise_error(F.lit("a key or value is longer than 65535 bytes")))
        mark = self._state().watermark
        rows = records.select("key", "value", "ts", "seq", "rec_type").where("key is not null")
        if mark is not None and late == "drop":
            rows = rows.where(F.col("ts") > mark)
        elif mark is not None:
            key = key.when(F.col("ts") <= mark, F.raise_error(F.lit(f"a record is not newer than the watermark {mark}")))
        return rows.withColumn("key", key.otherwise(F.col("key"))).withColumn("p", partition_of(F.col("key"), self.config.partitions))

    def apply(self, records: DataFrame, in_order: bool = False, late: str = "refuse") -> None:
        """Append a batch (key, value, ts, seq, rec_type) as one level-0 run; within it each key's newest record counts.

        Batches may come in any order of ts above the watermark.  With ``in_order`` the batch is newer
        than all that is there, so deletes of keys that are not live write nothing.
        """
        self._checked()
        newest = V.latest(self._sound(records, late), keys=("p", "key"), order=("ts", "seq", "value"))
        if in_order:
            gone = newest.where(F.col("rec_type") == DELETE).select("p", "key")
            newest = newest.join(gone.join(self.snapshot(), ["p", "key"], "left_anti"), ["p", "key"], "left_anti")
        self._write_run(newest)

    def append(self, records: DataFrame, late: str = "refuse") -> None:
        """Make a batch durable and readable without a shuffle; ``flush`` turns it into a sorted run."""
        self._checked()
        folder, run = uuid.uuid4().hex, self._state().next_run
        self._sound(records, late).write.partitionBy("p").parquet(f"{self.path}/logs/w={folder}/run={run}")
        if rows := self._added(folder, LOG, 0):
            self._commit(rows)

    def flush(self) -> int:
        """Turn all logs that wait into one level-0 run and retire them, in one commit; how many files they were."""
        self._checked()
        logs = self._state().of(LOG)
        if logs:
            self._write_run(V.latest(self._records(logs, LOG), keys=("p", "key")), logs)
        return len(logs)

    def put(self, rows: DataFrame) -> None:
        """Write ``rows`` (key, value), stamped now; of rows with one key the last by value counts."""
        self._stamped(rows.select("key", "value"), WRITE)

    def delete(self, keys: DataFrame) -> DataFrame:
        """Delete ``keys``; the values that they had, null for keys that were not live."""
        held = f"{self.path}/returned/{uuid.uuid4().hex}"  # read before the deletes are
        self.multi_get(keys).select("key", "value").write.parquet(held)
        self._stamped(keys.select("key", F.lit(None).cast("string").alias("value")), DELETE)
        return self.spark.read.schema("key string, value string").parquet(held)

    def _stamped(self, rows: DataFrame, kind: int) -> None:
        # After what is there, even if the clock was set back.
        state = self._state()
        now = F.greatest(F.unix_micros(F.current_timestamp()), F.lit(max(state.last_ts, state.watermark or 0) + 1))
        self.apply(rows.select("key", "value", now.alias("ts"), F.xxhash64("key").alias("seq"), F.lit(kind).alias("rec_type")), in_order=kind == DELETE)

    def newest(self) -> int:
        """The largest ts of all records, 0 where there is none."""
        return self._state().last_ts

    def advance(self, watermark: int) -> None:
        """Declare that no record with ts up to ``watermark`` will come any more; compaction may drop tombstones up to there."""
        self._checked()
        if watermark > (self._state().watermark or -1):
            self._commit([{"p": -1, "run": 0, "level": 0, "fop": 0, "file_type": WATERMARK, "max_ts": watermark}])

    # Reads.

    def _live(self, files: list[dict]) -> DataFrame:
        """Each key's newest record in ``files`` where that is a write.  A file of data whose keys no other file of its shard meets holds them once, so only the rest is shuffled."""
        alone: list[dict] = []
        shards: dict[int, list[dict]] = {}
        for f in files:
            shards.setdefault(f["p"], []).append(f)
        for own in shards.values():
            own.sort(key=lambda f: f["start_key"])
            reach = ""  # the largest key of the files before
            for i, f in enumerate(own):
                after = own[i + 1]["start_key"] if i + 1 < len(own) else None
                if f["file_type"] == DATA and (i == 0 or reach < f["start_key"]) and (after is None or f["end_key"] < after):
                    alone.append(f)
                reach = max(reach, f["end_key"])
        taken = {(f["file_type"], f["p"], f["run"]) for f in alone}
        rest = [f for f in files if (f["file_type"], f["p"], f["run"]) not in taken]
        out = self._records(alone).where(F.col("rec_type") == WRITE)
        if not rest:
            return out
        data, logs = ([f for f in rest if f["file_type"] == t] for t in (DATA, LOG))
        mixed = self._records(data) if not logs else self._records(data).unionByName(self._records(logs, LOG))
        newest = V.live(mixed, keys=("p", "key"))
        return out.unionByName(newest) if alone else newest

    def snapshot(self) -> DataFrame:
        """The live records."""
        self._checked()
        return self._live(self._state().files)

    def _found(self, key: str) -> list:
        return V.point_get(self.log(), key, self.config.partitions).select("value").take(1)

    def get(self, key: str) -> str | None:
        rows = self._found(key)
        return rows[0][0] if rows else None

    def get_or_raise(self, key: str) -> str | None:
        """As a server answers: a missing key is an error."""
        rows = self._found(key)
        if not rows:
            raise KeyError(key)
        return rows[0][0]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Every asked key (distinct) with its value, null where none is live, and ``found``."""
        asked = keys.select(partition_of(F.col("key"), self.config.partitions).alias("p"), "key").distinct()
        rows = asked.join(self.snapshot().select("p", "key", "value", F.lit(True).alias("found")), ["p", "key"], "left")
        return rows.select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))

    def scan(self, start: str, end: str) -> DataFrame:
        """Live records with start <= key < end, from the files whose range meets it."""
        self._checked()
        files = [f for f in self._state().files if f["start_key"] < end and start <= f["end_key"]]
        return self._live(files).where((F.col("key") >= start) & (F.col("key") < end))

    def partition_of(self, key: str) -> int:
        return literal_partition(key.encode(), self.config.partitions)

    # Upkeep.

    def _chosen(self, level: int, whole: bool) -> list[tuple[list[dict], list[dict]]]:
        """Per shard the files of ``level`` to compact, and those of the next level that they meet; ``whole``: all files, due or not."""
        shards: dict[int, tuple[list[dict], list[dict]]] = {}
        for f in self._state().of(DATA):
            if f["level"] in (level, level + 1):
                shards.setdefault(f["p"], ([], []))[f["level"] - level].append(f)
        out = []
        for own, low in shards.values():
            if whole:
                picked = [f["run"] for f in own]
            elif level == 0:
                picked = R.pick_level0(own, low)[0] if len(own) >= self.config.level0_files else []
            else:
                picked = R.pick_deeper(own, R.LEVEL_LIMITS[level]) if len(own) > R.LEVEL_LIMITS[level] else []
            if picked:
                taken = [f for f in own if f["run"] in set(picked)]
                start, end = R.span(taken)
                out.append((taken, [f for f in low if R.meets(f, start, end)]))
        return out

    def compact(self, level: int = 0, whole: bool = True) -> bool:
        """Merge files of ``level`` and those of the next one whose keys they meet into the next level, shard by shard in one job.

        Above level 0, files that meet nothing below only change their level in the manifest.  Tombstones
        go where the watermark has passed them and no file with their keys is left out.
        """
        self._checked()
        if not 0 <= level < R.LEVELS - 1:
            raise ValueError(f"level {level} has no next level")
        chosen = self._chosen(level, whole)
        moved = [f for own, low in chosen if level and not low for f in own]
        merges = [(own, low) for own, low in chosen if not level or low]
        rows = [{**f, "level": level + 1} for f in moved]
        if merges:
            rows += self._merged(merges, level + 1)
        if rows:
            self._commit(rows)
        return bool(rows)

    def _merged(self, merges: list[tuple[list[dict], list[dict]]], level: int) -> list[dict]:
        state = self._state()
        inputs = [f for own, low in merges for f in (*own, *low)]
        taken = {(f["p"], f["run"]) for f in inputs}
        clear = []  # shards of which no file with these keys is left out
        for own, low in merges:
            start, end = R.span([*own, *low])
            p = own[0]["p"]
            if not any(f["p"] == p and (f["file_type"] == LOG or (p, f["run"]) not in taken) and R.meets(f, start, end) for f in state.files):
                clear.append(p)
        parts = max(-(-sum(f["bytes"] for f in inputs) // self.config.run_bytes), min(len(merges), self.spark.sparkContext.defaultParallelism))
        # By ranges of keys, so that each output run is narrow; a key has one record a run, so none is hot.
        dealt = self._records(inputs).drop("run").repartitionByRange(parts, "p", "key")
        out = V.latest(dealt, keys=("p", "key"))
        if clear and state.watermark is not None:
            out = out.where(~((F.col("rec_type") == DELETE) & F.col("p").isin(clear) & (F.col("ts") <= state.watermark)))
        folder = uuid.uuid4().hex
        numbered = out.withColumn("run", (F.spark_partition_id() + F.lit(state.next_run)).cast("long"))
        numbered.select("key", "value", "ts", "seq", "rec_type", "run", "p").sortWithinPartitions("run", "p", "key").write.option("maxRecordsPerFile", self.config.records_per_file).partitionBy("run", "p").parquet(f"{self.path}/data/w={folder}")
        return [*self._added(folder, DATA, level), *({**f, "fop": 1} for f in inputs)]

    def compact_where_due(self) -> int:
        """Compact levels that hold too many files, from the top, until none does; how many compactions that took."""
        done = 0
        for level in range(R.LEVELS - 1):
            while self.compact(level, whole=False):
                done += 1
        return done

    def vacuum(self) -> list[str]:
        """Remove the folders that the manifest doesn't list (or no longer), and answers of deletes; call it when no reader or writer is at work."""
        self._checked()
        state, gone = self._state(), []
        for file_type, root in _ROOTS.items():
            live = {f["folder"] for f in state.of(file_type)}
            gone += [f"{root}/{n}" for n in self.files.names(f"{self.path}/{root}") if n.startswith("w=") and n[2:] not in live]
            kept = {(f["folder"], f["run"], f["p"]) for f in state.of(file_type)}
            for folder, run in sorted(state.partial):
                if folder in live:
                    path = f"{root}/w={folder}/run={run}"
                    gone += [f"{path}/{n}" for n in self.files.names(f"{self.path}/{path}") if n.startswith("p=") and (folder, run, int(n[2:])) not in kept]
        gone += [f"returned/{n}" for n in self.files.names(f"{self.path}/returned")]
        marks = self._marks()
        since = max((n for n, kind, _ in marks if kind == "all"), default=0)
        old = [m for m in marks if m[0] < since or (m[0] == since and m[1] == "add")]
        known = {f for _, _, f in marks} - {f for _, _, f in old}
        gone += [f"manifest/{n:012d}.{kind}.{f}" for n, kind, f in old]
        gone += [f"manifest/{n}" for n in self.files.names(f"{self.path}/manifest") if re.fullmatch(r"\w+", n) and n not in known]
        for path in gone:
            self.files.delete(f"{self.path}/{path}")
        return gone

    def stats(self) -> DataFrame:
        """Per shard, empty ones too: live keys, runs, logs that wait, and records of each kind in files."""
        schema = "p int, sst_count long, waiting_logs long, n_write long, n_del long"
        rows = {p: [p, 0, 0, 0, 0] for p in range(self.config.partitions)}
        for f in self._state().files:
            row = rows[f["p"]]
            row[1 if f["file_type"] == DATA else 2] += 1
            row[3] += f["n_write"]
            row[4] += f["n_del"]
        keys = self.snapshot().groupBy("p").agg(F.count(F.lit(1)).alias("keys"))
        return self.spark.createDataFrame([tuple(r) for r in rows.values()], schema).join(keys, "p", "left").na.fill(0, ["keys"])

    def levels(self) -> DataFrame:
        """Per shard and level, empty ones too: the run numbers, and their writes and deletes."""
        rows = {(p, level): [p, level, [], 0, 0] for p in range(self.config.partitions) for level in range(R.LEVELS)}
        for f in self._state().of(DATA):
            row = rows[f["p"], f["level"]]
            row[2].append(f["run"])
            row[3] += f["n_write"]
            row[4] += f["n_del"]
        return self.spark.createDataFrame([tuple(r) for r in rows.values()], "p int, level int, runs array<long>, n_write long, n_del long")

    def drain(self) -> None:
        """Stop the streams into this store, flush what waits, remove answers of deletes, and close."""
        for query in self.streams:
            query.stop()
        self.flush()
        self.files.delete(f"{self.path}/returned")
        self.close()

    def close(self) -> None:
        """All batches are durable when they return, so closing only forbids further use."""
        self.is_open = False


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder (spark.checkpoint.dir; where unset, under the warehouse, which is shared on a cluster)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def scratch_store(spark: SparkSession, partitions: int) -> Store:
    return Store(spark, scratch_folder(spark, "stores"), Config(partitions=partitions))
