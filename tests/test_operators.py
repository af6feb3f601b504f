"""Operators on change logs and runs, against plain Python."""

import glob
import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernlog.functions import codec
from quernlog.functions.routing import literal_partition, partition_of
from quernlog.operators import runs as R
from quernlog.operators import versions as V

LOG = "key string, value string, ts long, seq long, rec_type int"


def random_log(spark, n=400, keys=25, seed=1, distinct_ts=True):
    rng = random.Random(seed)
    times = rng.sample(range(1, 10 * n), n) if distinct_ts else [rng.randrange(5) for _ in range(n)]
    rows = [(f"k{rng.randrange(keys):02d}", f"v{i}", t, i, int(rng.random() < 0.3)) for i, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, LOG)


def newest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        out[r[0]] = r
    return out


def test_partition_follows_the_hash(spark):
    keys = ["", "a", "é", "key:1", "x" * 300]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", partition_of(F.col("key"), 7).alias("p")).collect()
    for r in got:
        assert r.p == int.from_bytes(hashlib.sha256(r.key.encode()).digest()[:2], "little") % 7 == literal_partition(r.key.encode(), 7)
    with pytest.raises(ValueError):
        partition_of(F.col("key"), 0)


@pytest.mark.parametrize("distinct_ts", [True, False])
def test_latest_and_live_follow_one_total_order(spark, distinct_ts):
    rows, log = random_log(spark, distinct_ts=distinct_ts)
    want = newest(rows)
    assert {r.key: tuple(r) for r in V.latest(log).collect()} == want
    assert {r.key for r in V.live(log).collect()} == {k for k, r in want.items() if r[4] == 0}


def test_lookups(spark):
    rows, log = random_log(spark)
    live = {k: r[1] for k, r in newest(rows).items() if r[4] == 0}
    keys = spark.createDataFrame([(f"k{i:02d}",) for i in range(40)] + [("k01",)], "key string")
    got = V.multi_get(log, keys).collect()
    assert len(got) == 40 and all(r.value == live.get(r.key) and r.found == (r.key in live) for r in got)
    assert {r.key for r in V.existing(log, keys).collect()} == set(live)
    assert {r.key for r in V.missing(log, keys).collect()} == {f"k{i:02d}" for i in range(40)} - set(live)
    sharded = V.change_log(log, 5)
    for k in ("k00", "k01", "k39"):
        assert [r.value for r in V.point_get(sharded, k, 5).collect()] == ([live[k]] if k in live else [])


def test_deletes_return_what_they_removed(spark):
    rows, log = random_log(spark)
    held, want, idle = {}, {}, set()
    for k, v, ts, seq, kind in sorted(rows, key=lambda r: (r[2], r[3])):
        if kind == 0:
            held[k] = v
        elif k in held:
            want[seq] = held.pop(k)
        else:
            idle.add(seq)
    assert {r.seq: r.prior_value for r in V.effective_deletes(log).collect()} == want
    assert {r.seq for r in V.idle_deletes(log).collect()} == idle


def test_memtable_takes_the_last_arrival_and_index_only_newer_times(spark):
    rows, log = random_log(spark)
    last, seen, kept = {}, {}, set()
    for r in rows:
        last[r[0]] = r
        if r[0] not in seen or r[2] > seen[r[0]]:
            kept.add(r[3])
            seen[r[0]] = r[2]
    assert {r.key: tuple(r) for r in V.memtable(log).collect()} == last
    assert {r.seq for r in V.on_time(log).collect()} == kept


def test_codec_round_trip(spark):
    rows = [(i, k, v, t, kind) for i, (k, v, t, kind) in enumerate([("", "", 0, 0), ("k", None, 1, 1), ("é" * 50, "x" * 4096, 2**49, 0), ("a", "b\n\x00", 2**56 - 1, 0), ("z", "y", 1_700_000_000_000_000, 1), ("q", "w", 127, 0), ("q", "w", 128, 0)])]
    df = spark.createDataFrame(rows, "seq long, key string, value string, ts long, rec_type int")
    coded = df.select(F.col("seq").cast("string").alias("path"), codec.encode(F.col("rec_type"), F.col("key"), F.col("value"), F.col("ts")).alias("content"), codec.record_bytes(F.col("key"), F.col("value"), F.col("ts")).alias("size"))
    assert all(len(r.content) == r.size for r in coded.collect())
    got = {int(r.path): (r.key.decode(), r.value.decode(), r.ts, r.rec_type) for r in codec.decode_files(coded).collect()}
    assert got == {i: (k, v or "", t, kind) for i, k, v, t, kind in rows}
    raw = b"".join(bytes(r.content) for r in coded.orderBy("path").collect())
    assert [r[2].decode() for r in codec.decode_all(raw)] == [r[1] for r in rows]
    assert len(list(codec.decode_all(raw[:-3]))) == len(rows) - 1
    assert spark.range(1).select(codec.encode(F.lit(0), F.lit("k" * 65536), F.lit(""), F.lit(1).cast("long"))).first()[0] is None


def test_rollover_matches_a_fold(spark):
    rows, log = random_log(spark, 200)
    sharded = V.change_log(log, 3)
    got = {r.seq: (r.p, r.file) for r in R.rollover(sharded, 120).collect()}
    used, file = {}, {}
    for r in sorted(sharded.withColumn("size", codec.record_bytes(F.col("key"), F.col("value"), F.col("ts"))).collect(), key=lambda r: r.seq):
        if used.get(r.p, 0) and used[r.p] + r["size"] >= 120:
            file[r.p], used[r.p] = file.get(r.p, 0) + 1, 0
        used[r.p] = used.get(r.p, 0) + r["size"]
        assert got[r.seq] == (r.p, file.get(r.p, 0))


def test_rollover_in_batches_and_of_large_records(spark):
    sizes = [9, 50, 130, 5, 5, 119, 1, 1, 300, 300, 2] * 40

    def fold(sizes, most, used=0):
        out, file = [], 0
        for x in sizes:
            if used and used + x >= most:
                file, used = file + 1, 0
            used += x
            out.append(file)
        return out, used

    for most, used in ((120, 0), (120, 7), (120, 119), (1, 0), (10**6, 3)):
        got, left = R._file_numbers(used, np.array(sizes), most)
        assert (got.tolist(), left) == fold(sizes, most, used)
    log = spark.range(30_000).select(F.lit(0).alias("p"), F.lit("k").alias("key"), F.lit("v" * 91).alias("value"), F.lit(1).cast("long").alias("ts"), F.col("id").alias("seq"))
    assert [r.file for r in R.rollover(log, 400).orderBy("seq").collect()] == [i // 3 for i in range(30_000)]


def test_log_files_hold_what_rollover_cuts(spark, tmp_path):
    rows, log = random_log(spark, 700)
    sharded = V.change_log(log, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for most in (1, 120, 1000, 10**6):
            want = {}
            for r in R.rollover(sharded, most).orderBy("seq").collect():
                want.setdefault((r.p, r.file), []).append(r.seq)
            files = R.log_files(sharded, most)
            got = {(r.p, r.file): [(k.decode(), v.decode(), t, kind) for _, kind, k, v, t in codec.decode_all(bytes(r.content))] for r in files.collect()}
            assert got == {f: [(rows[i][0], rows[i][1], rows[i][2], rows[i][4]) for i in seqs] for f, seqs in want.items()}
            path = f"{tmp_path}/logs{most}"
            codec.write_logs(files, f"file://{path}")
            back = codec.read_logs(spark, f"file://{path}").orderBy("p", "file", "offset").collect()
            assert [(r.p, r.file, r.key.decode(), r.ts) for r in back] == [(*f, rows[i][0], rows[i][2]) for f in sorted(want) for i in want[f]]
            assert len(glob.glob(f"{path}/part-*")) <= 4  # tasks, not log files
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert R.log_files(sharded.limit(0), 100).count() == 0
    odd = spark.createDataFrame([(None, "v", 1, 0, 0), ("k", None, 2, 1, 0)], LOG)
    assert [len(r.content) for r in R.log_files(V.change_log(odd, 3), 100).collect()] == [9]
    with pytest.raises(Exception, match="no log record can hold"):
        R.log_files(V.change_log(odd.withColumn("value", F.lit("v" * 65536)), 3), 100).collect()


def test_log_recovery_does_not_write_a_file_for_each_log(spark, tmp_path, monkeypatch):
    from quernlog.plans import events
    from quernlog.sources import store

    n = 12_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 1000).alias("user_id"),
        F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("props"),
    )
    rows.write.parquet(f"file://{tmp_path}/events.parquet")
    monkeypatch.setattr(store, "scratch_folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    got = {r.key: r.value for r in events.queries()["log_recovery"](spark, f"file://{tmp_path}").collect()}
    assert got == {str(i % 1000): f"p{i}" for i in range(n - 1000, n) if i % 7}
    assert len(glob.glob(f"{tmp_path}/logs/**/part-*", recursive=True)) <= 4  # more than 70 log files


def test_encoding_times_of_every_length(spark):
    times = [t for b in range(63) for t in (2**b - 1, 2**b)]
    df = spark.createDataFrame([(t,) for t in times], "ts long").select("ts", codec.encode(F.lit(1), F.lit("k"), F.lit("v"), F.col("ts")).alias("r"))
    assert [list(codec.decode_all(bytes(r.r))) for r in df.collect()] == [[(0, 1, b"k", b"v", t)] for t in times]


def test_decoding_a_few_bytes_at_a_time(monkeypatch):
    record = lambda k: struct.pack("<HHHB", 1, 2, 8, 0) + k + b"vv" + b"\x05"
    files = [record(b"a") * 3, b"", record(b"b") * 40, record(b"c"), b"\x01", record(b"d") * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(files))), pa.array(files, pa.binary())], names=["file", "content"])
    want = [(f, at, k) for f, raw in enumerate(files) for at, _, k, _, _ in codec.decode_all(raw)]
    for most in (1, 30, 500, 10**6):
        monkeypatch.setattr(codec, "_BATCH_BYTES", most)
        got = [(r["file"], r["offset"], r["key"]) for b in codec._decode(iter([batch])) for r in b.to_pylist()]
        assert got == want


def test_decoding_many_files_and_torn_ones(spark):
    rng = random.Random(2)
    record = lambda k, v, t: bytes([len(k) & 255, len(k) >> 8, len(v) & 255, len(v) >> 8, 8, 0, 0]) + k + v + varint(t)

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    files, want = [], []
    for i in range(70):
        rows = [(rng.randbytes(rng.randrange(5)), rng.randbytes(rng.randrange(300)), rng.randrange(2 ** rng.randrange(1, 50))) for _ in range(i % 6)]
        whole = b"".join(record(*r) for r in rows)
        if rows and i % 4 == 0:
            whole, rows = whole[: -rng.randint(1, 6)], rows[:-1]
        files.append((str(i), whole))
        want += [(str(i), *r) for r in rows]
    for some in (files, files[:9]):
        df = spark.createDataFrame(some, "path string, content binary").coalesce(1)
        got = [(r.path, bytes(r.key), bytes(r.value), r.ts) for r in codec.decode_files(df).orderBy(F.col("path").cast("int"), "offset").collect()]
        assert got == [w for w in want if int(w[0]) < len(some)]


RUNS = "p int, run long, level int, start_key string, end_key string, n_write long, n_del long"


@pytest.mark.parametrize(("a", "b", "meets"), [(("11", "55"), ("10", "66"), True), (("11", "19"), ("12", "8"), True), (("12", "78"), ("1", "10"), False), (("41", "49"), ("91", "99"), False), (("200", "999"), ("222", "666"), True), (("200", "250"), ("270", "300"), False)])
def test_ranges_meet_as_strings(spark, a, b, meets):
    left, right = (spark.createDataFrame([(0, i, i, *x, 1, 0)], RUNS) for i, x in enumerate((a, b)))
    assert bool(R.overlapping(left, right).count()) is meets


def test_level0_picker(spark):
    make = lambda *ranges: [{"run": i, "start_key": s, "end_key": e} for i, (s, e) in enumerate(ranges)]
    low = make(("200", "250"), ("270", "300"), ("998", "999"))
    assert R.pick_level0(low, make(("222", "666"))) == ([0, 1], [0])
    assert R.pick_level0(low, []) == ([0, 1, 2], [])
    assert R.pick_level0(make(("a", "b"), ("y", "z")), make(("m", "n"))) == ([0, 1], [0])  # only their common range meets level 1
    wide = make(*((f"{i:02d}", f"{i:02d}") for i in range(40)))
    assert R.pick_level0(make(("00", "39"), ("00", "01")), wide) == ([0], list(range(40)))  # the first is taken whatever it meets
    assert R.pick_level0(make(("00", "01"), ("00", "39"), ("05", "30"), ("31", "35")), wide) == ([0, 2], list(range(31)))
    dels = make(("00", "01"), ("02", "03"))
    dels[1] |= {"n_del": 4, "n_write": 0}
    dels.append({"run": 2, "start_key": "39", "end_key": "39"})
    assert R.pick_level0(dels, wide)[0] == [0, 1]  # from run 1 on, 39 is out of reach
    assert R.pick_deeper(dels, 3) == [1]
    runs = spark.createDataFrame([(5, r["run"], level, r["start_key"], r["end_key"], r.get("n_write", 1), r.get("n_del", 0)) for level, rs in ((0, dels), (1, wide)) for r in rs] + [(6, 1, 1, "a", "b", 1, 0)], RUNS)
    assert {(r.p, r.run) for r in R.level0_picks(runs).where("level = 0").collect()} == {(5, 0), (5, 1)}


def test_a_locator_of_a_lost_run_is_an_error(spark):
    log = R.record_offsets(V.change_log(random_log(spark)[1], 3).withColumn("run", F.col("seq") % 4))
    index = V.locator_index(log)
    assert V.read_located(index, log).count() == index.count()
    with pytest.raises(Exception, match="no record at 2:"):
        V.read_located(index, log.where("run <> 2")).collect()


def test_level_picker_and_moves(spark):
    runs = spark.createDataFrame([(0, 0, 1, "200", "250", 5, 0), (0, 1, 1, "270", "300", 0, 5), (0, 2, 1, "998", "999", 4, 1), (0, 3, 2, "222", "666", 9, 0)], RUNS)
    assert [r.run for r in R.picked(runs.where("level = 1"), 2).orderBy("rank").collect()] == [1, 0]
    assert R.picked(runs.where("level = 1"), 100).count() == 0
    assert {(r.run, r.new_level) for r in R.movable(runs).collect()} == {(2, 2), (3, 3)}
    low = spark.createDataFrame([(0, i, 0, "a", "b", 1, 0) for i in range(4)] + [(1, i, 0, "a", "b", 1, 0) for i in range(3)], RUNS)
    assert [(r.p, r.files) for r in R.eligible_levels(low).collect()] == [(0, 4)]


def test_compaction_keeps_reads_and_drops_tombstones_only_at_the_bottom(spark):
    writes = [(f"{i}Key_", f"{i}", 1, i, 0) for i in range(20)]
    deletes = [(f"{i}Key_", None, 2, 100 + i, 1) for i in range(10, 25)]
    records = spark.createDataFrame(writes + deletes, LOG)
    assert R.merged(records, bottom=False).count() == 25
    assert {r.key for r in R.merged(records, bottom=True).collect()} == {f"{i}Key_" for i in range(10)}
    assert V.live(R.merged(records, bottom=False)).count() == 10


def test_manifest_replay_takes_the_last_operation(spark):
    rows = [(0, 1, 0, 0, 1, 1), (0, 1, 1, 1, 1, 2), (0, 2, 0, 0, 1, 3), (1, 1, 0, 0, 0, 4), (0, 1, 2, 0, 1, 5)]
    m = spark.createDataFrame(rows, "p int, run long, level int, fop int, file_type int, commit long")
    assert {(r.p, r.run, r.level) for r in R.current_runs(m).collect()} == {(0, 1, 2), (0, 2, 0)}


def test_index_merge_takes_strictly_newer(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 5, 1), ("z", 3, 1)], "key string, ts long, run long")
    b = spark.createDataFrame([("x", 2, 2), ("y", 5, 2), ("w", 1, 2)], "key string, ts long, run long")
    assert {tuple(r) for r in V.merge_index(a, b).collect()} == {("x", 2, 2), ("y", 5, 1), ("z", 3, 1), ("w", 1, 2)}


def test_empty_log(spark):
    log = V.change_log(spark.createDataFrame([], LOG), 4)
    for df in (V.live(log), V.effective_deletes(log), V.memtable(log), V.on_time(log), R.rollover(log, 100), R.run_metadata(log, ("p",))):
        assert df.count() == 0
