"""The store against a dictionary, through flush, compaction, reopening and streams."""

import random

import pytest

from quernlog.operators.versions import live
from quernlog.sources.store import Config, Store
from quernlog.streaming.ingest import into_store, into_table, latest_state, read_changes

LOG = "key string, value string, ts long, seq long, rec_type int"


def contents(store):
    return {r.key: r.value for r in store.snapshot().collect()}


def test_put_get_delete(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=4))
    assert contents(store) == {} and store.get("a") is None
    store.put(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], "key string, value string"))
    assert contents(store) == {"a": "1", "b": "2", "c": ""}
    removed = store.delete(spark.createDataFrame([("a",), ("nope",)], "key string"))
    assert {r.key: r.value for r in removed.collect()} == {"a": "1", "nope": None}
    assert store.get("a") is None and store.get("b") == "2" and store.get("c") == ""
    assert store.log().where("key = 'nope'").count() == 0  # a delete of what is not there writes nothing
    with pytest.raises(KeyError):
        store.get_or_raise("a")
    store.put(spark.createDataFrame([("a", "3")], "key string, value string"))
    assert store.get("a") == "3"
    assert [r.key for r in store.scan("a", "b").collect()] == ["a"]
    store.close()
    with pytest.raises(RuntimeError):
        store.snapshot()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_and_compactions_reads_the_same(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", f"v{i}", i, i, int(rng.random() < 0.35)) for i in range(120)]
    want = {}
    for k, v, _, _, kind in rows:
        want[k] = None if kind else v
    want = {k: v for k, v in want.items() if v is not None}
    batches = [rows[i::4] for i in range(4)]
    rng.shuffle(batches)
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=3))
    for b in batches:
        store.apply(spark.createDataFrame(b, LOG))
    assert contents(store) == want
    assert store.compact_where_due() >= 1
    assert contents(store) == want
    store.compact()
    again = Store(spark, f"file://{tmp_path}/s", Config(partitions=3))  # reopened
    assert contents(again) == want
    assert again.vacuum() and contents(again) == want
    assert sum(r["keys"] for r in again.stats().collect()) == len(want) and again.stats().count() == 3


PAIRS = "key string, value string"


def as_dict(rows):
    out = {}
    for k, v, _, _, kind in sorted(rows, key=lambda r: (r[2], r[3])):
        out[k] = None if kind else v
    return {k: v for k, v in out.items() if v is not None}


def test_every_sequence_leaves_the_store_writable(spark, tmp_path):
    pairs = lambda **kv: spark.createDataFrame(list(kv.items()), PAIRS)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=2))
    assert [r.value for r in store.delete(keys("a")).collect()] == [None]  # absent, in an empty store
    store.put(pairs(a="1", b="2"))
    assert contents(store) == {"a": "1", "b": "2"}
    store.delete(keys("a", "b"))
    store.advance(store.newest())
    assert store.compact() and store.runs().count() == 0  # to nothing
    store.put(pairs(a="3"))
    assert contents(store) == {"a": "3"}
    store.apply(spark.createDataFrame([(None, "x", 2**60, 1, 0)], LOG))  # null keys only
    store.put(pairs(c="4"))
    # Writers that died: a run without a commit, and a commit without a marker.
    run = store._state().next_run
    store.log().select("key", "value", "ts", "seq", "rec_type", "p").write.partitionBy("p").parquet(f"file://{tmp_path}/s/data/w=dead/run={run}")
    store.manifest().write.parquet(f"file://{tmp_path}/s/manifest/dead")
    store.put(pairs(d="5"))
    assert contents(store) == {"a": "3", "c": "4", "d": "5"}
    gone = store.vacuum()
    assert "data/w=dead" in gone and "manifest/dead" in gone and contents(store) == {"a": "3", "c": "4", "d": "5"}


@pytest.mark.parametrize("seed", [3, 4])
def test_compactions_between_batches_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(10)}", f"v{i}", i, i, int(rng.random() < 0.4)) for i in range(100)]
    batches = [rows[i::7] for i in range(7)]
    rng.shuffle(batches)
    store, seen = Store(spark, f"file://{tmp_path}/s", Config(partitions=2, level0_files=2)), []
    for n, b in enumerate(batches):
        seen += b
        if n % 3 == 2:
            store.append(spark.createDataFrame(b, LOG))
            assert contents(store) == as_dict(seen)
            assert store.flush() > 0 and store.flush() == 0
        else:
            store.apply(spark.createDataFrame(b, LOG))
        store.compact_where_due()
        assert contents(store) == as_dict(seen)
    store.advance(99)
    store.compact()
    store.compact(1)
    assert contents(store) == as_dict(rows) and store.log().where("rec_type = 1").count() == 0
    with pytest.raises(Exception, match="not newer than the watermark"):
        store.apply(spark.createDataFrame([("k1", "late", 50, 500, 0)], LOG))
    store.apply(spark.createDataFrame([("k1", "late", 50, 500, 0), ("new", "n", 100, 501, 0)], LOG), late="drop")
    assert contents(store) == {**as_dict(rows), "new": "n"}


def test_a_late_write_stays_deleted(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=1, level0_files=2))
    store.apply(spark.createDataFrame([("k", None, 10, 1, 1)], LOG))
    store.apply(spark.createDataFrame([("x", "1", 11, 2, 0)], LOG))
    assert store.compact_where_due() == 1
    store.apply(spark.createDataFrame([("k", "old", 5, 3, 0)], LOG))
    assert store.get("k") is None and contents(store) == {"x": "1"}


def test_compaction_picks_and_moves(spark, tmp_path, monkeypatch):
    """Level 0 takes what its picker takes; level 1 above its limit moves what meets nothing by metadata alone."""
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=1, level0_files=2, run_bytes=1))
    batch = lambda first, ts: [(f"{k:03d}", f"v{ts}", ts, ts, 0) for k in range(first, first + 10)]
    want = []
    for ts, first in enumerate((200, 205, 500, 700), 1):
        want += batch(first, ts)
        store.apply(spark.createDataFrame(batch(first, ts), LOG))
        store.compact(whole=False)
    levels = {r.level: r for r in store.levels().where("p = 0").collect()}
    assert len(levels) == 7 and contents(store) == as_dict(want) and sum(len(r.runs) for r in levels.values()) >= 2
    monkeypatch.setattr("quernlog.operators.runs.LEVEL_LIMITS", (2, 0, 1000, 10_000, 100_000, 1_000_000))
    store.compact()
    folders = set(r.folder for r in store.runs().collect())
    assert store.compact(1, whole=False) and {r.folder for r in store.runs().collect()} == folders  # no new data
    assert {r.level for r in store.runs().collect()} == {2} and contents(store) == as_dict(want)
    with pytest.raises(ValueError):
        store.compact(6)


def test_checkpoints_and_reopening(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quernlog.sources.store.CHECKPOINT_COMMITS", 3)
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=2))
    for i in range(7):
        store.put(spark.createDataFrame([(f"k{i}", str(i)), ("k", str(i))], PAIRS))
        if i == 4:
            store.compact()
    kinds = [kind for _, kind, _ in store._marks()]
    assert kinds.count("all") == 2
    store.vacuum()
    again = Store(spark, f"file://{tmp_path}/s", Config(partitions=2))
    assert contents(again) == {**{f"k{i}": str(i) for i in range(7)}, "k": "6"} and again._state().next_run == store._state().next_run
    again.append(spark.createDataFrame([("w", "1", 2**60, 1, 0)], LOG))
    again.drain()
    last = Store(spark, f"file://{tmp_path}/s", Config(partitions=2))
    assert last.get("w") == "1" and not last._state().of(0)
    with pytest.raises(RuntimeError):
        again.put(spark.createDataFrame([("w", "2")], PAIRS))


def test_configuration_files(spark, tmp_path):
    path = tmp_path / "store.conf"
    path.write_text("# options\npartitions: 4\n\nlevel0_files: 3  # files\n")
    assert Config.load(spark, f"file://{path}") == Config(partitions=4, level0_files=3)
    with pytest.raises(FileNotFoundError):
        Config.load(spark, f"file://{tmp_path}/none")
    for bad in ("partitions 4", "shards: 4", "partitions: many", "partitions: 0"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            Config.load(spark, f"file://{path}")


def test_a_point_lookup_reads_one_shard(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=8))
    store.put(spark.createDataFrame([(f"k{i}", "v") for i in range(100)], "key string, value string"))
    from quernlog.operators.versions import point_get

    plan = point_get(store.log(), "k7", 8)._jdf.queryExecution().executedPlan().toString()
    assert f"(p#" in plan and f"= {store.partition_of('k7')})" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,k7)]" in plan


def test_limits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=2))
    with pytest.raises(Exception, match="longer than 65535"):
        store.put(spark.createDataFrame([("k" * 65536, "v")], "key string, value string"))
    for bad in ({"partitions": 0}, {"partitions": 70_000}, {"level0_files": 1}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_stream_into_store_and_state(spark, tmp_path):
    rows = [(f"k{i % 7}", f"v{i}", i, i, int(i % 5 == 0)) for i in range(60)]
    for n in (2, 0, 1):  # the newest records come first
        spark.createDataFrame(rows[20 * n : 20 * n + 20], LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    want = as_dict(rows)
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=2, level0_files=2))
    into_store(read_changes(spark, f"file://{tmp_path}/in", LOG, 1), store, f"file://{tmp_path}/c1").awaitTermination()
    assert contents(store) == want
    q = into_table(latest_state(read_changes(spark, f"file://{tmp_path}/in", LOG, 1)), f"file://{tmp_path}/t", f"file://{tmp_path}/c2")
    q.awaitTermination()
    assert {r.key: r.value for r in live(spark.read.parquet(f"file://{tmp_path}/t")).collect()} == want
    # A watermark behind the newest record: what is later is dropped, whatever was compacted.
    late = Store(spark, f"file://{tmp_path}/l", Config(partitions=2, level0_files=2))
    into_store(read_changes(spark, f"file://{tmp_path}/in", LOG, 1), late, f"file://{tmp_path}/c3", delay=30).awaitTermination()
    assert contents(late) == as_dict([r for r in rows if r[2] > 29])
    store.drain()
    with pytest.raises(RuntimeError):
        store.snapshot()


def test_processing_time_stream(spark, tmp_path):
    spark.createDataFrame([("a", "1", 1, 1, 0)], LOG).write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s", Config(partitions=1))
    q = into_store(read_changes(spark, f"file://{tmp_path}/in", LOG), store, f"file://{tmp_path}/c", available_now=False)
    q.processAllAvailable()
    assert contents(store) == {"a": "1"} and q.isActive
    store.drain()
    assert not q.isActive
