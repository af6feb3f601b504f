"""Driver tables as change logs, and every operator's query on them with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.routing import key_hash
from ..operators import runs as R
from ..operators import versions as V

PARTITIONS, DAY = 8, 86_400_000_000
WAL_BYTES = 4_000
Query = Callable[[SparkSession, str], DataFrame]


def as_change_log(e: DataFrame) -> DataFrame:
    """``events`` as a change log: a user's rows are versions of one key, errors are deletes."""
    ts = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), ts.alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", codec.DELETE).otherwise(codec.WRITE).alias("rec_type"))
    return V.change_log(rows, PARTITIONS)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_change_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def permuted(log: DataFrame) -> DataFrame:
    """The same records in an order of arrival that is not that of ts."""
    return log.withColumn("arrival", F.sha2(F.col("seq").cast("string"), 256))


def tied(log: DataFrame) -> DataFrame:
    """Times cut to days, so that many versions share one."""
    return log.withColumn("ts", F.col("ts") - F.col("ts") % DAY)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: those of all customers, most of which no event has."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of flushed runs: run = the shard's day, level = run modulo 3."""
    log = event_log(spark, sf_dir)
    first = log.groupBy("p").agg(F.expr(f"min(ts) div {DAY}").alias("e0"))
    return R.flushed(log, F.expr(f"ts div {DAY}")).join(F.broadcast(first), "p").withColumn("run", F.col("epoch") - F.col("e0")).withColumn("level", (F.col("run") % 3).cast("int")).drop("e0")  # one row a shard


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_metadata(event_runs(spark, sf_dir), ("p", "run", "level"))


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made of orders: each creates a file of its shard, some later ones delete it again."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        (F.col("o_custkey") % PARTITIONS).alias("p"), (F.col("o_orderkey") % 500).alias("run"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("fop"),
        F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1).alias("file_type"), (F.col("o_orderkey") % 7).cast("int").alias("level"), F.col("o_orderkey").alias("commit"),
    )


LOG = """log AS (
  SELECT user_id::VARCHAR AS key, props AS value, epoch_us(ts) AS ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rec_type,
    (('0x' || substr(sha256(user_id::VARCHAR), 3, 2) || substr(sha256(user_id::VARCHAR), 1, 2))::INT % 8)::INT AS p FROM events
)"""
SIZE = "(7 + strlen(key) + coalesce(strlen(value), 0) + ceil(len(bin(ts)) / 7.0))::BIGINT"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"
LATEST = f"latest AS (SELECT * FROM log {NEWEST}), live AS (SELECT * FROM latest WHERE rec_type = 0)"
ASKED = "asked AS (SELECT c_custkey::VARCHAR AS key FROM customer)"
RUNS = f"""flushed AS (
  SELECT *, ts // {DAY} AS epoch FROM log QUALIFY row_number() OVER (PARTITION BY p, ts // {DAY}, key ORDER BY ts DESC, seq DESC) = 1
), runs AS (
  SELECT *, epoch - min(epoch) OVER (PARTITION BY p) AS run, ((epoch - min(epoch) OVER (PARTITION BY p)) % 3)::INT AS level, {SIZE} AS size FROM flushed
)"""
TABLE = """run_table AS (
  SELECT p, run, level, min(key) AS start_key, max(key) AS end_key, count(*) FILTER (rec_type = 0) AS n_write, count(*) FILTER (rec_type = 1) AS n_del, sum(size)::BIGINT AS bytes, max(ts) AS max_ts FROM runs GROUP BY p, run, level
)"""
PRIOR = "prior AS (SELECT *, lag(rec_type) OVER w AS prior_type, lag(value) OVER w AS prior_value FROM log WINDOW w AS (PARTITION BY key ORDER BY ts, seq))"
MANIFEST = """manifest AS (
  SELECT o_custkey % 8 AS p, o_orderkey % 500 AS run, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fop, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END AS file_type, (o_orderkey % 7)::INT AS level, o_orderkey AS commit FROM orders
), replayed AS (
  SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY file_type, p, run ORDER BY commit DESC) = 1
)"""

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, query: Query) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


_register("route_partition", f"WITH {LOG} SELECT p, count(*) AS n_records, count(DISTINCT key) AS n_keys FROM log GROUP BY p",
          lambda s, d: event_log(s, d).groupBy("p").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("key").alias("n_keys")))
_register("key_hash", "SELECT DISTINCT user_id::VARCHAR AS key, sha256(user_id::VARCHAR) AS h FROM events",
          lambda s, d: event_log(s, d).select("key").distinct().withColumn("h", key_hash(F.col("key"))))
_register("put_change_log", f"WITH {LOG} SELECT key, value, ts, seq, rec_type, p FROM log", event_log)
_register("point_get", f"WITH {LOG}, {LATEST} SELECT key, value, ts FROM live WHERE key = '42'",
          lambda s, d: V.point_get(event_log(s, d), "42", PARTITIONS).select("key", "value", "ts"))
_register("multi_get", f"WITH {LOG}, {LATEST}, {ASKED} SELECT a.key, l.value, l.key IS NOT NULL AS found FROM asked a LEFT JOIN live l ON a.key = l.key",
          lambda s, d: V.multi_get(event_log(s, d), asked(s, d)))
_register("exists_keys", f"WITH {LOG}, {LATEST}, {ASKED} SELECT key FROM asked WHERE key IN (SELECT key FROM live)", lambda s, d: V.existing(event_log(s, d), asked(s, d)))
_register("missing_keys", f"WITH {LOG}, {LATEST}, {ASKED} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM live)", lambda s, d: V.missing(event_log(s, d), asked(s, d)))
_register("delete_prior_value", f"WITH {LOG}, {PRIOR} SELECT key, ts, seq, prior_value FROM prior WHERE rec_type = 1 AND prior_type = 0",
          lambda s, d: V.effective_deletes(event_log(s, d)).select("key", "ts", "seq", "prior_value"))
_register("delete_noop", f"WITH {LOG}, {PRIOR} SELECT key, ts, seq FROM prior WHERE rec_type = 1 AND coalesce(prior_type, 1) = 1",
          lambda s, d: V.idle_deletes(event_log(s, d)).select("key", "ts", "seq"))
_register("effective_log", f"WITH {LOG}, {PRIOR} SELECT key, ts, seq, rec_type FROM prior WHERE rec_type = 0 OR prior_type = 0",
          lambda s, d: V.sequenced(event_log(s, d).limit(0), event_log(s, d)).select("key", "ts", "seq", "rec_type"))
_register("memtable_dump", f"WITH {LOG} SELECT key, value, ts, rec_type FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY sha256(seq::VARCHAR) DESC) = 1",
          lambda s, d: V.memtable(permuted(event_log(s, d)), "arrival").select("key", "value", "ts", "rec_type"))
_register("memtable_size", f"WITH {LOG} SELECT p, count(DISTINCT key) AS keys FROM log GROUP BY p", lambda s, d: event_log(s, d).groupBy("p").agg(F.countDistinct("key").alias("keys")))
_register("late_data_reject", f"""WITH {LOG} SELECT key, ts, seq FROM (SELECT *, max(ts) OVER (PARTITION BY key ORDER BY sha256(seq::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log) WHERE seen IS NULL OR ts > seen""",
          lambda s, d: V.on_time(permuted(event_log(s, d)), "arrival").select("key", "ts", "seq"))
_register("live_snapshot", f"WITH {LOG}, {LATEST} SELECT key, value, ts, seq FROM live", lambda s, d: V.live(event_log(s, d)).select("key", "value", "ts", "seq"))
_register("live_snapshot_ties", f"WITH {LOG} SELECT key, value, ts, seq FROM (SELECT * REPLACE (ts - ts % {DAY} AS ts) FROM log {NEWEST.replace('ts DESC', f'ts - ts % {DAY} DESC')}) WHERE rec_type = 0",
          lambda s, d: V.live(tied(event_log(s, d))).select("key", "value", "ts", "seq"))
_register("all_latest", f"WITH {LOG}, {LATEST} SELECT key, value, ts, seq, rec_type FROM latest", lambda s, d: V.latest(event_log(s, d)).select("key", "value", "ts", "seq", "rec_type"))
_register("range_scan", f"WITH {LOG}, {LATEST} SELECT key, value FROM live WHERE key >= '1' AND key < '2'", lambda s, d: V.live(event_log(s, d).where("key >= '1' and key < '2'")).select("key", "value"))
_register("flush_runs", f"WITH {LOG}, {RUNS} SELECT p, run, key, ts, seq, rec_type FROM runs", lambda s, d: event_runs(s, d).select("p", "run", "key", "ts", "seq", "rec_type"))
_register("run_metadata", f"WITH {LOG}, {RUNS}, {TABLE} SELECT * FROM run_table", run_table)
_register("record_offsets", f"""WITH {LOG}, {RUNS} SELECT p, run, key, coalesce(sum(size) OVER (PARTITION BY p, run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM runs""",
          lambda s, d: R.record_offsets(event_runs(s, d)).select("p", "run", "key", "offset"))
_register("wal_rollover", f"""WITH RECURSIVE {LOG}, sized AS (SELECT p, seq, {SIZE} AS size, row_number() OVER (PARTITION BY p ORDER BY seq) AS i FROM log),
fold(p, seq, i, used, file) AS (
  SELECT p, seq, i, size, 0 FROM sized WHERE i = 1
  UNION ALL
  SELECT s.p, s.seq, s.i, CASE WHEN f.used + s.size >= {WAL_BYTES} THEN s.size ELSE f.used + s.size END, f.file + CASE WHEN f.used + s.size >= {WAL_BYTES} THEN 1 ELSE 0 END FROM fold f JOIN sized s ON s.p = f.p AND s.i = f.i + 1
) SELECT p, seq, file FROM fold""", lambda s, d: R.rollover(event_log(s, d), WAL_BYTES))  # fmt: skip
_register("key_range", f"WITH {LOG}, {RUNS}, {TABLE} SELECT p, level, min(start_key) AS start_key, max(end_key) AS end_key FROM run_table GROUP BY p, level",
          lambda s, d: run_table(s, d).groupBy("p", "level").agg(F.min("start_key").alias("start_key"), F.max("end_key").alias("end_key")))
_register("run_overlap", f"WITH {LOG}, {RUNS}, {TABLE} SELECT a.p, a.run AS left_run, b.run AS right_run FROM run_table a JOIN run_table b ON a.p = b.p AND a.level = 0 AND b.level = 1 AND a.start_key <= b.end_key AND b.start_key <= a.end_key",
          lambda s, d: R.overlapping(run_table(s, d).where("level = 0"), run_table(s, d).where("level = 1")))
_register("trivial_move", f"""WITH {LOG}, {RUNS}, {TABLE} SELECT p, run, level, level + 1 AS new_level FROM run_table r WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM run_table w WHERE w.p = r.p AND w.level = r.level + 1 AND r.start_key <= w.end_key AND w.start_key <= r.end_key)""",
          lambda s, d: R.movable(run_table(s, d)).select("p", "run", "level", "new_level"))
_register("level0_pick", f"""WITH RECURSIVE {LOG}, {RUNS}, {TABLE}, below AS (
  SELECT p, list({{'s': start_key, 'e': end_key}}) AS low FROM run_table WHERE level = 1 GROUP BY p
), tried AS (
  SELECT p, run, start_key AS s, end_key AS e, coalesce(low, []) AS low, row_number() OVER (PARTITION BY p ORDER BY n_del // (n_del + n_write) DESC, run) AS i FROM run_table LEFT JOIN below USING (p) WHERE level = 0
), judged AS (
  SELECT *, len(list_filter(low, lambda n: n.s <= e AND s <= n.e)) AS own FROM tried
), fold(p, i, s, e, run, took) AS (
  SELECT DISTINCT p, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, false FROM judged
  UNION ALL
  SELECT p, i, CASE WHEN take THEN s2 ELSE s1 END, CASE WHEN take THEN e2 ELSE e1 END, run, take FROM (
    SELECT *, own > 0 AND (s1 IS NULL OR (own <= {R.MOST_OVERLAP} AND len(list_filter(low, lambda n: n.s <= e2 AND s2 <= n.e)) <= {R.MOST_OVERLAP})) AS take FROM (
      SELECT j.p, j.i, j.run, j.own, j.low, f.s AS s1, f.e AS e1, least(coalesce(f.s, j.s), j.s) AS s2, greatest(coalesce(f.e, j.e), j.e) AS e2 FROM fold f JOIN judged j ON j.p = f.p AND j.i = f.i + 1))
), taken AS (
  SELECT t.p, t.run, t.s, t.e FROM tried t JOIN fold f USING (p, i) WHERE f.took OR t.p NOT IN (SELECT p FROM fold WHERE took)
), spans AS (
  SELECT p, min(s) AS s, max(e) AS e FROM taken GROUP BY p
) SELECT p, run, 0 AS level FROM taken UNION ALL SELECT r.p, r.run, 1 FROM run_table r JOIN spans x ON x.p = r.p AND r.level = 1 AND r.start_key <= x.e AND x.s <= r.end_key""",
          lambda s, d: R.level0_picks(run_table(s, d)))
_register("level_runs", f"WITH {LOG}, {RUNS}, {TABLE} SELECT p, level, string_agg(run::VARCHAR, ',' ORDER BY run) AS runs FROM run_table GROUP BY p, level", lambda s, d: R.level_runs(run_table(s, d)))
_register("pick_compaction", f"""WITH {LOG}, {RUNS}, {TABLE}, ranked AS (SELECT *, n_del // (n_del + n_write) AS ratio, count(*) OVER (PARTITION BY p, level) AS files, row_number() OVER (PARTITION BY p, level ORDER BY n_del // (n_del + n_write) DESC, run) AS rank FROM run_table)
SELECT p, level, run, ratio::BIGINT AS ratio, rank::INT AS rank FROM ranked WHERE files >= 4 AND rank <= files - 4 + 1""", lambda s, d: R.picked(run_table(s, d), 4).select("p", "level", "run", "ratio", "rank"))  # fmt: skip
_register("level_eligible", f"WITH {LOG}, {RUNS}, {TABLE}, n AS (SELECT p, level, count(*) AS files FROM run_table GROUP BY p, level) SELECT p, level, files FROM n JOIN (VALUES (0, 4), (1, 100), (2, 1000), (3, 10000), (4, 100000), (5, 1000000)) AS l(level, most) USING (level) WHERE CASE WHEN level = 0 THEN files >= most ELSE files > most END",
          lambda s, d: R.eligible_levels(run_table(s, d)))
_register("compact_runs", f"WITH {LOG}, {RUNS} SELECT p, key, ts, seq, rec_type FROM runs WHERE level < 2 {NEWEST}", lambda s, d: R.merged(event_runs(s, d).where("level < 2"), False).select("p", "key", "ts", "seq", "rec_type"))
_register("compact_bottom", f"WITH {LOG}, {RUNS} SELECT p, key, ts, seq FROM (SELECT * FROM runs {NEWEST}) WHERE rec_type = 0", lambda s, d: R.merged(event_runs(s, d), True).select("p", "key", "ts", "seq"))
_register("manifest_replay", f"WITH {MANIFEST} SELECT p, run, fop, file_type, level, commit FROM replayed", lambda s, d: R.replayed(event_manifest(s, d)))
_register("current_runs", f"WITH {MANIFEST} SELECT p, level, count(*) AS files, max(run) AS max_run FROM replayed WHERE file_type = 1 AND fop = 0 GROUP BY p, level",
          lambda s, d: R.current_runs(event_manifest(s, d)).groupBy("p", "level").agg(F.count(F.lit(1)).alias("files"), F.max("run").alias("max_run")))
_register("unclosed_logs", f"WITH {MANIFEST} SELECT p, run FROM replayed WHERE file_type = 0 AND fop = 0", lambda s, d: R.replayed(event_manifest(s, d)).where("file_type = 0 and fop = 0").select("p", "run"))
_register("next_seq", f"WITH {MANIFEST} SELECT p, file_type, max(run) + 1 AS next_seq FROM manifest GROUP BY p, file_type", lambda s, d: event_manifest(s, d).groupBy("p", "file_type").agg((F.max("run") + 1).alias("next_seq")))
_register("partition_stats", f"""WITH {LOG}, {RUNS}, {LATEST}, act AS (SELECT DISTINCT p, key FROM log WHERE seq % 5 = 0)
SELECT p, ((SELECT count(*) FROM live WHERE live.p = x.p) + (SELECT count(*) FROM act WHERE act.p = x.p) + (SELECT count(*) FROM flushed f WHERE f.p = x.p AND f.seq % 11 = 0))::BIGINT AS keys,
  (SELECT count(DISTINCT epoch) FROM flushed f WHERE f.p = x.p AND f.seq % 11 = 0)::BIGINT AS inactive_memtables, (SELECT count(DISTINCT run) FROM runs r WHERE r.p = x.p)::BIGINT AS sst_count FROM (SELECT unnest(range({PARTITIONS}))::INT AS p) x""",
          lambda s, d: R.partition_stats(V.live(event_log(s, d)), event_log(s, d).where("seq % 5 = 0").select("p", "key").distinct(), event_runs(s, d).where("seq % 11 = 0"), event_runs(s, d), PARTITIONS))
_register("level_stats", f"""WITH {LOG}, {RUNS}, own AS (SELECT p, level, count(DISTINCT run) AS files, count(*) FILTER (rec_type = 0) AS n_write, count(*) FILTER (rec_type = 1) AS n_del FROM runs GROUP BY p, level)
SELECT p, level, coalesce(files, 0) AS files, coalesce(n_write, 0) AS n_write, coalesce(n_del, 0) AS n_del FROM (SELECT DISTINCT p FROM runs) CROSS JOIN (SELECT unnest(range(7))::INT AS level) LEFT JOIN own USING (p, level)""", lambda s, d: R.level_stats(event_runs(s, d)))  # fmt: skip
_register("write_delete_totals", f"WITH {LOG}, {RUNS} SELECT p, run, count(*) FILTER (rec_type = 0) AS n_write, count(*) FILTER (rec_type = 1) AS n_del FROM runs GROUP BY ROLLUP (p, run)", lambda s, d: R.write_delete_totals(event_runs(s, d)))
_register("recovery_index", f"""WITH {LOG}, {RUNS}, placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY p, run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM runs)
SELECT sha256(key) AS key_hash, key, run, "offset", ts FROM (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, run DESC, seq DESC) = 1) WHERE rec_type = 0""", lambda s, d: V.locator_index(R.record_offsets(event_runs(s, d))))  # fmt: skip
_register("index_merge", f"""WITH {LOG}, {RUNS}, a AS (SELECT key, ts, run FROM runs WHERE seq % 2 = 0 {NEWEST}), b AS (SELECT key, ts, run FROM runs WHERE seq % 2 = 1 {NEWEST})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.ts IS NULL OR b.ts > a.ts THEN b.ts ELSE a.ts END AS ts, CASE WHEN a.ts IS NULL OR b.ts > a.ts THEN b.run ELSE a.run END AS run FROM a FULL JOIN b ON a.key = b.key""",
          lambda s, d: V.merge_index(V.latest(event_runs(s, d).where("seq % 2 = 0")), V.latest(event_runs(s, d).where("seq % 2 = 1"))))
_register("encoded_sizes", f"WITH {LOG} SELECT seq, {SIZE} AS size FROM log", lambda s, d: event_log(s, d).select("seq", codec.record_bytes(F.col("key"), F.col("value"), F.col("ts")).alias("size")))


for _ties, _order in (("first", ""), ("last", " DESC")):
    _register(f"index_ties_{_ties}", f"WITH {LOG} SELECT key, ts, seq FROM (SELECT * REPLACE (ts - ts % {DAY} AS ts) FROM log) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq{_order}) = 1",
              lambda s, d, t=_ties: V.index_of(tied(event_log(s, d)).withColumn("run", F.lit(0)), t).select("key", "ts", "seq"))
_register("index_remove", f"WITH {LOG}, {LATEST} SELECT key, ts FROM latest WHERE key NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)",
          lambda s, d: V.index_without(V.latest(event_log(s, d)), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"))).select("key", "ts"))
_register("locator_read", f"WITH {LOG}, {LATEST} SELECT key, value, ts FROM live",
          lambda s, d: V.read_located(V.locator_index(R.record_offsets(event_runs(s, d))), R.record_offsets(event_runs(s, d))).select("key", "value", "ts"))


def log_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live snapshot that replaying rolled-over log files gives."""
    from ..sources.store import scratch_folder

    log = event_log(spark, sf_dir)
    path = scratch_folder(spark, "logs")
    codec.write_logs(R.log_files(log, WAL_BYTES), path)
    back = codec.read_logs(spark, path).withColumn("seq", F.struct("file", "offset"))
    return V.live(back).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts")


_register("log_recovery", f"WITH {LOG}, {LATEST} SELECT key, value, ts FROM live", log_recovery)


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    coded = log.select(codec.encode(F.col("rec_type"), F.col("key"), F.col("value"), F.col("ts")).alias("content"), F.col("seq").cast("string").alias("path"))
    back = codec.decode_files(coded)
    return back.select(F.col("path").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts", "rec_type")


_register("codec_roundtrip", f"WITH {LOG} SELECT seq, key, value, ts, rec_type FROM log", codec_roundtrip)


def bench_read_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded keys 1 to 20000 looked up in a store of the orders' keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    held = o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key")).distinct()
    asked_keys = spark.range(1, 20_001).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("key"))
    found = asked_keys.join(held.withColumn("hit", F.lit(True)), "key", "left")
    return found.agg(F.count_if(F.col("hit").isNotNull()).alias("found"), F.count_if(F.col("hit").isNull()).alias("not_found"))


_register("bench_read_hits", "SELECT count(*) FILTER (o.k IS NOT NULL) AS found, count(*) FILTER (o.k IS NULL) AS not_found FROM (SELECT unnest(range(1, 20001)) AS id) LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders) o ON id = o.k", bench_read_hits)


def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import stream_latest

    return stream_latest(spark, sf_dir)


_register("stream_lww", f"WITH {LOG}, {LATEST} SELECT key, value, ts, seq FROM live", stream_lww)


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.store import scratch_store

    store = scratch_store(spark, PARTITIONS)
    log = event_log(spark, sf_dir).drop("p")
    store.apply(log.where("seq % 2 = 0"))
    store.apply(log.where("seq % 2 = 1"))
    store.compact()
    return store.snapshot().select("key", "value", "ts", "seq")


_register("store_roundtrip", f"WITH {LOG}, {LATEST} SELECT key, value, ts, seq FROM live", store_roundtrip)


def store_late_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest batch first, compactions between batches, a log that waits while the store is opened again."""
    from ..sources.store import Store, scratch_store

    store = scratch_store(spark, PARTITIONS)
    log = event_log(spark, sf_dir).drop("p").withColumn("batch", F.ntile(3).over(Window.partitionBy(F.col("seq") % 100).orderBy(F.col("ts").desc())))
    store.apply(log.where("batch = 1"))
    store.compact()
    store.append(log.where("batch = 3"))
    store = Store(spark, store.path, store.config)
    store.compact()
    store.flush()
    store.apply(log.where("batch = 2"))
    store.compact()
    return store.snapshot().select("key", "value", "ts", "seq")


_register("store_late_batches", f"WITH {LOG}, {LATEST} SELECT key, value, ts, seq FROM live", store_late_batches)


def store_delete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete what is absent, put, delete, compact to nothing, put again: what deletes gave, and what is there."""
    from ..sources.store import scratch_store

    store = scratch_store(spark, PARTITIONS)
    pairs = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(f"{c}_{t}key").cast("string").alias("key"), F.col(f"{c}_name").alias("value"))
    nations, regions = pairs("nation", "n"), pairs("region", "r")
    answers = [store.delete(nations.select("key"))]
    store.put(nations)
    answers += [store.delete(nations.select("key")), store.delete(regions.select("key"))]
    store.advance(store.newest())
    store.compact()
    store.compact(1)
    store.put(regions)
    answers.append(store.snapshot().select("key", "value"))
    out = answers[0].withColumn("step", F.lit(0))
    for n, a in enumerate(answers[1:], 1):
        out = out.unionByName(a.withColumn("step", F.lit(n)))
    return out


_register("store_delete_first", """SELECT 0 AS step, n_nationkey::VARCHAR AS key, NULL AS value FROM nation UNION ALL SELECT 1, n_nationkey::VARCHAR, n_name FROM nation
UNION ALL SELECT 2, r_regionkey::VARCHAR, NULL FROM region UNION ALL SELECT 3, r_regionkey::VARCHAR, r_name FROM region""", store_delete_first)


def bench_store_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bench_read_hits``, by a multi-get from a store that the keys were put into."""
    from ..sources.store import scratch_store

    store = scratch_store(spark, PARTITIONS)
    keys = lambda c: F.lpad(c.cast("string"), 12, "0").alias("key")
    store.put(spark.read.parquet(f"{sf_dir}/orders.parquet").select(keys(F.col("o_orderkey")), F.col("o_orderkey").cast("string").alias("value")))
    got = store.multi_get(spark.range(1, 20_001).select(keys(F.col("id"))))
    return got.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("not_found"))


_register("bench_store_hits", _SQL["bench_read_hits"], bench_store_hits)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
