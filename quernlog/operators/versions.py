"""Last-writer-wins reads of a change log (key, value, ts, seq, rec_type [, p]).

One total order holds everywhere: (ts, seq), larger wins.  A key's newest record is found with
``row_number() = 1``, which Spark plans as a group limit before and after the shuffle: a key that
holds a third of all rows sends one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import DELETE, WRITE
from ..functions.routing import as_binary, key_hash, literal_partition, partition_of

ORDER = ("ts", "seq")


def change_log(rows: DataFrame, n_partitions: int) -> DataFrame:
    """``rows`` (key, value, ts, seq, rec_type) with their shard ``p``."""
    return rows.withColumn("p", partition_of(F.col("key"), n_partitions))


def latest(log: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ORDER) -> DataFrame:
    """Each key's newest record, tombstones included."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def live(log: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ORDER) -> DataFrame:
    """Each key's newest record where that is a write."""
    return latest(log, keys, order).where(F.col("rec_type") == WRITE)


def point_get(log: DataFrame, key: str | bytes, n_partitions: int | None = None) -> DataFrame:
    """A key's live record: no row if it is missing or deleted.  With ``n_partitions`` only its shard is read."""
    raw = key.encode() if isinstance(key, str) else key
    if n_partitions:
        log = log.where(F.col("p") == literal_partition(raw, n_partitions))
    kind = dict(log.dtypes)["key"]
    return live(log.where(F.col("key") == (F.lit(raw) if kind == "binary" else F.lit(raw.decode()))))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every asked key (distinct) with its value, null where none is live, and ``found``.  A hot key of the log is cut to one row a task before the join."""
    held = live(log.select("key", "value", *ORDER, "rec_type")).select("key", "value", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(held, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def existing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(live(log), "key", "left_semi")


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(live(log), "key", "left_anti")


def with_prior(log: DataFrame) -> DataFrame:
    """Every record with the one before it on its key: prior_type and prior_value."""
    own = Window.partitionBy("key").orderBy(*ORDER)
    return log.withColumn("prior_type", F.lag("rec_type").over(own)).withColumn("prior_value", F.lag("value").over(own))


def effective_deletes(log: DataFrame) -> DataFrame:
    """Deletes of keys that were live, with the value that they removed."""
    return with_prior(log).where((F.col("rec_type") == DELETE) & (F.col("prior_type") == WRITE)).drop("prior_type")


def idle_deletes(log: DataFrame) -> DataFrame:
    """Deletes of keys that were not live: they change nothing and write nothing."""
    return with_prior(log).where((F.col("rec_type") == DELETE) & ((F.col("prior_type") != WRITE) | F.col("prior_type").isNull())).drop("prior_type", "prior_value")


def sequenced(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The records of ``batch`` that take effect on ``state``: writes, and deletes of what is live just before them."""
    both = state.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
    return with_prior(both).where("_new").where((F.col("rec_type") == WRITE) | (F.col("prior_type") == WRITE)).drop("_new", "prior_type", "prior_value")


def memtable(log: DataFrame, arrival: str = "seq") -> DataFrame:
    """The sorted dump of a memtable: the last arrival of each key, whatever its ts."""
    return latest(log, order=(arrival,))


def on_time(log: DataFrame, arrival: str = "seq") -> DataFrame:
    """Records that an index would take: strictly newer than all that arrived before them on their key."""
    before = Window.partitionBy("key").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_seen", F.max("ts").over(before)).where(F.col("_seen").isNull() | (F.col("ts") > F.col("_seen"))).drop("_seen")


def locator_index(runs: DataFrame) -> DataFrame:
    """The index that recovery builds from records of runs (with run and offset): hash of each live key, and where its record is."""
    return live(runs, order=("ts", "run", "seq")).select(key_hash(F.col("key")).alias("key_hash"), "key", "run", "offset", "ts")


def merge_index(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both indexes (key, ts, run): of entries on one key the strictly newer one, the current one on a tie."""
    a, b = (d.select("key", F.col("ts").alias(f"{n}_ts"), F.col("run").alias(f"{n}_run")) for d, n in ((current, "a"), (incoming, "b")))
    take = F.col("a_ts").isNull() | (F.col("b_ts") > F.col("a_ts"))
    pick = lambda c: F.when(take, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return a.join(b, "key", "full_outer").select("key", pick("ts"), pick("run"))


def index_of(entries: DataFrame, ties_go_to: str = "first") -> DataFrame:
    """The index after ``entries`` (key, ts, run, seq) were set in order of seq: the newest ts of each key; on a tie the first or the last one set."""
    tie = F.col("seq").asc() if ties_go_to == "first" else F.col("seq").desc()
    newest = Window.partitionBy("key").orderBy(F.col("ts").desc(), tie)
    return entries.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("key", "ts", "run", "seq")


def index_without(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index after ``keys`` were removed from it."""
    return index.join(keys.select("key").distinct(), "key", "left_anti")


def read_located(index: DataFrame, records: DataFrame) -> DataFrame:
    """The records (with run and offset) that locators (key, run, offset) point at; a locator that points at nothing, as its run is gone, is an error."""
    on = ["key", "run", "offset"]
    rows = index.select(*on).join(records.withColumn("_held", F.lit(True)), on, "left")
    lost = F.raise_error(F.concat(F.lit("no record at "), F.concat_ws(":", F.col("run").cast("string"), F.col("offset").cast("string"))))
    return rows.withColumn("key", F.when(F.col("_held").isNull(), lost).otherwise(F.col("key"))).drop("_held").select(*records.columns)


def binary_keys(log: DataFrame) -> DataFrame:
    return log.withColumn("key", as_binary(F.col("key"))).withColumn("value", as_binary(F.col("value")))
