"""Incremental observations: polled files, first and last sight, windows, cascades."""

from __future__ import annotations

import contextlib
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lectern.operators.graph import shared_folder

LATE = "1 day"
#: After so long without a sight an address is forgotten; a later sight is its first again.
FORGET = timedelta(days=365)
_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files as they arrive, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE)


def first_copies(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key while its watermark lasts, so replays add nothing."""
    return _timed(stream, ts).dropDuplicatesWithinWatermark(keys)


class Sights(StatefulProcessor):
    """First and last sight and number of sights of a key as value state, forgotten some time after the last one.

    Times are microseconds. Rows may come in any order inside the watermark.
    What a batch changes is given once for each key.
    """

    def __init__(self, forget: timedelta):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sights = handle.getValueState("sights", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.sights.get() if self.sights.exists() else None
        first, last, n = held if held is not None else (None, None, 0)
        before = last
        for r in rows:
            first, last, n = min(r.at if first is None else first, r.at), max(r.at if last is None else last, r.at), n + 1
        self.sights.update((first, last, n))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(last))
        yield Row(key=key[0], first_seen=first, last_seen=last, n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.sights.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _end(self, last: int) -> int:
        return (last + self.forget // timedelta(microseconds=1)) // 1000


def seen(stream: DataFrame, url: str, ts: str, event: str | None = None, forget: timedelta = FORGET) -> DataFrame:
    """First and last sight and count per url, a row whenever a batch changes them (for update output).

    Where events have an id, replays of one within the watermark count once.
    Needs the state store that `state_store` sets.
    """
    rows = _timed(stream.select(F.col(url).alias("key"), F.col(ts).alias("ts"), *([F.col(event).alias("event")] if event else [])), "ts")
    if event:
        rows = rows.dropDuplicatesWithinWatermark(["event"])
    rows = rows.withColumn("at", F.unix_micros("ts"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithState(Sights(forget), f"key {kind}, first_seen long, last_seen long, n long", "update", "eventTime")
    return out.select(F.col("key").alias(url), F.timestamp_micros("first_seen").alias("first_seen"), F.timestamp_micros("last_seen").alias("last_seen"), "n")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which value state and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def cascade_pairs(origins: DataFrame, copies: DataFrame, key: str, ts: str, event: str, minutes: int = 180) -> DataFrame:
    """(key, origin, origin_ts, copy, copy_ts): copies that follow an origin of their key within the window, joined as both streams run.

    Both sides have a watermark, so either forgets what can't be met any more.
    """
    a = _timed(origins.select(F.col(key).alias("__key"), F.col(event).alias("origin"), F.col(ts).alias("origin_ts")), "origin_ts")
    b = _timed(copies.select(F.col(key).alias(key), F.col(event).alias("copy"), F.col(ts).alias("copy_ts")), "copy_ts")
    near = (F.col("copy_ts") >= F.col("origin_ts")) & (F.col("copy_ts") <= F.col("origin_ts") + F.expr(f"interval {minutes} minutes"))
    met = a.join(b, (F.col("__key") == F.col(key)) & near & (F.struct("origin_ts", "origin") < F.struct("copy_ts", "copy")))
    return met.select(key, "origin", "origin_ts", "copy", "copy_ts")


def predecessors(pairs: DataFrame) -> DataFrame:
    """Of the origins of each copy the last one."""
    best = pairs.groupBy("copy", "copy_ts").agg(F.max(F.struct("origin_ts", "origin")).alias("o"))
    return best.select("copy", F.col("o.origin").alias("origin"), (F.unix_seconds("copy_ts") - F.unix_seconds("o.origin_ts")).alias("gap_s"))


def event_windows(stream: DataFrame, ts: str, keys: list[str], length: str = "36 hours") -> DataFrame:
    return _timed(stream, ts).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "180 minutes") -> DataFrame:
    """Runs of sights with gaps under three hours."""
    return _timed(stream, ts).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """foreachBatch sink: appends rows whose keys aren't stored; replays of a batch append nothing."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(keys)
    try:
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def rate_violations(requests: DataFrame, host: str, ts: str, seconds: float = 1.0, tie: str | None = None) -> DataFrame:
    """Requests to a host sooner than allowed after the one before."""
    w = Window.partitionBy(host).orderBy(ts, *[tie] * bool(tie))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w)) / 1e6
    return requests.withColumn("gap_s", gap).where(F.col("gap_s") < seconds)


def drained(frame: DataFrame, name: str, mode: str, folder: str | None = None, key: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its result as a table (for tests and batch twins).

    Batches go to files of the shared folder, next to the stream's checkpoint:
    nothing passes through the driver. In append mode each batch has its part
    under its own number, so a replayed batch replaces itself; in complete mode
    the last batch is the result, in update mode the last row of each `key`.
    A stream run again under its name goes on from its checkpoint.
    """
    spark = frame.sparkSession
    root = f"{folder or shared_folder(spark)}/{name}"
    schema = frame.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        parts = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{root}/out")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if mode == "complete":
        last = parts.agg(F.max("batch")).first()[0]
        parts = parts.where(F.col("batch") == (-1 if last is None else last))
    if mode == "update":
        newest = F.max_by(F.struct(*frame.columns), "batch").alias("r")
        return parts.groupBy(F.col(key).alias("__key")).agg(newest).select("r.*")
    return parts.drop("batch")
