"""Streams with state of their own (RocksDB, timers), and a sink that takes each batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from turnledger.session import shared_path, use_state_store


class StepsAndEpochs(StatefulProcessor):
    """State of a stream of events: its epoch and its step in it. A batch's events are counted at once, by running sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("place", "epoch long, step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(rows)).sort_values("seq", kind="stable")
        epoch, step = self.state.get() or (0, 0)
        reset, moved = e["reset"].to_numpy(dtype=bool), np.cumsum(e["moves"].to_numpy(dtype=np.int64))
        last = np.maximum.accumulate(np.where(reset, np.arange(len(e)), -1))  # the row of the latest reset
        steps = np.where(last >= 0, moved - (moved - e["moves"].to_numpy(dtype=np.int64))[np.maximum(last, 0)], moved + step)
        epochs = epoch + np.cumsum(reset)
        self.state.update((int(epochs[-1]), int(steps[-1])))
        out = e.drop(columns=["reset", "moves"])
        out["epoch"], out["step"] = epochs, steps
        yield out

    def close(self) -> None:
        pass


def step_epoch_state(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, epoch, step) of a stream (session, seq, reset, moves): a reset starts a new epoch, a move is a step. A state is two counters for
    each value of the keys (by default each session). A batch's events are taken in order of ``seq``; one that comes in a later batch than its
    successors is counted when it comes. The batch twin is ``journal.step_epochs``."""
    use_state_store(events.sparkSession)
    keys = keys or ("session",)
    rows = events.select(*keys, "seq", F.coalesce("reset", F.lit(False)).alias("reset"), F.coalesce(F.col("moves").cast("int"), F.lit(0)).alias("moves"))
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (*keys, "seq"))
    return rows.groupBy(*keys).transformWithStateInPandas(StepsAndEpochs(), f"{kinds}, epoch long, step long", "Append", "None")


class LiveContents(StatefulProcessor):
    """State of a handle: when it was stored last. A timer removes it once it is too old."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(rows)).sort_values(["at", "asks"], kind="stable")  # what is stored at a time can be asked for at that time
        held = self.created.get()
        at, asks = e["at"].to_numpy(dtype=np.int64), e["asks"].to_numpy(dtype=bool)
        latest = np.maximum.accumulate(np.where(asks, np.iinfo(np.int64).min, at))  # the latest storing up to each row
        latest = np.maximum(latest, held[0]) if held else latest
        known = latest > np.iinfo(np.int64).min
        age = np.where(known, at - np.where(known, latest, 0), 0)
        status = np.where(~asks, "stored", np.where(~known, "unknown", np.where(age > self.ttl, "expired", "found")))
        if known[-1] and (not held or latest[-1] > held[0]):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.created.update((int(latest[-1]),))
            self.handle.registerTimer(int(latest[-1]) + self.ttl + 1)
        yield pd.DataFrame({"handle": key[0], "at": at, "status": status, "age": np.where(known, age, -1)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.created.clear()
        yield pd.DataFrame({"handle": [key[0]], "at": [expiredTimerInfo.getExpiryTimeInMs()], "status": ["removed"], "age": [self.ttl + 1]})

    def close(self) -> None:
        pass


def live_contents(accesses: DataFrame, ttl_seconds: int = 24 * 3600, late: str = "1 hour") -> DataFrame:
    """(handle, at in milliseconds, status, age in milliseconds) of a stream (handle, ts, asks): rows that ask find what was stored up to then (found),
    too old (expired) or nothing (unknown); rows that do not ask store it (stored) and begin its time anew. Once the watermark has passed a handle's
    time, it is removed from the state, which says so once (removed); who asks later finds nothing."""
    use_state_store(accesses.sparkSession)
    rows = accesses.select("handle", "ts", F.unix_millis("ts").alias("at"), "asks").withWatermark("ts", late)
    kind = accesses.schema["handle"].dataType.simpleString()
    return rows.groupBy("handle").transformWithStateInPandas(LiveContents(ttl_seconds), f"handle {kind}, at long, status string, age long", "Append", "EventTime")


def journal_sink(path: str, schema: str, key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` over raw deliveries (value): a batch's good and bad rows are written by one job into one folder named by the
    batch, so they are there together or not at all, and a batch that comes again replaces itself. A ``key`` that occurs twice, in the batch or in
    an earlier one, is an error: nothing of the batch is written and the query stops. Reads only the keys of the earlier batches.

    The folder holds the columns of ``schema`` and ``bad`` (the raw delivery where it could not be parsed); read it with ``journal_rows``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = batch.select("value", F.from_json("value", f"{schema}, broken_delivery string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_delivery"}).alias("d")).persist()
        try:
            bad = F.col("d").isNull() | F.col("d.broken_delivery").isNotNull()
            rows = parsed.select(F.when(~bad, F.col("d")).alias("d"), F.when(bad, F.coalesce("value", F.lit(""))).alias("bad")).select("d.*", "bad").drop("broken_delivery")
            own = rows.filter(f"bad is null and {key} is not null").select(key)
            again = own.groupBy(key).count().filter("count > 1").select(key)
            try:
                earlier = spark.read.parquet(path).filter(F.col("batch") != number).select(key)
            except AnalysisException:  # nothing there yet
                earlier = None
            if earlier is not None:
                again = again.unionByName(own.join(earlier, key, "left_semi"))
            first = again.first()
            if first is not None:
                raise ValueError(f"{key} {first[0]!r} comes a second time")
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            parsed.unpersist()

    return write


def take_all(writer: DataStreamWriter, later: Sequence[Callable[[], None]] = (), spark: SparkSession | None = None) -> None:
    """Runs a query over all that is there now, then goes on with it after each of the deliveries that come ``later``."""
    writer = writer.trigger(availableNow=True).option("checkpointLocation", shared_path(spark or SparkSession.active(), "checkpoint"))
    writer.start().awaitTermination()
    for come in later:
        come()
        writer.start().awaitTermination()


def drained(stream: DataFrame, mode: str = "append", later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Runs a stream over all that is there now, and over what comes ``later``, and gives what it wrote, with the number of the batch (batch): each
    batch is a folder of its own in the shared folder, which a repeated batch overwrites. In mode update, a key's row of the latest batch is the valid one."""
    spark = stream.sparkSession
    at = shared_path(spark, "drained")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/batch=-1")
    take_all(stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/batch={n}")).outputMode(mode), later, spark)
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(at)


def journal_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows of a journal folder, and the raw bad deliveries (value)."""
    return rows.filter("bad is null").drop("bad"), rows.filter("bad is not null").select(F.col("bad").alias("value"))
