"""Queries that run the streams over files written from the test tables, in several micro-batches, with the SQL of what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.plans import calls, retention
from turnledger.session import shared_path, stored
from turnledger.sources import driver_views as V
from turnledger.streaming import events as live
from turnledger.streaming import states

Q: dict[str, tuple] = {}
#: Parts in which a table arrives, in the order of its ids.
PARTS = 3


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def arriving(rows: DataFrame, by: str) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream over a folder that has the first part of the rows by a number, and what brings the other parts, one after the other. A part is
    as many files as its rows have partitions, so a part must have been taken before the next one comes."""
    s, path = rows.sparkSession, shared_path(rows.sparkSession, "arriving")
    rows = stored(rows, "rows")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.least(F.lit(PARTS - 1), F.floor((F.col(by) - F.lit(low or 0)) * PARTS / F.lit(max(1, (high or 0) - (low or 0)))))
    come = [lambda k=k: rows.filter(part == k).write.mode("append").parquet(path) for k in range(PARTS)]
    come[0]()
    return s.readStream.schema(rows.schema).parquet(path), come[1:]


def steps(s: SparkSession, d: str) -> DataFrame:
    e = V.table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), (F.col("event_type") == "signup").alias("reset"), (F.col("event_type") != "error").alias("moves"))
    stream, later = arriving(e, "seq")
    return states.drained(states.step_epoch_state(stream), later=later).select("seq", "epoch", "step")


add("streamed_steps", steps, calls.Q["step_epochs"][1])


def ledger(s: SparkSession, d: str) -> DataFrame:
    """Overlapping windows in update mode: what the last batch of a window says."""
    requests = V.requests(s, d).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need it
    stream, later = arriving(requests, "id")
    found = states.drained(live.live_ledger(stream, "6 hours", "400 days", "2 hours"), "update", later)
    last = found.withColumn("k", F.row_number().over(Window.partitionBy("start", "model").orderBy(F.desc("batch")))).filter("k = 1")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "model", "requests", "occupancy")


add("streamed_sliding_ledger", ledger, retention.Q["sliding_ledger"][1])


def journal(s: SparkSession, d: str) -> DataFrame:
    """Events as raw deliveries, of which some cannot be parsed, through the sink that takes each batch once."""
    path = shared_path(s, "deliveries")
    e = V.table(s, d, "events")
    whole = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("session")))
    raw = e.select("event_id", F.when(F.col("event_id") % 17 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    stream, later = arriving(raw, "event_id")
    sink = states.journal_sink(path, "event_id string, kind string, session long")
    states.take_all(stream.select("value").writeStream.foreachBatch(sink), later)
    good, bad = states.journal_rows(s.read.parquet(path))
    return good.groupBy("kind").agg(F.count("*").alias("deliveries"), F.countDistinct("event_id").alias("events")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("deliveries"), F.countDistinct("value").alias("events")))


add("streamed_journal", journal, "select event_type as kind, count(*) as deliveries, count(distinct event_id) as events from events where event_id % 17 <> 0 group by 1 union all select 'bad', count(*), count(distinct left('{\"event_id\":\"e' || event_id || '\",\"kind\":\"' || event_type || '\"', 20)) from events where event_id % 17 = 0")
TTL = 20_000


def contents(s: SparkSession, d: str) -> DataFrame:
    """Documents as accesses to handles, a third of them stores; who asks is told whether the content is still there."""
    i = F.col("doc_id")
    a = V.table(s, d, "documents").select(F.concat_ws("-", "lang", (F.col("n_chars") % 9).cast("string")).alias("handle"), F.timestamp_seconds(1_700_000_000 + i * 1000).alias("ts"), (i % 3 != 0).alias("asks"), i.alias("at_id"))
    stream, later = arriving(a, "at_id")
    found = states.drained(states.live_contents(stream.drop("at_id"), TTL, "1 second"), later=later)
    asked = found.filter("status in ('found', 'expired', 'unknown')")
    return asked.groupBy("handle").agg(F.count("*").alias("asked"), F.sum((F.col("status") == "found").cast("bigint")).alias("found"))


add("streamed_contents", contents, f"""with a as (select lang || '-' || (n_chars % 9) as handle, doc_id * 1000 as t, doc_id % 3 <> 0 as asks from documents), b as (select *, max(case when not asks then t end) over (partition by handle order by t) as stored from a)
    select handle, count(*) as asked, count(*) filter (stored is not null and t - stored <= {TTL}) as found from b where asks group by 1""")
