"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.streaming.states import step_epoch_state  # noqa: F401 - one of these twins


def live_ledger(requests: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Occupancy by model in windows of event time, tumbling or, with ``slide``, overlapping: a request then counts in every window that covers it.
    Rows later than ``late`` are left out. On a table, the batch twin: nothing is late."""
    windows = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = requests.withWatermark("ts", late).groupBy(windows, "model").agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write")).alias("occupancy"))
    return g.select(F.col("window.start").alias("start"), "model", "requests", "occupancy")


def live_sessions(requests: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    return requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("requests")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "session", "requests")


def dedupe(deliveries: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """A key, of one column or several, is taken once within the watermark; rows that lack a part of it pass."""
    d, whole = deliveries.withWatermark("ts", late), F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    return d.filter(whole).dropDuplicatesWithinWatermark(list(keys)).unionByName(d.filter(~whole))


def pair_pre_post(pre: DataFrame, post: DataFrame, late: str = "10 minutes", band: str = "1 hour") -> DataFrame:
    """Calls with their results; a call without one comes out, as pending, when the watermark has passed."""
    a = pre.select(F.col("tool_use_id").alias("call_id"), F.col("ts").alias("pre_ts"), F.col("digest").alias("pre_digest")).withWatermark("pre_ts", late)
    b = post.select(F.col("tool_use_id").alias("result_id"), F.col("ts").alias("post_ts"), F.col("digest").alias("post_digest")).withWatermark("post_ts", late)
    both = a.join(b, F.expr(f"call_id = result_id and post_ts >= pre_ts and post_ts <= pre_ts + interval {band}"), "leftOuter")
    state = F.when(F.col("result_id").isNull(), "pending").when(F.col("pre_digest").isNull() | F.col("post_digest").isNull(), "unverified").when(F.col("pre_digest") == F.col("post_digest"), "stable").otherwise("raced")
    return both.withColumn("version_status", state)


def counters(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "metric").count()


def good_and_bad(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed deliveries, and those that cannot be parsed (value), for a sink of their own. A bad one leaves its neighbours alone."""
    parsed = raw.withColumn("delivery", F.from_json("value", f"{schema}, broken_delivery string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_delivery"}))
    bad = F.col("delivery.broken_delivery").isNotNull() | F.col("delivery").isNull()
    return parsed.filter(~bad).select("delivery.*").drop("broken_delivery"), parsed.filter(bad).select("value")


def expire_content(accesses: DataFrame, ttl: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(handle, first_seen, expired_at, accesses) once nobody has asked for a handle for ``ttl``: a session window that has closed."""
    w = accesses.withWatermark("ts", late).groupBy(F.session_window("ts", ttl), "handle").agg(F.count("*").alias("accesses"))
    return w.select("handle", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("expired_at"), "accesses")
