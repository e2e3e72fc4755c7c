"""Read labels: which reads were needed for a later edit, for several windows in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a read shows that is no file's own content.
NO_FILE = ("search", "path_listing", "derived")


def to_events(rows: DataFrame) -> DataFrame:
    """The journal rows that labels rest on: reads that succeeded and edits, both with a path. A failed edit may still have changed its file."""
    return rows.filter("path is not null and (kind = 'edit' or (kind = 'read' and success))")


def classify_reads(events: DataFrame, windows: tuple[int, ...] = (2,), config: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each successful read and window: seq, stream, path, step, tokens, edit_seq, window, class, reason, distance.

    A read that shows no file's content, or raced with a change, is unknown. Without a later edit of its path it is verification within the
    window after an edit (unknown if that edit is unverified), else configuration where ``config`` says so of the path, else exploration. Before
    an edit it is a precondition if it is the latest one whose edit is verified, not of the same batch, of the same version and within the
    window; else unknown. The first later and last earlier edit do not depend on the window, so one shuffle serves all.
    """
    e = to_events(events)
    w = Window.partitionBy("stream", "path").orderBy("seq")
    edit = F.when(F.col("kind") == "edit", F.struct("seq", "step", "version", "status", "batch"))
    back = Window.partitionBy("stream", "path").orderBy(F.desc("seq"))  # Spark works frames that end at the last row out anew for each row
    e = e.withColumns({"later": F.last(edit, True).over(back.rowsBetween(Window.unboundedPreceding, -1)), "earlier": F.last(edit, True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    r = e.filter("kind = 'read'").withColumn("window", F.explode(F.array(*[F.lit(x) for x in windows]))).withColumn("distance", F.col("later.step") - F.col("step"))
    last, since = F.col("later").isNull(), F.col("earlier").isNotNull() & (F.abs(F.col("step") - F.col("earlier.step")) <= F.col("window"))
    reason = (
        F.when(F.col("representation").isin(*NO_FILE), "search_result").when(F.col("status") == "raced", "raced")
        .when(last & since & (F.col("earlier.status") == "unverified"), "prior_edit_unverified").when(last & since, "read_after_edit").when(last & (config(F.col("path")) if config else F.lit(False)), "config_path").when(last, "never_edited")
        .when(F.col("later.status") == "unverified", "unverified_version").when(F.col("batch") == F.col("later.batch"), "same_batch").when(F.col("version") != F.col("later.version"), "version_conflict").when(F.abs("distance") > F.col("window"), "outside_window").otherwise("candidate")
    )
    r = r.withColumn("reason", reason).withColumn("candidate", F.col("reason") == "candidate")
    best = Window.partitionBy("stream", "path", "window", F.col("later.seq"), "candidate").orderBy(F.desc("seq"))
    newest = F.row_number().over(best) == 1
    r = r.withColumn("reason", F.when(~F.col("candidate"), F.col("reason")).when(newest, "latest_eligible_read").otherwise("superseded_by_later_read"))
    kinds = {"latest_eligible_read": "precondition", "read_after_edit": "verification", "never_edited": "exploration", "config_path": "config"}
    kind = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in kinds.items()], F.lit("unknown"))
    return r.select("seq", "session", "stream", "path", "step", "tokens", F.col("later.seq").alias("edit_seq"), "window", kind.alias("class"), "reason", "distance")


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("window", "class", "reason").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"))


def window_sensitivity(labels: DataFrame, primary: int) -> DataFrame:
    """Reads by their class in the primary window and in each other one."""
    base = labels.filter(F.col("window") == primary).select("seq", F.col("class").alias("from_class"))
    return labels.filter(F.col("window") != primary).join(base, "seq").groupBy("window", "from_class", F.col("class").alias("to_class")).agg(F.count("*").alias("reads"))


def stable_preconditions(labels: DataFrame, n_windows: int) -> DataFrame:
    """Reads that are preconditions in every window."""
    return labels.filter("class = 'precondition'").groupBy("seq").agg(F.countDistinct("window").alias("n")).filter(F.col("n") == n_windows).select("seq")


def causal_distance(labels: DataFrame) -> DataFrame:
    d = labels.filter("class = 'precondition'")
    return d.groupBy("window").agg(F.count("*").alias("links"), F.round(F.percentile("distance", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("distance", F.lit(0.9)), 4).alias("p90"), F.round(F.percentile("distance", F.lit(0.95)), 4).alias("p95"), F.max("distance").alias("longest"))


def closed_streams(events: DataFrame) -> DataFrame:
    """A stream is closed when its session went on to a newer epoch."""
    s = events.select("session", "stream", F.element_at(F.split("stream", ":"), -1).cast("bigint").alias("epoch")).groupBy("session", "stream", "epoch").agg(F.count("*").alias("events"))
    return s.withColumn("closed", F.col("epoch") < F.max("epoch").over(Window.partitionBy("session"))).select("stream", "epoch", "events", "closed")


def censoring_bounds(labels: DataFrame, closed: DataFrame) -> DataFrame:
    """Exploration reads: certain (closed streams), and all that an open stream could still change."""
    r = labels.join(closed.select("stream", "closed"), "stream")
    hit = F.col("class") == "exploration"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return r.groupBy("window").agg(n(hit & F.col("closed")).alias("floor_reads"), n(hit).alias("after_reads"), n(hit | (~F.col("closed") & (F.col("class") == "unknown"))).alias("before_reads"), F.count("*").alias("reads"))


def opportunity_ceiling(labels: DataFrame) -> DataFrame:
    """Exploration tokens as a share of all read tokens: over everything, and mean and median over sessions."""
    s = labels.groupBy("window", "session").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("class") == "exploration", F.col("tokens")).otherwise(0)).alias("free")).withColumn("share", 100 * F.col("free") / F.nullif("tokens", F.lit(0)))
    return s.groupBy("window").agg(F.count("*").alias("sessions"), F.round(100 * F.sum("free") / F.sum("tokens"), 4).alias("micro"), F.round(F.avg("share"), 4).alias("macro_mean"), F.round(F.percentile("share", F.lit(0.5)), 4).alias("macro_median"), F.sum((F.col("share") > 10).cast("bigint")).alias("above_10"))


def bypass_rate(labels: DataFrame) -> DataFrame:
    n = labels.filter("class = 'exploration'")
    return n.groupBy("window", "path").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"))


def future_touches(events: DataFrame, k: int = 50) -> DataFrame:
    """Searches and the file events of the same stream that follow within ``k`` positions: an equi join on position blocks."""
    e = events.select("stream", "seq", "kind", "representation", "path")
    left = e.filter("representation = 'search'").select("stream", F.col("seq").alias("search_seq"), F.explode(F.array(F.expr(f"seq div {k}"), F.expr(f"seq div {k} + 1"))).alias("block"))
    right = e.filter("representation <> 'search'").select("stream", "seq", "path", F.expr(f"seq div {k}").alias("block"))
    return left.join(right, ["stream", "block"]).filter((F.col("seq") > F.col("search_seq")) & (F.col("seq") <= F.col("search_seq") + k)).groupBy("stream", "search_seq").agg(F.count("*").alias("touches"), F.countDistinct("path").alias("paths"))


def capture_integrity(events: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return events.groupBy("kind").agg(F.count("*").alias("events"), n(F.col("success")).alias("succeeded"), n(F.col("version").isNull()).alias("unversioned"), n(F.col("status") == "raced").alias("raced"), n(F.col("batch").isNotNull()).alias("batched"))
