"""Experiment runs: verdicts, arms, shards and policy decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored


def grading_summary(runs: DataFrame) -> DataFrame:
    """Per stratum: runs, resolved, grader errors (no verdict)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = runs.groupBy("stratum").agg(F.count("*").alias("runs"), n(F.col("resolved")).alias("resolved_runs"), n(F.col("resolved").isNull()).alias("grader_errors"))
    return g.withColumn("success_rate", F.round(100 * F.col("resolved_runs") / F.nullif(F.col("runs") - F.col("grader_errors"), F.lit(0)), 2))


def runs_with_verdicts(index: DataFrame, verdicts: DataFrame, empty: DataFrame) -> DataFrame:
    """Runs (task_id, stratum, arm, ...) with ``outcome``: resolved or unresolved as graded; empty_patch where there was nothing to grade,
    which is a result; grader_error where a verdict is missing."""
    r = index.join(verdicts.select("task_id", "resolved"), "task_id", "left").join(empty.select("task_id", F.lit(True).alias("nothing")), "task_id", "left")
    return r.withColumn("outcome", F.when(F.col("resolved"), "resolved").when(F.col("resolved").isNotNull(), "unresolved").when(F.col("nothing"), "empty_patch").otherwise("grader_error")).drop("nothing")


def arm_means(runs: DataFrame) -> DataFrame:
    """Means by (arm) and (stratum, arm) in one pass."""
    return runs.groupingSets([["arm"], ["stratum", "arm"]], "stratum", "arm").agg(F.count("*").alias("runs"), F.round(F.avg("total"), 4).alias("mean_total"), F.max("total").alias("max_total"))


def compare_arms(runs: DataFrame, arms: tuple[str, str]) -> DataFrame:
    a, b = arms
    m = runs.groupBy("stratum").pivot("arm", [a, b]).agg(F.avg("total"))
    return m.select("stratum", F.round(a, 4).alias("base"), F.round(b, 4).alias("other"), F.round(100 * (F.col(b) - F.col(a)) / F.col(a), 4).alias("delta_percent"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in this order: range partitions and their sizes give it, not one global window."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m"))
    placed = stored(parts, "ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.col("m") - F.shiftleft(F.col("part").cast("bigint"), 33)
    return placed.join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside).drop("part", "m", "before")  # one row for each range


def shard_assignment(ids: DataFrame, n: int) -> DataFrame:
    """Rank of sorted ids modulo ``n``."""
    return numbered(ids.select("id").distinct(), "id").select("id", (F.col("place") % n).alias("shard"))


def policy_decisions(calls: DataFrame, floor: int = 400) -> DataFrame:
    """pass, recommend, reduce or deny for each call; edits always pass."""
    kind = F.when(F.col("kind") == "edit", "pass").when(~F.col("success"), "pass").when(F.col("representation") == "search", F.when(F.col("tokens") >= floor, "reduce").otherwise("pass")).when(F.col("status") == "raced", "deny").when(F.col("tokens") >= floor, "recommend").otherwise("pass")
    reason = F.when(F.col("kind") == "edit", "edit").when(~F.col("success"), "failed_call").when(F.col("representation") == "search", F.when(F.col("tokens") >= floor, "large_search").otherwise("small_search")).when(F.col("status") == "raced", "unstable").when(F.col("tokens") >= floor, "large_read").otherwise("small_read")
    return calls.select("seq", "session", "tokens", kind.alias("decision"), reason.alias("reason"))


def policy_dashboard(decisions: DataFrame) -> DataFrame:
    n = lambda d: F.sum(F.when(F.col("decision") == d, 1).otherwise(0)).alias(f"n_{d}")
    return decisions.groupBy("session").agg(F.count("*").alias("calls"), n("pass"), n("recommend"), n("reduce"), n("deny"), F.sum(F.when(F.col("decision") == "reduce", F.col("tokens")).otherwise(0)).alias("tokens_reducible"))
