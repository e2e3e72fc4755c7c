"""Journal work besides labels: pseudonyms, validation, counters, closure, telemetry by channel, and run measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.runs import numbered

#: Why a stream can be closed, and labels that a later edit could still change.
CLOSURE_REASONS = ("controlled_run_completed", "superseded_clear_epoch", "timeout", "aborted")
ABSENCE_DERIVED = ("never_edited", "read_after_edit", "prior_edit_unverified")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of each table."""
    out = None
    for name, table in tables.items():
        own = table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = own if out is None else out.unionByName(own)
    return out


def pseudonyms(events: DataFrame) -> DataFrame:
    """(stream, pseudonym): ``stream_001`` and so on, by the first event of each stream."""
    streams = events.filter("stream is not null").groupBy("stream").agg(F.min("seq").alias("first_seq"))
    n = F.col("place") + 1
    return numbered(streams, "first_seq", "stream").select("stream", F.concat(F.lit("stream_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))).alias("pseudonym"))


def rejected_events(events: DataFrame) -> DataFrame:
    """(id, problem) of events that must not be taken: a closure reason that is none of the fixed ones, or a producer key (source_system,
    stream, source_event_key) that is given in part or blank."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    keyed = F.col("source_event_key").isNotNull()
    problem = (
        F.when(F.col("closure_reason").isNotNull() & ~F.col("closure_reason").isin(*CLOSURE_REASONS), "closure_reason").when(keyed & blank("source_event_key"), "empty_key")
        .when(keyed & blank("source_system"), "no_source_system").when(keyed & blank("stream"), "no_stream")
    )
    return events.select("id", problem.alias("problem")).filter("problem is not null")


def require_valid(events: DataFrame) -> DataFrame:
    """``events``, which fail where they are read if one of them is rejected."""
    bad = rejected_events(events)
    marked = events.join(bad, "id", "left")
    fine = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("rejected event: "), F.col("problem"))).cast("boolean"))
    return marked.filter(fine).drop("problem")


def provisional_reads(labels: DataFrame, closures: DataFrame) -> DataFrame:
    """(seq, window, provisional): whether an edit not yet seen could change the label. ``closures``: stream, closed, closed_at_seq."""
    r = labels.join(closures.select("stream", "closed", "closed_at_seq"), "stream", "left")
    still = ~F.coalesce("closed", F.lit(False)) | F.coalesce(F.col("seq") > F.col("closed_at_seq"), F.lit(False))
    return r.select("seq", "window", (F.col("reason").isin(*ABSENCE_DERIVED) & still).alias("provisional"))


def step_epochs(events: DataFrame) -> DataFrame:
    """(seq, epoch, step) of events (session, seq, reset, moves): epochs count the resets of a session, steps the moves within an epoch."""
    w = Window.partitionBy("session").orderBy("seq")
    e = events.withColumn("epoch", F.sum(F.col("reset").cast("bigint")).over(w))
    return e.select("seq", "epoch", F.sum(F.col("moves").cast("bigint")).over(Window.partitionBy("session", "epoch").orderBy("seq")).alias("step"))


def reads_by_channel(reads: DataFrame) -> DataFrame:
    """Per channel and representation: reads, tokens of the payload, tokens sent, and what sending added."""
    added = F.greatest(F.lit(0), F.col("transport_tokens") - F.col("payload_tokens"))
    return reads.groupBy("channel", "representation").agg(F.count("*").alias("reads"), F.sum("payload_tokens").alias("payload_tokens"), F.sum("transport_tokens").alias("transport_tokens"), F.sum(added).alias("overhead"))


def run_metrics(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Per session: all tokens, turns, reads of a file read before, repeated searches, and calls that expand a handle."""
    usage = requests.groupBy("session").agg(F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("total"), F.count("*").alias("turns"))
    again = events.filter("kind = 'read' and path is not null").groupBy("session", "representation", "path").agg((F.count("*") - 1).alias("again"))
    g = again.groupBy("session").agg(F.sum(F.when(F.col("representation") == "file", F.col("again")).otherwise(0)).alias("rereads"), F.sum(F.when(F.col("representation") == "search", F.col("again")).otherwise(0)).alias("repeat_searches"))
    asked = events.groupBy("session").agg(count_if(F.col("kind") == "expand").alias("expansions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return usage.join(g, "session", "left").join(asked, "session", "left").select("session", "total", "turns", zero("rereads"), zero("repeat_searches"), zero("expansions"))


def engagement(events: DataFrame, few_reads: int = 1) -> DataFrame:
    """One row over all sessions as runs: how many changed nothing, did next to nothing, or worked, and the median reads."""
    s = events.groupBy("session").agg(count_if((F.col("kind") == "read") & F.col("success")).alias("reads"), count_if((F.col("kind") == "edit") & F.col("success")).alias("edits"))
    empty = F.col("edits") == 0
    return s.agg(F.count("*").alias("runs"), count_if(empty).alias("empty_runs"), count_if(empty & (F.col("reads") <= few_reads)).alias("degenerate"), count_if(~empty).alias("engaged"), F.round(F.percentile("reads", F.lit(0.5)), 4).alias("median_reads"))


def search_heavy(events: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` sessions with most tokens of search results."""
    g = events.filter("representation = 'search'").groupBy("session").agg(F.sum("tokens").alias("search_tokens")).filter("search_tokens > 0")
    return g.orderBy(F.desc("search_tokens"), "session").limit(k)


def opportunity_probe(reads: DataFrame, signatures: DataFrame) -> DataFrame:
    """(seq, opportunity, tokens, signature_tokens, avoidable): reads (seq, path, tokens, edited) with what a view of the signatures
    (path, est_tokens) would cost instead; edited files and files without signatures are none."""
    cost = signatures.groupBy("path").agg(F.sum("est_tokens").alias("signature_tokens"))
    r = reads.join(cost, "path", "left")
    kind = F.when(F.col("signature_tokens").isNull(), "no_signatures").when(F.col("edited"), "edited").when(F.col("signature_tokens") >= F.col("tokens"), "no_gain").otherwise("opportunity")
    return r.select("seq", kind.alias("opportunity"), "tokens", F.coalesce("signature_tokens", F.lit(0)).alias("signature_tokens"), F.when(kind == "opportunity", F.col("tokens") - F.col("signature_tokens")).otherwise(0).alias("avoidable"))


def opportunity_dashboard(reads: DataFrame) -> DataFrame:
    """Per session of reads (session, seq, path, channel, opportunity, avoidable): reads, opportunities, how many were used (read through
    symbols) or not, tokens avoided and missed, and plain reads of a path right after a symbol read of it (retries)."""
    w = Window.partitionBy("session", "path").orderBy("seq")
    r = reads.withColumn("before", F.lag("channel").over(w))
    chance, used = F.col("opportunity") == "opportunity", F.col("channel") == "symbol"
    spare = lambda c: F.sum(F.when(c, F.col("avoidable")).otherwise(0))
    return r.groupBy("session").agg(F.count("*").alias("reads"), count_if(chance).alias("opportunities"), count_if(chance & used).alias("used"), count_if(chance & ~used).alias("fallbacks"), spare(chance & used).alias("tokens_avoided"), spare(chance & ~used).alias("tokens_missed"), count_if(~used & (F.col("before") == "symbol")).alias("retries"))
