"""Context retirement: when objects became obsolete, and what retiring them would have saved."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.session import ship_package


def obsolescence(objects: DataFrame) -> DataFrame:
    """Adds superseded_at (turn of the next object with the key; null: an abandoned tail) and last_turn."""
    w = Window.partitionBy("session", "key").orderBy("pos")
    return objects.withColumns({"superseded_at": F.lead("turn").over(w), "last_turn": F.max("turn").over(Window.partitionBy("session"))})


def retirement_ceiling(obsolete: DataFrame) -> DataFrame:
    """For each session, token-turns that retirement could save: of superseded objects, and with tails from the next turn on."""
    spare = lambda t: F.col("size") * F.greatest(F.lit(0), F.col("last_turn") - t)
    provable = F.when(F.col("superseded_at").isNotNull(), spare(F.col("superseded_at"))).otherwise(0)
    return obsolete.groupBy("session").agg(F.count("*").alias("objects"), F.sum(spare(F.col("turn"))).alias("resident"), F.sum(provable).alias("provable"), F.sum(F.coalesce(provable, F.lit(0)) + F.when(F.col("superseded_at").isNull(), spare(F.col("turn") + 1)).otherwise(0)).alias("with_tail"))


def retirement_relief(obsolete: DataFrame, reads: DataFrame, include_tail: bool = False) -> DataFrame:
    """What retiring each object at once would relieve, for each session: turns, objects, retired, gross (token-turns), percent_of_reads (of the
    session's cache reads; reads: session, cache_read), peak_resident, peak_relief_percent and mean_relief (tokens a turn).

    Objects go when they are superseded, abandoned tails only with ``include_tail``, from the turn after theirs. Both what is resident and what
    could be gone only grow from turn to turn, so both peaks are at the last turn, and the mean is a sum over objects: no turn becomes a row.
    """
    turns, goes = F.col("last_turn"), F.col("superseded_at")
    goes = F.coalesce(goes, F.col("turn") + 1) if include_tail else goes
    size, gone = F.col("size"), goes.isNotNull()
    by_then = F.when(gone, size * (turns - F.greatest(F.least(goes, turns), F.lit(1)) + 1)).otherwise(0)
    g = obsolete.groupBy("session").agg(F.max("last_turn").alias("turns"), F.count("*").alias("objects"), F.sum(gone.cast("bigint")).alias("retired"), F.sum(F.when(gone, size * F.greatest(F.lit(0), turns - goes)).otherwise(0)).alias("gross"), F.sum("size").alias("peak_resident"), F.sum(F.when(gone, size).otherwise(0)).alias("peak_relief"), F.sum(by_then).alias("relief"))
    r = g.join(reads.groupBy("session").agg(F.sum("cache_read").alias("cache_read")), "session", "left")
    share = lambda a, b: F.round(100 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)
    return r.select("session", "turns", "objects", "retired", "gross", share("gross", "cache_read").alias("percent_of_reads"), "peak_resident", share("peak_relief", "peak_resident").alias("peak_relief_percent"), F.round(F.col("relief") / F.nullif(F.col("turns"), F.lit(0)), 4).alias("mean_relief"))


def rewritten_suffix(o: DataFrame) -> DataFrame:
    """(session, batch, rewritten): what each batch makes the cache write again: tokens of objects after the first object that the
    batch removes, in the context by then and not removed by then. ``o``: session, pos, turn, size, batch (null: never removed).

    What is in the context by a turn, and what lies before an object, are running sums. What of the rest is gone by then is a sum over
    two bounds (place after the first removed, batch not later): each object counts in its dyadic blocks of places, and a batch reads
    the few blocks that make up "after", each by a running sum over batches. No batch meets the objects of its session one by one.
    """
    by_place = Window.partitionBy("session").orderBy("pos")
    o = o.select("session", "turn", "size", "batch", F.row_number().over(by_place).alias("place"), F.sum("size").over(by_place.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.count("*").over(Window.partitionBy("session")).alias("objects"))
    first = o.filter("batch is not null").groupBy("session", "batch").agg(F.min("place").alias("place"), F.min("upto").alias("upto"), F.max("objects").alias("objects"))
    arrived = o.select("session", F.col("turn").alias("at"), "size", F.lit(None).cast("bigint").alias("batch")).unionByName(first.select("session", F.col("batch").alias("at"), F.lit(0).alias("size"), F.col("batch").cast("bigint").alias("batch")))
    arrived = arrived.withColumn("held", F.sum("size").over(Window.partitionBy("session").orderBy("at"))).filter("batch is not null").select("session", "batch", "held")
    levels = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("objects") + 1)).cast("int"))).alias("level")
    gone = o.filter("batch is not null").select("session", "batch", "size", "place", levels).select("session", "level", F.expr("shiftright(place, level)").alias("block"), "batch", "size", F.lit(False).alias("asks"))
    asked = first.select("session", "batch", "place", levels).withColumn("block", F.expr("shiftright(place + shiftleft(1, level), level)")).filter("block % 2 = 1")
    both = gone.unionByName(asked.select("session", "level", "block", "batch", F.lit(0).alias("size"), F.lit(True).alias("asks")))
    left = both.withColumn("left", F.sum("size").over(Window.partitionBy("session", "level", "block").orderBy("batch"))).filter("asks").groupBy("session", "batch").agg(F.sum("left").alias("left"))
    return first.join(arrived, ["session", "batch"]).join(left, ["session", "batch"], "left").select("session", "batch", (F.col("held") - F.col("upto") - F.coalesce("left", F.lit(0))).alias("rewritten"))


def every_turns(obsolete: DataFrame, every: int = 10) -> DataFrame:
    """Adds ``batch``: objects go at the next multiple of ``every``, at the last turn at the latest."""
    return obsolete.withColumn("batch", F.when(F.col("superseded_at").isNotNull(), F.least(F.col("last_turn"), F.greatest(F.lit(every), F.ceil(F.col("superseded_at") / every) * every))))


def once_at_end(obsolete: DataFrame) -> DataFrame:
    """Adds ``batch``: all that is obsolete by the last turn but one goes there."""
    at = F.greatest(F.col("last_turn") - 1, F.lit(1))
    return obsolete.withColumn("batch", F.when(F.col("superseded_at") <= at, at))


def full_turns(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """(session, event): turns at which ``tokens`` have come together since the one before; rows (session, turn, size) by session and turn."""
    session, held = None, 0
    for batch in batches:
        hits = []
        for k, (own, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if own != session:
                session, held = own, 0
            held += size or 0
            if held >= tokens:
                hits.append(k)
                held = 0
        if hits:
            found = batch.take(pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["session", "event"])


def at_threshold(obsolete: DataFrame, tokens: int = 20_000) -> DataFrame:
    """Adds ``batch``: objects go when ``tokens`` have become obsolete since the batch before, and what is left at the last turn. The
    turns of the batches come from one pass over each session's obsolete tokens by turn, which holds two numbers."""
    ship_package(obsolete.sparkSession)
    turns = obsolete.filter("superseded_at is not null").groupBy("session", F.col("superseded_at").cast("bigint").alias("turn")).agg(F.sum("size").cast("bigint").alias("size"))
    ordered = turns.repartition("session").sortWithinPartitions("session", "turn")
    events = ordered.mapInArrow(lambda batches: full_turns(batches, tokens), T.StructType([turns.schema["session"], T.StructField("event", T.LongType())]))
    following = Window.partitionBy("session").orderBy(F.desc("by")).rangeBetween(Window.unboundedPreceding, 0)  # backwards: one pass
    both = obsolete.withColumns({"by": F.coalesce("superseded_at", F.lit(-1)), "event": F.lit(None).cast("bigint")}).unionByName(events.select("session", F.col("event").alias("by"), "event"), allowMissingColumns=True)
    placed = both.withColumn("next", F.min("event").over(following)).filter("pos is not null")
    return placed.withColumn("batch", F.when(F.col("superseded_at").isNotNull(), F.coalesce("next", "last_turn"))).drop("by", "event", "next")


def batched_retirement(obsolete: DataFrame, every: int = 10) -> DataFrame:
    """Retiring once in ``every`` turns: gross saving and the suffix that the batches rewrite, per session."""
    o = every_turns(obsolete, every)
    gross = o.filter("batch is not null").groupBy("session").agg(F.sum(F.col("size") * (F.col("last_turn") - F.col("batch"))).alias("gross"))
    suffix = rewritten_suffix(o).groupBy("session").agg(F.sum("rewritten").alias("rewritten"))
    return gross.join(suffix, "session").select("session", "gross", "rewritten")


def retirement_costs(batched: DataFrame, read: float = 0.1, write: float = 1.25) -> DataFrame:
    """Per session with anything removed (``batched``: objects with ``batch``): batches, objects removed, gross token-turns, tokens
    written again, and the net in prices relative to input tokens."""
    gone = batched.filter("batch is not null")
    gross = gone.groupBy("session").agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("removed"), F.sum(F.col("size") * F.greatest(F.col("last_turn") - F.col("batch"), F.lit(0))).alias("gross"))
    suffix = rewritten_suffix(batched).groupBy("session").agg(F.sum("rewritten").alias("rewritten"))
    net = F.round(read * F.col("gross") - (write - read) * F.col("rewritten"), 4)
    return gross.join(suffix, "session").select("session", "batches", "removed", "gross", "rewritten", net.alias("cost_net"))


def retire_turns(obsolete: DataFrame, lag: int = 5) -> DataFrame:
    """Adds ``retired``: superseded objects go when they are replaced, last versions ``lag`` turns after they came."""
    return obsolete.withColumn("retired", F.coalesce("superseded_at", F.col("turn") + lag))


def deferral(reads: DataFrame, retired: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Per session and threshold that the context (reads: session, turn, cache_read) crosses: the first turn over it, the first with
    retired objects (session, retired, size) taken out, and by how many turns that is later (to the last turn if never)."""
    last = reads.groupBy("session").agg(F.max("turn").alias("last_turn"))
    both = reads.select("session", "turn", "cache_read", F.lit(0).alias("size")).unionByName(retired.select("session", F.col("retired").alias("turn"), F.lit(None).cast("bigint").alias("cache_read"), "size"))
    r = both.withColumn("gone", F.sum("size").over(Window.partitionBy("session").orderBy("turn"))).filter("cache_read is not null")
    r = r.withColumns({"left": F.greatest(F.col("cache_read") - F.col("gone"), F.lit(0)), "threshold": F.explode(F.array(*[F.lit(t) for t in thresholds]))})
    at = lambda c: F.min(F.when(F.col(c) > F.col("threshold"), F.col("turn")))
    k = r.groupBy("session", "threshold").agg(at("cache_read").alias("native_turn"), at("left").alias("retired_turn")).filter("native_turn is not null").join(last, "session")
    return k.select("session", "threshold", "native_turn", "retired_turn", F.col("retired_turn").isNull().alias("avoided"), (F.coalesce("retired_turn", "last_turn") - F.col("native_turn")).alias("deferral"))


def unique_savings(retired: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per session: token-turns that retirement saves alone, and those it saves before the session's own next reset (boundaries: session,
    turn) would have done it. ``retired``: session, turn, size, last_turn, retired."""
    r = retired.filter("retired < last_turn")
    marks = boundaries.select("session", "turn", F.col("turn").alias("reset"))
    both = r.select("session", "turn", "size", "last_turn", "retired", F.lit(None).cast("bigint").alias("reset")).unionByName(marks.select("session", "turn", "reset"), allowMissingColumns=True)
    after = Window.partitionBy("session").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)  # backwards: one pass
    r = both.withColumn("next", F.min("reset").over(after)).filter("retired is not null")
    until = F.least(F.coalesce("next", "last_turn"), F.col("last_turn"))
    return r.groupBy("session").agg(F.sum(F.col("size") * (F.col("last_turn") - F.col("retired"))).alias("standalone"), F.sum(F.col("size") * F.greatest(until - F.col("retired"), F.lit(0))).alias("unique_saving"))


def turn_buckets(ceiling: DataFrame, edges: tuple[int, ...] = (40, 60, 100)) -> DataFrame:
    bucket = sum((F.when(F.col("objects") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return ceiling.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("sessions"), F.round(F.avg(100 * F.col("provable") / F.nullif("resident", F.lit(0))), 4).alias("provable_share"))


def retired_cumulative(obsolete: DataFrame) -> DataFrame:
    """Running obsolete tokens by the turn at which they became so."""
    d = obsolete.filter("superseded_at is not null").groupBy("session", F.col("superseded_at").alias("turn")).agg(F.sum("size").alias("retired"))
    return d.withColumn("retired_so_far", F.sum("retired").over(Window.partitionBy("session").orderBy("turn")))


def first_crossing(cumulative: DataFrame, thresholds: tuple[int, ...] = (1000, 5000, 20000)) -> DataFrame:
    c = cumulative.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter("retired_so_far > threshold")
    return c.groupBy("session", "threshold").agg(F.min("turn").alias("turn"))
