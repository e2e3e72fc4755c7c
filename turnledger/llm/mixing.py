"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

1. Each source's documents are shuffled by a hash of their ids and wait in the source's queue, once for every copy that its target can
   need. A document enters as packets of at most ``QUANTUM`` words, so that a long one cannot hold up the others or overshoot a target.
2. A packet's virtual finish time is the number of its source's words up to its end, divided by the source's weight. The words
   before a document come from sums over even blocks of the shuffle, so a hot source is spread over as many tasks as its size needs.
3. All packets are range-sorted by finish time; the sums of the ranges give every packet its place in the mix, which ends at the
   budget. A source that has given all its copies drops out of the queue and the others go on by weight: these are the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.text import SPACE
from turnledger.operators.runs import numbered
from turnledger.session import stored

#: Weights of the sources in their order, repeating, and the copies of a document that a mix may take.
WEIGHTS, COPIES = (1, 2, 3), 3
#: Most words of a packet.
QUANTUM = 256
#: Rows of one block of a source's queue, and of one range of the sorted packets (about).
BLOCK_ROWS = 1_000_000
#: Bits of the number that shuffles a document, and the low ones that a block ignores.
HASH_BITS, LOW_BITS = 60, 30


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """(row, doc_id, source, source_key, size, h, tie), stored: the words of each row and its place in the shuffle."""
    ident, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # never null, as joins need it
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("doc_id"), F.col(source_col).alias("source"), key.alias("source_key"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"), F.xxhash64(text).alias("tie"))
    return stored(rows, "sizes")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = COPIES) -> DataFrame:
    """(source_key, source_size, weight, target) of each source of ``sized``'s rows.

    Sources take the weights in the order of their code points, a null source last. Their targets share the sum of all sizes by weight,
    none beyond ``most`` times its source's size: sources over that bound are closed and what they leave goes to the open ones, by
    weight, until no more close. Each round is one sum over the sources. Empty sources have target 0.
    """
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    each = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(numbered(sizes, "missing", "source").select("source_key", "source_size", each.alias("weight")), "sources")
    cap, level, closed = most * F.col("source_size"), 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        shut = cap <= F.col("weight") * level
        now = sources.agg(F.coalesce(F.sum(F.when(shut, 1)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(shut, cap)), F.lit(0)).alias("words"), F.sum(F.when(~shut, F.col("weight"))).alias("open")).first()
        if now["n"] == closed or not now["open"]:
            return sources.withColumn("target", F.when(shut, cap.cast("double")).otherwise(F.col("weight") * level))
        closed, level = now["n"], (total - now["words"]) / now["open"]


def packets(rows: DataFrame, targets: DataFrame, quantum: int = QUANTUM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, doc_id, source, source_key, size, source_size, target, h, copy, packet, words, finish): all that waits in the queues. A document without words
    is one empty packet."""
    blocks = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.withColumn("block", F.shiftright(F.shiftright("h", LOW_BITS) * blocks, HASH_BITS - LOW_BITS))
    inside = Window.partitionBy("source_key", "block").orderBy("h", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    sums = placed.groupBy("source_key", "block").agg(F.sum("size").alias("block_size")).withColumn("ahead", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    sums = sums.join(targets, "source_key").select("source_key", "block", "ahead", "source_size", "weight", "target")
    queued = placed.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source_key", "block"])
    copies = F.greatest(F.lit(1), F.ceil(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / quantum))
    each = queued.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(copies, F.lit(1)).cast("long") - 1)))
    each = each.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    end = F.least(F.col("size"), (F.col("packet") + 1) * quantum)
    finish = (F.col("copy") * F.col("source_size") + F.col("ahead") + F.col("upto") - F.col("size") + end) / F.col("weight")
    return each.select("row", "doc_id", "source", "source_key", "size", "source_size", "target", "h", "copy", "packet", (end - F.col("packet") * quantum).alias("words"), finish.alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = COPIES, quantum: int = QUANTUM, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """All packets with their place in the mix: row, doc_id, source, size, source_size, target, copy (from 0), start (the packet's first word in
    its document), words, finish, position (words of the mix before it), taken (its words inside the budget, the sum of all sizes).

    The mix is the packets with ``taken`` above 0 by ``position``; the packet that meets the budget is cut there. Each source comes
    within about one packet of its target. A null text has no words and a null source is a source, the last; rows that share an id are
    documents of their own, in an order that their texts decide; a null id is shuffled as an empty one. An empty table gives an empty
    result; long texts are packets like others; other columns are ignored. The same rows give the same mix.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, source_col, seed)
    budget = rows.agg(F.sum("size")).first()[0] or 0
    waiting = packets(rows, source_targets(rows, weights, most), quantum, block_rows)
    order = ["finish", "source_key", "copy", "h", "doc_id", "packet", "row"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / block_rows))
    dealt = stored(waiting.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "queue")
    ahead = dealt.groupBy("part").agg(F.sum("words").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("words").over(Window.partitionBy("part").orderBy("at")) - F.col("words")
    placed = dealt.withColumn("inside", inside).join(F.broadcast(ahead), "part").withColumn("position", F.col("before") + F.col("inside"))  # one row for each range
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("position")))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", "copy", (F.col("packet") * quantum).alias("start"), "words", "finish", "position", taken.cast("long").alias("taken"))


def taken_words(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of the documents, from ``mix``."""
    return mixed.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.sum("taken").alias("taken")).drop("row")
