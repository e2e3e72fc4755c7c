"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of the shared folder, bucketed and sorted by hash; all runs have the same buckets. A batch of documents is
reduced to its line hashes, dealt once into these buckets, and merged with every run bucket by bucket: no run is shuffled or
sorted again. Hashes that a run holds belong to an earlier document; the rest become a new run of level 0. When a level has two
runs, they are merged (a full outer merge join of their buckets) into one run of the next level, so a batch meets about log2 of
the batches' number of runs. Batches come in the order of the documents' ids and hold a bounded number of rows, so their
number grows with the table.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.llm.text import ascii_lower, id_text, split_by_bitmap, strip_space
from turnledger.session import shared_path, stored

MIN_KEY = 10
#: Least number of batches, and the documents that a batch holds at most (about).
BATCHES, BATCH_DOCS = 4, 20_000_000
#: Line hashes for each bucket of the runs.
BUCKET_ROWS = 500_000
#: Lines of a batch from which a hash is hot: these few hashes (at most a batch's lines divided by this) are sent to all tasks instead.
HOT_LINES = 100_000
#: Ids that bound the batches where ids are texts (about).
SAMPLED = 10_000
#: Lets readers of the runs rely on the order that is written in each bucket's file.
KEEP_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(strip_space(line))


def key_hash(key: Column) -> list[Column]:
    """128 bits, so that chance collisions stay away at any size."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")]


class RunStore:
    """The runs by level. ``add`` merges a batch and gives its table; ``close`` forgets the names (files stay in the shared folder)."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels, self.names = spark, buckets, [[]], []

    def _write(self, rows: DataFrame) -> str:
        """A table of (a, b, ...), one sorted file for each bucket."""
        name = f"turnledger_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", shared_path(self.spark, name)).saveAsTable(name)
        self.names.append(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("not held").select("a", "b")

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch``: (a, b, doc), one row or more for each key hash of each document. The result (a, b, n, owner, last, nulls, held):
        for each hash its rows, its smallest and greatest document in the batch (null: only a null id), whether a null id is among them,
        and whether an earlier batch had it."""
        merged = batch.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc").alias("owner"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("nulls")).repartition(self.buckets, "a", "b")
        held = F.lit(False)
        for k, name in enumerate(n for level in self.levels for n in level):
            merged = merged.join(self._run(name).withColumn(f"in_{k}", F.lit(True)), ["a", "b"], "left")
            held = held | F.coalesce(f"in_{k}", F.lit(False))
        name = self._write(merged.select("a", "b", "n", "owner", "last", "nulls", held.alias("held")))
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= 2:
            left, right = (self._run(n) for n in self.levels[level])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(left.join(right, ["a", "b"], "full_outer").withColumn("held", F.lit(False))))
            self.levels[level] = []
            level += 1
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def order_number(ident: Column, kind: T.DataType) -> Column:
    """What orders the ids: texts themselves, otherwise a number that never falls when ids rise."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return ident
    if isinstance(kind, T.IntegralType):
        return ident.cast("long")
    return (F.unix_micros(ident.cast("timestamp")) if isinstance(kind, (T.DateType, T.TimestampType)) else ident).cast("double")


def batch_bounds(rows: DataFrame, batches: int) -> list:
    """Upper ends of about equal ranges of ``place``: quantiles of numbers, or of the texts with the smallest hashes, a bounded sample. They only
    say where batches end."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    if isinstance(rows.schema["place"].dataType, (T.StringType, T.BinaryType)):
        some = rows.filter("place is not null").orderBy(F.xxhash64("place")).limit(max(SAMPLED, 10 * batches)).select("place").collect()
        ids = sorted(r["place"] for r in some)
        return sorted({ids[min(len(ids) - 1, int(q * len(ids)))] for q in shares}) if ids else []
    cuts = rows.agg(F.percentile_approx("place", F.array(*map(F.lit, shares)), F.lit(max(1000, 10 * batches))).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def beside(own: DataFrame, repeated: DataFrame, hot_lines: int = HOT_LINES) -> DataFrame:
    """The lines ``own`` with what is known of their hashes. Hot hashes, which would each be one task's in the bucket join, go to all tasks
    and their lines stay where they are; they are few, as each has ``hot_lines`` lines of the batch."""
    hot = repeated.filter(F.col("n") >= hot_lines)
    if not hot.limit(1).count():
        return own.join(repeated.drop("n"), ["a", "b"])
    cold = own.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(repeated.filter(F.col("n") < hot_lines).drop("n"), ["a", "b"])
    return own.join(F.broadcast(hot.drop("n")), ["a", "b"]).unionByName(cold)


def lost_lines(docs: DataFrame, min_key: int = MIN_KEY, batches: int | None = None) -> DataFrame:
    """(doc, t, positions): the line numbers (from 0) that each document loses. ``docs``: (doc, t, place, text)."""
    spark = docs.sparkSession
    n_docs = docs.count()
    bounds = batch_bounds(docs.select("place"), batches or max(BATCHES, math.ceil(n_docs / BATCH_DOCS)))
    under = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("place"))) if bounds else F.lit(0)
    batch = F.when(F.col("place").isNull(), len(bounds)).otherwise(under)
    lines = docs.select("doc", "t", batch.cast("int").alias("batch"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "t", "batch", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    keys = stored(keys.select("doc", "t", "batch", "pos", *key_hash(F.col("key"))), "keys", ["batch"])
    store = RunStore(spark, max(8, math.ceil(keys.count() / BUCKET_ROWS)))
    before, lost = spark.conf.get(KEEP_ORDER), None
    spark.conf.set(KEEP_ORDER, "true")
    try:
        for i in range(len(bounds) + 1):
            own = keys.filter(F.col("batch") == i).drop("batch")
            repeated = store.add(own.select("a", "b", "doc")).filter("held or owner < last or (owner is not null and nulls)").select("a", "b", "n", "owner", "held")
            found = beside(own, repeated).filter("held or doc > owner or (owner is not null and doc is null)").groupBy("doc", "t").agg(F.collect_set("pos").alias("positions"))
            found = stored(found, "lost")
            lost = found if lost is None else lost.unionByName(found)
    finally:
        spark.conf.set(KEEP_ORDER, before)
        store.close()
    return lost


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, batches: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of ``min_key`` code points or more that
    at least two doc_ids hold lose all their lines except in the smallest such doc_id, which keeps every one of them. Rows
    that share a doc_id are one document here, each with its own result; a null doc_id sorts after all others. Ids can be numbers,
    texts or times. A null or empty text is one empty line, long texts are taken whole, an empty table gives an empty result,
    other columns are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    lost = lost_lines(rows.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("t"), order_number(F.col("doc_id"), kind).alias("place"), "text"), min_key, batches)
    row_hash = F.xxhash64("doc_id", F.xxhash64("text"))
    maybe, whole = split_by_bitmap(rows, row_hash, lost, F.xxhash64("doc", "t"))
    own = maybe.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_t"), "text")
    joined = own.join(lost, F.col("own_id").eqNullSafe(F.col("doc")) & (F.col("own_t") == F.col("t")), "left")
    lines, n = F.split("text", "\n", -1), F.size("lines")
    out = joined.unionByName(whole.select(F.col("doc_id").alias("own_id"), "text"), allowMissingColumns=True).select("own_id", "positions", "text", lines.alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "positions")
    kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return out.select(F.col("own_id").alias("doc_id"), n.cast("long").alias("n_lines"), F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_dropped"), kept.alias("kept_text"))
