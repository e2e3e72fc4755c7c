"""How filters interact: what each removes in every order of application, counted from a stream with retractions.

1. The files of a table come as micro-batches of an available-now stream. The row filters are column conditions; a document's failures
   are the bits of a mask.
2. The duplicate filter fails every document whose text a smaller id holds. Each task collapses the copies that it reads, so a frequent
   text sends a row or two from each task; then the state, kept in the state store, holds every text's smallest id and the parts of that
   id's rows. Every row is counted as a duplicate first and corrected when it holds the smallest id; when a smaller id arrives later, the
   state takes the earlier correction back. Texts share a state by ranges of their hashes, about ``STATE_TEXTS`` in each, which saves a
   trip to the store for every text; a batch rewrites the states that it meets, so there are few and large batches.
3. A batch's changes are summed and written under its number, so a repeated batch overwrites itself. The sums over all batches are the
   counters by part, mask and label, from which every order and step follows.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnledger.llm.text import SPACE
from turnledger.session import shared_path

#: Micro-batches that the files are dealt into (about), and rows that a task collapses at a time.
BATCHES, COLLAPSE_ROWS = 4, 100_000
#: Texts that share a state (about).
STATE_TEXTS = 256
#: The duplicate filter's letter; it is the last bit of a mask.
DUPLICATE = "E"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # or every partition's store takes megabytes beforehand
}
CHANGE = "part string, mask int, good int, toxic int, change long"


def row_filters(text: Column) -> dict[str, Column]:
    """A: under 100 words; B: under 80 % of the words distinct; C: over 10 % of the code points A-Z; D: one of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str, text: Column, part_col: str) -> DataFrame:
    """(text_key, mask, part, good, toxic, doc_id) of each row. Of several labels of one id, any 1 counts."""
    mask = reduce(lambda a, b: a + b, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())], F.lit(0))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), mask.alias("mask"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(known, F.col("doc_id") == F.col("labelled"), "left").select("text_key", "mask", "part", none("good"), none("toxic"), "doc_id")


def collapsed(rows: DataFrame, at_most: int = COLLAPSE_ROWS) -> DataFrame:
    """One row for each text, part and label of a task: how many rows they are (n), their smallest id (null: only null ids) and how many
    rows hold it (n_smallest). A task with more than ``at_most`` of them sends what it has and goes on."""
    keys = ["text_key", "mask", "part", "good", "toxic"]
    names = [*keys, "n", "smallest", "n_smallest"]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def by_id(t: pa.Table) -> pa.Table:
            return t.group_by([*keys, "doc_id"], use_threads=False).aggregate([("rows", "sum")]).rename_columns([*keys, "doc_id", "rows"])

        def smallest(t: pa.Table) -> list[pa.RecordBatch]:
            ordered = t.sort_by([("doc_id", "ascending")])  # nulls come last
            out = ordered.group_by(keys, use_threads=False).aggregate([("rows", "sum"), ("doc_id", "first"), ("rows", "first")])
            return out.select([*keys, "rows_sum", "doc_id_first", "rows_first"]).rename_columns(names).combine_chunks().to_batches(max_chunksize=1000)

        for b in batches:
            t = by_id(pa.Table.from_batches([b]).append_column("rows", pa.array([1] * b.num_rows, pa.int64())))
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > at_most:
                yield from smallest(by_id(held))
                held = None
        if held is not None and held.num_rows:
            yield from smallest(by_id(held))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(collapse, f"text_key binary, mask int, part string, good int, toxic int, n long, smallest {kind}, n_smallest long")


class SmallestIds(StatefulProcessor):
    """State of a group of texts: for each its smallest id and, by part and label, the rows that hold it. Gives the changes of the counters."""

    def __init__(self, duplicate_bit: int):
        self.bit = duplicate_bit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("smallest", "texts binary")  # a pickled dictionary: text key to (id, holders)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, changes, masks = self.state.get(), {}, {}
        texts = pickle.loads(before[0]) if before is not None else {}
        earlier: dict[bytes, tuple | None] = {}  # what was known of the texts that change

        def add(part: str, mask: int, good: int, toxic: int, n: int) -> None:
            changes[part, mask, good, toxic] = changes.get((part, mask, good, toxic), 0) + n

        for r in rows:
            k = bytes(r.text_key)
            masks[k] = r.mask  # the same for all rows of a text
            add(r.part, r.mask | self.bit, r.good, r.toxic, r.n)
            known, who = texts.get(k), (r.part, r.good, r.toxic)
            if known is None or (r.smallest is not None and (known[0] is None or r.smallest < known[0])):
                holders = {who: r.n_smallest}
            elif r.smallest == known[0]:
                holders = known[1] | {who: known[1].get(who, 0) + r.n_smallest}
            else:
                continue
            earlier.setdefault(k, known)
            texts[k] = (r.smallest, holders)
        for k, known in earlier.items():
            for holders, sign in ((known[1] if known else {}, -1), (texts[k][1], 1)):  # take back, then correct
                for (part, good, toxic), n in holders.items():
                    add(part, masks[k] | self.bit, good, toxic, -sign * n)
                    add(part, masks[k], good, toxic, sign * n)
        if earlier:
            self.state.update((pickle.dumps(texts),))
        for (part, mask, good, toxic), n in changes.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, change=n)

    def close(self) -> None:
        pass


def changes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", states: int = 4096) -> DataFrame:
    """(part, mask, good, toxic, change) from a stream of documents: what each batch adds to the counters or takes back. The texts'
    smallest ids are kept in ``states`` states; a stream that goes on from a checkpoint must keep that number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filters = row_filters(text)
    rows = collapsed(marked(docs, labels, filters, id_col, text, part_col))
    rows = rows.withColumn("state", F.pmod(F.xxhash64("text_key"), F.lit(states)))
    return rows.groupBy("state").transformWithState(SmallestIds(1 << len(filters)), CHANGE, "Update", "None")


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files under ``path`` (a folder or one file) as a stream of about ``batches`` micro-batches."""
    table = spark.read.parquet(path)
    files, (folder, name) = table.inputFiles(), path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a stream starts at a folder
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def counters(stream: DataFrame, labels: DataFrame, states: int = 4096, **columns: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail, after all that the stream has to give now.

    ``stream``: documents with any other columns. Null texts count as empty, null parts as the empty string; a null id is greater than
    all others, and rows that share the smallest id of their text are no duplicates of each other. Long texts are taken whole. An empty
    stream gives no counters. A lost executor's tasks run again from the batch's checkpoint.
    """
    spark = stream.sparkSession
    at, checkpoint = shared_path(spark, "counters"), shared_path(spark, "filter_audit")
    spark.createDataFrame([], CHANGE).write.parquet(f"{at}/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(f"{at}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = changes(stream, labels, states=states, **columns).writeStream.foreachBatch(sink).outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(f"{CHANGE}, batch long").parquet(at)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("n")).filter("n > 0")


def every_step(letters: str) -> list[dict]:
    """Each order of the filters and each of its steps: the bit applied there, and the bits applied earlier."""
    bits = {c: 1 << k for k, c in enumerate(letters)}
    return [{"filter_order": "".join(order), "step": k + 1, "bit": bits[c], "earlier": sum(bits[x] for x in order[:k])} for order in permutations(letters) for k, c in enumerate(order)]


def report(counts: DataFrame, letters: str = "ABCD" + DUPLICATE) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A part has at most
    one entry for each mask, so all orders are worked out where its few counters are."""
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), when(F.col("good") == 1).alias("good"), when(F.col("toxic") == 1).alias("toxic"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.from_json(F.lit(json.dumps(every_step(letters))), "array<struct<filter_order:string,step:int,bit:int,earlier:int>>")
    rows = parts.select("part", "masks", F.inline(steps))
    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~gone(m)

    def total(name, held, value):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(held(m), value(m)).otherwise(0)).alias(name)

    n = lambda m: m["n"]
    orders = F.lit(math.factorial(len(letters)))
    return rows.select(
        "part", "filter_order", "step",
        total("kept", lambda m: ~fails(m) & ~gone(m), n), total("removed", removed, n), total("redundant", lambda m: fails(m) & gone(m), n), total("unique_fails", lambda m: m["mask"] == F.col("bit"), n),
        total("good_lost", removed, lambda m: m["good"]), total("toxic_lost", removed, lambda m: m["toxic"]),
        # of the orders, one in as many as a mask has bits applies this filter first
        total("shapley", fails, lambda m: m["n"] * (orders / F.bit_count(m["mask"])).cast("long")),
    )


def audit_files(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, **columns: str) -> DataFrame:
    """The report on all documents of the Parquet files under ``path``."""
    states = max(1, math.ceil(spark.read.parquet(path).count() / STATE_TEXTS))
    return report(counters(file_stream(spark, path, batches), labels, states, **columns))
