"""Importance resampling toward a target distribution: documents whose word runs are frequent in the benchmark are drawn more often.

1. Features are runs of one to three words, hashed into buckets by the CRC of their bytes. A run's CRC follows from the CRCs of
   its words, as appending bytes is linear: a table for each word length shifts a CRC, so a task works on whole arrays of words.
2. Each task counts its features in an array of buckets; the sums over all tasks give every bucket's gain. A document's weight is the sum
   of its features' gains; a fixed pseudo-random number of its id turns weights into scores of a draw without replacement.
3. Scores are ranked by regular sampling: each task sorts its rows into a run, runs give every so many rows a sample, samples at
   regular places are the splitters. A row's segment follows from the splitters, segments are exchanged and sorted where they arrive,
   and the counts of the segments before give exact ranks. Segments beyond the draw are counted, not exchanged.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.decontaminate import WORD_BYTES
from turnledger.llm.text import Learned, id_text, release
from turnledger.session import stored

BUCKETS, RUN = 10_000, 3
#: Words that a document needs to be drawn, and the share that is drawn, in percent.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Rows of one segment (about), and samples for each segment.
SEGMENT_ROWS, SAMPLES = 1_000_000, 16
#: Words of more bytes are appended byte by byte instead of by table.
TABLE_BYTES = 64
#: The CRC's polynomial, reflected.
POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """[length, byte place, byte]: what a CRC becomes when so many bytes follow, for each of its four bytes."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    steps = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    out = [np.stack(steps)]
    for _ in range(TABLE_BYTES):
        steps = [(s >> np.uint32(8)) ^ c[s & 255] for s in steps]
        out.append(np.stack(steps))
    return np.stack(out)


def appended(crcs: np.ndarray, tails: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> np.ndarray:
    """The CRC of each text followed by a space and its word. ``tails``: CRCs of a space and the word; ``lengths``: their bytes."""
    tables, n = shift_tables(), np.minimum(lengths, TABLE_BYTES)
    out = tables[n, 0, crcs & 255] ^ tables[n, 1, (crcs >> 8) & 255] ^ tables[n, 2, (crcs >> 16) & 255] ^ tables[n, 3, crcs >> 24] ^ tails
    for k in np.flatnonzero(lengths > TABLE_BYTES).tolist():
        out[k] = crc32(b" " + words[k], int(crcs[k]))
    return out


class Features:
    """The feature buckets of texts; a task keeps what it has learned of words, within a bound."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        # a word's CRC, the CRC of a space and the word, and their length, as one number of 96 bits
        self.words = Learned(lambda w: crc32(w).to_bytes(4, "little") + crc32(b" " + w).to_bytes(4, "little") + min(len(w) + 1, 0xFFFFFFFF).to_bytes(4, "little"), 48 << 20)

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(words, the bucket of each feature)."""
        words = text.encode().translate(WORD_BYTES).split()
        if not words:
            return 0, np.zeros(0, dtype=np.uint32)
        known = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4").reshape(-1, 3)
        run, parts = known[:, 0], [known[:, 0]]
        for k in range(1, min(RUN, len(words))):
            run = appended(run[:-1], known[k:, 1], known[k:, 2], words[k:])
            parts.append(run)
        return len(words), np.concatenate(parts) % np.uint32(self.buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives a row for each bucket that it has met; only the sums, one
    number for each bucket, reach the driver."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(buckets), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                counts += np.bincount(features.of(text.as_py())[1], minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], names=["bucket", "n"])
        release()

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to corpus) of each bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def draw_number(ident: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the hash of seed and id: the Gumbel noise of a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    rows = id_text(docs, id_col, text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain))
        for b in batches:
            found = []
            for text in b.column("text"):
                n, buckets = features.of(text.as_py())
                found.append((n, len(buckets), int(gain[buckets].sum())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*found)]] if found else [b.column("doc_id"), *[pa.array([], pa.int64())] * 3], names=["doc_id", "n_words", "n_features", "weight"])
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + draw_number(F.col("doc_id"), seed))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, drawable, score, ...) as stored runs: each task's rows in the order of ranks, with the run's number and the place in it."""
    runs = rows.sortWithinPartitions(F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, run), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "run", "place"])
            at += b.num_rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(runs.mapInArrow(number, f"{kinds}, run int, place long"), "runs")


def key_of(score: int, ident, run: int, place: int) -> tuple:
    """Ranks go by this key: highest score, smallest id (null last), then the place among the runs."""
    return -score, ident is None, 0 if ident is None else ident, run, place


def splitters(runs: DataFrame, n: int, segments: int, samples: int = SAMPLES) -> list[tuple]:
    """The keys that part ``n`` rows into about equal segments, from every so many rows of each run; runs start at different phases, so
    that short runs are sampled too. About ``samples`` keys a segment reach the driver."""
    if segments < 2:
        return []
    stride = max(1, n // (segments * samples))
    picked = runs.filter("drawable").filter(F.pmod(F.col("place") + F.pmod(F.xxhash64("run"), F.lit(stride)), F.lit(stride)) == 0)
    keys = sorted(key_of(*r) for r in picked.select("score", "doc_id", "run", "place").collect())
    return [keys[len(keys) * k // segments] for k in range(1, segments)] if keys else []


def in_segments(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Adds ``segment``: how many splitters are not above the row's key. Only rows that tie with a splitter's score compare their ids."""
    falling = np.array([c[0] for c in cuts], dtype=np.int64)  # rising, as scores count negative

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = -b.column("score").to_numpy(zero_copy_only=False)
            segment, upper = np.searchsorted(falling, score, "left"), np.searchsorted(falling, score, "right")
            for k in np.flatnonzero(segment != upper).tolist():
                key = key_of(-int(score[k]), *(b.column(c)[k].as_py() for c in ("doc_id", "run", "place")))
                at = bisect_left(cuts, key, int(segment[k]), int(upper[k]))
                segment[k] = at + (at < len(cuts) and cuts[at] == key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment, pa.int32())], names=[*b.schema.names, "segment"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(place, f"{kinds}, segment int")


def ranked(rows: DataFrame, percent: int = PERCENT, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` (doc_id, drawable, score, ...) with ``rank``: 1, 2, 3, ... for the highest ``percent`` of the drawable rows, null for all others."""
    spark = rows.sparkSession
    names, runs = rows.columns, sorted_runs(rows)
    n = runs.filter("drawable").count()
    drawn, segments = percent * n // 100, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / segment_rows))
    dealt = in_segments(runs, splitters(runs, n, segments))
    sizes = {r["segment"]: r["n"] for r in dealt.filter("drawable").groupBy("segment").agg(F.count("*").alias("n")).collect()}  # one row for each segment
    ahead, last = [], -1
    for segment in range(segments):
        before = ahead[-1] + sizes.get(segment - 1, 0) if ahead else 0
        if before >= drawn:
            break
        ahead.append(before)
        last = segment
    near = F.col("drawable") & (F.col("segment") <= last)
    merge = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "run", "place")
    before = F.element_at(F.array(*[F.lit(a).cast("long") for a in ahead] or [F.lit(0).cast("long")]), F.col("segment") + 1)
    inside = dealt.filter(near).withColumn("rank", before + F.row_number().over(merge))
    first = inside.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionByName(dealt.filter(~near).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank.

    Documents of at least ``least_words`` words are drawn by score, ``percent`` of them; ties go to the smaller id, a null id last, and
    rows of one id each have their own rank. A null or empty text has no features and weight 0; long texts are taken whole; an empty
    target leaves the smoothed ratio; an empty table gives an empty result; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    rows = weighted(docs, gain, id_col, text_col, seed).withColumn("drawable", F.col("n_words") >= least_words)
    return ranked(rows, percent, segment_rows).select("doc_id", "n_features", "weight", "score", "rank")
