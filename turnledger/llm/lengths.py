"""Exact token-length histogram: one row for each encoded length, with suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.text import id_text
from turnledger.llm.tokens import byte_encoder
from turnledger.session import stored

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length) of each row; a null or empty text has length 0. Long texts are encoded whole, repeated rows each for itself; an empty
    table gives an empty result, and other columns, whatever their names, are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(encode(t)) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "length"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: encoded_length, n_docs, n_at_least and tokens_at_least (suffix sums over lengths
    from this one on), n_total, tokens_total, share_at_most, and truncated_total: the tokens left when every document is cut
    to this length. Between two lengths the truncated total is linear, so the rows answer every context limit.

    Suffix sums are taken over blocks of lengths and then inside each block, so no task holds all lengths. An empty table
    gives an empty result.
    """
    hist = stored(lengths.groupBy(F.col("length").alias("encoded_length")).agg(F.count("*").alias("n_docs")).withColumn("block", F.expr(f"encoded_length div {BLOCK}")), "histogram")
    weight = F.col("n_docs") * F.col("encoded_length")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum(weight).alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("n", "tokens")], F.sum("n").over(everything).alias("n_total"), F.sum("tokens").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("encoded_length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").withColumns({"n_at_least": F.sum("n_docs").over(inside) + F.col("later_n"), "tokens_at_least": F.sum(weight).over(inside) + F.col("later_tokens")})
    return out.select(
        "encoded_length", "n_docs", "n_at_least", "tokens_at_least", "n_total", "tokens_total",
        ((F.col("n_total") - F.col("n_at_least") + F.col("n_docs")) / F.col("n_total")).alias("share_at_most"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("encoded_length") * F.col("n_at_least")).alias("truncated_total"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """One row: q_0, q_1, ... the smallest length that at least this share of the documents does not exceed."""
    return histogram.agg(*[F.min(F.when(F.col("share_at_most") >= q, F.col("encoded_length"))).alias(f"q_{i}") for i, q in enumerate(shares)])


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_longer, kept_tokens) for each limit, in one pass over the histogram."""
    length, n = F.col("encoded_length"), F.col("n_docs")
    each = [F.struct(F.lit(k).alias("context_limit"), F.coalesce(F.sum(F.when(length > k, n).otherwise(0)), F.lit(0)).alias("n_longer"), F.coalesce(F.sum(n * F.least(length, F.lit(k))), F.lit(0)).alias("kept_tokens")) for k in limits]
    return histogram.agg(F.array(*each).alias("each")).select(F.inline("each"))
