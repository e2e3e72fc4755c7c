"""Exact deduplication by an extendible-hash index on files of the shared folder. DataFrame functions only.

1. One pass over the texts gives each row a 64-bit hash and a digest; only these are stored.
2. Rows become one entry for each (hash, digest), aggregated before the shuffle, so a group of copies, however large, is one entry.
3. The directory grows by doubling: it starts with the fewest leading bits of the hash that can hold all entries, and buckets
   that are overfull split by one more bit until none is. Its slots name the bucket of every hash.
4. Owner tasks take ranges of buckets. In a bucket, entries are sorted by hash; entries of one hash are a chain, and the owner
   counts the rows of each. The buckets are written as the index files.
5. Only chains of more than one row need bytes: a bitmap of their hashes picks the rows whose texts are then grouped by hash and
   whole normalised text, copies collapsing before the shuffle. What that finds is set into the chains of the index, and every
   row gets its entry's answer from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.text import id_text, one_space, split_by_bitmap
from turnledger.session import stored

#: Most entries of a bucket.
BUCKET_ENTRIES = 4096
#: Bits of the hash; a directory never has more.
MOST_BITS = 60


def prefix(h: Column, bits: int) -> Column:
    """The leading bits of a hash, as a number from 0."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, digest) of each row."""
    rows = id_text(docs, id_col, text_col).select("doc_id", one_space(F.col("text")).alias("normal"))
    return rows.select("doc_id", F.xxhash64("normal").alias("h"), F.unhex(F.sha2("normal", 256)).alias("digest"))


def directory(entries: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, list[int]]:
    """The buckets (bucket, local_depth, prefix) of a directory over the hashes ``h``, and the local depths that occur. A bucket holds
    the hashes whose leading ``local_depth`` bits are ``prefix``; its number is that of its first slot, and one of less depth than
    the directory stands for several slots. One hash alone cannot be split."""
    depth = max(0, math.ceil(math.log2(max(1, entries.count() / bucket_entries))))
    waiting, buckets, depths = entries.select("h"), None, []
    while True:
        held = waiting.groupBy(prefix(F.col("h"), depth).alias("prefix")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        held = stored(held.withColumn("overfull", (F.col("n") > bucket_entries) & (F.col("low") < F.col("high")) & F.lit(depth < MOST_BITS)), "held")
        fits = held.filter("not overfull").select("prefix", F.lit(depth).alias("local_depth"))
        buckets = fits if buckets is None else buckets.unionByName(fits)
        depths.append(depth)
        overfull = held.filter("overfull").select("prefix")
        if not overfull.limit(1).count():
            return buckets.withColumn("bucket", F.expr(f"shiftleft(prefix, {depth} - local_depth)")), depths
        waiting = waiting.withColumn("prefix", prefix(F.col("h"), depth)).join(overfull, "prefix", "left_semi").select("h")
        depth += 1


def build_index(rows: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """The index files: (bucket, local_depth, h, digest, first_id, n, chain_rows), each bucket sorted within its owner's range.
    ``rows`` are as ``hashed`` gives them; chain_rows counts the rows of all entries with the hash."""
    entries = stored(rows.groupBy("h", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "entries")
    buckets, depths = directory(entries, bucket_entries)
    # a hash is in exactly one bucket, of one of the few depths that occur
    asked = entries.withColumn("at", F.explode(F.array(*[F.struct(F.lit(d).alias("local_depth"), prefix(F.col("h"), d).alias("prefix")) for d in depths])))
    placed = asked.select("h", "digest", "first_id", "n", "at.*").join(buckets, ["local_depth", "prefix"]).drop("prefix")
    owned = placed.repartitionByRange("bucket").withColumn("chain_rows", F.sum("n").over(Window.partitionBy("bucket", "h")))
    return stored(owned.sortWithinPartitions("bucket", "h", "digest"), "index")


def chained(index: DataFrame) -> DataFrame:
    """The hashes (h, bucket) whose chains hold more than one row."""
    return index.filter("chain_rows > 1").select("h", "bucket").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and group with each other. Of rows that share a text and the smallest doc_id (repeated rows),
    all are marked kept, as they cannot be told apart by id. A null doc_id stays only in a group without any other id.
    Long texts are compared whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = stored(hashed(docs, id_col, text_col), "hashed")
    index = build_index(rows, bucket_entries)
    texts = id_text(docs, id_col, text_col).select("doc_id", one_space(F.col("text")).alias("normal")).withColumn("h", F.xxhash64("normal"))
    maybe, _ = split_by_bitmap(texts, F.col("h"), chained(index), F.col("h"))
    same = maybe.groupBy("h", "normal").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = stored(same.select("h", F.unhex(F.sha2("normal", 256)).alias("digest"), "keep_id", "group_size"), "groups")
    # an entry of the index with one row answers for itself, one with several as the comparison of its bytes says
    answers = index.join(groups, ["h", "digest"], "left").select("h", "digest", F.when(F.col("group_size").isNull(), F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    out = rows.join(answers, ["h", "digest"])
    return out.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``docs`` with one row of each text, all columns as they were: the row with the smallest id (a null id after all others).

    Of identical rows with that id one stays. Null texts count as empty; long texts are compared whole; an empty table stays
    empty. Rows whose hash no other row has, as the index tells, are passed on without a shuffle.
    """
    index = build_index(hashed(docs, id_col, text_col), bucket_entries)
    normal = lambda c: one_space(F.coalesce(c, F.lit("")))
    maybe, alone = split_by_bitmap(docs, F.xxhash64(normal(F.col(f"`{text_col}`"))), chained(index), F.col("h"))
    names = docs.columns
    own = maybe.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)])
    text, ident = F.col(f"own_{names.index(text_col)}"), F.col(f"own_{names.index(id_col)}")
    first = own.groupBy(F.xxhash64(normal(text)).alias("h"), normal(text).alias("normal")).agg(F.min_by(F.struct(*[f"own_{i}" for i in range(len(names))]), F.struct(ident.isNull().alias("none"), ident.alias("id"))).alias("row"))
    return alone.unionByName(first.select(*[F.col(f"row.own_{i}").alias(c) for i, c in enumerate(names)]))
