"""Column functions and byte tables for text that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z in UTF-8 bytes; all other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z. Texts of ASCII only take the faster function, which does the same to them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def one_space(text: Column) -> Column:
    """Each run of white space becomes one space. Single spaces are runs already and need no match, which saves most of them."""
    return F.regexp_replace(text, f"[\\x09-\\x0D][{SPACE}]*|\\x20[{SPACE}]+", " ")


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Learned(dict):
    """A dictionary that asks ``learn`` for a key it lacks, within about ``most`` bytes: beyond them it starts anew. Long keys are
    not kept. One belongs to one task, so that nothing outlives the task in a reused worker."""

    def __init__(self, learn: Callable, most: int = 24 << 20):
        super().__init__()
        self.learn, self.most, self.held = learn, most, 0

    def __missing__(self, key):
        value = self.learn(key)
        if len(key) <= 200:
            self.held += 240 + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[key] = value
        return value


def release() -> None:
    """Gives unused Arrow memory of this worker back, at the end of a task."""
    pa.default_memory_pool().release_unused()


#: Parts of a bitmap, of 4 KB each: 8 MB at most, whatever the input.
FILTER_PARTS = 2048


def split_by_bitmap(rows: DataFrame, row_hash: Column, asked: DataFrame, asked_hash: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash may be in ``asked``, and those whose hash surely is not.

    A bitmap of the asked hashes goes to all tasks; its size is fixed, so it is safe to broadcast, and rows that nobody asks
    for need no shuffle. Hashes that share a bit come out as "may be"; what follows must decide exactly. With far more
    asked hashes than the bitmap has bits (67 million) it tells nothing apart, and all rows take the exact way.
    """
    part = lambda h: F.pmod(h, F.lit(FILTER_PARTS))
    bit = lambda h: F.pmod(F.shiftright(h, 32), F.lit(32768))
    bits = asked.groupBy(part(asked_hash).alias("filter_part")).agg(F.bitmap_construct_agg(bit(asked_hash)).alias("filter_bits"))
    names = rows.columns
    marked = rows.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)], row_hash.alias("own_hash"))
    marked = marked.join(F.broadcast(bits), part(F.col("own_hash")) == F.col("filter_part"), "left")
    byte = F.conv(F.hex(F.substring("filter_bits", (F.shiftright(bit(F.col("own_hash")), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (bit(F.col("own_hash")) % 8).cast("int")) == 1, F.lit(False))
    back = [F.col(f"own_{i}").alias(c) for i, c in enumerate(names)]
    return marked.filter(there).select(*back), marked.filter(~there).select(*back)
