"""Delivered contents kept for recovery: bounded redacted rows by hash, retention by age and number, and what became of a handle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators.runs import numbered
from turnledger.session import stored

#: Bytes kept of a content, seconds until a handle is stale, most contents kept, and the schemes of handles.
MOST_BYTES, TTL_SECONDS, MOST_ROWS, SCHEMES = 200_000, 24 * 3600, 20_000, ("result://", "ctx://blob/")
#: Fewest outputs in tokens for which a reduction is worth its handle.
FLOOR = 400


def first_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most ``most`` bytes; a character is never cut."""
    raw = text.cast("binary")
    inside = lambda at: F.substring(raw, at, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))  # noqa: E731 - of a character of several bytes
    cut = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def bounded(outputs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds to outputs (text, ...) what would be kept: full_bytes, sample (redacted, of at most ``most_bytes`` of the text), stored_bytes, truncated,
    redacted, and exact: the sample is the text."""
    cut = F.octet_length("text") > most_bytes
    o = outputs.withColumns({"full_bytes": F.octet_length("text").cast("bigint"), "truncated": cut, "sample": C.redact(first_bytes(F.col("text"), most_bytes))})
    return o.withColumns({"stored_bytes": F.octet_length("sample").cast("bigint"), "redacted": F.when(cut, F.col("sample") != first_bytes(F.col("text"), most_bytes)).otherwise(F.col("sample") != F.col("text")), "exact": ~cut & (F.col("sample") == F.col("text"))})


def retained(contents: DataFrame, now: int, ttl_seconds: int = TTL_SECONDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """The contents (hash, created_at in seconds, ...) that are not too old, and of these the newest ``most_rows`` (equally old ones by hash).

    Places come from range partitions, so neither a global window nor one task sorts all contents; without too many of them nothing is sorted.
    """
    fresh = contents.filter(F.col("created_at") >= now - ttl_seconds)
    if fresh.count() <= most_rows:
        return fresh
    newest = numbered(fresh.withColumn("age", -F.col("created_at")), "age", "hash")
    return newest.filter(F.col("place") < most_rows).drop("age", "place")


def stored_contents(outputs: DataFrame, now: int, ttl_seconds: int = TTL_SECONDS, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each content of outputs (id, text, at in seconds) that is kept at ``now``: handle, hash, first_id, holders, created_at (its
    latest delivery), full_bytes, stored_bytes, truncated, redacted, exact, sample.

    Only hashes and times are aggregated and ranked; texts are read for the kept ones alone, from the output that had each first, and they
    are redacted there. An empty table keeps nothing; null texts are no contents.
    """
    thin = outputs.filter("text is not null").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("id").alias("first_id"), F.count("*").alias("holders"), F.max("at").alias("created_at"))
    kept = retained(stored(thin, "contents"), now, ttl_seconds, most_rows)
    texts = outputs.select(F.col("id").alias("first_id"), "text").withColumn("hash", content_hash(F.col("text"))).join(kept, ["first_id", "hash"])  # kept: at most most_rows rows
    one = texts.dropDuplicates(["hash"])
    return bounded(one, most_bytes).select(F.concat(F.lit(SCHEMES[0]), "hash").alias("handle"), "hash", "first_id", "holders", "created_at", "full_bytes", "stored_bytes", "truncated", "redacted", "exact", "sample")


def recovered(asked: DataFrame, contents: DataFrame, now: int, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(handle, status, age_seconds, bounded, sample) of each asked handle, however often: found, expired (kept but too old by now), unknown (never
    kept, or removed) or unrecognized (no handle). Samples come with found ones only."""
    h = asked.select("handle", F.regexp_extract("handle", f"^(?:{'|'.join(SCHEMES)})(.*)$", 1).alias("hash"))
    c = contents.select("hash", "created_at", "sample", "truncated")
    age = F.lit(now) - F.col("created_at")
    status = F.when(F.coalesce("hash", F.lit("")) == "", "unrecognized").when(F.col("created_at").isNull(), "unknown").when(age > ttl_seconds, "expired").otherwise("found")
    return h.join(c, "hash", "left").withColumn("status", status).select("handle", "status", age.alias("age_seconds"), F.coalesce((F.col("status") == "found") & F.col("truncated"), F.lit(False)).alias("bounded"), F.when(F.col("status") == "found", F.col("sample")).alias("sample"))


def reduction_decisions(outputs: DataFrame, reduced: DataFrame, protected: DataFrame, floor: int = FLOOR, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, decision, raw_tokens, shown_tokens) of each output (id, kind, text): reduce, or why it is passed on as it is.

    A reduction (reduced: id, reduced, invariants) stands only if there is one, its output has at least ``floor`` tokens, it is smaller, its
    invariants hold (what must stay is still there), and the output can be given back exactly: it is small enough to be kept whole and redaction
    changes nothing in it. A file's content is also passed on where an edit needs it as it is (protected: id). The first reason counts.
    """
    o = outputs.join(reduced.select("id", "reduced", "invariants"), "id", "left").join(protected.select("id", F.lit(True).alias("needed")).distinct(), "id", "left")
    tokens = lambda c: F.floor(F.length(c) / 4)
    why = F.when(F.col("reduced").isNull(), "no_reducer").when(tokens("text") < floor, "below_floor").when(F.length("reduced") >= F.length("text"), "not_smaller").when(~F.coalesce("invariants", F.lit(False)), "invariant_lost")
    why = why.when(F.octet_length("text") > most_bytes, "too_large").when(C.redactions(F.col("text")) > 0, "secret").when((F.col("kind") == "file") & F.coalesce("needed", F.lit(False)), "needed_by_edit").otherwise("reduce")
    return o.select("id", why.alias("decision"), tokens("text").alias("raw_tokens"), F.when(why == "reduce", tokens("reduced")).otherwise(tokens("text")).alias("shown_tokens"))
