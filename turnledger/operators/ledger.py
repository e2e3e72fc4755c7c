"""Occupancy, cost, breaks and duplicates. Inputs are the canonical tables; thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR, HARD, TTL_MINUTES = 20_000, 0.15, 60


def occupancy_ledger(requests: DataFrame) -> DataFrame:
    g = requests.groupBy("model").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("input", "cache_read", "cache_write", "output")])
    return g.withColumn("occupancy", F.col("input") + F.col("cache_read") + F.col("cache_write"))


def cache_breaks(requests: DataFrame, floor: int = FLOOR, hard: float = HARD, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Requests whose cache read fell below what the request before had: session, id, turn, lost, hard, cause, gap_minutes. Where requests say
    how many compactions lie between them and the request before (column ``compactions``), these are the first cause."""
    w = Window.partitionBy("session").orderBy("turn")
    r = requests.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("cache_read", "cache_write", "model", "version", "ts")])
    before = F.col("p_cache_read") + F.col("p_cache_write")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("p_ts").cast("timestamp"))) / 6e7
    r = r.withColumns({"before": before, "gap_minutes": gap}).filter((F.col("before") >= floor) & (F.col("cache_read") < F.col("before") * 0.5))
    compacted = F.col("compactions") > 0 if "compactions" in requests.columns else F.lit(False)
    cause = F.when(compacted, "compaction").when(F.col("model") != F.col("p_model"), "model").when(F.col("version") != F.col("p_version"), "version").when(F.col("gap_minutes") > ttl_minutes, "ttl").otherwise("unknown")
    return r.select("session", "id", "turn", (F.col("before") - F.col("cache_read")).alias("lost"), (F.col("cache_read") < F.col("before") * hard).alias("hard"), cause.alias("cause"), "gap_minutes", "cache_write")


def breaks_by_cause(breaks: DataFrame) -> DataFrame:
    return breaks.groupBy("cause").agg(F.count("*").alias("breaks"), F.sum(F.col("hard").cast("bigint")).alias("hard_breaks"), F.sum("lost").alias("lost"), F.sum("cache_write").alias("rewritten"))


def cache_islands(requests: DataFrame, breaks: DataFrame) -> DataFrame:
    """Runs of requests between breaks."""
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    r = requests.join(breaks.select("session", "id", F.lit(1).alias("broke")), ["session", "id"], "left").withColumn("island", F.sum(F.coalesce("broke", F.lit(0))).over(w))
    return r.groupBy("session", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("requests"), F.sum("cache_write").alias("written"))


def model_switches(requests: DataFrame, large: int = 100_000) -> DataFrame:
    """Switches from the request before, by models: how many, what was established, and how many had ``large`` tokens. Where requests fork,
    ``lineage.switches`` measures them against what each one continues."""
    w = Window.partitionBy("session").orderBy("turn")
    r = requests.withColumn("p_model", F.lag("model").over(w)).withColumn("moved", F.lag(F.col("cache_read") + F.col("cache_write")).over(w)).filter("p_model <> model")
    return r.groupBy(F.col("p_model").alias("from_model"), F.col("model").alias("to_model")).agg(F.count("*").alias("switches"), F.sum("moved").alias("migrated"), F.sum((F.col("moved") >= large).cast("bigint")).alias("large"))


def match_price(models: DataFrame, prices: DataFrame) -> DataFrame:
    """First pattern of the ordered price list that a model's name contains; else the default (ord -1). Only distinct names meet
    the price list; ``lineage.price_columns`` needs no join."""
    names = models.select("model").distinct()
    hit = names.join(prices.filter("ord >= 0"), F.col("model").contains(F.col("match")), "left").groupBy("model").agg(F.min_by(F.struct("match", "input_price"), "ord").alias("p"))
    default = prices.filter("ord < 0").select(F.col("input_price").alias("default_price")).limit(1)
    return hit.join(default).select("model", F.col("p.match").alias("match"), F.coalesce("p.input_price", "default_price").alias("input_price"))


def residency_horizon(objects: DataFrame, breaks: DataFrame) -> DataFrame:
    """Each object's last resident turn: before the next break after its entry, else the session's last turn. Objects and breaks are
    ordered together once, from the last on, as Spark works frames that end at the last row out anew for each row."""
    marks = breaks.select("session", "turn", F.col("turn").alias("break_turn"))
    both = objects.withColumn("is_object", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    after = Window.partitionBy("session").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)  # backwards: one pass
    o = both.withColumns({"next_break": F.min("break_turn").over(after), "last_turn": F.max(F.when(F.col("is_object"), F.col("turn"))).over(Window.partitionBy("session"))}).filter("is_object")
    return o.withColumn("exit_turn", F.coalesce(F.col("next_break") - 1, F.col("last_turn"))).drop("is_object", "break_turn", "next_break", "last_turn")


def token_turns(objects: DataFrame, by: str) -> DataFrame:
    return objects.groupBy(by).agg(F.count("*").alias("objects"), F.sum("size").alias("tokens"), F.sum(F.col("size") * F.greatest(F.lit(1), F.col("exit_turn") - F.col("turn") + 1)).alias("token_turns"))


def duplicate_of(outputs: DataFrame) -> DataFrame:
    """Deliveries of a text that its session had before, linked to the first one."""
    h = outputs.withColumn("hash", F.substring(F.sha1("text"), 1, 16))
    first = h.groupBy("session", "hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return h.join(first, ["session", "hash"]).filter("id > first_id").select("session", "id", "first_id", "hash", F.floor(F.length("text") / 4).alias("tokens"))


def redundancy(duplicates: DataFrame) -> DataFrame:
    return duplicates.groupBy("session").agg(F.count("*").alias("duplicates"), F.sum("tokens").alias("tokens"))


def gap_histogram(requests: DataFrame, bucket) -> DataFrame:
    w = Window.partitionBy("session").orderBy("turn")
    g = requests.withColumn("gap", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 6e7).filter("gap is not null")
    return g.groupBy(bucket(F.col("gap")).alias("bucket")).agg(F.count("*").alias("n"))


def merge_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key: earliest first and latest last sight."""
    return old.unionByName(new).groupBy("session", "key").agg(F.min("turn").alias("first_seen"), F.max("turn").alias("last_seen"), F.count("*").alias("n"))
