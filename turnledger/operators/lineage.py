"""Cache breaks and model switches against the request that each one continues, and what requests cost.

A row's ancestor is the nearest usage row on its chain of parents (``usage.lineage_parent``), so a fork is measured against what it
forked from. Inputs: usage rows (id, session, model, version, ts, cache_read, cache_write).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.ledger import FLOOR, HARD, TTL_MINUTES
from turnledger.operators.runs import numbered

#: A break reads less than this share of what was established; bounds of large contexts; gaps in minutes.
SHARE, LARGE, SWITCH_GAPS, GAPS = 0.5, (100_000, 400_000), (5, 30, 60), (1, 5, 60)
#: The signals of a break in the order in which one becomes its cause.
SIGNALS = ("compaction", "fork", "model_change", "version_change", "ttl_expiration")
#: Most patterns of a price list.
PATTERNS = 1000


def minutes(later: str | Column, earlier: str | Column) -> Column:
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / 6e7


def with_ancestors(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each row with its ancestor's columns (p_...), whether a compaction lies between (crossed), whether it forks: its ancestor is not the
    session's latest row before it, the minutes between (gap) and what was established. Rows without an ancestor have none of these."""
    own = rows.select("id", "session", "model", "version", "ts", "cache_read", "cache_write")
    latest = own.withColumn("latest", F.lag("id").over(Window.partitionBy("session").orderBy("id"))).join(lineage.select("id", "ancestor", "crossed"), "id", "left")
    up = own.select(F.col("id").alias("ancestor"), *[F.col(c).alias(f"p_{c}") for c in ("model", "version", "ts", "cache_read", "cache_write")])
    r = latest.join(up, "ancestor", "left").withColumns({"established": F.col("p_cache_read") + F.col("p_cache_write"), "gap": minutes("ts", "p_ts"), "fork": F.col("p_cache_read").isNotNull() & F.coalesce(F.col("ancestor") != F.col("latest"), F.lit(False))})
    return r.withColumn("broke", F.coalesce((F.col("established") >= FLOOR) & (F.col("cache_read") < F.col("established") * SHARE), F.lit(False)))


def lineage_breaks(pairs: DataFrame, ttl_minutes: int = TTL_MINUTES, hard: float = HARD) -> DataFrame:
    """(session, id, signals, cause, hard, written, recache, fresh, avoidability) of each break of ``with_ancestors``'s rows.

    ``signals`` joins all that can explain the break, the first is its cause (none: unknown). What was written splits into what the ancestor
    had already (recache) and new content (fresh). ``avoidability`` says whether the recache could have been spared.
    """
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    late = F.coalesce(F.col("gap") > ttl_minutes, F.lit(False))
    seen = [F.coalesce("crossed", F.lit(False)), F.col("fork"), other("model"), other("version"), late]
    signals = F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in zip(seen, SIGNALS)]))
    b = pairs.filter("broke").withColumns({"found": signals, "late": late})
    cause = F.coalesce(F.try_element_at("found", F.lit(1)), F.lit("unknown"))
    recache = F.least("cache_write", F.greatest(F.lit(0), F.col("established") - F.col("cache_read")))
    config = cause.isin("model_change", "version_change")
    spare = F.when(cause == "ttl_expiration", "unavoidable_ttl_idle").when(cause == "fork", "artifact_or_userfork").when(config & F.col("late"), "unavoidable_ttl_coincident").when(config, "addressable_config").when(cause == "compaction", "compaction").otherwise("addressable_midwork")
    return b.select("session", "id", F.when(F.size("found") > 0, F.array_join("found", "+")).otherwise("unknown").alias("signals"), cause.alias("cause"), (F.col("cache_read") < F.col("established") * hard).alias("hard"), F.col("cache_write").alias("written"), recache.alias("recache"), (F.col("cache_write") - recache).alias("fresh"), spare.alias("avoidability"))


def break_summary(breaks: DataFrame, by: str) -> DataFrame:
    """Breaks by cause, by set of signals or by avoidability: breaks, hard ones, and tokens written, cached again and new."""
    return breaks.groupBy(by).agg(F.count("*").alias("breaks"), F.sum(F.col("hard").cast("bigint")).alias("hard_breaks"), *[F.sum(c).alias(c) for c in ("written", "recache", "fresh")])


def bucketed(value: Column, bounds: tuple[int, ...]) -> Column:
    """How many of the bounds a value has reached: 0 for less than the first; null stays."""
    return F.when(value.isNotNull(), sum(((value >= b).cast("int") for b in bounds), F.lit(0)))


def gap_shares(pairs: DataFrame, bounds: tuple[int, ...] = GAPS) -> DataFrame:
    """(bucket, n, percent) of the gaps to the ancestor in minutes."""
    n = pairs.filter("gap is not null").groupBy(bucketed(F.col("gap"), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))  # one row for each bucket


def switches(pairs: DataFrame) -> DataFrame:
    """The rows whose model is not their ancestor's: from_model, to_model, established, broke, warm (the new model found an established cache),
    migrated (tokens cached again after a break), crossed, gap_bucket."""
    s = pairs.filter("model <> p_model")
    moved = F.when(F.col("broke"), F.least("cache_write", F.greatest(F.lit(0), F.col("established") - F.col("cache_read")))).otherwise(0)
    return s.select("session", "id", F.col("p_model").alias("from_model"), F.col("model").alias("to_model"), "established", "broke", ((F.col("established") >= FLOOR) & ~F.col("broke")).alias("warm"), moved.alias("migrated"), F.coalesce("crossed", F.lit(False)).alias("crossed"), bucketed(F.col("gap"), SWITCH_GAPS).alias("gap_bucket"))


def switch_matrix(found: DataFrame) -> DataFrame:
    """Per pair of models: switches, breaks, warm returns, migrated tokens, large contexts, switches across a compaction, and switches by gap
    (gap_0 below the first bound; gap_unknown without times)."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    gaps = [n(F.col("gap_bucket") == k, f"gap_{k}") for k in range(len(SWITCH_GAPS) + 1)]
    return found.groupBy("from_model", "to_model").agg(F.count("*").alias("switches"), n(F.col("broke"), "breaks"), n(F.col("warm"), "warm_returns"), F.sum("migrated").alias("migrated"), *[n(F.col("established") >= b, f"from_{b // 1000}k") for b in LARGE], n(F.col("crossed"), "near_compaction"), *gaps, n(F.col("gap_bucket").isNull(), "gap_unknown"))


def nearest_ranks(rows: DataFrame, column: str, shares: tuple[float, ...], key: str = "id") -> DataFrame:
    """(share, value): the value at place floor(share * n) of the n sorted ones, the last at most. Places come from range partitions, and only the
    rows at the wanted places are read back."""
    placed = numbered(rows.select(column, key), column, key)
    n = rows.count()
    at = F.array(*[F.struct(F.lit(p).alias("share"), F.lit(min(n - 1, int(p * n))).cast("bigint").alias("wanted")) for p in shares])
    asked = placed.withColumn("w", F.explode(F.filter(at, lambda w: w["wanted"] == F.col("place"))))
    return asked.select("w.share", F.col(column).alias("value"))


def price_columns(prices: DataFrame, model: Column) -> dict[str, Column]:
    """The prices of a model by tier, and whether they are verified: those of the first pattern of the ordered list that the name contains, else
    the default's (ord below 0; without one, nothing costs). The list is configuration of at most ``PATTERNS`` rows and becomes an expression."""
    listed = sorted(prices.limit(PATTERNS + 1).collect(), key=lambda r: r["ord"])
    if len(listed) > PATTERNS:
        raise ValueError(f"a price list has at most {PATTERNS} patterns")
    tiers = {"input": "input_price", "output": "output_price", "cache_read": "cache_read", "cache_write_5m": "cache_write_5m", "cache_write_1h": "cache_write_1h", "verified": "verified"}
    default = next((r for r in listed if r["ord"] < 0), None)

    def tier(name: str) -> Column:
        kind = "boolean" if name == "verified" else "double"
        out = None
        for r in listed:
            if r["ord"] >= 0:
                hit, value = F.contains(F.coalesce(model, F.lit("")), F.lit(r["match"])), F.lit(r[tiers[name]]).cast(kind)
                out = F.when(hit, value) if out is None else out.when(hit, value)
        last = F.lit(default[tiers[name]] if default else None).cast(kind)
        return F.coalesce(last if out is None else out.otherwise(last), F.lit(False) if name == "verified" else F.lit(None).cast(kind))

    return {name: tier(name) for name in tiers}


def costed_ledger(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model and over all (model null, overall true): requests, tokens by kind, occupancy, cost in dollars and whether all its prices are verified.

    ``cost`` takes every cache write at the one-hour price, or the five-minute one where there is no other; ``tier_cost`` takes writes known to be
    of either tier (cache_write_5m, cache_write_1h) at their own price. Prices are per million tokens and sums are taken before them.
    """
    tokens = ("input", "cache_read", "cache_write", "output", "cache_write_5m", "cache_write_1h")
    have = requests.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in requests.columns else F.lit(0).cast("bigint") for c in tokens})
    g = have.groupBy("model").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in tokens])
    p = price_columns(prices, F.col("model"))
    price = lambda c: F.coalesce(p[c], F.lit(0.0))
    hour = F.coalesce(p["cache_write_1h"], p["cache_write_5m"], F.lit(0.0))
    same = F.col("input") * price("input") + F.col("cache_read") * price("cache_read") + F.col("output") * price("output")
    split = F.col("cache_write_5m") * F.coalesce(p["cache_write_5m"], hour) + F.col("cache_write_1h") * hour + (F.col("cache_write") - F.col("cache_write_5m") - F.col("cache_write_1h")) * hour
    g = g.withColumns({"cost": (same + F.col("cache_write") * hour) / 1e6, "tier_cost": (same + split) / 1e6, "verified": p["verified"], "occupancy": F.col("input") + F.col("cache_read") + F.col("cache_write")})
    kept = ["requests", *tokens, "occupancy", "cost", "tier_cost"]
    out = g.groupingSets([["model"], []], "model").agg(*[F.sum(c).alias(c) for c in kept], F.bool_and("verified").alias("verified"), (F.grouping("model") == 1).alias("overall"))
    return out.filter("requests is not null").withColumns({c: F.round(c, 6) for c in ("cost", "tier_cost")})
