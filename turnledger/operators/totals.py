"""Totals over sessions: rebuilds by cause, prices by tier, opportunity pools, ceilings with their robustness, gates and tables by lag or
threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def tokens_if(condition: Column, tokens: str = "tokens") -> Column:
    return F.sum(F.when(condition, F.col(tokens)).otherwise(0))


def avoidability(requests: DataFrame, floor: int = 20_000, share: float = 0.5, ttl_minutes: int = 60) -> DataFrame:
    """(cause, bucket, rebuilds, recached, fresh) over requests (cache_read, cache_write, held, crossed, fork, p_model, model, p_version, version,
    gap_minutes; held: what the parent request had) that lost their cache: the first cause that applies, whether it could have been
    avoided, tokens written again and tokens that were new."""
    r = requests.filter((F.col("held") >= floor) & (F.col("cache_read") < share * F.col("held"))).withColumn("expired", F.coalesce(F.col("gap_minutes") > ttl_minutes, F.lit(False)))
    changed = lambda c: F.col(c) != F.col(f"p_{c}")
    cause = F.when(F.col("crossed"), "compaction").when(F.col("fork"), "fork").when(changed("model"), "model_change").when(changed("version"), "version_change").when(F.col("expired"), "ttl_expiration").otherwise("unknown")
    r = r.withColumns({"cause": cause, "recached": F.least("cache_write", F.greatest(F.lit(0), F.col("held") - F.col("cache_read")))})
    config = F.col("cause").isin("model_change", "version_change")
    bucket = (
        F.when(F.col("cause") == "ttl_expiration", "unavoidable_ttl_idle").when(F.col("cause") == "fork", "artifact_or_userfork").when(config & F.col("expired"), "unavoidable_ttl_coincident")
        .when(config, "addressable_config").when(F.col("cause") == "compaction", "compaction").otherwise("addressable_midwork")
    )
    return r.groupBy("cause", bucket.alias("bucket")).agg(F.count("*").alias("rebuilds"), F.sum("recached").alias("recached"), F.sum(F.col("cache_write") - F.col("recached")).alias("fresh"))


def tier_prices(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: the price of a token in each tier, weighted by the requests of each model. ``prices``: model and one column for each tier."""
    n = requests.groupBy("model").agg(F.count("*").alias("n"))
    tiers = [c for c in prices.columns if c != "model"]
    return n.join(prices, "model").agg(*[F.round(F.sum(F.col("n") * F.col(t)) / F.sum("n"), 6).alias(t) for t in tiers])


def addressable_cost(duplicates: DataFrame, stale: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: cost of what is delivered again (duplicates: tokens, token_turns) and of results that are stale (token_turns), at the prices
    (cache_write, cache_read) of a million tokens: a repeat is written once and read on the turns after."""
    a = duplicates.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("repeated"), F.coalesce(F.sum("token_turns"), F.lit(0)).alias("repeated_turns"))
    b = stale.agg(F.coalesce(F.sum("token_turns"), F.lit(0)).alias("stale_turns"))
    r = a.crossJoin(b).crossJoin(prices.select("cache_write", "cache_read"))  # three rows of totals
    cost_a = (F.col("repeated") * F.col("cache_write") + F.greatest(F.lit(0), F.col("repeated_turns") - F.col("repeated")) * F.col("cache_read")) / 1e6
    cost_b = F.col("stale_turns") * F.col("cache_read") / 1e6
    return r.select("repeated", "repeated_turns", "stale_turns", F.round(cost_a, 6).alias("repeat_cost"), F.round(cost_b, 6).alias("stale_cost"), F.round(cost_a + cost_b, 6).alias("addressable_cost"))


def result_pools(results: DataFrame, large_test: int = 400, large_search: int = 800, tail: int = 15) -> DataFrame:
    """(pool, results, tokens) of results (class, tokens, text, failed): what passing tests say beyond their last lines, dumped files, and
    searches that are too large."""
    ls = F.split("text", "\n")
    end = F.floor(F.length(F.array_join(F.slice(ls, F.greatest(F.size(ls) - tail + 1, F.lit(1)), tail), "\n")) / 4)
    pool = F.when((F.col("class") == "shell_test") & (F.col("tokens") > large_test) & ~F.col("failed"), "passing_test_verbosity").when(F.col("class") == "shell_file_dump", "bash_file_dump").when(F.col("class").isin("shell_search", "search_tool") & (F.col("tokens") > large_search), "oversized_search_dump")
    spare = F.when(pool == "passing_test_verbosity", F.greatest(F.lit(0), F.col("tokens") - end)).otherwise(F.col("tokens"))
    return results.select(pool.alias("pool"), spare.alias("spare")).filter("pool is not null").groupBy("pool").agg(F.count("*").alias("results"), F.sum("spare").alias("tokens"))


def ceiling_summary(labels: DataFrame) -> DataFrame:
    """Per window and kind (safe: exploration; broad: with searches): the share of read tokens over everything, its mean, quartiles and high
    counts over sessions, and its mean over strata. ``labels``: window, session, stratum, class, reason, tokens."""
    explored = F.col("class") == "exploration"
    free = F.explode(F.array(F.struct(F.lit("safe").alias("kind"), explored.alias("free")), F.struct(F.lit("broad").alias("kind"), (explored | ((F.col("class") == "unknown") & (F.col("reason") == "search_result"))).alias("free"))))
    r = labels.select("window", "session", "stratum", "tokens", free.alias("f")).select("window", "session", "stratum", "tokens", "f.*")
    share = lambda *keys: r.groupBy("window", "kind", *keys).agg((tokens_if(F.col("free")) / F.nullif(F.sum("tokens"), F.lit(0))).alias("share"))
    q = lambda p: F.round(F.percentile("share", F.lit(p)), 4)
    s = share("session").groupBy("window", "kind").agg(F.count("share").alias("sessions"), F.round(F.avg("share"), 4).alias("macro_mean"), q(0.25).alias("p25"), q(0.5).alias("macro_median"), q(0.75).alias("p75"), count_if(F.col("share") > 0.1).alias("above_10"), count_if(F.col("share") > 0.2).alias("above_20"))
    m = share().select("window", "kind", F.round("share", 4).alias("micro"))
    t = share("stratum").groupBy("window", "kind").agg(F.round(F.avg("share"), 4).alias("stratum_mean"))
    return m.join(s, ["window", "kind"]).join(t, ["window", "kind"])


def last_touch_ceiling(events: DataFrame, percent: int = 80) -> DataFrame:
    """Per session: tokens saved if each file's largest read went after the file was last read or edited. Files never read save nothing."""
    read = F.col("kind") == "read"
    f = events.filter("path is not null").groupBy("session", "path").agg(F.max(F.when(read, F.col("tokens"))).alias("size"), F.max("step").alias("last")).filter("size is not null")
    end = events.groupBy("session").agg(F.greatest(F.max("step"), F.lit(1)).alias("last_step"))
    g = f.join(end, "session")
    return g.groupBy("session").agg(F.count("*").alias("files"), F.floor(F.sum(F.col("size") * F.greatest(F.col("last_step") - F.col("last"), F.lit(0))) * percent / 100).alias("gross_saving"))


def output_ceiling(outputs: DataFrame, reduced: DataFrame, floor: int = 200) -> DataFrame:
    """Per session: tokens of outputs (id, session, turn, last_turn, tokens, test_like), those of test runs, and what their reduction (id, small)
    saves on all later turns; only where it is smaller."""
    r = outputs.join(reduced, "id", "left").withColumn("fits", F.col("test_like") & (F.col("tokens") >= floor))
    fired = F.coalesce(F.col("fits") & (F.col("small") < F.col("tokens")), F.lit(False))
    saved = F.when(fired, (F.col("tokens") - F.col("small")) * F.greatest(F.col("last_turn") - F.col("turn"), F.lit(0))).otherwise(0)
    return r.groupBy("session").agg(F.sum("tokens").alias("tokens"), tokens_if(F.col("fits")).alias("test_tokens"), count_if(fired).alias("fired"), F.sum(saved).alias("saving"))


def integrity(calls: DataFrame) -> DataFrame:
    """Per session of calls (session, seen, resolved, error, pending, shell, known, step, tokens, kind): the counts and ratios of the capture."""
    n = lambda c: count_if(F.coalesce(c, F.lit(False)))
    g = calls.groupBy("session").agg(
        F.count("*").alias("deliveries"), n(F.col("error")).alias("errors"), n(F.col("seen")).alias("seen_calls"), n(F.col("resolved")).alias("resolved_calls"), n(F.col("pending")).alias("pending"), n(F.col("shell")).alias("shell_calls"), n(F.col("shell") & ~F.col("known")).alias("unknown_shell"),
        n(F.col("step").isNull()).alias("missing_steps"), n((F.col("kind") == "read") & F.col("tokens").isNull()).alias("unmeasured_reads"),
    )
    return g.withColumns({"delivery_success": F.round(1 - F.col("errors") / F.col("deliveries"), 4), "unknown_share": F.round(F.col("unknown_shell") / F.nullif("shell_calls", F.lit(0)), 4)})


def admission(integrity: DataFrame) -> DataFrame:
    """Per session: the checks that all must hold for it to count, and two stricter ones reported beside them."""
    checks = {"pre_equals_batch": F.col("seen_calls") == F.col("resolved_calls"), "zero_errors": F.col("errors") == 0, "zero_pending": F.col("pending") == 0, "steps_complete": F.col("missing_steps") == 0}
    a = integrity.select("session", *[c.alias(k) for k, c in checks.items()], (F.col("unknown_shell") == 0).alias("shell_clean"), (F.col("unmeasured_reads") == 0).alias("token_share_eligible"))
    every = F.lit(True)
    for k in checks:
        every &= F.col(k)
    return a.withColumn("admissible", every)


def edge_report(edges: DataFrame) -> DataFrame:
    """Edges by type and match, with their mean confidence, and all of them."""
    g = edges.groupingSets([["type", "match"], ["type"], []], "type", "match")
    return g.agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def session_rollup(sessions: DataFrame) -> DataFrame:
    """Sessions (project, kind, requests, tokens) in all, by project and by kind."""
    g = sessions.groupingSets([["project"], ["kind"], []], "project", "kind")
    return g.agg(F.count("*").alias("sessions"), F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


def lag_table(safety: DataFrame) -> DataFrame:
    """Per lag over sessions: retired objects, the safe share of them, and the safe share of what retiring them saves."""
    g = safety.groupBy("lag").agg(F.count("*").alias("sessions"), F.sum("n_retired").alias("retired"), F.sum("n_safe").alias("safe"), F.sum("tail_gross").alias("gross"), F.sum("safe_gross").alias("safe_gross"))
    return g.withColumns({"safe_share": F.round(F.col("safe") / F.col("retired"), 4), "safe_gross_share": F.round(F.col("safe_gross") / F.nullif("gross", F.lit(0)), 4)})


def overlap_table(deferrals: DataFrame) -> DataFrame:
    """Per threshold: sessions that cross it, those that no longer do with retirement, and by how many turns the rest come later."""
    return deferrals.groupBy("threshold").agg(F.count("*").alias("crossings"), count_if(F.col("avoided")).alias("avoided"), F.round(F.avg("deferral"), 4).alias("mean_deferral"))


def merge_first(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or ignore: rows of ``old``, and those of ``new`` whose key is new (one of each)."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys)))


def merge_last(old: DataFrame, new: DataFrame, order: str, *keys: str) -> DataFrame:
    """Insert or replace: of each key the row with the greatest ``order``; new rows win ties."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(order, "is_new")).alias("r"))
    return best.select("r.*")


def eligible_reads(events: DataFrame) -> DataFrame:
    """(seq, session, path) of reads of paths that nobody in the session edits; a path with an edit of unknown outcome is not eligible."""
    edits = events.filter("kind = 'edit' and path is not null").select("session", "path").distinct()
    known = events.filter("kind = 'edit' and path is null").select("session").distinct()
    return events.filter("kind = 'read' and path is not null").join(edits, ["session", "path"], "left_anti").join(known, "session", "left_anti").select("seq", "session", "path")


def top_repeats(items: DataFrame, per_session: int = 20, top: int = 12) -> DataFrame:
    """(item, tokens, sessions): the dearest repeated items over all sessions, of each session's own ``per_session`` dearest."""
    g = items.groupBy("session", "item").agg(F.sum("tokens").alias("tokens"))
    own = g.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("tokens"), "item"))).filter(F.col("rank") <= per_session)
    return own.groupBy("item").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sessions")).orderBy(F.desc("tokens"), "item").limit(top)
