"""Waste, rebuilds and lineage in session logs, and look-ups in code symbols. Everything is joins, grouping and keyed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored


def lineage_parent(rows: DataFrame) -> DataFrame:
    """(id, ancestor, crossed): the nearest ancestor with usage, and whether a boundary row lies between.

    ``rows``: id, parent, usage, boundary. Pointers double in each round, so a chain of n rows takes about log2(n) rounds.
    Rows without such an ancestor, and rows on a cycle, have none.
    """
    up = rows.select(F.col("id").alias("parent"), F.col("usage").alias("p_usage"), F.col("boundary").alias("p_boundary"))
    done = F.coalesce("p_usage", F.lit(True))
    jumps = rows.select("id", "parent").join(up, "parent", "left").select("id", F.when(F.col("p_usage").isNotNull(), F.col("parent")).alias("to"), (~done & F.coalesce("p_boundary", F.lit(False))).alias("crossed"), done.alias("done"))
    jumps, before = stored(jumps, "jumps"), None
    while (open_rows := jumps.filter("not done").count()) and open_rows != before:
        before = open_rows
        step = jumps.select(F.col("id").alias("to"), F.col("to").alias("to_2"), F.col("crossed").alias("crossed_2"), F.col("done").alias("done_2"))
        moved = jumps.filter("not done").join(step, "to").select("id", F.col("to_2").alias("to"), (F.col("crossed") | F.col("crossed_2")).alias("crossed"), F.col("done_2").alias("done"))
        jumps = stored(jumps.filter("done").unionByName(moved), "jumps")
    return jumps.select("id", F.when(F.col("done"), F.col("to")).alias("ancestor"), "crossed")


def forks(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Usage rows whose ancestor is not the session's latest usage row before them."""
    w = Window.partitionBy("session").orderBy("id")
    latest = rows.filter("usage").select("session", "id").withColumn("latest", F.lag("id").over(w))
    return latest.join(lineage, "id").filter("ancestor <> latest").select("session", "id", "ancestor", "latest")


def recache_by_bucket(requests: DataFrame) -> DataFrame:
    """Honest rebuilds (writes of what the request before already held) by how they could have been avoided."""
    w = Window.partitionBy("session").orderBy("turn")
    r = requests.select("*", F.lag(F.col("cache_read") + F.col("cache_write")).over(w).alias("held"), F.lag("model").over(w).alias("p_model"), F.lag("ts").over(w).alias("p_ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("p_ts").cast("timestamp"))) / 6e7
    bucket = F.when(F.col("model") != F.col("p_model"), "model").when(gap < 5, "within_5m").when(gap < 60, "within_1h").otherwise("expired")
    r = r.withColumns({"rebuilt": F.least("cache_write", F.greatest(F.lit(0), F.col("held") - F.col("cache_read"))), "bucket": bucket}).filter("held is not null and rebuilt > 0")
    return r.groupBy("bucket").agg(F.count("*").alias("requests"), F.sum("rebuilt").alias("rebuilt"), F.sum("cache_write").alias("written"))


def cache_churn(requests: DataFrame) -> DataFrame:
    """For each session, cache writes that new content does not explain."""
    g = requests.groupBy("session").agg(F.sum("cache_write").alias("written"), F.sum(F.col("input") + F.col("output")).alias("fresh"))
    return g.withColumn("churn", F.greatest(F.lit(0), F.col("written") - F.col("fresh")))


def reset_boundaries(requests: DataFrame, share: float = 0.6, floor: int = 50_000) -> DataFrame:
    """Requests whose context fell under ``share`` of the one before, where that was over ``floor``."""
    total = F.col("input") + F.col("cache_read") + F.col("cache_write")
    r = requests.select("session", "turn", total.alias("total")).withColumn("before", F.lag("total").over(Window.partitionBy("session").orderBy("turn")))
    return r.filter((F.col("before") > floor) & (F.col("total") < F.col("before") * share))


def boundaries_since_previous(rows: DataFrame) -> DataFrame:
    """For each usage row, the boundary rows since the usage row before it."""
    w = Window.partitionBy("session").orderBy("id")
    r = rows.withColumn("seen", F.sum(F.col("boundary").cast("bigint")).over(w)).filter("usage")
    return r.select("session", "id", (F.col("seen") - F.coalesce(F.lag("seen").over(w), F.lit(0))).alias("boundaries"))


def next_user_turn(turns: DataFrame) -> DataFrame:
    """For each row of a conversation, the turn of the next user row (null: none follows)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("next_user"))


def stale_results(calls: DataFrame) -> DataFrame:
    """Results that the same call later gave with other content, and the token-turns that they stayed on."""
    w = Window.partitionBy("session", "args").orderBy("turn")
    last = calls.groupBy("session").agg(F.max("turn").alias("last_turn"))
    c = calls.withColumns({"next_hash": F.lead("hash").over(w), "stale_from": F.lead("turn").over(w)}).filter("next_hash <> hash").join(last, "session")
    return c.select("session", "turn", "stale_from", (F.col("tokens") * (F.col("last_turn") - F.col("stale_from"))).alias("token_turns"))


def opportunity_pools(calls: DataFrame, large: int = 500, old: int = 50) -> DataFrame:
    """Per session, tokens of large results and of results that stayed for more than ``old`` turns."""
    last = calls.groupBy("session").agg(F.max("turn").alias("last_turn"))
    held = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0))
    return calls.join(last, "session").groupBy("session").agg(F.count("*").alias("results"), held(F.col("tokens") >= large).alias("large_tokens"), held(F.col("last_turn") - F.col("turn") > old).alias("old_tokens"))


def corpus_rollup(events: DataFrame) -> DataFrame:
    """Calls and tokens by kind, by representation and in all, in one pass."""
    g = events.groupingSets([["kind"], ["representation"], []], "kind", "representation")
    return g.agg(F.count("*").alias("calls"), F.sum(F.col("success").cast("bigint")).alias("succeeded"), F.sum("tokens").alias("tokens"))


def token_shares(read_labels: DataFrame) -> DataFrame:
    """Share of each class in the tokens of its window."""
    g = read_labels.groupBy("window", "class").agg(F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy("window"))
    return g.withColumn("share", F.round(100 * F.col("tokens") / F.nullif(whole, F.lit(0)), 4))


def support_paths(events: DataFrame) -> DataFrame:
    """Paths that a stream read and never edited."""
    path = lambda kind: events.filter((F.col("kind") == kind) & F.col("path").isNotNull()).select("stream", "path")
    return path("read").distinct().join(path("edit").distinct(), ["stream", "path"], "left_anti")


def attribute_tokens(events: DataFrame) -> DataFrame:
    """Batches with one read have its tokens attributed; those with several are ambiguous."""
    g = events.filter("kind = 'read' and batch is not null").groupBy("batch").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"))
    return g.withColumn("attribution", F.when(F.col("reads") == 1, "attributed").otherwise("ambiguous"))


def call_fingerprint(tool: Column, representation: Column, *args: Column) -> Column:
    """A hash of the call that shows none of its arguments."""
    return F.sha1(F.concat_ws("|", tool, representation, *args))


def rewrite_amplification(versions: DataFrame) -> DataFrame:
    """Lines that each version of a file added and removed, as multisets: session, path, version, added, removed.

    ``versions``: session, path, version (0, 1, ...), text. Each line counts +1 in its own version and -1 in the next one.
    """
    last = versions.groupBy("session", "path").agg(F.max("version").alias("last_version"))
    own = versions.select("session", "path", "version", F.explode(F.split("text", "\n")).alias("line"))
    own = own.groupBy("session", "path", "version", F.xxhash64("line").alias("h"), F.sha1("line").alias("line")).agg(F.count("*").alias("n"))
    after = own.join(last, ["session", "path"]).filter("version < last_version").withColumns({"version": F.col("version") + 1, "n": -F.col("n")}).drop("last_version")
    d = own.unionByName(after).groupBy("session", "path", "version", "h", "line").agg(F.sum("n").alias("n")).filter("version > 0")
    return d.groupBy("session", "path", "version").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def top_items(items: DataFrame, by: str, item: str, top: int = 12) -> DataFrame:
    """Each group's most frequent items as text, and how many more it has."""
    g = items.groupBy(by, item).agg(F.count("*").alias("n"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), item))).filter(F.col("rank") <= top)
    listed = ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item, "n"))), lambda x: F.concat_ws(":", x[item], x["n"])), ",").alias("listed"))
    return listed.join(g.groupBy(by).agg(F.greatest(F.lit(0), F.count("*") - top).alias("more")), by)


def callers(edges: DataFrame, kind: str, top: int = 5) -> DataFrame:
    """The first ``top`` sources of each target, and how many it has."""
    e = edges.filter(F.col("type") == kind).select("dst", "src").distinct()
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter(F.col("rank") <= top)
    return ranked.select("dst", "src").join(e.groupBy("dst").agg(F.count("*").alias("total")), "dst")


#: Lines of one block when spans meet lines.
LINE_BLOCK = 64


def line_blocks(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / LINE_BLOCK), F.floor(high / LINE_BLOCK))


def symbol_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The narrowest symbol around each (path, line); of equals the one that starts last, then the smallest id. Spans and places meet by
    path and block of lines."""
    spans = symbols.select("id", "path", "start_line", "end_line", F.explode(line_blocks(F.col("start_line"), F.col("end_line"))).alias("block"))
    hit = places.withColumn("block", F.floor(F.col("line") / LINE_BLOCK)).join(spans, ["path", "block"]).filter("line between start_line and end_line")
    order = F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("id"))
    return hit.groupBy("path", "line").agg(F.min_by("id", order).alias("id"), F.count("*").alias("enclosing"))


def search_symbols(symbols: DataFrame, wanted: list[str], top: int = 10) -> DataFrame:
    """For each wanted name (a short list, given by the caller): exact hits, then suffixes, then substrings; short names first. A symbol
    gives rows only for the names that it holds."""
    hits = F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda q: F.contains("qualified", q))).alias("query")
    s = symbols.select("id", "qualified", hits)
    kind = F.when(F.col("qualified") == F.col("query"), 0).when(F.endswith("qualified", F.col("query")), 1).otherwise(2)
    w = Window.partitionBy("query").orderBy("kind", F.length("qualified"), "qualified", "id")
    return s.withColumn("kind", kind.cast("bigint")).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top).select("query", "rank", "kind", "id")


def expansion_debt(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Each parent's tokens and what its expansions cost on top."""
    debt = children.groupBy("parent_id").agg(F.count("*").alias("expansions"), F.sum("tokens").alias("debt"))
    return parents.join(debt, parents["id"] == debt["parent_id"], "left").select("id", F.coalesce("expansions", F.lit(0)).alias("expansions"), F.coalesce("debt", F.lit(0)).alias("debt"))


def token_crosscheck(log: DataFrame, journal: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """How many calls both sides have, and on how many they agree."""
    both = log.select("id", F.col("tokens").alias("a")).join(journal.select("id", F.col("tokens").alias("b")), "id")
    agree = F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.col("b"), F.lit(1))
    return both.groupBy(F.col("b").isNull().alias("unmeasured")).agg(F.count("*").alias("compared"), F.sum(F.coalesce(agree, F.lit(False)).cast("bigint")).alias("agreed"))
