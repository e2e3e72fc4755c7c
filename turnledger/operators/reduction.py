"""Compaction of search outputs, what compaction is worth, and pools of candidates for what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators import compaction

#: Messages of search tools that are evidence of their own.
DIAGNOSTIC = r"(: No such file or directory$|: Permission denied$|: Is a directory$|^Binary file .* matches$|^grep: |^egrep: |^fgrep: |^rg: |^ripgrep: |^find: |^ls: )"

#: Search lines with and without a line number.
NUMBERED, NAMED = r"^(.*?):(\d+):", r"^([^:]+):"


def matched_path(line: Column) -> Column:
    """The file of a search line: before ``:number:``, else before the first colon, else the whole line."""
    return F.when(~line.contains(":"), line).when(line.rlike(NUMBERED), F.regexp_extract(line, NUMBERED, 1)).when(line.rlike(NAMED), F.regexp_extract(line, NAMED, 1)).otherwise(line)


def reduce_search(outputs: DataFrame, budget: int = 256, diagnostic: str = DIAGNOSTIC, scores: DataFrame | None = None) -> DataFrame:
    """(id, reduced, matches, files, diagnostics, kept) of outputs (id, text) with any line that is not blank.

    Diagnostics always stay. Matches stay verbatim, in file order or by the score of their file (path, score), while what
    diagnostics leave of ``budget`` tokens lasts; kept lines are shown in file order.
    """
    rows = compaction.lines(outputs).filter("trim(line) <> ''").withColumns({"diagnostic": F.col("line").rlike(diagnostic), "path": matched_path(F.col("line"))})
    found, cost = ~F.col("diagnostic"), F.length("line") + 1
    head = rows.groupBy("id").agg(F.count(F.when(found, 1)).alias("matches"), F.countDistinct(F.when(found, F.col("path"))).alias("files"), F.count(F.when(~found, 1)).alias("diagnostics"), F.sum(F.when(~found, cost).otherwise(0)).alias("spoken"))
    kept = within(rows, head, budget, scores)
    body = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(found.alias("later"), "pos", "line"))), lambda r: r["line"]), "\n").alias("body"), F.count(F.when(found, 1)).alias("kept"))
    title = F.concat(F.col("matches").cast("string"), F.lit(" matches in "), F.col("files").cast("string"), F.lit(" file(s)"))
    return head.join(body, "id", "left").select("id", F.concat_ws("\n", title, "body").alias("reduced"), "matches", "files", "diagnostics", F.coalesce("kept", F.lit(0)).alias("kept"))


def within(rows: DataFrame, head: DataFrame, budget: int, scores: DataFrame | None) -> DataFrame:
    """Diagnostics, and matches while their running cost fits what diagnostics leave."""
    rows = rows.withColumn("cost", F.length("line") + 1)  # so that lines travel only where they are wanted
    ranked = rows.withColumn("score", F.lit(0.0)) if scores is None else rows.join(scores.select("path", "score"), "path", "left").fillna(0.0, ["score"])
    w = Window.partitionBy("id", "diagnostic").orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranked.withColumn("spent", F.sum("cost").over(w)).join(head.select("id", "spoken"), "id")
    return spent.drop("cost").filter(F.col("diagnostic") | (F.col("spent") <= 4 * budget - F.col("spoken")))


def kept_matches(outputs: DataFrame, budget: int = 256, diagnostic: str = DIAGNOSTIC, scores: DataFrame | None = None) -> DataFrame:
    """(id, pos, line, path): the match lines that ``reduce_search`` keeps."""
    rows = compaction.lines(outputs).filter("trim(line) <> ''").withColumns({"diagnostic": F.col("line").rlike(diagnostic), "path": matched_path(F.col("line"))})
    head = rows.groupBy("id").agg(F.sum(F.when(F.col("diagnostic"), F.length("line") + 1).otherwise(0)).alias("spoken"))
    return within(rows, head, budget, scores).filter("not diagnostic").select("id", "pos", "line", "path")


def reduction_scan(outputs: DataFrame, floor: int = 400, most_bytes: int = 200_000, ends: int = 10) -> DataFrame:
    """Outputs (id, text) by what becomes of them: too small or large, holding secrets, not getting smaller, or reduced; with
    their tokens before and after. Only outputs that can be given back exactly are reduced."""
    small = compaction.reduce_generic(outputs, ends).select("id", F.length("reduced").alias("after"))
    r = outputs.select("id", F.length("text").alias("before"), F.octet_length("text").alias("bytes"), (C.redactions(F.col("text")) > 0).alias("secret")).join(small, "id")
    reason = F.when(F.floor(F.col("before") / 4) < floor, "below_floor").when(F.col("bytes") > most_bytes, "too_large").when(F.col("secret"), "secret").when(F.col("after") >= F.col("before"), "not_smaller").otherwise("reduced")
    tokens = lambda c: F.sum(F.floor(F.col(c) / 4))
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("outputs"), tokens("before").alias("raw_tokens"), F.sum(F.when(reason == "reduced", F.floor(F.col("after") / 4)).otherwise(F.floor(F.col("before") / 4))).alias("reduced_tokens"))


def candidate_pool(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, rank, layer): union of ranked relations (id, rank), each candidate with its best rank and the first layer that has it."""
    every = None
    for k, (name, layer) in enumerate(layers):
        part = layer.select("id", F.col("rank").cast("bigint").alias("rank"), F.lit(k).alias("k"), F.lit(name).alias("layer"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.min(F.struct("rank", "k", "layer")).alias("best")).select("id", "best.rank", "best.layer")


def file_read_ceiling(events: DataFrame, percent: int = 80) -> DataFrame:
    """Per session: tokens saved over all later turns if file reads were cut by ``percent``: of all reads, of reads of files
    nobody edits, and of all reads until their file's first edit."""
    reads = events.filter("kind = 'read' and representation = 'file'").select("session", "path", "step", "tokens")
    end = events.groupBy("session").agg(F.greatest(F.max("step"), F.lit(1)).alias("last_step"))
    first = events.filter("kind = 'edit'").groupBy("session", "path").agg(F.min("step").alias("edit_step"))
    r = reads.join(end, "session").join(first, ["session", "path"], "left")
    rest = F.col("tokens") * F.greatest(F.col("last_step") - F.col("step"), F.lit(0))
    free = F.col("edit_step").isNull()
    until = F.when(free, rest).otherwise(F.col("tokens") * F.greatest(F.col("edit_step") - F.col("step"), F.lit(0)))
    saved = lambda c: F.floor(F.sum(c) * percent / 100)
    return r.groupBy("session").agg(F.count("*").alias("reads"), F.count(F.when(free, 1)).alias("reducible_reads"), saved(rest).alias("raw_saving"), saved(F.when(free, rest).otherwise(0)).alias("reducible_saving"), saved(until).alias("residency_saving"))


def effective_price(requests: DataFrame, prices: list[tuple[int, str, float]]) -> DataFrame:
    """Request-weighted price by version: of an ordered list (order, part of the model's name, price), the first that fits;
    order -1 is the default."""
    price = F.lit([p for k, _, p in prices if k < 0][0])
    for _, match, p in sorted((x for x in prices if x[0] >= 0), reverse=True):
        price = F.when(F.contains(F.coalesce("model", F.lit("")), F.lit(match)), p).otherwise(price)
    return requests.groupBy("version").agg(F.count("*").alias("requests"), F.round(F.avg(price), 6).alias("effective"))


def continuation(rows: DataFrame, prefix: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the earlier part of the session does not have."""
    return rows.join(prefix.select(key), key, "left_anti")


def reduction_by_reducer(outputs: DataFrame, reducers: dict[str, DataFrame]) -> DataFrame:
    """(reducer, reason, outputs, raw_tokens, reduced_tokens) of outputs (id, text, kind, reducer): what the retention rule says of each, and what
    its reducer makes of it (reducers: name to (id, reduced)). A text that does not get smaller stays."""
    small = None
    for name, reduced in reducers.items():
        own = outputs.filter(F.col("reducer") == name).select("id").join(reduced, "id").select("id", F.floor(F.length("reduced") / 4).alias("small"))
        small = own if small is None else small.unionByName(own)
    r = outputs.select("id", "reducer", "kind", F.floor(F.length("text") / 4).alias("raw")).join(small, "id", "left").withColumn("rule", C.should_reduce(F.col("kind"), F.col("raw")))
    reason = F.when(F.col("rule.reduce") & F.coalesce(F.col("small") < F.col("raw"), F.lit(False)), "reduced").when(F.col("rule.reduce"), "not_smaller").otherwise(F.col("rule.reason"))
    return r.groupBy("reducer", reason.alias("reason")).agg(F.count("*").alias("outputs"), F.sum("raw").alias("raw_tokens"), F.sum(F.when(reason == "reduced", F.col("small")).otherwise(F.col("raw"))).alias("reduced_tokens"))
