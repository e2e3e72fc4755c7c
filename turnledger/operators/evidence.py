"""What the journal says about versions, responses, gates, distances, and whether retired objects were needed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators import compaction
from turnledger.operators.usage import LINE_BLOCK, line_blocks

#: How header and hunk lines of diffs and logs begin.
GIT_HEADERS = ("commit ", "Author:", "Date:", "diff --git", "+++", "---", "@@")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def read_versions(calls: DataFrame) -> DataFrame:
    """(seq, version, version_status, mutation_status, outcome) of calls (seq, kind, pre, post, success).

    Reads are stable when both digests agree, raced when they differ. Edits that changed nothing are no mutations and go;
    a failed edit that changed bytes anyway is a partial failure.
    """
    known = F.col("pre").isNotNull() & F.col("post").isNotNull()
    edit, same = F.col("kind") == "edit", F.col("pre") == F.col("post")
    kept = calls.filter(~(edit & known & same))
    status = F.when(~known, "unverified").when(edit | same, "stable").otherwise("raced")
    mutation = F.when(edit & known, "verified_change").when(edit, "unverified")
    failed = F.when(~edit, "failed").when(known, "failed_partial").otherwise("failed_uncertain")
    version = F.when(edit | (known & same), F.col("pre"))
    return kept.select("seq", version.alias("version"), status.alias("version_status"), mutation.alias("mutation_status"), F.when(F.col("success"), "success").otherwise(failed).alias("outcome"))


def measure_responses(blocks: DataFrame) -> DataFrame:
    """(id, chars, tokens, text_hash, status) of responses in blocks (id, pos, type, text). Blocks that are not text leave the
    response partly measured, or, without any text block, unmeasured."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))), lambda b: b["text"]), "")
    g = blocks.groupBy("id").agg(text.alias("joined"), count_if(F.col("type") == "text").alias("texts"), count_if(F.col("type") != "text").alias("others"))
    joined = F.when(F.col("texts") > 0, F.col("joined"))
    status = F.when((F.col("texts") > 0) & (F.col("others") > 0), "text_partial_multimodal").when(F.col("texts") > 0, "text").otherwise("multimodal")
    return g.select("id", F.length(joined).cast("bigint").alias("chars"), C.est_tokens(joined).cast("bigint").alias("tokens"), C.content_hash(joined).alias("text_hash"), status.alias("status"))


def causal_histogram(labels: DataFrame) -> DataFrame:
    """Links from reads to the edits that needed them, by distance in steps."""
    return labels.filter("class = 'precondition'").groupBy("window", C.distance_bucket(F.col("distance")).alias("bucket")).agg(F.count("*").alias("links"))


def admission_gates(events: DataFrame, unknown_share: float = 0.5) -> DataFrame:
    """Per session: whether every step is known, every read is measured and stable versions prevail, and all of these at once."""
    read = F.col("kind") == "read"
    g = events.groupBy("session").agg(
        F.count("*").alias("events"), F.bool_and(F.col("step").isNotNull()).alias("steps_clean"), F.coalesce(F.bool_and(F.when(read, F.col("tokens").isNotNull())), F.lit(False)).alias("token_share_eligible"),
        (count_if(F.col("status") != "stable") <= unknown_share * F.count("*")).alias("versions_clean"),
    )
    return g.withColumn("admissible", F.col("steps_clean") & F.col("token_share_eligible") & F.col("versions_clean"))


def reduce_git(outputs: DataFrame) -> DataFrame:
    """(id, reduced, added, removed): header and hunk lines of diffs and logs stay, changed lines are counted."""
    line = F.col("line")
    header = F.lit(False)
    for start in GIT_HEADERS:
        header |= line.startswith(start)
    rows = outputs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("header", header)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("header"), F.struct("pos", "line")))), lambda r: r["line"]), "\n")
    g = rows.groupBy("id").agg(kept.alias("kept"), count_if(~F.col("header") & line.startswith("+")).alias("added"), count_if(~F.col("header") & line.startswith("-")).alias("removed"))
    footer = F.concat(F.lit("[+"), F.col("added").cast("string"), F.lit(" / -"), F.col("removed").cast("string"), F.lit(" changed lines]"))
    return g.select("id", F.when(F.col("kept") == "", footer).otherwise(F.concat("kept", F.lit("\n"), footer)).alias("reduced"), "added", "removed")


def staleness_safety(objects: DataFrame, needs: DataFrame, lags: tuple[int, ...] = (0, 3, 5, 10, 20)) -> DataFrame:
    """Per session and lag: last versions (session, key, turn, size) retired ``lag`` turns after their last touch, and how many
    nobody needs (session, key, turn) later. Only the last need counts, so it is found once for all lags."""
    last = F.row_number().over(Window.partitionBy("session", "key").orderBy(F.desc("turn"))) == 1
    end = objects.groupBy("session").agg(F.max("turn").alias("last_turn"))
    tails = objects.withColumn("last", last).filter("last").select("session", "key", F.col("turn").alias("tail_turn"), "size")
    needed = needs.groupBy("session", "key").agg(F.max("turn").alias("needed"))
    r = tails.join(end, "session").join(needed, ["session", "key"], "left").withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    r = r.withColumn("retired", F.col("tail_turn") + F.col("lag")).filter("retired < last_turn")
    gross, safe = F.col("size") * (F.col("last_turn") - F.col("retired")), F.coalesce(F.col("needed") <= F.col("retired"), F.lit(True))
    return r.groupBy("session", "lag").agg(F.count("*").alias("n_retired"), count_if(safe).alias("n_safe"), F.sum(gross).alias("tail_gross"), F.sum(F.when(safe, gross).otherwise(0)).alias("safe_gross"))


def later_needs(mentions: DataFrame, objects: DataFrame, edits: DataFrame, least: int = 20) -> DataFrame:
    """(session, key, turn): what needs an object again, of both kinds: turns that mention its key (mentions: session, key, turn), and edits
    (session, turn, text) that hold a distinctive line of one of its texts (objects: session, key, text). Only the last turn counts."""
    marked = lambda df, *keys: compaction.distinctive_lines(df.select(F.struct(*keys).alias("id"), "text"), least).select("id.*", F.xxhash64("line").alias("h"), F.sha1("line").alias("line"))
    shown = marked(objects, "session", "key").distinct()
    used = marked(edits, "session", "turn").groupBy("session", "h", "line").agg(F.max("turn").alias("turn"))
    reused = shown.join(used, ["session", "h", "line"]).select("session", "key", "turn")
    return mentions.select("session", "key", "turn").unionByName(reused).groupBy("session", "key").agg(F.max("turn").alias("turn"))


def read_tokens(events: DataFrame) -> DataFrame:
    """Per representation of successful reads: reads, tokens and their share of all."""
    g = events.filter("kind = 'read' and success").groupBy("representation").agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens"))
    return g.withColumn("share", C.pct(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))))  # one row for each representation


def path_scores(scores: DataFrame, matched: DataFrame) -> DataFrame:
    """(path, score): matched paths with the best score of their file, or else of the files they are a suffix of at a
    component boundary (or that are a suffix of them). Both ways are equi joins on path suffixes."""
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, F.size(F.split(c, "/"))), "/"))
    files = scores.groupBy("path").agg(F.max("score").alias("score")).filter("score > 0")
    asked = matched.select("path").distinct()
    exact = asked.join(files, "path")
    rest = asked.join(files, "path", "left_anti")
    under = files.select(F.explode(tails(F.col("path"))).alias("path"), "score").join(rest, "path")
    above = rest.select("path", F.explode(tails(F.col("path"))).alias("tail")).join(files.withColumnRenamed("path", "tail"), "tail").select("path", "score")
    return exact.unionByName(under.unionByName(above).groupBy("path").agg(F.max("score").alias("score")))


def symbols_overlapping_reads(spans: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, id) for spans (id, path, start_line, end_line) that touch the lines lo to hi of a read of the same path. Both are dealt to
    blocks of lines; a pair counts in the first block that both are in."""
    a = spans.select("id", "path", "start_line", "end_line", F.explode(line_blocks(F.col("start_line"), F.col("end_line"))).alias("block"))
    b = reads.select("read_id", "path", "lo", "hi", F.explode(line_blocks(F.col("lo"), F.col("hi"))).alias("block"))
    first = F.col("block") == F.floor(F.greatest("start_line", "lo") / LINE_BLOCK)
    return b.join(a, ["path", "block"]).filter(first & (F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo"))).select("read_id", "id")


def prefix_composition(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Per session: tokens of reads by representation and their share, and the first cache write."""
    file, search = (F.coalesce(F.sum(F.when((F.col("kind") == "read") & (F.col("representation") == r), F.col("tokens"))), F.lit(0)) for r in ("file", "search"))
    g = events.groupBy("session").agg(file.alias("file_tokens"), search.alias("search_tokens"), F.sum("tokens").alias("tokens"))
    floor = requests.filter("cache_write > 0").groupBy("session").agg(F.min_by("cache_write", "turn").alias("first_write"))
    return g.join(floor, "session", "left").select("session", "file_tokens", "search_tokens", "tokens", C.pct(F.col("file_tokens"), F.col("tokens")).alias("file_share"), "first_write")


def stratified_means(sessions: DataFrame, value: str, edges: tuple[int, ...] = (60, 100, 150), most_read: int = 210_000) -> DataFrame:
    """Mean of ``value`` by number of turns over sessions (turns, avg_read, value); sessions of several windows are left out."""
    bucket = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("turns") < edge, k).otherwise(bucket)
    return sessions.filter(F.col("avg_read") <= most_read).groupBy(bucket.cast("bigint").alias("stratum")).agg(F.count("*").alias("sessions"), F.round(F.avg("turns"), 4).alias("mean_turns"), F.round(F.avg(value), 4).alias("mean_value"))
