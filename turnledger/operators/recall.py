"""Whether compaction keeps what is needed later: reads before edits, kept lines, and measured savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators import compaction, reduction


def last_read_before_edit(events: DataFrame) -> DataFrame:
    """(edit_seq, session, path, turn, read_seq, read_turn, first_edit) for edits of a path that was read at the same turn or before; the
    latest such read. ``events``: seq, session, path, turn, kind."""
    w = Window.partitionBy("session", "path").orderBy("turn", F.when(F.col("kind") == "read", 0).otherwise(1), "seq").rowsBetween(Window.unboundedPreceding, -1)
    read = F.when(F.col("kind") == "read", F.struct(F.col("seq").alias("read_seq"), F.col("turn").alias("read_turn")))
    first = F.min(F.when(F.col("kind") == "edit", F.col("turn"))).over(Window.partitionBy("session", "path"))
    e = events.filter("kind in ('read', 'edit') and path is not null").select("seq", "session", "path", "turn", "kind", F.last(read, True).over(w).alias("read"), first.alias("first_turn"))
    return e.filter("kind = 'edit' and read is not null").select(F.col("seq").alias("edit_seq"), "session", "path", "turn", "read.read_seq", "read.read_turn", (F.col("turn") <= F.col("first_turn")).alias("first_edit"), (F.col("read_turn") <= F.col("first_turn")).alias("read_before_edits"))


def edit_recall(edits: DataFrame, old_lines: DataFrame, outputs: DataFrame, pattern: str, budget: int, gated: bool = True) -> DataFrame:
    """One row: edits that replace lines which a read had shown (``edits`` as last_read_before_edit gives them; old_lines: edit_seq, line;
    outputs: id of the read, text), and on how many all of these lines survive the reduction of that read. With the gate, reads after
    a file's first edit are not reduced."""
    wanted = old_lines.select("edit_seq", F.rtrim("line").alias("line")).filter("trim(line) <> ''").distinct()
    scored = edits.join(wanted.select("edit_seq").distinct(), "edit_seq", "left_semi").withColumn("reduced", F.lit(not gated) | F.col("read_before_edits"))
    reads = outputs.join(scored.filter("reduced").select(F.col("read_seq").alias("id")).distinct(), "id", "left_semi")
    kept = compaction.kept_lines(reads, pattern, budget).select(F.col("id").alias("read_seq"), F.rtrim("line").alias("line")).distinct()
    lost = scored.filter("reduced").select("edit_seq", "read_seq").join(wanted, "edit_seq").join(kept, ["read_seq", "line"], "left_anti").select("edit_seq").distinct().withColumn("lost", F.lit(True))
    s = scored.join(lost, "edit_seq", "left").withColumn("hit", (~F.coalesce("lost", F.lit(False))).cast("bigint"))
    n = F.count("*")
    return s.agg(n.alias("scored"), F.coalesce(F.sum(F.col("first_edit").cast("bigint")), F.lit(0)).alias("first_edits"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.round(F.sum("hit") / n, 4).alias("recall"))


def paired_reduction(outputs: DataFrame, budgets: tuple[int, ...], floors: tuple[int, ...], diagnostic: str = reduction.DIAGNOSTIC) -> DataFrame:
    """Per budget and floor: outputs, how many the search reduction makes smaller, and tokens before and after. Outputs (id, text) under
    the floor stay whole. Each budget is reduced once for all floors."""
    size = outputs.filter("text <> ''").select("id", F.floor(F.length("text") / 4).alias("raw"))
    out = None
    for budget in budgets:
        small = reduction.reduce_search(outputs, budget, diagnostic).select("id", F.floor(F.length("reduced") / 4).alias("small"))
        r = size.join(small, "id").select("raw", "small", F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor"))
        fired = (F.col("raw") >= F.col("floor")) & (F.col("small") < F.col("raw"))
        own = r.groupBy("floor").agg(F.count("*").alias("outputs"), F.sum(fired.cast("bigint")).alias("reductions"), F.sum("raw").alias("raw_tokens"), F.sum(F.when(fired, F.col("small")).otherwise(F.col("raw"))).alias("reduced_tokens")).withColumn("budget", F.lit(budget))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("saving", F.round(1 - F.col("reduced_tokens") / F.nullif("raw_tokens", F.lit(0)), 4))


def evidence_recall(outputs: DataFrame, touches: DataFrame, budget: int, diagnostic: str = reduction.DIAGNOSTIC) -> DataFrame:
    """One row: matched paths of search outputs (id, text) that are touched afterwards (touches: id of the search, path), how many of
    them the reduced text still has a line of, and matched lines of needed paths and how many stay."""
    lines = compaction.lines(outputs).filter("trim(line) <> ''").withColumn("diagnostic", F.col("line").rlike(diagnostic)).filter("not diagnostic").withColumn("path", reduction.matched_path(F.col("line")))
    needed = lines.join(touches.select("id", "path").distinct(), ["id", "path"], "left_semi")
    kept = reduction.kept_matches(outputs, budget, diagnostic).select("id", "pos", F.lit(1).alias("stays"))
    n = needed.join(kept, ["id", "pos"], "left").groupBy("id", "path").agg(F.count("*").alias("lines"), F.count("stays").alias("kept_lines"))
    s = n.agg(F.countDistinct("id").alias("searches"), F.count("*").alias("needed_paths"), F.coalesce(F.sum((F.col("kept_lines") > 0).cast("bigint")), F.lit(0)).alias("retained_paths"), F.coalesce(F.sum("lines"), F.lit(0)).alias("needed_lines"), F.coalesce(F.sum("kept_lines"), F.lit(0)).alias("retained_lines"))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(b, F.lit(0)), 4)
    return s.withColumns({"path_recall": rate("retained_paths", "needed_paths"), "line_recall": rate("retained_lines", "needed_lines")})


def compare_ranking(outputs: DataFrame, scores: DataFrame, budget: int, diagnostic: str = reduction.DIAGNOSTIC) -> DataFrame:
    """(id, pos, path, change) of match lines that only one of two reductions keeps: by place, or by the score of their file (path, score)."""
    plain = reduction.kept_matches(outputs, budget, diagnostic).select("id", "pos", "path")
    ranked = reduction.kept_matches(outputs, budget, diagnostic, scores).select("id", "pos", "path")
    only = lambda a, b, name: a.join(b, ["id", "pos"], "left_anti").withColumn("change", F.lit(name))
    return only(ranked, plain, "promoted").unionByName(only(plain, ranked, "demoted"))


def ranking_recall(outputs: DataFrame, touches: DataFrame, scores: DataFrame, budget: int, diagnostic: str = reduction.DIAGNOSTIC) -> DataFrame:
    """(id, path, lines_plain, lines_ranked, rank_plain, rank_ranked, change) of each matched path that is touched afterwards (touches: id, path):
    how many of its lines a reduction by place and one by score keep, the place of its first kept line among all kept ones in order of choice,
    and whether the score promoted or demoted it (same: both or neither keep a line; missed: neither does)."""
    lines = compaction.lines(outputs.filter("id is not null")).filter("trim(line) <> ''")
    kind = F.when(F.col("line").rlike(diagnostic), 1).otherwise(0)
    lines = lines.select("id", "pos", kind.alias("kind"), reduction.matched_path(F.col("line")).alias("path"), (F.length("line") + 1).alias("cost")).join(scores.select("path", "score"), "path", "left")
    lines = lines.select("id", "kind", F.when(F.col("kind") == 0, F.col("path")).alias("path"), "pos", "cost", F.coalesce("score", F.lit(0.0)).alias("score"))
    touched = touches.filter("id is not null and path is not null").select("id", F.lit(2).alias("kind"), "path", F.lit(0).alias("pos"), F.lit(0).alias("cost"), F.lit(0.0).alias("score"))
    rows = lines.unionByName(touched).repartition("id")  # all that follows looks at one search at a time
    rows = rows.withColumn("room", 4 * budget - F.sum(F.when(F.col("kind") == 1, F.col("cost")).otherwise(0)).over(Window.partitionBy("id"))).filter("kind <> 1")

    def placed(rows: DataFrame, name: str, order: list) -> DataFrame:
        w = Window.partitionBy("id", "kind").orderBy(*order)
        spent = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(name, F.when((F.col("kind") == 0) & (spent <= F.col("room")), F.row_number().over(w) - 1))  # kept lines come first, as each costs something

    rows = placed(placed(rows, "plain", ["pos"]), "ranked", [F.desc("score"), "pos"])
    r = rows.groupBy("id", "path").agg(*[f(c).alias(f"{n}_{c}") for c in ("plain", "ranked") for n, f in (("lines", F.count), ("rank", F.min))], F.min("kind").alias("first"), F.max("kind").alias("last")).filter("first = 0 and last = 2")
    plain, ranked = F.col("lines_plain") > 0, F.col("lines_ranked") > 0
    change = F.when(ranked & ~plain, "promoted").when(plain & ~ranked, "demoted").when(plain, "same").otherwise("missed")
    return r.select("id", "path", "lines_plain", "lines_ranked", "rank_plain", "rank_ranked", change.alias("change"))


def ranking_summary(found: DataFrame) -> DataFrame:
    """One row over ``ranking_recall``: needed paths, those with a line under either reduction, promoted, demoted and missed ones, both recalls, and
    the mean gain of rank where both keep one (to three places)."""
    n = lambda c: F.sum(F.when(F.col("change") == c, 1).otherwise(0)).alias(c)
    some = lambda c: F.sum(F.when(F.col(f"lines_{c}") > 0, 1).otherwise(0)).alias(f"held_{c}")
    s = found.agg(F.count("*").alias("needed"), some("plain"), some("ranked"), n("promoted"), n("demoted"), n("missed"), F.sum(F.col("rank_plain") - F.col("rank_ranked")).alias("gain"), F.count(F.col("rank_plain") + F.col("rank_ranked")).alias("both"))
    rate = lambda a: F.round(F.col(a) / F.nullif("needed", F.lit(0)), 4)
    return s.select("needed", "held_plain", "held_ranked", "promoted", "demoted", "missed", rate("held_plain").alias("recall_plain"), rate("held_ranked").alias("recall_ranked"), F.round(F.col("gain") / F.nullif("both", F.lit(0)), 3).alias("mean_rank_gain"))
