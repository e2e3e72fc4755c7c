"""Compaction of long tool outputs by lines: explode, flag, rank, put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C

#: A line number in front of a line.
NUMBERING = r"^\s*\d+\t"
#: What makes a log line important.
LOG = r"\b(ERROR|CRITICAL|FATAL|WARN|Exception|Traceback|panic)\b"


def lines(outputs: DataFrame) -> DataFrame:
    return outputs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def joined(rows: DataFrame) -> DataFrame:
    """(id, reduced, kept): kept lines in order."""
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("reduced"), F.count("*").alias("kept"))


def reduce_grep(outputs: DataFrame, keep: int = 20) -> DataFrame:
    """The first lines that are not blank, and a line that says how many more there were."""
    w = Window.partitionBy("id").orderBy("pos")
    r = lines(outputs).filter("trim(line) <> ''").withColumn("rank", F.row_number().over(w))
    rest = r.groupBy("id").agg(F.greatest(F.lit(0), F.count("*") - keep).alias("dropped"))
    out = joined(r.filter(F.col("rank") <= keep)).join(rest, "id")
    return out.withColumn("reduced", F.when(F.col("dropped") > 0, F.concat("reduced", F.lit("\n... "), F.col("dropped").cast("string"), F.lit(" more matches"))).otherwise(F.col("reduced")))


def reduce_generic(outputs: DataFrame, ends: int = 10) -> DataFrame:
    """Head and tail, and between them a line that says how many lines are left out."""
    n = F.size("ls")
    whole = outputs.select("id", F.split("text", "\n").alias("ls")).withColumn("cut", F.greatest(F.lit(0), n - 2 * ends))
    head, tail = F.slice("ls", F.lit(1), F.lit(ends)), F.slice("ls", n - ends + 1, F.lit(ends))
    return whole.select("id", F.when(F.col("cut") > 0, F.array_join(F.concat(head, F.array(F.concat(F.lit("... "), F.col("cut").cast("string"), F.lit(" lines omitted ..."))), tail), "\n")).otherwise(F.array_join("ls", "\n")).alias("reduced"), F.col("cut").cast("bigint").alias("dropped"))


def reduce_logs(outputs: DataFrame, tail: int = 15, pattern: str = LOG) -> DataFrame:
    """Important lines first, then the last ones; a line's text appears once."""
    w = Window.partitionBy("id").orderBy(F.desc("pos"))
    r = lines(outputs).withColumns({"hit": F.col("line").rlike(pattern), "back": F.row_number().over(w)}).filter(F.col("hit") | (F.col("back") <= tail))
    r = r.withColumn("rank", F.struct((~F.col("hit")).alias("later"), "pos"))
    return joined(r.groupBy("id", "line").agg(F.min("rank").alias("rank")))


def wrapped(reduced: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, text, handle, raw_tokens, reduced_tokens, smaller): reduced texts (id, reduced) as they are shown: without secrets, and with a last
    line that names the handle of the whole output (id, text)."""
    raw = outputs.select("id", F.concat(F.lit("result://"), C.content_hash(F.col("text"))).alias("handle"), C.est_tokens(F.col("text")).alias("raw_tokens"))
    shown = F.concat(C.redact(F.col("reduced")), F.lit("\n[+ full output: "), "handle", F.lit("]"))
    r = reduced.select("id", "reduced").join(raw, "id").select("id", shown.alias("text"), "handle", "raw_tokens")
    return r.withColumn("reduced_tokens", C.est_tokens(F.col("text"))).withColumn("smaller", F.col("reduced_tokens") < F.col("raw_tokens"))


def keeps_all(reduced: DataFrame, outputs: DataFrame, pattern: str) -> DataFrame:
    """(id, invariants_ok): whether every line of the pattern is still in the reduced text."""
    must = lines(outputs).filter(F.col("line").rlike(pattern)).select("id", "line").distinct()
    kept = reduced.select("id", F.explode(F.split("reduced", "\n")).alias("line")).distinct()
    lost = must.join(kept, ["id", "line"], "left_anti").select("id").distinct().withColumn("lost", F.lit(True))
    return reduced.select("id").join(lost, "id", "left").select("id", F.col("lost").isNull().alias("invariants_ok"))


def distinctive_lines(texts: DataFrame, least: int = 20) -> DataFrame:
    """(id, line): the trimmed lines of each text without line numbers in front, each once, with ``least`` characters besides white space."""
    line = F.trim(F.regexp_replace("line", NUMBERING, ""))
    return lines(texts).select("id", line.alias("line")).filter(F.length(F.regexp_replace("line", r"\s", "")) >= least).distinct()


def line_overlap(outputs: DataFrame, least: int = 20) -> DataFrame:
    """Distinctive lines (``least`` characters besides white space, or more) that several outputs share."""
    r = distinctive_lines(outputs, least)
    return r.groupBy("line").agg(F.count("*").alias("outputs"), F.min("id").alias("first_id")).filter("outputs > 1")


def savings_grid(outputs: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Tokens saved for each (cap, floor): outputs of at least both are cut to the cap."""
    size = outputs.select(F.floor(F.length("text") / 4).alias("size"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("cap"), F.lit(f).cast("bigint").alias("floor")) for c, f in grid]))
    s = size.select("size", cells.alias("g")).select("size", "g.*").withColumn("hit", F.col("size") >= F.greatest("cap", "floor"))
    return s.groupBy("cap", "floor").agg(F.sum("size").alias("raw"), F.sum(F.col("hit").cast("bigint")).alias("reduced"), F.sum(F.when(F.col("hit"), F.col("size") - F.col("cap")).otherwise(0)).alias("saved"))


def content_store(outputs: DataFrame) -> DataFrame:
    """One row for each content: its handle, first holder and size."""
    h = outputs.select("id", F.substring(F.sha1("text"), 1, 16).alias("hash"), F.length("text").cast("bigint").alias("chars"))
    return h.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("holders"), F.max("chars").alias("chars")).select(F.concat(F.lit("result://"), "hash").alias("handle"), "first_id", "holders", "chars")


def budget_prefix(items: DataFrame, by: str, order: Column, cost: str, room: int) -> DataFrame:
    """Items in order while their running cost fits; stops at the first that does not."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= room)


def kept_lines(outputs: DataFrame, pattern: str, budget: int, head: int = 6) -> DataFrame:
    """(id, pos, line): the first lines and those of the pattern, in order while they fit the budget of characters."""
    w = Window.partitionBy("id").orderBy("pos")
    return lines(outputs).filter((F.col("pos") < head) | F.col("line").rlike(pattern)).withColumn("spent", F.sum(F.length("line") + 1).over(w)).filter(F.col("spent") <= budget).drop("spent")


def reduce_file(outputs: DataFrame, pattern: str, budget: int, head: int = 6) -> DataFrame:
    """The kept lines as one text; gaps are marked."""
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(Window.partitionBy("id").orderBy("pos")), F.lit(-1)) - 1
    return joined(kept_lines(outputs, pattern, budget, head).withColumns({"rank": F.col("pos"), "line": F.when(gap > 0, F.concat(F.lit("... "), gap.cast("string"), F.lit(" lines\n"), F.col("line"))).otherwise(F.col("line"))}))


def reduce_tests(outputs: DataFrame, failure: str, summary: str, last: int = 3) -> DataFrame:
    """Failure lines and the last summary lines, each text once; without failures, only the last summary line."""
    back = F.row_number().over(Window.partitionBy("id", "failed").orderBy(F.desc("pos")))
    r = lines(outputs).withColumn("failed", F.col("line").rlike(failure)).filter(F.col("failed") | F.col("line").rlike(summary)).withColumn("back", back)
    any_failed = r.groupBy("id").agg(F.max("failed").alias("any_failed"))
    r = r.join(any_failed, "id").filter(F.col("failed") | (F.col("back") <= F.when(F.col("any_failed"), last).otherwise(1)))
    return joined(r.groupBy("id", "line").agg(F.min("pos").alias("rank")))


#: Lines that show structure.
STRUCTURE = r"^\s*(def |class |if |elif |else|for |while |try|except|finally|with |return|raise|yield|await |function |=>|switch|case )"
CALLISH = r"[A-Za-z_$][\w$]*\s*\("
LEVELS = ("identity", "signature", "skeleton", "slice", "implementation")


def detail_levels(sources: DataFrame) -> DataFrame:
    """(id, level, pos, line) of sources (id, text): the lines of each level of detail, each level holding the one before. A signature is
    the first lines up to one that ends in ``:`` or ``{``, four at most; a skeleton adds structural lines, a slice the first three
    fifths; nothing is in an identity."""
    r = lines(sources).withColumns({"opens": F.col("line").rlike(r"[:{]\s*$"), "n": F.count("*").over(Window.partitionBy("id"))})
    r = r.withColumn("ends", F.min(F.when(F.col("opens"), F.col("pos"))).over(Window.partitionBy("id")))
    header = F.col("pos") <= F.least(F.coalesce("ends", F.lit(3)), F.lit(3), F.col("n") - 1)
    size = F.least(F.coalesce("ends", F.lit(3)), F.lit(3), F.col("n") - 1) + 1
    structural = F.col("line").rlike(STRUCTURE) | F.col("line").rlike(CALLISH)
    region = F.col("pos") < F.least(F.col("n"), F.greatest(size + 1, F.floor(F.col("n") * 0.6)))
    least = F.when(header, 1).when(structural, 2).when(region, 3).otherwise(4)
    level = F.explode(F.slice(F.array(*map(F.lit, LEVELS)), least + 1, len(LEVELS))).alias("level")
    return r.select("id", level, "pos", "line")
