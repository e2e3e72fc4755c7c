"""Whole summaries of tool outputs as they are shown: searches, test runs and files, with what each line costs counted against a budget of
tokens (quarters of characters), what was left out named, secrets taken out, and the handle of the whole output at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators import compaction, reduction

#: Failures and tallies of test runs, and the structural lines of sources, with or without a line number in front.
FAILED = r"(?i)(FAILED|ERROR\b|FAIL\b|✗|✘|AssertionError|Traceback|^E\s|Exception|panic:|--- FAIL)"
TALLY = r"(?i)(\d+\s+(failed|passed|error|skipped)|=+.*=+|Tests:|Ran \d+)"
STRUCTURAL, NUMBERED = r"^\s*(?:from\s+\S+\s+import|import\s+\S|@|(?:async\s+)?def\s+\w|class\s+\w)|^[A-Z_][A-Z0-9_]*\s*(?::[^=]+)?=", r"^\s*\d+[→\t]"
#: The wording of what is shown.
NO_TALLY, HANDLE = "(tests passed; no summary line found)", "[+ full output: "
HEADLINE, IN_FILES, DIAGNOSTICS, BY_FILE, MORE_FILES = " matches in ", " file(s)", " diagnostic(s)", "matches by file: ", " more file(s)"
MORE, ACROSS, FULL, NO_MORE = " more match(es) across ", " file(s) — full: ", "\n... ", "... 0 more match(es) across 0 file(s) — full: "
SKELETON, LINES, GAP, CUT = "file skeleton: ", " lines", "… ", " more lines (full file recoverable) …"
#: Files named in a roll-up.
NAMED_FILES = 12


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def handle_line(handle: Column) -> Column:
    return F.concat(F.lit(HANDLE), handle, F.lit("]"))


def text_of(c: Column) -> Column:
    return c.cast("string")


def ranked_files(paths: Column) -> Column:
    """The files of the match lines of one output, of which each gives its path, as an array of (less, first, path): those with most lines first
    (ties: first seen first). ``less`` is the number of lines below zero. Paths are sorted, and a file's lines end where the next path differs."""
    placed = F.sort_array(F.transform(paths, lambda path, k: F.struct(path.alias("path"), (-k).alias("back"))))
    return C.let(placed, lambda p: C.let(F.filter(F.transform(F.zip_with(p, F.slice(p, 2, F.size(p)), last_of_path), at), lambda x: x["last"]), counted))


def last_of_path(x: Column, after: Column) -> Column:
    return F.struct(x["path"].alias("path"), (-x["back"]).alias("first"), (~x["path"].eqNullSafe(after["path"])).alias("last"))


def at(x: Column, k: Column) -> Column:
    return F.struct(x["path"].alias("path"), x["first"].alias("first"), x["last"].alias("last"), k.alias("at"))


def counted(ends: Column) -> Column:
    before = F.slice(F.concat(F.array(F.lit(-1)), ends["at"]), 1, F.size(ends))
    return F.sort_array(F.zip_with(ends, before, lambda x, b: F.struct((b - x["at"]).alias("less"), x["first"].alias("first"), x["path"].alias("path"))))


def search_summary(outputs: DataFrame, budget: int = 256, diagnostic: str = reduction.DIAGNOSTIC) -> DataFrame:
    """(id, text, matches, kept) of outputs (id, text) of searches, whose ids differ: a headline, all diagnostics, the first matches while what is
    reserved for headline, diagnostics, roll-up, footer and handle leaves room, and, where matches are left out, the roll-up and how many.
    Outputs of blank lines only are left out. An output is one row all the way, so nothing is shuffled."""
    says = lambda line: line.rlike(diagnostic)
    handle = F.concat(F.lit("result://"), C.content_hash(F.col("text"))).alias("handle")
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "").alias("lines")
    r = outputs.filter("id is not null").select("id", F.inline(F.filter(F.array(F.struct(handle, lines)), lambda x: F.size(x["lines"]) > 0)))  # a filter of rows would work texts out twice
    r = r.select("id", "handle", F.filter("lines", lambda line: ~says(line)).alias("found"), F.filter("lines", says).alias("spoken"))
    r = r.withColumn("paths", F.transform("found", reduction.matched_path))
    r = r.select("*", ranked_files(F.col("paths")).alias("files"), size("found").alias("matches"), size("spoken").alias("diagnostics"))
    named = F.array_join(F.transform(F.slice("files", 1, NAMED_FILES), lambda x: F.concat(x["path"], F.lit("×"), text_of(-x["less"]))), ", ")
    more = F.when(size("files") > NAMED_FILES, F.concat(F.lit(", +"), text_of(size("files") - NAMED_FILES), F.lit(MORE_FILES))).otherwise("")
    title = F.concat(text_of(F.col("matches")), F.lit(HEADLINE), text_of(size("files")), F.lit(IN_FILES), F.when(F.col("diagnostics") > 0, F.concat(F.lit("; "), text_of(F.col("diagnostics")), F.lit(DIAGNOSTICS))).otherwise(""))
    top = F.when(F.col("diagnostics") > 0, F.concat(title, F.lit("\n"), F.array_join("spoken", "\n"))).otherwise(title)
    r = r.select("id", "handle", "found", "paths", "matches", top.alias("top"), F.concat(F.lit(BY_FILE), named, more).alias("rollup"))
    reserved = tokens(F.col("top")) + tokens(handle_line(F.col("handle"))) + F.when(F.col("matches") == 0, 0).otherwise(tokens(F.col("rollup")) + tokens(F.concat(F.lit(NO_MORE), "handle")))
    r = r.withColumn("kept", fitting(F.slice("found", 1, max(budget, 0)), F.greatest(F.lit(0), F.lit(budget) - reserved)))  # a line costs one token at least
    cut_files = F.size(F.array_distinct(F.slice("paths", F.col("kept").cast("int") + 1, F.size("paths"))))
    cut = F.col("matches") - F.col("kept")
    footer = F.when(cut > 0, F.concat("rollup", F.lit(FULL), text_of(cut), F.lit(MORE), text_of(cut_files), F.lit(ACROSS), "handle"))
    body = F.when(F.col("kept") > 0, F.array_join(F.slice("found", F.lit(1), F.col("kept").cast("int")), "\n"))
    r = r.select("id", "handle", "matches", "kept", F.concat_ws("\n", "top", body, footer).alias("shown"))
    return r.select("id", F.concat_ws("\n", C.redact(F.col("shown")), handle_line(F.col("handle"))).alias("text"), "matches", "kept")


def size(of: str) -> Column:
    return F.size(of).cast("bigint")


def fitting(lines: Column, room: Column) -> Column:
    """How many of the lines, from the first on, fit the room together."""
    zero = F.lit(0).cast("bigint")

    def step(a: Column, line: Column) -> Column:
        spent = a["spent"] + tokens(line) + 1
        return F.struct(spent.alias("spent"), (a["n"] + (spent <= a["room"]).cast("bigint")).alias("n"), a["room"].alias("room"))

    return F.aggregate(lines, F.struct(zero.alias("spent"), zero.alias("n"), room.alias("room")), step)["n"]


def test_summary(outputs: DataFrame, last: int = 3) -> DataFrame:
    """(id, text) of outputs (id, text) of test runs: each failure line once, then the last tallies; without any of them a word that says so."""
    rows = compaction.lines(outputs).withColumns({"failed": F.col("line").rlike(FAILED), "tally": F.col("line").rlike(TALLY)}).filter("failed or tally")
    back = F.row_number().over(Window.partitionBy("id", "tally").orderBy(F.desc("pos")))
    rows = rows.withColumn("late", F.col("tally") & (back <= last)).filter("failed or late")
    rank = F.struct((~F.col("failed")).alias("later"), "pos")
    small = compaction.joined(rows.groupBy("id", "line").agg(F.min(rank).alias("rank"))).select("id", "reduced")
    every = outputs.select("id").join(small, "id", "left").withColumn("reduced", F.coalesce("reduced", F.lit(NO_TALLY)))
    return compaction.wrapped(every, outputs).select("id", "text")


test_summary.__test__ = False  # not a test of pytest


def file_skeleton(outputs: DataFrame, budget: int = 512, head: int = 6) -> DataFrame:
    """(id, text, kept) of files (id, text): the first lines and the structural ones while their running cost, gaps included, fits; gaps
    and what is cut at the end are named. Empty files are left out."""
    whole = outputs.filter("text <> ''")
    n = Window.partitionBy("id")
    rows = compaction.lines(whole).withColumn("n", F.count("*").over(n)).filter((F.col("pos") < head) | F.regexp_replace("line", NUMBERED, "").rlike(STRUCTURAL))
    order = Window.partitionBy("id").orderBy("pos")
    skipped = F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(-1)) - 1
    rows = rows.withColumn("gap", F.when(skipped > 0, F.concat(F.lit("… "), text_of(skipped), F.lit(" lines …")))).withColumn("cost", tokens(F.col("line")) + 1)
    charged = F.coalesce(F.sum(F.col("cost") + F.coalesce(tokens(F.col("gap")) + 1, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    raw = whole.select("id", F.concat(F.lit("result://"), C.content_hash(F.col("text"))).alias("handle"))
    title = F.concat(F.lit(SKELETON), text_of(F.col("n")), F.lit(LINES))
    rows = rows.join(raw, "id").withColumn("over", F.when(tokens(title) + tokens(handle_line(F.col("handle"))) + charged + F.col("cost") > budget, F.col("pos")))
    rows = rows.withColumn("cut", F.min("over").over(n))
    shown = F.when(F.col("cut").isNull() | (F.col("pos") < F.col("cut")), F.struct("pos", F.concat_ws("\n", "gap", "line").alias("line")))
    g = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"]), "\n").alias("body"), F.count(shown).alias("kept"), F.max(F.when(shown.isNotNull(), F.col("pos"))).alias("last"), F.max("n").alias("n"), F.max("cut").alias("cut"), F.max("handle").alias("handle"))
    end = F.when(F.col("cut").isNotNull(), F.concat(F.lit("… "), text_of(F.col("n") - F.col("cut")), F.lit(CUT))).when(F.col("last") < F.col("n") - 1, F.concat(F.lit("… "), text_of(F.col("n") - 1 - F.col("last")), F.lit(" lines …")))
    return g.select("id", F.concat_ws("\n", C.redact(F.concat_ws("\n", title, F.when(F.col("kept") > 0, F.col("body")), end)), handle_line(F.col("handle"))).alias("text"), "kept")
