"""From transcript lines to tool results: content blocks, calls paired with results, running turns and context objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C

#: Tools that read or change a file, and those whose exact call is their key.
READ_TOOLS, EDIT_TOOLS, KEYED_TOOLS = ("Read", "NotebookRead"), ("Edit", "Write", "MultiEdit", "NotebookEdit"), ("Grep", "Glob", "Bash")


def flatten_content(content: Column) -> Column:
    """The text of a VARIANT content: itself if it is a string, else its strings and text blocks, joined by newlines."""
    part = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(F.try_variant_get(b, "$.type", "string").isin("text", "tool_reference"), F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), lambda p: p.isNotNull())
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))


def transcript_blocks(lines: DataFrame) -> DataFrame:
    """(session, pos, block, line_type, request, has_usage, type, call_id, tool, input, text) of lines (session, pos, raw JSON).

    A string content is one block of type ``text``; text blocks and results carry their flattened text, calls their tool and
    input (VARIANT). Lines that are no JSON give nothing.
    """
    v = lines.select("session", "pos", F.try_parse_json("raw").alias("v")).filter("v is not null")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    v = v.select("session", "pos", get("$.type").alias("line_type"), get("$.requestId").alias("request"), get("$.message.usage", "variant").isNotNull().alias("has_usage"), get("$.message.content", "variant").alias("content"))
    whole = F.schema_of_variant("content") == "STRING"
    b = v.select("session", "pos", "line_type", "request", "has_usage", whole.alias("whole"), F.posexplode(F.when(whole, F.array("content")).otherwise(F.try_variant_get("content", "$", "array<variant>"))).alias("block", "b"))
    own = lambda path, kind="string": F.when(~F.col("whole"), F.try_variant_get("b", path, kind))
    kind = F.when(F.col("whole"), "text").otherwise(own("$.type"))
    text = F.when(F.col("whole"), F.try_variant_get("b", "$", "string")).when(own("$.type") == "tool_result", flatten_content(own("$.content", "variant"))).when(own("$.type") == "text", F.coalesce(own("$.text"), F.lit("")))
    call = F.coalesce(own("$.tool_use_id"), own("$.id"))
    return b.select("session", "pos", "block", "line_type", "request", "has_usage", kind.alias("type"), call.alias("call_id"), own("$.name").alias("tool"), own("$.input", "variant").alias("input"), text.alias("text"))


def object_key(tool: Column, call: Column) -> Column:
    """What a later call replaces: the path for file tools, the exact call for searches and commands, else nothing."""
    get = lambda name: F.try_variant_get(call, f"$.{name}", "string")
    same = lambda prefix, *names: F.concat(F.lit(prefix), F.to_json(F.struct(*[get(n).alias(n) for n in sorted(names)])))
    return (
        F.when(tool.isin(*READ_TOOLS, *EDIT_TOOLS), F.concat(F.lit("path:"), C.norm_path(F.coalesce(get("file_path"), get("notebook_path"), F.lit("")))))
        .when(tool == "Bash", F.concat(F.lit("bash:"), F.trim(F.coalesce(get("command"), F.lit("")))))
        .when(tool == "Grep", same("grep:", "pattern", "path", "glob", "type")).when(tool == "Glob", same("glob:", "pattern", "path")).otherwise("")
    )


def pair_tool_calls(blocks: DataFrame) -> DataFrame:
    """(session, pos, block, call_id, tool, key, call_pos, text) of each result, with the last call of its id before it; tool ``?``
    where there is none. One shuffle serves all results of an id, whatever their number."""
    order = F.struct("pos", "block")
    call = F.when(F.col("type") == "tool_use", F.struct(F.coalesce("tool", F.lit("?")).alias("tool"), object_key(F.col("tool"), F.col("input")).alias("key"), "pos"))
    w = Window.partitionBy("session", "call_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = blocks.filter("type in ('tool_use', 'tool_result') and call_id is not null").select("session", "pos", "block", "type", "call_id", "text", call.alias("call"))
    found = both.withColumn("use", F.last("call", True).over(w)).filter("type = 'tool_result'")
    return found.select("session", "pos", "block", "call_id", F.coalesce("use.tool", F.lit("?")).alias("tool"), F.coalesce("use.key", F.lit("")).alias("key"), F.col("use.pos").alias("call_pos"), "text")


def entry_turns(blocks: DataFrame) -> DataFrame:
    """(session, pos, turn): how many distinct requests a line has seen, its own included."""
    lines = blocks.groupBy("session", "pos").agg(F.max(F.when(F.col("has_usage"), F.col("request"))).alias("request"))
    first = F.col("request").isNotNull() & (F.row_number().over(Window.partitionBy("session", "request").orderBy("pos")) == 1)
    running = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("first", first.cast("bigint")).select("session", "pos", F.sum("first").over(running).alias("turn"))


def context_objects(blocks: DataFrame) -> DataFrame:
    """(session, pos, turn, key, tool, size): one row for each result of a file or keyed tool, at the turn of its call. Turns are
    lines with usage, counted as they come."""
    tools = (*READ_TOOLS, *EDIT_TOOLS, *KEYED_TOOLS)
    running = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = blocks.groupBy("session", "pos").agg(F.max((F.col("has_usage") & (F.col("line_type") == "assistant")).cast("bigint")).alias("n")).select("session", F.col("pos").alias("call_pos"), F.sum("n").over(running).alias("turn"))
    objects = pair_tool_calls(blocks).filter(F.col("tool").isin(*tools))
    return objects.join(turns, ["session", "call_pos"]).select("session", "pos", "turn", "key", "tool", C.est_tokens(F.col("text")).alias("size"))


#: What a retired result says instead.
STUB = "[retired: ask again if needed]"


def clean_cuts(blocks: DataFrame, turn: int) -> DataFrame:
    """(session, cut): the last message line within ``turn`` turns after which no call waits for its result."""
    opened = blocks.filter("type = 'tool_use'").select("session", "pos", F.lit(1).alias("n"))
    closed = pair_tool_calls(blocks).filter("call_pos is not null").groupBy("session", "call_id").agg(F.min("pos").alias("pos")).select("session", "pos", F.lit(-1).alias("n"))
    lines = blocks.groupBy("session", "pos").agg(F.max("line_type").alias("line_type"), F.max((F.col("has_usage") & (F.col("line_type") == "assistant")).cast("int")).alias("usage"))
    waits = opened.unionByName(closed).groupBy("session", "pos").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.join(waits, ["session", "pos"], "left").withColumns({"turns": F.sum("usage").over(w), "waiting": F.sum(F.coalesce("n", F.lit(0))).over(w)})
    return run.filter((F.col("turns") <= turn) & (F.col("waiting") == 0) & F.col("line_type").isin("assistant", "user")).groupBy("session").agg(F.max("pos").alias("cut"))


def stub_retired(results: DataFrame, retired: DataFrame, turn: int) -> DataFrame:
    """Results (session, pos, text, ...) with the text of those that are retired by ``turn`` replaced; adds ``stubbed``. ``retired``: session,
    pos, turn, retired."""
    gone = retired.filter((F.col("retired") <= turn) & (F.col("turn") <= turn)).select("session", "pos", F.lit(True).alias("gone"))
    r = results.join(gone, ["session", "pos"], "left").withColumn("stubbed", F.coalesce("gone", F.lit(False)))
    return r.withColumn("text", F.when(F.col("stubbed"), STUB).otherwise(F.col("text"))).drop("gone")


def continuation_report(blocks: DataFrame, source_lines: DataFrame, retired_paths: DataFrame) -> DataFrame:
    """Per session: lines after the source's (session, pos), their calls, reads of retired paths (session, path), and edits."""
    path = C.norm_path(F.try_variant_get("input", "$.file_path", "string"))
    later = blocks.join(source_lines.select("session", "pos"), ["session", "pos"], "left_anti").withColumn("path", path)
    again = later.filter(F.col("tool").isin(*READ_TOOLS)).join(retired_paths.select("session", "path").distinct(), ["session", "path"], "left_semi").groupBy("session").agg(F.count("*").alias("rereads"))
    g = later.groupBy("session").agg(F.countDistinct("pos").alias("lines"), F.count(F.when(F.col("type") == "tool_use", 1)).alias("calls"), F.count(F.when(F.col("tool").isin(*EDIT_TOOLS), 1)).alias("edits"))
    return g.join(again, "session", "left").withColumn("rereads", F.coalesce("rereads", F.lit(0)))
