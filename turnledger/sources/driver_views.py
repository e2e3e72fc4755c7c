"""The canonical tables of the session-log model over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", number())
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), (F.row_number().over(w) - 1).cast("bigint").alias("turn"), F.col("event_type").alias("model"), "ts", F.floor("value").alias("input"), F.floor(F.col("value") * 1000).alias("cache_read"), (F.col("k") * 100).alias("cache_write"), F.col("k").alias("output"), (F.col("k") % 3).alias("version"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumns({"k": number()}).withColumns({"signups": F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w), "step": F.sum(F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0)).over(w)})
    e = e.filter("event_type <> 'signup'").withColumn("q", F.floor(F.col("k") / 4))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.col("user_id").cast("string"), F.lit(":main:"), F.floor(F.col("signups") / 5).cast("string")).alias("stream"), F.col("user_id").alias("session"), "step",
        F.when(F.col("event_type") == "purchase", "edit").otherwise("read").alias("kind"), (F.col("event_type") != "error").alias("success"), F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("path"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("v"), (F.col("q") % 2).cast("string"))).alias("version"), F.when((F.col("event_type") == "click") & (F.col("k") % 5 == 0), "search").otherwise("file").alias("representation"),
        F.when(F.col("q") % 11 == 5, "raced").when(F.col("q") % 6 == 0, "unverified").otherwise("stable").alias("status"),
        F.when(F.col("k") % 3 == 0, F.col("user_id") * 1000 + F.floor(F.col("event_id") / 300)).alias("batch"), F.floor(F.col("value") * 4).alias("tokens"),
    )


def context_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("session"), F.col("doc_id").alias("pos"), F.row_number().over(w).cast("bigint").alias("turn"), F.concat_ws("-", "lang", (F.col("n_chars") % 5).cast("string")).alias("key"), F.floor(F.length("text") / 4).alias("size"))


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"), F.col("text"))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type): parts that use suppliers, and the containment region, nation, customer, order."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    uses = table(spark, sf_dir, "lineitem").select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("USES").alias("type")).distinct()
    held = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    for t, p, a, q, b in held:
        uses = uses.unionByName(table(spark, sf_dir, t).select(name(p, a).alias("src"), name(q, b).alias("dst"), F.lit("CONTAINS").alias("type")))
    return uses


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a lineage: each event follows one of the three events before it; purchases have usage, signups are boundaries."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = lambda n: F.lag("event_id", n).over(w)
    e = table(spark, sf_dir, "events").withColumn("k", number())
    parent = F.when(F.col("k") % 3 == 0, before(1)).when(F.col("k") % 3 == 1, before(2)).otherwise(before(3))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), (F.col("event_type") == "purchase").alias("usage"), (F.col("event_type") == "signup").alias("boundary"), parent.alias("parent"))


def lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a lineage with usage: clicks, views and purchases are requests of models of that name, signups are compactions."""
    e = table(spark, sf_dir, "events").withColumn("k", number())
    own = e.select(F.col("event_id").alias("id"), F.col("event_type").isin("click", "view", "purchase").alias("usage"), F.col("event_type").alias("model"), (F.col("k") % 3).alias("version"), "ts", F.floor("value").alias("input"), F.floor(F.col("value") * 1000).alias("cache_read"), (F.col("k") * 500).alias("cache_write"), F.col("k").alias("output"), F.when(F.col("k") % 4 != 0, F.col("k") * 200).alias("cache_write_5m"), F.when(F.col("k") % 4 > 1, F.col("k") * 100).alias("cache_write_1h"))
    return event_rows(spark, sf_dir).drop("usage").join(own, "id")


def compacted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` without the signups, which are compactions here and count towards the next request."""
    w = Window.partitionBy("session").orderBy("turn")
    r = requests(spark, sf_dir).withColumn("seen", F.sum((F.col("model") == "signup").cast("bigint")).over(w)).filter("model <> 'signup'")
    return r.withColumn("compactions", F.col("seen") - F.coalesce(F.lag("seen").over(w), F.lit(0))).drop("seen")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of calls that come again: the language stands for a call's arguments."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("session"), F.col("lang").alias("args"), F.row_number().over(w).cast("bigint").alias("turn"), F.sha1("text").alias("hash"), F.floor(F.length("text") / 4).alias("tokens"))


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("lang").alias("path"), (F.row_number().over(w) - 1).cast("bigint").alias("version"), "text")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 500
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"), start.alias("start_line"), (start + 1 + F.col("o_orderkey") % 97).alias("end_line"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") * 7 % 500).alias("line")).distinct()


def version_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the digest before, and as digest after the one that the next call of the stream and path found."""
    after = F.lead("version").over(Window.partitionBy("stream", "path").orderBy("seq"))
    return tool_events(spark, sf_dir).select("seq", "kind", F.col("version").alias("pre"), after.alias("post"), "success")


def response_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as responses in blocks; system turns stand for images."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), "text")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as diffs: sentences are added lines, clauses removed ones, paragraphs that begin with T are hunks."""
    text = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit("\n+")), F.lit(", "), F.lit("\n-")), F.lit("\nT"), F.lit("\n@@ T"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("commit "), F.col("doc_id").cast("string"), F.lit("\n"), text).alias("text"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose input names the key of another object: the one with the next remainder."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("turn", F.row_number().over(w).cast("bigint"))
    return d.select(F.col("source").alias("session"), F.concat_ws("-", "lang", ((F.col("n_chars") + 1) % 5).cast("string")).alias("key"), "turn")


def line_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("c_custkey") * 7 % 500
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read_id"), F.col("c_custkey").alias("path"), low.alias("lo"), (low + 40).alias("hi"))


def session_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).groupBy("session").agg(F.count("*").alias("turns"), F.avg("cache_read").alias("avg_read"), (F.sum("cache_write") / F.count("*")).alias("value"))


SQL = {
    "requests": """select user_id as session, event_id as id, row_number() over (partition by user_id order by ts, event_id) - 1 as turn, event_type as model, ts,
        cast(floor(value) as bigint) as input, cast(floor(value * 1000) as bigint) as cache_read, k * 100 as cache_write, k as output, k % 3 as version
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events)""",
    "tool_events": """select event_id as seq, user_id || ':main:' || cast(floor(signups / 5) as bigint) as stream, user_id as session, step, case when event_type = 'purchase' then 'edit' else 'read' end as kind,
        event_type <> 'error' as success, 'f' || (k % 4) as path, case when k % 7 <> 0 then 'v' || (q % 2) end as version, case when event_type = 'click' and k % 5 = 0 then 'search' else 'file' end as representation,
        case when q % 11 = 5 then 'raced' when q % 6 = 0 then 'unverified' else 'stable' end as status, case when k % 3 = 0 then user_id * 1000 + cast(floor(event_id / 300) as bigint) end as batch, cast(floor(value * 4) as bigint) as tokens
        from (select *, cast(floor(k / 4) as bigint) as q, cast(sum(case when event_type = 'signup' then 1 else 0 end) over w as bigint) as signups, cast(sum(case when event_type in ('click', 'view', 'purchase') then 1 else 0 end) over w as bigint) as step
            from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events) window w as (partition by user_id order by event_id)) where event_type <> 'signup'""",
    "context_objects": """select source as session, doc_id as pos, row_number() over (partition by source order by doc_id) as turn, lang || '-' || (n_chars % 5) as key, cast(floor(length(text) / 4) as bigint) as size from documents""",
    "tool_outputs": "select doc_id as id, source as session, text from documents",
    "code_edges": """select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst, 'USES' as type from lineitem union all select 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS' from nation
        union all select 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' from customer union all select 'c' || o_custkey, 'o' || o_orderkey, 'CONTAINS' from orders""",
}


#: Tools of the made-up transcripts, and of the tool mix.
CALL_TOOLS = ("Read", "Grep", "Bash", "Edit", "WebFetch", "Glob")
MIX_TOOLS = ("Read", "Grep", "Bash", "Edit", "Task", "WebSearch", "TodoWrite", "mcp__chrome__click", "mcp__db__query", "Other", "Write", "Glob", "Agent", "Skill")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines (session, pos, raw): assistant turns say something and call a tool, most later user turns hold the
    result of the call before, the others are plain strings."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    inner = lambda c: F.regexp_extract(quoted(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    tool = F.element_at(F.array(*map(F.lit, CALL_TOOLS)), (n % 6 + 1).cast("int"))
    path = F.concat(F.lit("./src/f"), (n % 7).cast("string"))
    call = F.when(tool.isin("Read", "Edit"), F.to_json(F.struct(path.alias("file_path")))).when(tool == "Bash", F.to_json(F.struct(F.concat(F.lit(" cat "), path).alias("command")))).otherwise(F.to_json(F.struct(F.lit("p").alias("pattern"), path.alias("path"))))
    ident = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    said = F.concat(F.lit('{"type":"text","text":'), inner(text), F.lit("}"))
    assistant = F.concat(F.lit("["), said, F.lit(',{"type":"tool_use","id":"'), ident(F.col("turn")), F.lit('","name":"'), tool, F.lit('","input":'), call, F.lit("}]"))
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"'), ident(F.col("turn") - 1), F.lit('","content":['), said, F.lit("]}]"))
    content = F.when(F.col("role") == "assistant", assistant).when((F.col("role") == "user") & (F.col("turn") > 0) & (n % 9 != 0), result).otherwise(inner(text))
    usage = F.when(F.col("role") == "assistant", F.lit(',"usage":{"input_tokens":1}')).otherwise("")
    request = F.when(F.col("role") == "assistant", F.concat(F.lit('"requestId":"q'), ident(F.floor(F.col("turn") / 4)), F.lit('",'))).otherwise("")
    raw = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('",'), request, F.lit('"message":{"content":'), content, usage, F.lit("}}"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("pos"), raw.alias("raw"))


def tool_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", number())
    return e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, MIX_TOOLS)), (F.col("k") % 14 + 1).cast("int")).alias("tool"), F.floor("value").alias("tokens"), F.col("k"))


#: Command templates by event number; ``@`` stands for a file.
COMMANDS = (
    "cat src/@", "grep -n 'a;b' src/@ | head -5", "cd a && cat @", "cd a; cd b; cat ../@", "pytest -q tests/@", "cat @ | wc -l", "ls -la src", "find . -name '*.py'", "find . -delete",
    "git show HEAD:src/@", "git status", "sed -n 1,5p @", "sed -i s/a/b/ @", "echo hi > @", "cat @ 2>/dev/null", "rm @", "mv @ b && cat b", "cp @ c; head -n 5 c", "make build & cat @", "for x in *; do cat $x; done",
    "cat 'unclosed @", "cd /abs && ls", "rg -e pat @", "cargo test || cat @",
)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", number())
    command = F.replace(F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int")), F.lit("@"), F.concat(F.lit("f"), (F.col("k") % 4).cast("string")))
    return e.select(F.col("event_id").alias("id"), command.alias("command"), F.when(F.col("k") % 5 == 0, "Grep").when(F.col("k") % 5 == 1, "Read").otherwise("Bash").alias("tool"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with what they carried and what was sent, and the measurement state of each."""
    e = table(spark, sf_dir, "events").withColumn("k", number())
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("event_type").alias("channel"), F.when(k % 3 == 0, "search").otherwise("file").alias("representation"), F.floor("value").alias("payload_tokens"), (F.floor("value") + k - 20).alias("transport_tokens"),
        F.when(k % 5 == 0, "ambiguous_composite").when(k % 5 == 1, "ambiguous_multipath").when(k % 5 < 4, "attributed").alias("attribution"), F.when(k % 7 != 0, F.floor("value")).alias("tokens"),
        F.when(k % 4 == 0, "text_partial_multimodal").when(k % 4 == 1, "multimodal").when(k % 8 == 2, "unsupported").otherwise("text").alias("status"),
        F.when(k % 6 == 0, "timeout").when(k % 6 == 1, "went home").alias("closure_reason"), F.when(k % 9 != 0, "hook").alias("source_system"), F.when(k % 8 != 0, F.col("user_id").cast("string")).otherwise(" ").alias("stream"), F.when(k % 4 == 1, F.when(k % 3 == 0, "").otherwise("e")).alias("source_event_key"),
    )


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other stream is declared closed, some before its last events."""
    s = tool_events(spark, sf_dir).groupBy("session", "stream").agg(F.max("seq").alias("last_seq"))
    return s.select("stream", (F.col("session") % 2 == 0).alias("closed"), F.when(F.col("session") % 4 == 0, F.col("last_seq") - 3000).alias("closed_at_seq"))
