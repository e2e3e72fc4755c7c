"""Queries on files that Spark writes from the test tables and the sources read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.plans.registry import W, big
from turnledger.session import shared_path
from turnledger.sources import driver_views as V
from turnledger.sources import files, transcripts

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def written_requests(s: SparkSession, d: str) -> DataFrame:
    """Transcripts as text files, with a line in each session that is no JSON, read back and reduced to requests."""
    path = shared_path(s, "transcripts")
    raw = V.session_lines(s, d).select("session", "pos", F.concat(F.lit('{"sessionId":"'), "session", F.lit('",'), F.substring("raw", F.lit(2), F.length("raw"))).alias("raw"))
    broken = raw.select("session", F.lit(-1).alias("pos"), F.lit("{not json").alias("raw")).distinct()
    raw.unionByName(broken).repartition("session").sortWithinPartitions("session", "pos").select("raw").write.text(path)
    return transcripts.transcript_requests(transcripts.read_transcripts(s, path, "*.txt")).select("session", "id", "turn", "input")


add("read_transcripts", written_requests, """with q as (select cast(conv_id as varchar) as session, 'q' || conv_id || '-' || (turn // 4) as id, min(turn) as first from conversations where role = 'assistant' group by all)
    select session, id, row_number() over (partition by session order by first) - 1 as turn, cast(1 as bigint) as input from q""")


def written_events(s: SparkSession, d: str) -> DataFrame:
    """Tool events under other columns than the journal's, and read with the journal's."""
    path = shared_path(s, "journal")
    e = V.tool_events(s, d)
    e.select("seq", F.col("stream").alias("stream_key"), F.col("step").cast("int"), "kind", F.col("path").alias("path_normalized"), F.col("success").cast("int").alias("success"), F.lit(1).alias("unknown_column")).write.parquet(path)
    return files.read_tool_events(s, path).groupBy("kind", "path_normalized", "version_status").agg(F.count("*").alias("events"), F.sum("success").alias("successes"), F.max("step").alias("last_step"))


add("read_tool_events", written_events, f"with {W['tool_events']} select kind, path as path_normalized, cast(null as varchar) as version_status, count(*) as events, {big('sum(cast(success as int))')} as successes, cast(max(step) as int) as last_step from tool_events group by all")


def written_decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions as JSON lines, some of them broken."""
    path = shared_path(s, "decisions")
    e = V.tool_events(s, d)
    whole = F.to_json(F.struct(F.col("seq").cast("string").alias("tool_use_id"), F.col("kind").alias("decision"), F.col("tokens").alias("raw_tokens"), F.lit("x").alias("other")))
    e.select(F.when(F.col("seq") % 9 == 0, F.lit('{"decision": ')).otherwise(whole).alias("value")).write.text(path)
    return files.read_decisions(s, path).groupBy("decision").agg(F.count("*").alias("rows"), F.sum("raw_tokens").alias("raw_tokens"), F.count("reason").alias("reasons"))


add("read_decisions", written_decisions, f"with {W['tool_events']} select kind as decision, count(*) as rows, {big('sum(tokens)')} as raw_tokens, cast(0 as bigint) as reasons from tool_events where seq % 9 <> 0 group by 1")


def written_predictions(s: SparkSession, d: str) -> DataFrame:
    """The index of predictions, with the sizes of the written patches."""
    path = shared_path(s, "predictions")
    runs = V.table(s, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("task_id"), F.when(F.col("doc_id") % 6 == 0, " \n").otherwise(F.col("text")).alias("patch"), (F.col("doc_id") % 3).cast("string").alias("arm"), F.col("lang").alias("stratum"), F.lit("done").alias("termination_reason"))
    index = files.write_predictions(runs, path)
    written = s.read.schema("instance_id string, model_patch string, model_name_or_path string").json(path)
    return index.join(written.select(F.col("instance_id").alias("task_id"), F.length("model_patch").alias("chars")), "task_id").groupBy("stratum", "arm", "empty_patch").agg(F.count("*").alias("runs"), F.sum("chars").alias("chars"), F.min("patch_sha256").alias("first_sha256"))


add("write_predictions", written_predictions, f"""with r as (select lang as stratum, cast(doc_id % 3 as varchar) as arm, case when doc_id % 6 = 0 then ' ' || chr(10) else text end as patch from documents) select stratum, arm, trim(patch, ' ' || chr(9) || chr(10) || chr(13)) = '' as empty_patch, count(*) as runs, {big("sum(length(patch))")} as chars, min(sha256(patch)) as first_sha256 from r group by all""")


def replaced(s: SparkSession, d: str) -> DataFrame:
    """Every session is taken in once, and every third one again with other rows."""
    path = shared_path(s, "sessions")
    rows = V.tool_events(s, d).select("session", "seq", "tokens")
    transcripts.replace_sessions(rows, path, buckets=8)
    transcripts.replace_sessions(rows.filter("session % 3 = 0").withColumn("tokens", F.col("tokens") + 1), path, buckets=8)
    return s.read.parquet(path).groupBy("session").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))


add("replace_sessions", replaced, f"with {W['tool_events']} select session, count(*) as rows, {big('sum(tokens + cast(session % 3 = 0 as int))')} as tokens from tool_events group by 1")
add("require_version", lambda s, d: transcripts.require_version(V.tool_events(s, d).withColumn("schema_version", F.lit("3")), "3").groupBy("kind").agg(F.count("*").alias("rows")), f"with {W['tool_events']} select kind, count(*) as rows from tool_events group by 1")


def written_report(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "report")
    files.write_report(V.tool_events(s, d).groupBy("kind", "status").agg(F.sum("tokens").alias("tokens")), path)
    return s.read.schema("kind string, status string, tokens bigint").json(path)


add("write_report", written_report, f"with {W['tool_events']} select kind, status, {big('sum(tokens)')} as tokens from tool_events group by all")


def written_sources(s: SparkSession, d: str) -> DataFrame:
    """Documents as source files under folders by language, one of them vendored, and read back as a source tree."""
    path = shared_path(s, "tree")
    docs = V.table(s, d, "documents")
    docs.filter("lang <> 'fr'").select(F.concat(F.col("lang"), F.lit("_src")).alias("folder"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("value")).write.partitionBy("folder").text(f"{path}/kept")
    docs.filter("lang = 'fr'").select(F.col("text")).write.text(f"{path}/node_modules")
    found = files.read_source_files(s, path, most_bytes=1 << 40).filter(F.col("path").endswith(".txt"))
    lines = found.select(F.regexp_extract("path", "/folder=([a-z]+)_src/", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("line")).alias("chars"))


add("read_source_files", written_sources, f"select lang, count(*) as texts, {big('sum(length(text))')} as chars from documents where lang <> 'fr' and text <> '' group by 1")


def discovered(s: SparkSession, d: str) -> DataFrame:
    """Texts in folders by language as transcripts of projects; the content is not read."""
    path = shared_path(s, "projects")
    V.table(s, d, "documents").select("lang", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("value")).write.partitionBy("lang").text(path)
    return files.discover(s, path, names="*.txt").groupBy("project", "kind").agg(F.sum("size").alias("bytes"))


add("discover", discovered, f"select 'lang=' || lang as project, 'session' as kind, {big("sum(octet_length(encode(replace(coalesce(text, ''), chr(10), ' '))) + 1)")} as bytes from documents group by all")


def written_prices(s: SparkSession, d: str) -> DataFrame:
    """Nations as an ordered price list with a default."""
    path = shared_path(s, "prices")
    price = F.struct(F.col("n_name").alias("match"), (F.col("n_nationkey") * 1.5).alias("input"), F.lit(2.0).alias("output"), (F.col("n_regionkey") == 0).alias("verified"))
    listed = V.table(s, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", price.alias("p")))), lambda x: x["p"]).alias("models"), F.max("n_nationkey").alias("n"))
    listed.select(F.to_json(F.struct("models", F.struct(F.col("n").cast("double").alias("input"), F.lit(0.5).alias("cache_write_5m")).alias("default"))).alias("value")).coalesce(1).write.text(path)
    return files.load_prices(s, path).select("ord", "match", "input_price", "output_price", "cache_write_5m", "verified")


add("load_prices", written_prices, """select cast(n_nationkey as int) as ord, n_name as match, n_nationkey * 1.5::double as input_price, 2.0::double as output_price, cast(null as double) as cache_write_5m, n_regionkey = 0 as verified from nation
    union all select -1, '', max(n_nationkey)::double, null, 0.5::double, false from nation""")


def written_specs(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as task files, many in a file."""
    path = shared_path(s, "tasks")
    k = F.col("s_suppkey").cast("string")
    spec = F.concat(F.lit("task_id: t"), k, F.lit("\ncategory: c"), F.col("s_nationkey").cast("string"), F.lit("\n# Title\n## Prompt\n\n  Fix "), F.col("s_name"), F.lit(".\nThen stop.\n\n"))
    files.write_task_specs(V.table(s, d, "supplier").select(spec.alias("value")), path)
    return files.read_task_specs(s, path, bundled=True).select("task_id", "category", "problem", "run_order")


add("read_task_specs", written_specs, "select 't' || s_suppkey as task_id, 'c' || s_nationkey as category, 'Fix ' || s_name || '.' || chr(10) || 'Then stop.' as problem, cast(0 as int) as run_order from supplier")
