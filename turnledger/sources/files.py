"""Files around sessions: discovery, prices, journals, run reports, decisions, task specifications, source trees, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources, and the largest source file in bytes.
SKIPPED_FOLDERS, MOST_BYTES = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".next", "target", ".pytest_cache"), 1_500_000
#: Fixed value: what ends each task file where many are in one file.
NEXT_SPEC = "\x1e"
TESTS = "struct<success:array<string>,failure:array<string>>"
VERDICT = f"struct<resolved:boolean,patch_successfully_applied:boolean,tests_status:struct<FAIL_TO_PASS:{TESTS},PASS_TO_PASS:{TESTS}>>"
EVENT = (
    "seq bigint, event_id string, session_id string, agent_id string, stream_key string, prompt_id string, cwd string, step int, batch_id string, batch_size int, parallel boolean, tool_use_id string, tool_name string, "
    "kind string, channel string, mutation_source string, mutation_status string, representation string, path_absolute string, path_normalized string, repo_relative string, repo_id string, pre_version string, post_version string, "
    "content_version string, version_status string, response_hash string, model_visible_chars bigint, model_visible_tokens bigint, token_status string, token_attribution string, token_estimator_id string, success int, outcome string, "
    "wall_time_ns bigint, schema_version string"
)
PRICE = "struct<match:string,input:double,output:double,cache_read:double,cache_write_5m:double,cache_write_1h:double,verified:boolean>"


def discover(spark: SparkSession, root: str, since: str | None = None, most: int | None = None, names: str = "*.jsonl") -> DataFrame:
    """(path, project, kind, size) of the transcripts (files so named) under ``root``, largest first: kind session, or subagent for files named agent-*. Only
    those changed since a time, and only the ``most`` largest, where asked for. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    files = (files.option("modifiedAfter", since) if since else files).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    below = F.regexp_extract("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1)
    found = files.filter(name != "journal.jsonl").select("path", below.alias("project"), F.when(name.startswith("agent-"), "subagent").otherwise("session").alias("kind"), F.col("length").alias("size"))
    ordered = found.orderBy(F.desc("size"), "path")
    return ordered.limit(most) if most else ordered


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """(ord, match, input_price, output_price, cache_read, cache_write_5m, cache_write_1h, verified): the ordered patterns from 0, and the
    default with ord -1. Order decides which pattern wins."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"models array<{PRICE}>, default {PRICE}").alias("p"))
    rows = whole.select(F.posexplode("p.models").alias("ord", "m")).unionByName(whole.select(F.lit(-1).alias("ord"), F.col("p.default").alias("m")))
    return rows.select("ord", F.coalesce("m.match", F.lit("")).alias("match"), F.col("m.input").alias("input_price"), F.col("m.output").alias("output_price"), "m.cache_read", "m.cache_write_5m", "m.cache_write_1h", F.coalesce("m.verified", F.lit(False)).alias("verified"))


def read_tool_events(spark: SparkSession, path: str) -> DataFrame:
    """Journal rows with the fixed schema, whatever columns the files hold. ``seq`` orders them."""
    return spark.read.schema(EVENT).parquet(path)


def read_run_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts (task_id, resolved, applied, f2p_passed, p2p_passed) of all ``report.json`` under a folder, and the task ids (task_id) whose
    patch was empty, from the summaries beside them. Files that are no such JSON give nothing; the report last in order of paths wins."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "value")
    reports = text.filter("name = 'report.json'").select("file", F.explode(F.from_json("value", f"map<string,{VERDICT}>")).alias("task_id", "v")).filter("v is not null")
    tests = lambda kind, part: F.size(F.coalesce(F.col(f"v.tests_status.{kind}.{part}"), F.array().cast("array<string>")))
    last = reports.groupBy("task_id").agg(F.max_by("v", "file").alias("v"))
    verdicts = last.select("task_id", F.coalesce("v.resolved", F.lit(False)).alias("resolved"), F.coalesce("v.patch_successfully_applied", F.lit(False)).alias("applied"), ((tests("FAIL_TO_PASS", "failure") == 0) & (tests("FAIL_TO_PASS", "success") > 0)).alias("f2p_passed"), (tests("PASS_TO_PASS", "failure") == 0).alias("p2p_passed"))
    empty = text.filter(~F.col("file").rlike("/run_evaluation[^/]*/[^/]*$")).select(F.explode(F.from_json("value", "empty_patch_ids array<string>")["empty_patch_ids"]).alias("task_id")).distinct()
    return verdicts, empty


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a decision log: one JSON object in each line; others are dropped."""
    schema = "tool_use_id string, tool string, decision string, reason string, raw_tokens bigint, reduced_tokens bigint, handle string, broken string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path).filter("broken is null").drop("broken")


def write_task_specs(specs: DataFrame, path: str) -> None:
    """Writes the texts (value) of task files, many in a file with ``NEXT_SPEC`` after each, as a file for each task costs more than its text. A text
    that holds that mark is an error."""
    whole = F.when(F.contains("value", F.lit(NEXT_SPEC)), F.raise_error(F.lit("a task file holds the mark between task files"))).otherwise(F.col("value"))
    specs.select(whole.alias("value")).write.option("lineSep", NEXT_SPEC).text(path)


def read_task_specs(spark: SparkSession, path: str, heading: str = "## Prompt", bundled: bool = False) -> DataFrame:
    """(run_order, task_id, category, base_commit, repo_id, budget, spec_sha256, problem) of task files: header fields by name, and what
    follows the heading's line. ``bundled``: files hold many of them, as ``write_task_specs`` writes them."""
    text = spark.read.text(path, wholetext=not bundled, lineSep=NEXT_SPEC if bundled else None).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("t"))
    field = lambda n: F.trim(F.regexp_extract("t", rf"(?m)^{n}:\s*(.+)$", 1))
    problem = F.btrim(F.regexp_extract("t", rf"(?s)\n{heading}[^\n]*\n(.*)$", 1), F.lit(" \t\r\n"))
    return text.select(F.coalesce(F.regexp_extract("name", r"run-(\d+)", 1).try_cast("int"), F.lit(0)).alias("run_order"), field("task_id").alias("task_id"), field("category").alias("category"), field("base_commit_sha").alias("base_commit"), field("repo_id").alias("repo_id"), field("turn_or_walltime_budget").alias("budget"), F.sha2("t", 256).alias("spec_sha256"), problem.alias("problem"))


def read_source_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, text) of the files of a source tree, without vendored folders and large files. A caller that asks for paths only reads
    no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter((F.col("length") <= most_bytes) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED_FOLDERS))).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def write_report(report: DataFrame, path: str) -> None:
    """An aggregate as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_predictions(runs: DataFrame, path: str) -> DataFrame:
    """Writes one JSON object for each run (task_id, patch, arm, stratum, termination_reason) and gives the index (task_id, stratum, arm,
    termination_reason, empty_patch, patch_sha256)."""
    runs.select(F.col("task_id").alias("instance_id"), F.col("patch").alias("model_patch"), F.col("arm").alias("model_name_or_path")).write.mode("overwrite").json(path)
    return runs.select("task_id", "stratum", "arm", "termination_reason", (F.btrim("patch", F.lit(" \t\n\r\x0b\x0c")) == "").alias("empty_patch"), F.sha2("patch", 256).alias("patch_sha256"))
