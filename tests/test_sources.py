"""Files, sinks and streams on small made-up inputs."""

import json

import pytest
from pyspark.sql import functions as F

from turnledger import session
from turnledger.operators import journal, runs
from turnledger.sources import files, transcripts
from turnledger.streaming import events as live


def test_discovery(spark, tmp_path):
    for name, size in (("a/s1.jsonl", 30), ("a/sub/agent-1.jsonl", 50), ("b/journal.jsonl", 90), ("b/s2.jsonl", 10), ("b/x.txt", 10)):
        (tmp_path / "projects" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "projects" / name).write_text("x" * size)
    found = [(r["project"], r["kind"], r["size"]) for r in files.discover(spark, str(tmp_path / "projects")).collect()]
    assert found == [("a", "subagent", 50), ("a", "session", 30), ("b", "session", 10)]
    assert files.discover(spark, str(tmp_path / "projects"), most=1).count() == 1
    assert files.discover(spark, str(tmp_path / "projects"), since="2100-01-01T00:00:00").count() == 0


def test_prices_keep_their_order(spark, tmp_path):
    row = {"input": 5.0, "output": 25.0, "cache_read": 0.5, "cache_write_5m": 6.0, "cache_write_1h": 10.0}
    (tmp_path / "p.json").write_text(json.dumps({"models": [{"match": "a-5", **row, "verified": True}, {"match": "a", **row}], "default": row}, indent=1))
    found = {r["ord"]: (r["match"], r["input_price"], r["verified"]) for r in files.load_prices(spark, str(tmp_path / "p.json")).collect()}
    assert found == {0: ("a-5", 5.0, True), 1: ("a", 5.0, False), -1: ("", 5.0, False)}


def test_run_reports_and_outcomes(spark, tmp_path):
    good = {"resolved": True, "patch_successfully_applied": True, "tests_status": {"FAIL_TO_PASS": {"success": ["t"], "failure": []}, "PASS_TO_PASS": {"success": [], "failure": []}}}
    (tmp_path / "x" / "logs").mkdir(parents=True)
    (tmp_path / "x" / "logs" / "report.json").write_text(json.dumps({"t1": good, "t2": {"resolved": False}}, indent=1))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "report.json").write_text("not json")
    (tmp_path / "summary.json").write_text(json.dumps({"empty_patch_ids": ["t3"]}))
    verdicts, empty = files.read_run_reports(spark, str(tmp_path))
    assert sorted(map(tuple, verdicts.collect())) == [("t1", True, True, True, True), ("t2", False, False, False, True)]
    index = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "task_id string")
    assert {r["task_id"]: r["outcome"] for r in runs.runs_with_verdicts(index, verdicts, empty).collect()} == {"t1": "resolved", "t2": "unresolved", "t3": "empty_patch", "t4": "grader_error"}


def test_specs_decisions_sources_and_sinks(spark, tmp_path):
    (tmp_path / "run-07.md").write_text("task_id: t7\ncategory: easy\nbase_commit_sha: abc\n\n## Prompt (verbatim)\nfix it\nplease\n")
    spec = files.read_task_specs(spark, str(tmp_path / "run-07.md")).first()
    assert (spec["run_order"], spec["task_id"], spec["category"], spec["base_commit"], spec["repo_id"], spec["problem"]) == (7, "t7", "easy", "abc", "", "fix it\nplease")
    (tmp_path / "d.jsonl").write_text('{"tool_use_id": "a", "raw_tokens": 5}\nbroken\n')
    assert [r["raw_tokens"] for r in files.read_decisions(spark, str(tmp_path / "d.jsonl")).collect()] == [5]
    for name in ("src/a.py", "node_modules/b.py", "big.py"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x = 1\n" * (1000 if name == "big.py" else 1))
    assert [r["text"] for r in files.read_source_files(spark, str(tmp_path / "tree"), 100).collect()] == ["x = 1\n"]
    rows = spark.createDataFrame([("t1", "diff", "A", "s", "completed"), ("t2", " ", "A", "s", "timeout")], "task_id string, patch string, arm string, stratum string, termination_reason string")
    index = files.write_predictions(rows, str(tmp_path / "out"))
    assert {r["task_id"]: r["empty_patch"] for r in index.collect()} == {"t1": False, "t2": True}
    assert spark.read.json(str(tmp_path / "out")).columns == ["instance_id", "model_name_or_path", "model_patch"]
    files.write_report(index, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_journal_has_a_fixed_schema(spark, tmp_path):
    spark.createDataFrame([(1, "e", 9)], "seq long, event_id string, other int").write.parquet(str(tmp_path / "j"))
    row = files.read_tool_events(spark, str(tmp_path / "j")).first()
    assert row["seq"] == 1 and row["stream_key"] is None and "other" not in row.asDict()


def test_sessions_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda rows: transcripts.replace_sessions(spark.createDataFrame(rows, "session string, n long"), path, buckets=2)
    write([("a", 1), ("a", 2), ("b", 3), ("c", 4)])
    write([("a", 9)])
    write([("a", 9)])
    assert sorted(map(tuple, spark.read.parquet(path).select("session", "n").collect())) == [("a", 9), ("b", 3), ("c", 4)]


def test_invalid_events_stop_the_job(spark):
    rows = spark.createDataFrame([(1, None, "x", "s", "k"), (2, "timeout", None, None, None)], "id long, closure_reason string, source_system string, stream string, source_event_key string")
    assert journal.require_valid(rows).count() == 2
    with pytest.raises(Exception, match="closure_reason"):
        journal.require_valid(rows.withColumn("closure_reason", F.lit("because"))).collect()


def streamed(spark, tmp_path, rows, build, mode="append"):
    """What a stream of these rows gives, all read at once."""
    rows.write.parquet(str(tmp_path / "in"))
    q = build(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("found").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("found").collect()


def test_bad_deliveries_are_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([('{"id": 1, "t": "a"}',), ("not json",), ('{"id": 2}',), ('{"id": "x"}',)], "value string")
    good, bad = live.good_and_bad(rows, "id long, t string")
    assert sorted((r["id"], r["t"]) for r in good.collect()) == [(1, "a"), (2, None)]
    assert {r["value"] for r in bad.collect()} == {"not json", '{"id": "x"}'}
    assert {r["value"] for r in streamed(spark, tmp_path, rows, lambda s: live.good_and_bad(s, "id long, t string")[1])} == {"not json", '{"id": "x"}'}


def test_step_state_equals_batch(spark, tmp_path):
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("session"), F.col("id").alias("seq"), (F.col("id") % 14 == 0).alias("reset"), (F.col("id") % 3 != 0).alias("moves"))
    got = sorted((r["seq"], r["epoch"], r["step"]) for r in streamed(spark, tmp_path, rows, live.step_epoch_state, "append"))
    assert got == sorted((r["seq"], r["epoch"], r["step"]) for r in journal.step_epochs(rows).collect())


def test_calls_wait_for_their_results(spark, tmp_path):
    pre = spark.createDataFrame([("c1", 0, "d"), ("c2", 10, "d"), ("c3", 20, "d"), ("late", 20000, "d")], "tool_use_id string, n long, digest string").withColumn("ts", F.timestamp_seconds(F.col("n") + 1_700_000_000))
    post = spark.createDataFrame([("c1", 5, "d"), ("c2", 15, "e"), ("end", 20000, "x")], "tool_use_id string, n long, digest string").withColumn("ts", F.timestamp_seconds(F.col("n") + 1_700_000_000))
    pre.write.parquet(str(tmp_path / "pre"))
    post.write.parquet(str(tmp_path / "post"))
    a, b = (spark.readStream.schema(x.schema).parquet(str(tmp_path / p)) for x, p in ((pre, "pre"), (post, "post")))
    q = live.pair_pre_post(a, b).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["call_id"]: r["version_status"] for r in spark.table("paired").collect()} == {"c1": "stable", "c2": "raced", "c3": "pending"}


def test_counters_sessions_and_expiry(spark, tmp_path):
    rows = spark.createDataFrame([("read", 0), ("read", 30), ("edit", 60), ("read", 7200), ("read", 1_000_000)], "metric string, n long").withColumn("ts", F.timestamp_seconds(F.col("n") + 1_700_000_000))
    for name, build in (("n", live.counters), ("s", lambda s: live.live_sessions(s.withColumn("session", F.lit("x")))), ("e", lambda s: live.expire_content(s.withColumn("handle", F.col("metric"))))):
        (tmp_path / name).mkdir()
        found = streamed(spark, tmp_path / name, rows, build)
        if name == "n":
            assert sorted((r["metric"], r["count"]) for r in found) == [("edit", 1), ("read", 1), ("read", 2)]
        elif name == "s":
            assert sorted(r["requests"] for r in found) == [1, 3]
        else:
            assert sorted((r["handle"], r["accesses"]) for r in found) == [("edit", 1), ("read", 3)]


def test_dedupe_by_producer_key(spark, tmp_path):
    rows = spark.createDataFrame([("h", "s", "e1", 1), ("h", "s", "e1", 2), ("h", "t", "e1", 3), ("h", None, "e1", 4), ("h", None, "e1", 5)], "source_system string, stream string, source_event_key string, n long").withColumn("ts", F.timestamp_seconds(F.col("n") + 1_700_000_000))
    found = [r["n"] for r in streamed(spark, tmp_path, rows, lambda s: live.dedupe(s, "source_system", "stream", "source_event_key"))]
    assert len(found) == 4 and {3, 4, 5} < set(found)


def test_stored_tables_are_removed_when_asked(spark):
    kept = session.stored(spark.range(5), "kept")
    assert kept.count() == 5 and session.remove_stored(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.exist|no such file|does not exist"):
        spark.read.parquet(kept.inputFiles()[0]).count()
    assert session.stored(spark.range(3), "next").count() == 3  # later tables are not affected
