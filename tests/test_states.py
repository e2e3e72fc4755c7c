"""Streams with state: restarts from the checkpoint, late data, repeated batches, repeated ids, removal of what has expired."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from turnledger.operators import journal
from turnledger.streaming import events as live
from turnledger.streaming import states

START = 1_700_000_000


def parts(spark, tmp_path, batches, build, mode="append", check=None):
    """What a stream gives of these batches, each read by a query of its own that goes on from the same checkpoint."""
    found = []
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.foreachBatch(lambda b, _: found.append([r.asDict() for r in b.collect()])).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination()
        if check:
            check()
    return found


def test_steps_go_on_after_a_restart(spark, tmp_path):
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("session"), (F.col("id") % 3).alias("agent"), F.col("id").alias("seq"), (F.col("id") % 14 == 0).alias("reset"), (F.col("id") % 3 != 0).alias("moves")).cache()
    got = parts(spark, tmp_path, [rows.filter(c) for c in ("seq < 25", "seq between 25 and 26", "seq > 26")], live.step_epoch_state)
    want = sorted((r["seq"], r["epoch"], r["step"]) for r in journal.step_epochs(rows).collect())
    assert sorted((r["seq"], r["epoch"], r["step"]) for b in got for r in b) == want and len(got) == 3
    (tmp_path / "two").mkdir()
    both = parts(spark, tmp_path / "two", [rows.filter("seq < 30"), rows.filter("seq >= 30")], lambda s: states.step_epoch_state(s, "session", "agent"))
    one = journal.step_epochs(rows.withColumn("session", F.concat("session", F.col("agent").cast("string"))))
    assert sorted((r["seq"], r["epoch"], r["step"]) for b in both for r in b) == sorted((r["seq"], r["epoch"], r["step"]) for r in one.collect())


def accesses(spark, rows):
    return spark.createDataFrame(rows, "handle string, n long, asks boolean").select("handle", F.timestamp_seconds(F.col("n") + START).alias("ts"), "asks")


def test_expired_handles_leave_the_state(spark, tmp_path):
    batches = [
        accesses(spark, [("h", 0, False), ("h", 50, True), ("none", 5, True), ("k", 10, False), ("k", 5, True)]),
        accesses(spark, [("h", 120, True), ("k", 90, False), ("k", 150, True)]),  # h is 120 s old, k was stored again
        accesses(spark, [("z", 100_000, False)]),  # moves the watermark beyond all
        accesses(spark, [("h", 100_001, True), ("k", 100_002, True), ("z", 100_003, True)]),
    ]
    held = []

    def state():
        rows = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "created").load()
        held.append({r["key"]["handle"] for r in rows.collect()})

    got = parts(spark, tmp_path, batches, lambda s: states.live_contents(s, 100, "1 second"), check=state)
    rows = [(r["handle"], r["at"] // 1000 - START, r["status"]) for b in got for r in b]
    assert set(rows) >= {("h", 50, "found"), ("none", 5, "unknown"), ("k", 5, "unknown"), ("h", 120, "expired"), ("k", 150, "found"), ("h", 100_001, "unknown"), ("k", 100_002, "unknown"), ("z", 100_003, "found")}
    assert {r[0] for r in rows if r[2] == "removed"} == {"h", "k"}
    assert held[0] == {"h", "k"} and held[-1] == {"z"}


def test_a_batch_is_written_once(spark, tmp_path):
    sink = states.journal_sink(str(tmp_path / "journal"), "event_id string, n long")
    raw = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    first = raw('{"event_id": "a", "n": 1}', "not json", '{"event_id": "b", "n": "x"}', '{"n": 3}')
    sink(first, 0)
    sink(raw('{"event_id": "c", "n": 2}'), 1)
    sink(first, 0)  # comes again after a failure
    good, bad = states.journal_rows(spark.read.parquet(str(tmp_path / "journal")))
    assert sorted((r["batch"], r["event_id"], r["n"]) for r in good.collect() if r["event_id"]) == [(0, "a", 1), (1, "c", 2)] and good.count() == 3
    assert sorted(r["value"] for r in bad.collect()) == ["not json", '{"event_id": "b", "n": "x"}']
    for again in (raw('{"event_id": "d"}', '{"event_id": "d"}'), raw('{"event_id": "e"}', '{"event_id": "a"}')):
        with pytest.raises(ValueError, match="second time"):
            sink(again, 2)
    assert spark.read.parquet(str(tmp_path / "journal")).select("batch").distinct().count() == 2  # nothing of the refused batch


def test_a_repeated_id_stops_the_query(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(f'{{"event_id": "{i}", "n": 1}}',) for i in ids], "value string")

    def run():
        stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(states.journal_sink(str(tmp_path / "journal"), "event_id string, n long")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()

    rows("a", "b").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows("c").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows("d", "b").write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="second time"):
        run()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "journal")).collect()) == ["a", "b", "c"]


def test_sliding_windows_equal_their_batch_twin(spark, tmp_path):
    rows = spark.createDataFrame([(k * 700 % 20_000, "m" if k % 3 else "n", k) for k in range(60)], "n long, model string, k long").select(F.timestamp_seconds(F.col("n") + START).alias("ts"), "model", F.col("k").alias("input"), F.lit(10).alias("cache_read"), F.lit(1).alias("cache_write")).cache()
    build = lambda s: live.live_ledger(s, "1 hour", "30 days", "20 minutes")
    last = {}
    for batch in parts(spark, tmp_path, [rows.filter("input < 20"), rows.filter("input between 20 and 39"), rows.filter("input > 39")], build, mode="update"):
        last |= {(r["start"], r["model"]): (r["requests"], r["occupancy"]) for r in batch}  # late rows correct earlier windows
    want = {(r["start"], r["model"]): (r["requests"], r["occupancy"]) for r in build(rows).collect()}
    assert last == want and sum(n for n, _ in want.values()) == 3 * 60
