"""Transcripts to lineage, breaks, switches and cost, on lines made by hand."""

import json

import pytest

from turnledger.operators import ledger, lineage, usage
from turnledger.sources import transcripts


def line(uuid, parent, rid=None, model="m", read=0, write=0, at="00:00:00", version="1", tiers=None, kind="assistant", subtype=None):
    message = {"role": kind, "model": model, "content": "x"}
    if rid:
        message["usage"] = {"input_tokens": 10, "cache_read_input_tokens": read, "cache_creation_input_tokens": write, "output_tokens": 2} | ({"cache_creation": {"ephemeral_5m_input_tokens": tiers[0], "ephemeral_1h_input_tokens": tiers[1]}} if tiers else {})
    return json.dumps({"type": kind, "sessionId": "s", "uuid": uuid, "parentUuid": parent, "requestId": rid, "timestamp": f"2024-01-01T{at}Z", "version": version, "subtype": subtype, "message": message})


LINES = [
    line("u0", None, kind="user"),
    line("a1", "u0", "r1", read=0, write=120_000, tiers=(20_000, 100_000)),
    line("a1b", "u0", "r1", read=0, write=120_000, tiers=(20_000, 100_000)),  # the same request on a second line
    line("u1", "a1b", kind="user"),
    line("a2", "u1", "r2", read=120_000, write=500, at="00:01:00"),
    line("c", "a2", kind="system", subtype="compact_boundary"),
    line("a3", "c", "r3", read=0, write=30_000, at="00:02:00", tiers=(0, 0)),  # no tier says anything: the total counts
    line("a4", "a2", "r4", model="big", read=10_000, write=90_000, at="00:40:00"),  # a fork from before the compaction, with another model
    line("a5", "a4", "r5", model="m", read=99_000, write=100, at="00:41:00"),  # back to a warm cache
    line("a6", "a5", "r6", model="m", read=1_000, write=99_000, at="03:00:00", version="2"),
    line("x", "a6", "r7", model="<synthetic>"),
]


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("transcripts")
    (folder / "one.jsonl").write_text("\n".join(LINES))
    lines = transcripts.read_transcripts(spark, str(folder)).cache()
    rows = transcripts.transcript_lineage(lines)
    requests = transcripts.transcript_requests(lines, keep="first")
    own = rows.filter("usage").join(requests.withColumnRenamed("id", "request").drop("session"), "request")
    # ids by place, as the order of rows is the order of their ids
    place = rows.select("id", "pos")
    numbered = lambda df, *columns: df.join(place.select("id", "pos").withColumnsRenamed({"id": columns[0], "pos": f"{columns[0]}_pos"}), columns[0], "left").drop(columns[0]).withColumnRenamed(f"{columns[0]}_pos", columns[0])
    up = numbered(numbered(usage.lineage_parent(rows), "id"), "ancestor")
    return lineage.with_ancestors(numbered(own.drop("pos"), "id"), up).cache(), requests


def test_breaks_are_measured_against_what_they_continue(pairs):
    got = {r["id"]: (r["signals"], r["cause"], r["hard"], r["recache"], r["fresh"], r["avoidability"]) for r in lineage.lineage_breaks(pairs[0]).collect()}
    assert got == {
        6: ("compaction", "compaction", True, 30_000, 0, "compaction"),
        7: ("fork+model_change", "fork", True, 90_000, 0, "artifact_or_userfork"),
        9: ("version_change+ttl_expiration", "version_change", True, 98_100, 900, "unavoidable_ttl_coincident"),
    }
    by = {r["cause"]: (r["breaks"], r["written"]) for r in lineage.break_summary(lineage.lineage_breaks(pairs[0]), "cause").collect()}
    assert by == {"compaction": (1, 30_000), "fork": (1, 90_000), "version_change": (1, 99_000)}


def test_switches_and_their_ranks(spark, pairs):
    found = lineage.switches(pairs[0])
    got = {(r["from_model"], r["to_model"]): r for r in lineage.switch_matrix(found).collect()}
    there, back = got["m", "big"], got["big", "m"]
    assert (there["switches"], there["breaks"], there["warm_returns"], there["migrated"], there["from_100k"], there["from_400k"], there["gap_2"]) == (1, 1, 0, 90_000, 1, 0, 1)
    assert (back["switches"], back["breaks"], back["warm_returns"], back["gap_0"]) == (1, 0, 1, 1)
    values = spark.createDataFrame([(k, k * 10) for k in range(11)], "id long, v long")
    ranks = {r["share"]: r["value"] for r in lineage.nearest_ranks(values, "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    assert ranks == {0.0: 0, 0.5: 50, 0.9: 90, 1.0: 100}  # floor(share * 11), the last at most


def test_cost_by_hand(spark, pairs):
    prices = spark.createDataFrame([(0, "big", 15.0, 75.0, 1.5, 18.75, 30.0, True), (1, "bi", 0.0, 0.0, 0.0, 0.0, 0.0, False), (-1, "", 3.0, 15.0, 0.3, 3.75, 6.0, False)], "ord int, match string, input_price double, output_price double, cache_read double, cache_write_5m double, cache_write_1h double, verified boolean")
    got = {(r["model"], r["overall"]): r for r in lineage.costed_ledger(pairs[1], prices).collect()}
    big, small, both = got["big", False], got["m", False], got[None, True]
    assert big["cost"] == pytest.approx((10 * 15 + 10_000 * 1.5 + 90_000 * 30 + 2 * 75) / 1e6) and big["verified"] and not small["verified"] and not both["verified"]
    written = 120_000 + 500 + 30_000 + 100 + 99_000
    assert small["cache_write"] == written and (small["cache_write_5m"], small["cache_write_1h"]) == (20_000, 100_000)
    same = 5 * 10 * 3 + (120_000 + 99_000 + 1_000) * 0.3 + 5 * 2 * 15
    assert small["cost"] == pytest.approx((same + written * 6) / 1e6) and small["tier_cost"] == pytest.approx((same + written * 6 - 20_000 * 2.25) / 1e6)
    assert both["requests"] == 6 and both["cost"] == pytest.approx(big["cost"] + small["cost"]) and both["occupancy"] == big["occupancy"] + small["occupancy"]
    with pytest.raises(ValueError):
        lineage.price_columns(spark.range(1001).selectExpr("cast(id as int) as ord", "'x' as match", "1.0D as input_price", "1.0D as output_price", "1.0D as cache_read", "1.0D as cache_write_5m", "1.0D as cache_write_1h", "true as verified"), lineage.F.col("m"))
    assert lineage.costed_ledger(pairs[1].limit(0), prices).count() == 0


def test_a_compaction_is_the_first_cause(spark):
    rows = [("s", 0, 0, "m", 1, "2024-01-01 00:00:00", 0, 30_000, 0), ("s", 1, 1, "n", 1, "2024-01-01 00:01:00", 0, 30_000, 2), ("s", 2, 2, "m", 1, "2024-01-01 00:02:00", 0, 30_000, 0)]
    requests = spark.createDataFrame(rows, "session string, id long, turn long, model string, version long, ts string, cache_read long, cache_write long, compactions long")
    assert [r["cause"] for r in ledger.cache_breaks(requests).orderBy("turn").collect()] == ["compaction", "model"]
    assert [r["cause"] for r in ledger.cache_breaks(requests.drop("compactions")).orderBy("turn").collect()] == ["model", "model"]
