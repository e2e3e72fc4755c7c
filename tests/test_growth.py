"""What must not grow faster than its input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from turnledger import session
from turnledger.operators import bundles, graph, labels, ledger, recall, reduction, resolution, retirement, summaries, usage
from turnledger.plans import streamed
from turnledger.sources import files
from turnledger.streaming import states

N = 120_000  # rows of one session: seconds in one pass, many minutes where each row looks at all that follow


def timed(rows, seconds: int = 40):
    start = time.monotonic()
    out = rows.collect()
    assert time.monotonic() - start < seconds
    return out


@pytest.fixture(scope="module")
def objects(spark):
    return spark.range(N).select(F.lit("s").alias("session"), F.col("id").alias("pos"), F.col("id").alias("turn"), (F.col("id") % 1000).cast("string").alias("key"), F.lit(10).cast("bigint").alias("size"))


def test_horizons_of_a_long_session(objects):
    breaks = objects.filter("turn % 50000 = 7").select("session", "turn")
    out = ledger.residency_horizon(objects, breaks).groupBy("exit_turn").agg(F.count("*").alias("n"))
    assert {r["exit_turn"]: r["n"] for r in timed(out)} == {6: 7, 50006: 50000, 100006: 50000, N - 1: N - 100007}


def test_thresholds_and_resets_of_a_long_session(objects):
    o = retirement.obsolescence(objects)
    batches = retirement.at_threshold(o, 20).filter("batch is not null").groupBy("batch").agg(F.count("*").alias("n"))
    got = {r["batch"]: r["n"] for r in timed(batches)}
    assert sum(got.values()) == N - 1000 and len(got) == (N - 1000) // 2 and set(got.values()) == {2}
    saved = retirement.unique_savings(retirement.retire_turns(o), objects.filter("turn % 1000 = 0").select("session", "turn"))
    assert timed(saved)[0]["standalone"] > 0


def test_later_edits_and_users_of_a_long_session(spark, objects):
    e = objects.select(F.col("pos").alias("seq"), "session", F.lit("a").alias("stream"), F.lit("p").alias("path"), F.when(F.col("pos") == N - 1, "edit").otherwise("read").alias("kind"), F.lit(True).alias("success"), F.col("pos").alias("step"), F.lit("v").alias("version"), F.lit("file").alias("representation"), F.lit("stable").alias("status"), F.lit(None).cast("bigint").alias("batch"), F.lit(1).alias("tokens"))
    assert [tuple(r) for r in timed(labels.classify_reads(e).groupBy("edit_seq").agg(F.count("*")))] == [(N - 1, N - 1)]
    turns = objects.select(F.lit(1).alias("conv_id"), "turn", F.when(F.col("turn") == N - 1, "user").otherwise("assistant").alias("role"))
    assert {tuple(r) for r in timed(usage.next_user_turn(turns).groupBy("next_user").agg(F.count("*")))} == {(N - 1, N - 1), (None, 1)}


def test_parts_that_arrive_are_many_files_and_come_in_order(spark):
    stream, later = streamed.arriving(spark.range(0, 3000, 1, 4).selectExpr("id", "id % 4 as p"), "id")
    out = states.drained(stream, later=later)
    out = out.withColumn("file", F.input_file_name())
    got = {r["batch"]: (r["n"], r["low"], r["files"]) for r in out.groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.countDistinct("file").alias("files")).collect()}
    assert {b: v[:2] for b, v in got.items()} == {0: (1000, 0), 1: (1000, 1000), 2: (1000, 2000)}
    assert all(v[2] > 1 for v in got.values())  # not one file from one task


def test_many_task_files_are_few_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('task_id: t', id, '\\n## Prompt\\n\\nFix ', id, '\\nall.\\n\\n') as value")
    files.write_task_specs(rows, str(tmp_path / "t"))
    got = files.read_task_specs(spark, str(tmp_path / "t"), bundled=True).select("task_id", "problem").collect()
    assert {tuple(r) for r in got} == {(f"t{k}", f"Fix {k}\nall.") for k in range(3000)} and len(got) == 3000
    assert len(list((tmp_path / "t").rglob("part-*.txt"))) < 30
    with pytest.raises(Exception, match="the mark between task files"):
        files.write_task_specs(rows.limit(1).selectExpr("concat(value, char(30)) as value"), str(tmp_path / "u"))


def test_second_steps_are_not_dealt_out_again(spark):
    edges = spark.range(4000).selectExpr("id % 800 as src", "(id * 7 + id % 13) % 40 as dst", "'CALLS' as type", "'exact' as match", "0.5 + id % 9 / 20.0D as confidence")
    out = bundles.dependency_candidates(spark.range(800).selectExpr("id as root"), edges)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # first steps by root, and nothing after them
    assert out.count() == out.select("root", "node").distinct().count() > 800 and out.filter("root = node").count() == 0


def test_second_steps_too_many_to_send_everywhere_are_walked_in_parts(spark, monkeypatch):
    edges = spark.range(4000).selectExpr("cast(id % 800 as string) as src", "cast((id * 7 + id % 13) % 40 as string) as dst", "'CALLS' as type", "'exact' as match", "0.5 + id % 3 / 20.0D as confidence")
    roots = spark.range(800).selectExpr("cast(id as string) as root")
    want = {tuple(r) for r in bundles.dependency_candidates(roots, edges).collect()}
    monkeypatch.setattr(bundles, "FEW_STEPS", 0)
    monkeypatch.setattr(bundles, "WALKED", 2000)
    out = bundles.dependency_candidates(roots, edges)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    above = out._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert above.count("Exchange") == 1 and "REPARTITION_BY_NUM" in above  # first steps and edges meet in their part, and nothing moves after that


def test_candidates_of_bundles_are_neither_kept_nor_dealt_out_again(spark, monkeypatch):
    sizes = []

    def counted(df, name, *more, **named):
        out = session.stored(df, name, *more, **named)
        sizes.append(out.count())
        return out

    edges = spark.range(4000).selectExpr("id % 800 as src", "(id * 7 + id % 13) % 40 as dst", "'CALLS' as type", "'exact' as match", "0.5 + id % 9 / 20.0D as confidence")
    levels = spark.range(799).selectExpr("id", "'signature' as level", "8 + id % 3 as cost", "1.0D as value").unionByName(spark.range(700).selectExpr("id", "'implementation' as level", "20 + id % 50 as cost", "3.0D as value"))
    candidates = bundles.dependency_candidates(spark.range(800).selectExpr("id as root"), edges)
    monkeypatch.setattr(bundles, "stored", counted)
    out = bundles.select_bundle(candidates, levels, 66)
    assert candidates.count() > 2 * max(sizes)
    moved = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and all("hashpartitioning(root" in line for line in moved)  # first steps and the costs of roots, both by root
    own = {r["root"] for r in out.filter("root = node and level = 'implementation'").collect()}
    assert own == {k for k in range(799) if k >= 700 or 20 + k % 50 <= 66} and out.count() > len(own)


def test_anchors_where_a_file_has_many_symbols_on_the_same_lines(spark):
    symbols = spark.range(400_000).selectExpr("id", "concat('m.f', id) as qualified", "'function' as kind", "'m' as module", "'src/a.py' as path", "id % 3 as start_line", "id % 3 + 60 as end_line")
    asked = spark.range(180).selectExpr("id", "'' as text", "cast(null as string) as trace_path", "cast(null as bigint) as trace_line", "array('a.py', 'src/a.py', '/x/src/a.py')[id % 3] as path", "id div 3 as line", "cast(null as string) as symbol_name")
    start = time.monotonic()
    got = {r["id"]: (r["symbol"], r["anchor"]) for r in resolution.resolve_anchors(asked, symbols).collect()}  # 70 million meetings of lines and symbols, three sets of lines
    assert time.monotonic() - start < 70  # tables are written on the way, so all of it counts
    assert {k: v[1] for k, v in got.items()} == dict.fromkeys(range(180), "path_line") and len(got) == 180
    assert {(k // 3, v[0]) for k, v in got.items()} == {(line, 100_000 + (min(line, 2) - 100_000) % 3) for line in range(60)}  # of the longest names the least id


def test_coedited_pairs_are_walked_not_all_that_a_symbol_reaches(spark, monkeypatch):
    sizes = []

    def counted(df, name, *more, **named):
        out = session.stored(df, name, *more, **named)
        sizes.append(out.count())
        return out

    for module in (bundles, graph):
        monkeypatch.setattr(module, "stored", counted, raising=False)
    edges = spark.range(1, 1001).selectExpr("id as src", "0L as dst", "'CALLS' as type").unionByName(spark.range(1000, 2000).selectExpr("0L as src", "id as dst", "'CALLS' as type"))
    edited = spark.range(1, 1001).selectExpr("id div 2 as task", "id as symbol")
    paths = spark.range(2000).selectExpr("id as symbol", "concat('p', id div 4) as path")
    got = {r["relation"]: r["pairs"] for r in bundles.coedit_relations(edited, edges, paths).collect()}
    assert got == {"same_file": 998}  # (2, 3), (4, 5) and so on; none depends on its neighbour
    assert max(sizes) < 10_000  # a million pairs of a symbol and what it reaches


def test_relations_of_coedited_pairs_against_plain_loops(spark):
    draw = random.Random(3)
    edited = [(draw.randrange(12), draw.randrange(30)) for _ in range(90)] + [(1, 2), (1, 2), (None, 3), (2, None)]
    edges = [(draw.randrange(30), draw.randrange(25), draw.choice(("CALLS", "IMPORTS", "TESTED_BY", "OTHER"))) for _ in range(60)] + [(4, 4, "CALLS"), (5, 5, "TESTED_BY")]
    paths = {k: None if k % 9 == 0 else f"p{k % 4}" for k in range(28)}
    tables = [spark.createDataFrame(edited, "task long, symbol long"), spark.createDataFrame(edges, "src long, dst long, type string"), spark.createDataFrame(list(paths.items()), "symbol long, path string")]
    walk = {(a, b) for a, b, t in edges if t in bundles.WEIGHTS}
    tests = {p for a, b, t in edges if t == "TESTED_BY" for p in ((a, b), (b, a))}
    for hops in (1, 2, 3):
        reach = far = walk
        for _ in range(hops - 1):
            far = {(a, d) for a, b in far for c, d in walk if b == c}
            reach = reach | far
        want = {}
        for task in {t for t, _ in edited} - {None}:
            own = {x for t, x in edited if t == task and x is not None}
            for a, b in ((a, b) for a in own for b in own if a != b):
                same = paths.get(a) is not None and paths.get(a) == paths.get(b)
                r = "callee" if (a, b) in reach else "caller" if (b, a) in reach else "test" if (a, b) in tests else "same_file" if same else "none"
                want[r] = want.get(r, 0) + 1
        assert {r["relation"]: r["pairs"] for r in bundles.coedit_relations(*tables, hops).collect()} == want and len(want) == 5


def test_pairs_of_baskets_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    draw = random.Random(5)
    held = [(k, draw.randrange(40)) for k in range(300) for _ in range(draw.randrange(9))] + [(999, i) for i in range(41)] + [(None, 1), (None, 2), (3, None)]
    rows = spark.createDataFrame(held, "basket long, item long")
    want = {}
    for k in range(300):
        own = sorted({i for b, i in held if b == k and i is not None})
        for p in ((a, b) for a in own for b in own if a != b):
            want[p] = want.get(p, 0) + 1
    pairs = sum(want.values()) // 2
    for most, parts in ((pairs + 1, 1), (100, 1 + pairs // 100)):
        monkeypatch.setattr(graph, "PAIRS", most)
        out, n = graph.counted_together(rows, 40)
        assert n == parts and out.rdd.getNumPartitions() == parts  # not joined again because they are small on disk
        assert {(r["item"], r["other"]): r["together"] for r in out.collect()} == {p: c for p, c in want.items() if p[0] < p[1]}
        got = {(r["item"], r["rank"]): (r["other"], r["together"]) for r in graph.cochange_neighbours(rows, 40, 3).collect()}
        first = {a: sorted((-c, o) for (x, o), c in want.items() if x == a)[:3] for a in {p[0] for p in want}}
        assert got == {(a, k + 1): (o, -c) for a, best in first.items() for k, (c, o) in enumerate(best)}


def test_lines_of_searches_meet_scores_and_touches_in_few_shuffles(spark):
    outputs = spark.createDataFrame([(1, "a: x\nb: yy\n\ntoken\nc: zzzz"), (2, None), (None, "a: x")], "id long, text string")
    touches = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (1, None), (None, "a"), (1, "token"), (2, "a")], "id long, path string")
    scores = spark.createDataFrame([("b", 1.0), ("a", 0.5)], "path string, score double")
    found = recall.ranking_recall(outputs, touches, scores.hint("merge"), 3, "token")  # six characters go to the diagnostic, six are left
    assert {tuple(r) for r in found.collect()} == {(1, "a", 1, 0, 0, None, "demoted"), (1, "b", 0, 1, None, 0, "promoted"), (1, "c", 0, 0, None, None, "missed")}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 3  # lines and scores by path, then all by search


def test_search_summaries_are_made_within_their_row(spark):
    outputs = spark.range(200).selectExpr("id", "concat_ws('\n', transform(sequence(0, id % 40), k -> concat('f', k % 17, '.py:', k, ': hit'))) as text")
    out = summaries.search_summary(outputs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Range") == 1  # outputs are read once, and no line is moved
    assert out.filter("matches = id % 40 + 1").count() == 200


def test_search_summary_of_a_long_output(spark):
    lines = "transform(sequence(0, 119999), k -> concat('src/f', k % 40000, '.py:', k, ': ', if(k % 1000 = 7, 'grep: x', 'hit')))"
    row = timed(summaries.search_summary(spark.sql(f"select 1L as id, concat_ws('\n', {lines}) as text")))[0]
    assert row["matches"] == N and row["kept"] > 0
    assert f"... {N - row['kept']} more match(es) across 40000 file(s)" in row["text"] and row["text"].startswith(f"{N} matches in 40000 file(s)\nsrc/f0.py:0: hit\n")
    assert "matches by file: src/f0.py×3, src/f1.py×3, " in row["text"] and ", +39988 more file(s)" in row["text"]
