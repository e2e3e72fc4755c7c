"""Scoped resolution, anchors by priority and candidate pools on hand-made symbols."""

import pytest

from turnledger.operators import bundles, resolution

SYMBOLS = [
    (1, "pay.Service", "class", "pay", "src/pay.py", 1, 40, "charge validate"), (2, "pay.Service.process", "method", "pay", "src/pay.py", 5, 12, "validate(order) shared_log"), (3, "pay.Service.validate", "method", "pay", "src/pay.py", 14, 20, ""),
    (4, "pay.helper", "function", "pay", "src/pay.py", 42, 50, ""), (5, "a.repo.save", "function", "a.repo", "src/a/repo.py", 1, 5, ""), (6, "b.repo.save", "function", "b.repo", "src/b/repo.py", 1, 9, ""),
    (7, "shared.shared_log", "function", "shared", "src/shared.py", 3, 9, ""), (8, "shared", "module", "shared", "src/shared.py", 1, 30, ""), (9, "pay.Service.process", "test", "pay", "tests/pay.py", 1, 4, ""),
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "id long, qualified string, kind string, module string, path string, start_line int, end_line int, text string")


def test_names_are_looked_up_scope_by_scope(spark, symbols):
    edges = [(2, "pay", "pay.Service", "self.validate", "CALLS", 0.9), (2, "pay", "pay.Service", "helper", "CALLS", 0.9), (2, "pay", "pay.Service", "store.save", "CALLS", 0.8), (2, "pay", "pay.Service", "shared_log", "CALLS", 0.9), (2, "pay", "pay.Service", "requests.get", "IMPORTS", 0.7), (4, "pay", None, "shared.shared_log", "IMPLEMENTS", 0.55), (4, "pay", None, "validate", "TESTED_BY", 1.0), (5, "a.repo", "a", "save", "CALLS", 0.9), (2, "pay", "pay.Service", "pay.Service.process", "CALLS", 1.0)]
    out = resolution.resolve_edges(spark.createDataFrame(edges, "src long, module string, scope string, name string, type string, confidence double"), symbols)
    got = {r["name"]: (r["dst"], r["match"], r["ambiguity"], r["confidence"]) for r in out.collect()}
    assert got == {
        "self.validate": ("3", "scoped", 0, 0.9), "helper": ("4", "scoped", 0, 0.9), "store.save": ("ambiguous:save", "ambiguous", 2, 0.36), "shared_log": ("7", "inferred", 1, 0.81), "requests.get": ("unresolved:get", "unresolved", 0, 0.49),
        "shared.shared_log": ("7", "exact", 0, 0.55), "validate": ("3", "inferred", 1, 0.9), "save": ("5", "scoped", 0, 0.9), "pay.Service.process": ("9", "exact", 0, 1.0),
    }
    depends = {(r["name"], r["soft"]) for r in resolution.with_dependencies(out).filter("type = 'DEPENDS_ON'").collect()}
    assert depends == {("self.validate", False), ("helper", False), ("shared_log", True), ("shared.shared_log", False), ("save", False), ("pay.Service.process", False)}  # no ambiguous or unresolved name, no test
    report = resolution.resolution_report(out, symbols.selectExpr("id", "if(module = 'pay', 'one', 'two') as language")).collect()
    assert sorted((r["language"], r["symbols"], r["edges"], r["ambiguous"]) for r in report) == [("one", 5, 8, 1), ("two", 4, 1, 0)]


ANCHORS = [
    (1, 'Traceback\nFile "/x/y.py", line 9\nFile "/home/u/src/pay.py", line 15, in validate\nError', None, None, (3, "traceback")),
    (2, 'File "/home/src/pay.py", line 999\nsee shared.py:5', None, None, (7, "path_line")),  # the frame is in no symbol
    (3, "", "Service.process", None, (2, "symbol")), (4, "", "save", "b/repo.py", (6, "path_symbol")), (5, "", "save", "nowhere.py", (5, "path_symbol")), (6, "", None, "src/shared.py", (8, "file")),
    (7, "", None, "tests/pay.py", (9, "file")), (8, "the value of shared_log is an error", None, None, (7, "freetext")), (9, "the code of this file returns a value", None, None, (None, "unresolved")), (10, None, None, None, (None, "unresolved")), (11, "", "pay.Service.process", None, (2, "symbol")),
]


def test_the_strongest_signal_that_resolves_wins(spark, symbols):
    texts = resolution.text_signals(spark.createDataFrame([(i, t) for i, t, *_ in ANCHORS], "id long, text string"))
    given = spark.createDataFrame([(i, n, p) for i, _, n, p, _ in ANCHORS], "id long, symbol_name string, given string")
    tasks = texts.join(given, "id").selectExpr("id", "text", "trace_path", "trace_line", "coalesce(given, path) as path", "line", "symbol_name")
    got = {r["id"]: (r["symbol"], r["anchor"]) for r in resolution.resolve_anchors(tasks, symbols).collect()}
    assert got == {i: want for i, *_, want in ANCHORS}
    assert resolution.resolve_anchors(tasks, symbols.limit(0)).filter("anchor <> 'unresolved'").count() == 0


def test_layers_of_a_pool_are_nested(spark, symbols):
    edges = spark.createDataFrame([(2, 4, "CALLS"), (4, 6, "CALLS"), (6, 5, "CALLS"), (9, 2, "TESTED_BY")], "src long, dst long, type string")
    changed = spark.createDataFrame([("src/pay.py", "src/a/repo.py")], "path string, other string")
    anchors = spark.createDataFrame([("t", 2)], "task string, anchor long")
    pools = {layer: {r["id"]: (r["rank"], r["relation"]) for r in resolution.pool_from_sources(anchors, symbols, edges, changed, layer).collect()} for layer in resolution.LAYERS}
    assert pools["structural"] == {4: (1, "structural"), 6: (2, "structural")}
    local = {3: (3, "same_class"), 9: (3, "same_class"), 7: (4, "identifier"), 1: (5, "same_file")}
    assert pools["local"] == pools["structural"] | local
    assert pools["task"] == pools["local"] | {5: (4, "co_change")}


def many_symbols(spark):
    rows = spark.range(600).selectExpr("id", "concat('m', id % 3, '.', if(id % 2 = 0, 'C.', ''), 'f', id % 40) as qualified", "if(id % 2 = 0, 'method', 'function') as kind", "concat('m', id % 3) as module", "concat('p', id % 4) as path", "concat('see f', id % 40, ' f', id * 7 % 40) as text", "(1 + id % 9) * 5 as cost")
    edges = spark.range(600).selectExpr("id as src", "id * 13 % 50 as dst", "if(id % 5 = 0, 'TESTED_BY', 'CALLS') as type")
    return rows, edges, spark.createDataFrame([("p0", "p1"), ("p2", "p3")], "path string, other string")


def test_tasks_with_the_same_anchors_share_one_pool(spark, monkeypatch):
    anchors = spark.range(200).selectExpr("id as task", "explode(if(id % 10 = 0, array(4L, 7L, 4L), array(4L))) as anchor")
    seen = []
    own = resolution.related
    monkeypatch.setattr(resolution, "related", lambda pairs, a: seen.append(a.select("task").distinct().count()) or own(pairs, a))
    out = resolution.pool_from_sources(anchors, *many_symbols(spark)).collect()
    assert seen == [2]  # not 200
    pools = {}
    for r in out:
        pools.setdefault(r["task"], set()).add((r["id"], r["rank"], r["relation"]))
    assert len(pools) == 200 and all(pools[t] == pools[10 if t % 10 == 0 else 1] for t in pools) and pools[10] != pools[1]
    assert {4, 7}.isdisjoint(i for i, *_ in pools[10]) and 4 not in {i for i, *_ in pools[1]}


def test_recall_within_budgets_needs_no_whole_pool(spark):
    symbols, edges, changed = many_symbols(spark)
    anchors = spark.range(60).selectExpr("id as task", "explode(array(id % 12 * 17, id % 4)) as anchor")
    needed = spark.range(900).selectExpr("id % 70 as task", "id * 31 % 650 as id")  # tasks without anchors and ids of no symbol, too
    budgets = (12, 60, 200, 2000)
    whole = resolution.pool_from_sources(anchors, symbols, edges, changed).join(symbols.select("id", "cost"), "id")
    want = bundles.task_recall(needed, whole, budgets)
    got = resolution.pool_recall(needed, anchors, symbols, edges, changed, budgets)
    rows = lambda df: sorted(map(tuple, df.select("task", "budget", "needed", "reachable", "included").collect()))
    assert rows(got) == rows(want) and sum(r[4] for r in rows(got)) > 50


def test_where_the_closest_relation_leaves_no_room_the_others_are_not_asked(spark, monkeypatch):
    symbols, edges, changed = many_symbols(spark)
    anchors = spark.range(60).selectExpr("id as task", "id * 17 % 600 as anchor")
    needed = spark.range(900).selectExpr("id % 60 as task", "id * 31 % 600 as id")
    offered = []
    own = bundles.folded
    monkeypatch.setattr(bundles, "folded", lambda pool, *more: offered.append(pool.count()) or own(pool, *more))
    far = spark.range(600).selectExpr("id as src", "'CALLS' as type", "explode(sequence(0, 60)) as k").selectExpr("src", "(src + 1 + k) % 600 as dst", "type")
    got = resolution.pool_recall(needed, anchors, symbols, far, changed, (5, 100)).collect()
    assert offered[0] > 0 and offered[1] == 0  # each task has symbols of every cost two steps away, which take all of its room
    whole = resolution.pool_from_sources(anchors, symbols, far, changed).join(symbols.select("id", "cost"), "id")
    assert sorted(map(tuple, got)) == sorted(map(tuple, bundles.task_recall(needed, whole, (5, 100)).collect())) and sum(r["included"] for r in got) > 0


def test_relations_of_one_rank_go_by_symbol(spark):
    symbols = spark.createDataFrame([(1, "m.a", "function", "p", "see word", 5), (2, "m.word", "function", "q", "", 5), (3, "m.b", "function", "r", "", 5)], "id long, qualified string, kind string, path string, text string, cost int")
    changed = spark.createDataFrame([("p", "r")], "path string, other string")
    none = spark.createDataFrame([], "src long, dst long, type string")
    anchors, needed = spark.createDataFrame([(7, 1)], "task long, anchor long"), spark.createDataFrame([(7, 2), (7, 3)], "task long, id long")
    got = resolution.pool_recall(needed, anchors, symbols, none, changed, (5, 10)).collect()
    assert sorted((r["budget"], r["reachable"], r["included"]) for r in got) == [(5, 2, 1), (10, 2, 2)]
    got = resolution.pool_recall(needed.filter("id = 2"), anchors, symbols, none, changed, (5,)).collect()
    assert [r["included"] for r in got] == [1]  # named in the text and changed together have one rank, and 2 comes before 3
