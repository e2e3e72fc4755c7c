"""Small cases of the journal and reduction operators."""

import pytest

from turnledger.operators import evidence, reduction
from turnledger.sources.transcripts import require_version


def test_read_versions(spark):
    rows = [(1, "read", "a", "a", True), (2, "read", "a", "b", True), (3, "read", None, "a", False), (4, "edit", "a", "a", True), (5, "edit", "a", "b", False), (6, "edit", "a", None, False)]
    got = {r.seq: tuple(r)[1:] for r in evidence.read_versions(spark.createDataFrame(rows, "seq long, kind string, pre string, post string, success boolean")).collect()}
    assert got == {1: ("a", "stable", None, "success"), 2: (None, "raced", None, "success"), 3: (None, "unverified", None, "failed"), 5: ("a", "stable", "verified_change", "failed_partial"), 6: ("a", "unverified", "unverified", "failed_uncertain")}


def test_search_keeps_diagnostics_and_prefers_scored_files(spark):
    text = "\n".join([f"src/a.py:{k}: " + "x" * 30 for k in range(20)] + ["grep: secret: Permission denied", "src/b.py:1: wanted"])
    out = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    plain = reduction.reduce_search(out, 40).collect()
    assert [r.id for r in plain] == [1]
    assert "Permission denied" in plain[0].reduced and "wanted" not in plain[0].reduced and (plain[0].matches, plain[0].files, plain[0].diagnostics) == (21, 2, 1)
    scored = reduction.reduce_search(out, 40, scores=spark.createDataFrame([("src/b.py", 0.9)], "path string, score double")).collect()[0]
    assert "wanted" in scored.reduced and "Permission denied" in scored.reduced


def test_path_scores_at_component_boundaries(spark):
    scores = spark.createDataFrame([("/repo/a/foo.py", 0.5), ("b.py", 0.25), ("notfoo.py", 0.9)], "path string, score double")
    asked = spark.createDataFrame([("a/foo.py",), ("x/b.py",), ("foo.py",), ("none.py",)], "path string")
    assert {r.path: r.score for r in evidence.path_scores(scores, asked).collect()} == {"a/foo.py": 0.5, "x/b.py": 0.25, "foo.py": 0.5}


def test_reduce_git(spark):
    text = "commit 1\n+++ b\n--- a\n@@ -1 +1 @@\n+new\n+more\n-old\n same"
    got = {r.id: tuple(r)[1:] for r in evidence.reduce_git(spark.createDataFrame([(1, text), (2, "")], "id long, text string")).collect()}
    assert got == {1: ("commit 1\n+++ b\n--- a\n@@ -1 +1 @@\n[+2 / -1 changed lines]", 2, 1), 2: ("[+0 / -0 changed lines]", 0, 0)}


def test_staleness_counts_only_later_needs(spark):
    objects = spark.createDataFrame([("s", "a", 1, 10), ("s", "b", 2, 10), ("s", "c", 10, 5)], "session string, key string, turn long, size long")
    needs = spark.createDataFrame([("s", "a", 4)], "session string, key string, turn long")
    got = {r.lag: (r.n_retired, r.n_safe, r.tail_gross, r.safe_gross) for r in evidence.staleness_safety(objects, needs, (0, 3)).collect()}
    assert got == {0: (2, 1, 170, 80), 3: (2, 2, 110, 110)}


def test_require_version(spark):
    rows = spark.createDataFrame([("1",), (None,)], "schema_version string")
    assert require_version(rows.filter("schema_version is not null"), "1").count() == 1
    with pytest.raises(Exception, match="unexpected schema version none"):
        require_version(rows, "1").collect()
