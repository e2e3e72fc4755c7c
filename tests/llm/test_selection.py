"""Filter audit, importance resampling and mixing against brute force, on small hand-made tables and the smallest test tables."""

import hashlib
import math
import re
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pytest

from turnledger.llm import filter_audit, mixing, queries, resampling
from turnledger.session import ship_package

SF = "/root/testdata/sf0.001"
SPACE = "\\x20\\x09-\\x0D"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ---- op 11

SCHEMA = "doc_id long, text string, lang string, quality int, toxic string, mask int"  # columns that clash with labels and counters
LONG, LOUD = "one two three " * 40, "ABC DEF " * 60
FILES = [
    [(9, LONG, "en", 1, "x", 7), (8, LOUD, "de", 0, "", 0), (7, None, None, 0, "", 0), (5, "a # b", "en", 0, "", 0), (6, "w " * 300_000, "en", 0, "", 0)],
    [(3, LONG, "de", 1, "", 1), (3, LONG, "de", 1, "", 1), (4, "", "en", 0, "", 0), (None, "alone", "en", 0, "", 0), (None, LOUD, "fr", 0, "", 0)],
    [(1, LONG, "en", 0, "", 0), (2, LOUD, "de", 0, "", 0), (2, LOUD, "en", 0, "", 0), (20, LONG, "", 0, "", 0), (None, "alone", None, 0, "", 0)],
]
LABELS = [(1, 1, 0), (3, 1, 1), (9, 0, 1), (7, 1, 0), (2, 0, 0), (2, 1, 0), (100, 1, 1)]


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in docs:
        least[t or ""] = min(least.get(t or "", math.inf), math.inf if i is None else i)
    fails = []
    for i, t, part, *_ in docs:
        t = t or ""
        words = re.findall(f"[^{SPACE}]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (math.inf if i is None else i) > least[t]}
        fails.append((part or "", {c for c in f if f[c]}, i in good, i in toxic))
    out, by_filter = [], {}
    for part in {p for p, *_ in fails}:
        for order in permutations("ABCDE"):
            gone = set()
            for step, c in enumerate(order):
                own = [(k, x) for k, x in enumerate(fails) if x[0] == part]
                here = [(k, x) for k, x in own if c in x[1] and k not in gone]
                redundant = sum(c in x[1] and k in gone for k, x in own)
                gone |= {k for k, _ in here}
                by_filter[part, c] = by_filter.get((part, c), 0) + len(here)
                out.append([part, "".join(order), step + 1, len(own) - len(gone), len(here), redundant, sum(x[1] == {c} for _, x in own), sum(x[2] for _, x in here), sum(x[3] for _, x in here), c])
    return sorted((tuple(r[:-1]) + (by_filter[r[0], r[-1]],) for r in out), key=str)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_takes_back_what_smaller_ids_disprove(spark, tmp_path):
    labels, path = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), str(tmp_path / "docs")
    for k, batch in enumerate(FILES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        if k == 0:
            first = rows(filter_audit.audit_files(spark, path, labels), *COLUMNS)
            assert first == brute_audit(batch, LABELS)
    every = brute_audit([r for b in FILES for r in b], LABELS)
    assert rows(filter_audit.audit_files(spark, path, labels, batches=3), *COLUMNS) == every  # three batches, ids fall from one to the next
    assert rows(filter_audit.audit_files(spark, path, labels, batches=1), *COLUMNS) == every


def test_audit_goes_on_from_its_state(spark, tmp_path):
    """New files change the counters by what they add and take back; what was counted is not read again."""
    labels, path = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), str(tmp_path / "docs")
    seen = []

    def take(batch, number):
        seen.extend(map(tuple, batch.collect()))

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", filter_audit.STATE["spark.sql.streaming.stateStore.providerClass"])
    for batch in FILES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = filter_audit.changes(filter_audit.file_stream(spark, path), labels)
        stream.writeStream.foreachBatch(take).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    total = {}
    for *key, n in seen:
        total[tuple(key)] = total.get(tuple(key), 0) + n
    assert any(n < 0 for *_, n in seen) and min(total.values()) >= 0
    assert sum(total.values()) == sum(map(len, FILES))
    left = spark.createDataFrame([(*k, n) for k, n in total.items() if n], "part string, mask int, good int, toxic int, n long")
    assert rows(filter_audit.report(left), *COLUMNS) == brute_audit([r for b in FILES for r in b], LABELS)


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert filter_audit.audit_files(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- op 12


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return words, [crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(docs, target):
    corpus, aim = np.zeros(10_000, dtype=int), np.zeros(10_000, dtype=int)
    for t in docs:
        np.add.at(corpus, brute_features(t[1])[1], 1)
    for t in target:
        np.add.at(aim, brute_features(t)[1], 1)
    s_all, t_all, out = int(corpus.sum()), int(aim.sum()), []
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(corpus.tolist(), aim.tolist())]
    for i, text in docs:
        words, buckets = brute_features(text)
        weight, h = sum(gain[b] for b in buckets), int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_features_are_crcs_of_their_bytes():
    long = "x" * 70 + " é " + "y" * 300
    for text in ("", "one", "one two", "One-two, THREE four_five", f"{long} a b {long}", "z" * 1_000_000, "word " * 50_000, "日本 語 ÄÖ straße 1 2 3"):
        words, want = brute_features(text)
        n, got = resampling.Features().of(text)
        assert (n, got.tolist()) == (len(words), want)


def test_resampling(spark):
    source = "river stone paper light cloud forest engine window garden silver".split()
    docs = [(k, " ".join(source[(k * 7 + j * j) % 10] for j in range(15 + k % 40))) for k in range(400)]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1]), (1000, None), (1001, ""), (1002, "!!"), (1003, "river " * 20_000)]
    target = ["paper light cloud forest " * 5, None, "", "silver window"]
    table = spark.createDataFrame([(i, t, 0, 1, "s") for i, t in docs], "doc_id long, text string, score int, run int, segment string").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute_resample(docs, target)
    for segment_rows in (1_000_000, 20):
        assert rows(resampling.resample(table, bench, segment_rows=segment_rows)) == want
    assert resampling.resample(table.limit(0), bench).count() == 0
    assert resampling.resample(table, bench.limit(0)).count() == len(docs)


def test_ties_are_parted(spark):
    """All scores equal: splitters and segments then go by id."""
    table = spark.range(1000).selectExpr("cast(id as string) as doc_id", "true as drawable", "7L as score").repartition(5)
    got = resampling.ranked(table, percent=50, segment_rows=50).filter("rank is not null").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(map(str, range(1000)))[:500]
    runs = resampling.sorted_runs(table)
    cuts = resampling.splitters(runs, 1000, 20)
    sizes = [r["count"] for r in resampling.in_segments(runs, cuts).groupBy("segment").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 150


def test_resampling_query(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    assert rows(queries.queries()["op12_resampling"](spark, SF), "doc_id", "n_features", "weight", "score", "rank") == brute_resample(docs, target)


# ---- op 13


def table_of(spark, docs):
    return spark.createDataFrame([(i, t, s, 3, 1.5) for i, t, s in docs], "doc_id long, text string, source string, size int, target double")


def test_targets_reshare_what_full_sources_leave(spark):
    sizes = [("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 0), ("=d", "d", 40), ("=é", "é", 500), ("", None, 90)]
    got = {r["source_key"]: (r["weight"], r["target"]) for r in mixing.source_targets(spark.createDataFrame(sizes, "source_key string, source string, size long")).collect()}
    assert [got[k][0] for k in ("=a", "=b", "=c", "=d", "=é", "")] == [1, 2, 3, 1, 2, 3]  # a null source comes last
    closed, total = {"=a": 30.0, "=c": 0.0, "=d": 120.0, "": 270.0}, 1640
    assert {k: got[k][1] for k in closed} == closed
    assert got["=b"][1] == got["=é"][1] == (total - sum(closed.values())) / 2


@pytest.mark.parametrize("block_rows", [1_000_000, 10])
def test_mixing(spark, block_rows):
    docs = [(k, "w " * (k * 37 % 90), ("hot" if k % 3 == 0 else f"s{k % 5}")) for k in range(300)]
    docs += [(7, "w " * 20, "hot"), (7, "w " * 20, "hot"), (None, "w w", None), (400, None, "s1"), (401, "", None), (402, "word\n" * 3000, "big")]
    mixed = mixing.mix(table_of(spark, docs), block_rows=block_rows).cache()
    got = mixing.taken_words(mixed).collect()
    assert len(got) == len(docs)
    size = lambda t: len(re.findall(f"[^{SPACE}]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(i), size(t), str(s)) for i, t, s in docs)
    total = sum(size(t) for _, t, _ in docs)
    assert sum(r["taken"] for r in got) == total and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= mixing.QUANTUM
    order = sorted(mixed.collect(), key=lambda r: r["position"])
    assert [r["finish"] for r in order if r["words"]] == sorted(r["finish"] for r in order if r["words"])
    at = 0
    for r in order:  # without gaps, in queue order
        assert r["position"] == at
        at += r["words"]
    again = mixing.taken_words(mixing.mix(table_of(spark, docs).repartition(3), block_rows=block_rows)).drop("source")
    assert rows(again) == rows(spark.createDataFrame(got).select("doc_id", "size", "source_size", "target", "taken"))


def test_mixing_of_nothing(spark):
    assert mixing.taken_words(mixing.mix(table_of(spark, [(1, "a", "s")]).limit(0))).count() == 0
    assert [r["taken"] for r in mixing.taken_words(mixing.mix(table_of(spark, [(1, None, "s"), (2, "", None)]))).collect()] == [0, 0]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_mixing"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, got.select(*want.columns).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)
