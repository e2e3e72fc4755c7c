"""The operators on training documents against brute force, on small hand-made tables and the smallest test tables."""

import hashlib
import json
import re
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnledger import session
from turnledger.llm import chat, cotraining, decontaminate, exact_dedup, lengths, line_dedup, near_dedup, packing, queries, secrets, tokens, toxicity
from turnledger.session import ship_package

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, h long, keep_id string"
TEXTS = [(1, "a b  c\nlong line number one\nlong line number one"), (2, "a b c\nlong line number one\nlong line number one"), (3, None), (4, ""), (5, " x "), (5, " x "), (6, "A B c\nLONG line number one "), (None, "short"), (7, "w " * 6000 + "long line number one"), (8, "\n\n")]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_dedup(docs, empty):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    want = []
    for i, t in normal:
        ids = [j for j, u in normal if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert rows(exact_dedup.exact_groups(docs)) == sorted(want, key=str)
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len({t for _, t in normal})


def test_directory_splits(spark):
    entries = spark.range(1000).selectExpr("xxhash64(id) as h").unionByName(spark.range(300).selectExpr("shiftleft(id, 40) as h"))  # the second part shares 15 leading bits
    buckets, depths = exact_dedup.directory(entries, bucket_entries=200)
    found, held = buckets.collect(), {}
    assert len({r["bucket"] for r in found}) == len(found) and 15 <= depths[-1] <= 20
    for h in (r["h"] % 2**64 for r in entries.collect()):
        own = [r["bucket"] for r in found if h >> (64 - r["local_depth"]) == r["prefix"]]
        assert len(own) == 1
        held[own[0]] = held.get(own[0], 0) + 1
    assert max(held.values()) <= 200 and len({r["local_depth"] for r in found}) > 2


def test_index_holds_every_entry(spark, docs):
    index = exact_dedup.build_index(exact_dedup.hashed(docs), bucket_entries=2).collect()
    assert sum(r["n"] for r in index) == len(TEXTS) and len({r["bucket"] for r in index}) > 2
    assert all(r["chain_rows"] == sum(x["n"] for x in index if x["h"] == r["h"]) for r in index)
    assert rows(exact_dedup.exact_groups(docs, bucket_entries=2)) == rows(exact_dedup.exact_groups(docs))
    left = rows(exact_dedup.drop_copies(docs, bucket_entries=2))
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in left}) == len(left) == exact_dedup.exact_groups(docs).select("text_sha256").distinct().count()
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def brute_lines(texts):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip("\x20\t\n\x0b\x0c\r"))
    owner = {}
    for i, t in texts:
        for s in (t or "").split("\n"):
            owner.setdefault(key(s), set()).add(2**63 if i is None else i)
    out = []
    for i, t in texts:
        ls = (t or "").split("\n")
        kept = [s for s in ls if len(key(s)) < 10 or min(owner[key(s)]) == (2**63 if i is None else i)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, empty, batches):
    assert rows(line_dedup.dedup_lines(docs, batches=batches)) == brute_lines(TEXTS)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_with_text_ids(spark):
    texts = [(f"id{i:03d}", f"a line of text {i % 7}\nanother line {i}\nshort") for i in range(40)]
    got = rows(line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id string, text string"), batches=6))
    assert [r[2] for r in got] == [0] * 7 + [1] * 33
    assert got[8] == ("id008", 3, 1, "another line 8\nshort")


def test_text_ids_with_one_beginning_fill_all_batches(spark):
    ids = spark.range(2000).select(F.concat(F.lit("https://example.org/page/"), F.col("id").cast("string")).alias("place")).repartition(5)
    bounds = line_dedup.batch_bounds(ids, 8)
    assert len(bounds) == 7
    at = sorted(r["place"] for r in ids.collect())
    sizes = np.histogram([sum(b < x for b in bounds) for x in at], bins=range(9))[0]
    assert sizes.min() > 100 and sizes.max() < 500


def test_hot_lines_stay_where_they_are(spark, monkeypatch):
    """Lines that many documents hold are joined without a shuffle of them, and the result is that of brute force."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", 20)
    monkeypatch.setattr(line_dedup.beside, "__defaults__", (20,))
    texts = [(i, f"one line in every document\nrare line {i % 50}\nhalf of them have this\nshort" if i % 2 else f"one line in every document\nonly here {i}") for i in range(120)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert rows(line_dedup.dedup_lines(table, batches=3)) == brute_lines(texts)
    own = spark.createDataFrame([(1, k % 3, k) for k in range(90)], "a long, b long, doc long").withColumn("a", F.when(F.col("b") == 0, 1).otherwise(F.col("doc")))
    known = own.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc").alias("owner"))
    joined = line_dedup.beside(own, known, 20)
    assert joined.count() == 90 and "Broadcast" in joined._jdf.queryExecution().executedPlan().toString()


def test_length_histogram(docs, empty):
    tiktoken = queries.vocabulary("byte_bpe_50k.tiktoken")
    found = lengths.encoded_lengths(docs, tiktoken)
    n = sorted(r["length"] for r in found.collect())
    hist = lengths.length_histogram(found)
    for r in hist.collect():
        k = r["encoded_length"]
        assert (r["n_docs"], r["n_at_least"], r["truncated_total"]) == (n.count(k), sum(x >= k for x in n), sum(min(x, k) for x in n))
    assert [tuple(r) for r in lengths.at_limits(hist, [0, 3, 10**6]).collect()] == [(k, sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (0, 3, 10**6)]
    assert tuple(lengths.quantiles(hist, [0.5, 1.0]).first()) == (n[(len(n) + 1) // 2 - 1], n[-1])
    assert lengths.length_histogram(lengths.encoded_lengths(empty, tiktoken)).count() == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path, limit=64).collect()
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4") for _, x in TEXTS]
    want = sorted((str(i), k // 64, k, len(a[k : k + 64]), crc32(a[k : k + 64].tobytes())) for (i, _), a in zip(TEXTS, ids) for k in range(0, len(a), 64))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    check_places(found, 64)
    assert packing.pack_documents(empty, path).count() == 0


def check_places(found, limit):
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit
    return sequences


def test_pack_is_tight():
    random = np.random.default_rng(1)
    n = random.integers(1, 2049, 5000)
    bins, _ = packing.pack(n)
    assert len(set(bins.tolist())) <= 1.01 * n.sum() / 2048 + 2
    for odd in ([], [2048], [1], [2048, 1, 2047, 1025, 1024]):
        assert (packing.pack(np.array(odd, dtype=np.int64))[0] >= 0).all()


def test_word_encoder_equals_library():
    e = queries.packing.word_encoder(queries.vocabulary("word_bpe_49k.json"))
    for t in ["It's DON'T l'été 12½ foo--bar...", "Ünï ſtraße", "a\x1cb", "<|endoftext|> x", "ΑΣ α", "x y", "", "İ i"]:
        assert e.encode([t])[0] == e._whole(t)


def test_word_encoder_asks_each_part_once():
    """The library is asked once for each part within the cache's bound, whatever punctuation follows it; beyond it ids stay right."""
    e = tokens.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    asked, plain = [], e._part
    e._part = lambda part: asked.append(part) or plain(part)
    e.forget()
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(90_000)]
    first, *others = e.encode([" ".join(names), *[" ".join(n + sign for n in names) for sign in ".,"]])
    assert len(asked) == len(set(asked)) == 90_002 and all(len(o) == len(first) + 4 * 90_000 for o in others)
    e.parts.most = 3000
    texts = [r[0] or "" for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]
    assert e.encode(texts) == [e._whole(t) for t in texts] and len(e.parts) < 100


def brute_near(texts, size, percent):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(((texts[i][0], len(sets[i]), min((texts[j][0] for j in range(len(texts)) if group[j] == group[i] and texts[j][0] is not None), default=None)) for i in range(len(texts))), key=str)


def near_texts():
    random = np.random.default_rng(3)
    out = list(TEXTS)
    for g in range(12):
        base = [f"w{x}" for x in random.integers(0, 3000, 60)]
        for k in range(8):
            words = list(base)
            for p in random.integers(0, 60, k):
                words[p] = f"e{random.integers(0, 10**6)}"
            out.append((100 + 10 * g + k, " ".join(words)))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, docs, empty, size):
    texts = near_texts()
    table = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in texts], DOCS)
    found = near_dedup.near_components(table, size=size)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == brute_near(texts, size, 80)
    assert near_dedup.near_components(empty).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    text, other = "one two three four five six seven eight", "quite another text with some words of its own"
    table = spark.createDataFrame([(2, text, 1), (3, text, 2), (3, other, 3), (4, None, 4), (4, None, 5), (None, text + " nine", 6), (None, "alone here", 7)], "doc_id long, text string, lost_h int")
    left = near_dedup.keep_one(table)
    assert left.columns == table.columns
    assert sorted(r["lost_h"] for r in left.collect()) == [1, 3, 4, 5, 7]
    near = [f"w{k}" for k in range(60)]
    close = spark.createDataFrame([(7, " ".join(near), 1), (5, " ".join(near[:-1]), 2), (6, " ".join(near[1:]), 3)], table.schema)
    assert [r["doc_id"] for r in near_dedup.keep_one(close).collect()] == [5]
    assert near_dedup.keep_one(table.limit(0)).count() == 0


def test_chat_round_trip(spark, docs):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    said = [(1, 0, "user", "hi <|end|> \\<|turn|>"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", ""), (2, None, None, None), (None, 3, "assistant", "é\n" * 3000), (1, 2, "<|says|>", "\\\\<")]
    table = spark.createDataFrame([(*r, 1) for r in said], "conv_id long, turn int, role string, text string, ids int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(table, path), path).collect()}
    for c in (1, 2, None):
        own = sorted(((t, r or "", x or "") for i, t, r, x in said if i == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(table.limit(0), path), path).count() == 0
    for t in ("\\", "<", "\\<", "\\\\<\\", "<|end|>"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t).replace("\\<", "")


def test_decontamination(spark, docs, empty):
    passage = " ".join(f"p{k}" for k in range(14))
    items = [(7, passage), (10, "tiny item"), (11, None), (12, "...")]
    texts = [(1, f"x {passage.upper()} y"), (2, "x " + " ".join(f"p{k}" for k in range(9))), (3, "a tiny-item b tiny item"), (4, None), (None, "p3 p4, p5 p6 p7 p8 p9 p10 p11 p12")]
    table = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in texts], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 16, 14, ["7"]), (2, 10, 0, []), (3, 6, 4, ["10"]), (4, 0, 0, []), (None, 10, 10, ["7"])]
    for block in (8_000_000, 50):
        got = decontaminate.matches(table, bench, block_bytes=block)
        assert rows(got.select("doc_id", "n_words", "n_hit", "item_ids")) == sorted(want, key=str)
    assert decontaminate.drop_hit(table, bench, block_bytes=50).count() == 2
    assert decontaminate.drop_hit(table, bench).columns == table.columns and decontaminate.drop_hit(empty, bench).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(table, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_a_task_holds_one_shard_of_the_stored_suffix_arrays(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(decontaminate, "stored", lambda *a, **k: tables.append(session.stored(*a, **k)) or tables[-1])
    docs = spark.range(0, 4, 1, 1).selectExpr("id as doc_id", "concat(repeat(concat(repeat('x', 99), ' '), 30000), 'a b c d', id) as text")  # 3 MB each: a shard of its own
    bench = spark.createDataFrame([(1, "a b c d2")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.matches(docs, bench).filter("n_hit > 0").collect()] == [2]
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in tables[0].inputFiles()]
    assert sum(f.num_rows for f in files) == 4 == sum(f.num_row_groups for f in files)  # sizes in bytes are looked at after a hundred rows only


def brute_matches(text, items, window):
    """Maximal verbatim matches (item, start, start in the item, words)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, out = cut(text), []
    for item, other in ((str(i), cut(t)) for i, t in items):
        need = min(window, len(other))
        for p in range(len(words)):
            for q in range(len(other) if need else 0):
                if p and q and words[p - 1] == other[q - 1]:
                    continue
                n = 0
                while p + n < len(words) and q + n < len(other) and words[p + n] == other[q + n]:
                    n += 1
                if n >= need:
                    out.append((item, p, q, n))
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(8_000_000, 8_000_000), (200, 60)])
def test_longest_matches_equal_brute_force(spark, monkeypatch, shard, block):
    random = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{k}" for k in random.integers(0, 5, n))
    items = [(i, word(int(n))) for i, n in enumerate(random.integers(0, 14, 12))] + [(90, "a b c d e f g h"), (91, "d e f g h i j k l m")]
    texts = [(i, word(int(n))) for i, n in enumerate(random.integers(0, 60, 30))] + [(50, "z a b c d e f g h i j k l m z"), (50, items[3][1] * 3), (51, None), (52, "w1 " * 3000)]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_bytes=block)
    got = sorted((r["doc_id"], r["n_words"], sorted(tuple(m) for m in r["matches"]), r["n_hit"], r["longest"]) for r in found.collect())
    want = []
    for i, t in texts:
        m = brute_matches(t, items, 4)
        want.append((i, len((t or "").split()), m, len({p + k for _, p, _, n in m for k in range(n)}), max((n for *_, n in m), default=0)))
    assert got == sorted(want)
    overlapping = next(r for r in got if r[1] == 15)
    assert overlapping[4] == 10 and overlapping[3] == 13  # two items overlap; neither has more than ten words


@pytest.mark.parametrize(("doc", "item", "found"), [("w " * 1_000_000, "w " * 1_000_000, 1_999_981), ("a b c d e f g " * 70_000, "a b c d e f g " * 70_000, 139_997), ("= " * 1_000_000, "w", 0), ("w" * 1_000_000, "w" * 1_000_000, 1)])
def test_repeated_words_are_not_paired(doc, item, found):
    """Work grows with the matches, not with the pairs of places: seconds, where pairs would be 10^12."""
    import time

    began = time.time()
    hashes = decontaminate.Learned(decontaminate.xxh3_64_intdigest)
    hits = decontaminate.Hits(decontaminate.Shard.of([decontaminate.word_hashes(doc, hashes)]), decontaminate.Items([(1, item)], 10))
    places, _, starts, words = hits.matches()
    assert len(places) == found and (not found or words.max() == min(len(doc.split()), len(item.split())))
    assert hits.hit_words().sum() == (len(doc.split()) if found else 0) and time.time() - began < 20


def test_secrets(spark, docs, empty):
    texts = ["API_KEY = 'abcdefghijkl' x", "token=secret: longvalue12345678", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "x 0123456789abcdef0 y", "password: Password123", "pwd = 'xK9#qLz!72vB'"]
    known = secrets.ranks(["basketball", "correct", "horse", "battery", "staple"])
    cost = lambda v: secrets.guess_cost(v, known)
    found = [secrets.base_spans(t) for t in texts]
    assert [[(s, e) for s, _, e in f] for f in found] == [[(0, 23)], [], [], [(0, 18)], [(2, 19)], [], []]
    assert cost("password123") < 5 < 9 < cost("xK9#qLz!72vB") and cost("qwertyuiop") < 7 and cost("") == 0
    assert cost("20240131") < 6 and cost("basketball") < 3 and cost("correcthorsebatterystaple") < 10
    assert cost("a" * 12) == cost("a" * 128) == cost("a" * 257) < 4 and cost("kqz3wxvym" * 4) == cost("kqz3wxvym" * 40) < 20
    assert [bool(secrets.guessed_spans(t, known)) for t in texts[-2:]] == [False, True]
    assert secrets.find_secrets(docs).count() == len(TEXTS) and secrets.find_secrets(empty).count() == 0


def brute_cost(value, known):
    """The least cost over every segmentation, each part weighed by itself."""
    letter = np.log10(secrets.alphabet(value))

    def part(p):
        low, n = p.lower(), len(p)
        steps = {ord(b) - ord(a) for a, b in zip(low, low[1:])}
        costs = [letter] if n == 1 else []
        if 2 <= n <= secrets.LONGEST_WORD and (w := secrets.word_cost(p, known)) is not None:
            costs.append(w)
        if secrets.DATE.fullmatch(p):
            costs.append(secrets.SPAN + (secrets.YEAR_COST if n == 4 else secrets.DATE_COST))
        if n >= 3 and low.isalnum() and steps in ({1}, {-1}):
            costs.append(secrets.SPAN + secrets.SEQUENCE)
        if n >= 4 and all(b != a and b in secrets.NEAR.get(a, ()) for a, b in zip(low, low[1:])):
            costs.append(secrets.SPAN + secrets.WALK_START + secrets.WALK_STEP * n)
        costs += [secrets.SPAN + secrets.COUNT + letter * u for u in range(1, n // 2 + 1) if n >= 3 and n % u == 0 and p == p[:u] * (n // u)]
        return min(costs, default=float("inf"))

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + part(value[i:j]) for i in range(j)))
    return min(best[-1], secrets.MOST_COST)


def test_guess_cost_equals_exhaustive_segmentation():
    random, known = np.random.default_rng(7), secrets.ranks(["horse", "staple", "abba"])
    pieces = ["ab", "abc123", "qwer4", "Password", "19872024-", "horse", "St4ple", "user0!", "aaaa", "2024-01-31", "zyx", "K#9"]
    for k in range(400):
        value = "".join(random.choice(list(random.choice(pieces))) for _ in range(random.integers(1, 12)))
        value += random.choice(pieces) + value[:3] * int(random.integers(0, 4))
        assert secrets.guess_cost(value, known) == pytest.approx(brute_cost(value, known)), value


KEY = "password|passwd|passphrase|passcode|pwd|secret|token|credential|(?:api|access|private)[_-]?key|(?<![A-Za-z0-9])(?:pass|auth)(?![A-Za-z0-9])"
NAMED = re.compile(f"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*(?:{KEY}))[A-Za-z0-9_-]+[\"']?\\x20*[:=]\\x20*(?:\"([^\"\\s]{{6,}})\"|'([^'\\s]{{6,}})'|([^\\s\"',;<>]{{6,}}))", re.IGNORECASE)


def test_whole_secret_scan_equals_brute_force(spark):
    random = np.random.default_rng(11)
    bits = ["password = 'hunter2hunter2'", "token: K9x_Lq72vBz81mQ", "AKIA" + "Z9" * 8, "deadbeef" * 3, "see the secret: gardening gardening", "api-key=\"é#9kLmn0PQrs\"", "the gardening report\n"]
    bits += ["DB_PASSWORD=Xk9qLw2vTz8R", "client_secret : Xk9qLw2vT", "'user_token': 'Zq8Lm3xYt1w'", "MY_API_KEY=Zq8Lm3xYt1wPq", "x=aws_secret=Zq8Lm3xYt1w", "author: Zq8Lm3xYt1wPq", "basic-auth=Zq8Lm3xYt1wPq", "compass: Zq8Lm3xYt1wPq", "token: x: secretary = Zq8Lm3xYt1wPq"]
    texts = [(i, " ".join(random.choice(bits, int(n)))) for i, n in enumerate(random.integers(0, 9, 40))] + [(99, None), (99, None), (100, "secret=" + "ab" * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = {}
    for _, t in texts:
        for w in set(re.findall(r"(?<![a-z])[a-z]{3,24}(?![a-z])", (t or "").lower())):
            held[w] = held.get(w, 0) + 1
    words = [w for w, n in sorted(held.items(), key=lambda x: (-x[1], x[0])) if n >= 5]
    assert secrets.corpus_words(docs) == words and "gardening" in words
    known, want = secrets.ranks(words), []
    for i, t in texts:
        base, more = secrets.base_spans(t or ""), []
        for m in NAMED.finditer(t or ""):
            v = m[m.lastindex]
            cost = brute_cost(v, known) if len(v) < 60 else secrets.guess_cost(v, known)
            if cost >= secrets.LEAST_COST:
                more.append((m.start(m.lastindex), 3, m.end(m.lastindex)))
        want.append((i, secrets.named(base), secrets.named(sorted(base + more)), len(more)))
    assert rows(secrets.find_secrets(docs).select("doc_id", "base_spans", "spans", "n_guess")) == sorted(want, key=str)


def test_a_dictionary_is_full_where_many_words_are_equally_frequent(spark):
    letters = "abcdefghij"
    words = sorted(f"w{a}{b}" for a in letters for b in letters)
    docs = spark.createDataFrame([(k, " ".join(words) + (" common often" if k < 3 else " common")) for k in range(5)], "doc_id long, text string")
    assert secrets.corpus_words(docs, most=40) == sorted([*words, "common"])[:40]
    assert secrets.corpus_words(docs, most=40, least_docs=2) == sorted([*words, "common"])[:40]
    assert secrets.corpus_words(docs, most=101) == sorted([*words, "common"])
    assert secrets.corpus_words(docs, most=200, least_docs=3) == [*sorted([*words, "common"]), "often"]
    assert secrets.corpus_words(docs, most=50, least_docs=6) == []


@pytest.mark.parametrize("unit", ["=", "_", " ", "\n", "a", "a!", "token:", "token=\"", "word ", "'", "日本", "{", "a_"])
def test_a_megabyte_of_one_thing(unit):
    """Every per-row step takes a text of a million characters within seconds."""
    import time

    text = ("ab" + unit * 1_000_000)[:1_000_000] + "cd"
    encoder, words = tokens.byte_encoder(queries.vocabulary("byte_bpe_50k.tiktoken")), tokens.word_encoder(queries.vocabulary("word_bpe_49k.json"))
    scorer, known = toxicity.Scorer({"idiot": 1.0}, {"hat": 1.0}), secrets.ranks()
    began = time.time()
    assert encoder.decode_bytes(encoder.encode_ordinary(text)).decode() == text
    assert len(words.encode([text])) == 1 and len(scorer.features(text)) == toxicity.FEATURES
    assert secrets.guessed_spans(text, known) == [] or unit == "token:"
    secrets.base_spans(text)
    decontaminate.word_hashes(text, decontaminate.Learned(lambda w: hash(w) % 2**64))
    assert time.time() - began < 20


@pytest.mark.parametrize("space", [" ", "\n", " \n", "\t", "\u3000"])
def test_long_white_space_is_encoded_as_the_pattern_does(space):
    encoder = tokens.byte_encoder(queries.vocabulary("byte_bpe_50k.tiktoken"))
    for n in (9_999, 10_000, 10_001, 50_000):
        run = (space * n)[:n]
        for text in (f"ab{run}cd", f"ab{run}", f"{run}cd!", run, f"x  {run}\ny{run}  z"):
            assert encoder.encode_ordinary(text) == encoder.encoding.encode_ordinary(text)
    assert len(encoder.encode_ordinary(space * 1_000_000)) > 1  # the library's own splitter fails here


def test_core_of_a_part():
    outer = re.compile(r"^[\W_]+|[\W_]+$")
    for part in ("", "a", "!!", "_a_", "a!b", "--it's--", "«é»", "..a..b..", "_", "１", "ª!"):
        assert toxicity.core(part) == outer.sub("", part)


def test_fuzzy_lexicon_equals_brute_force():
    terms = {"idiot": 1.0, "stupid": 2.0, "scum": 3.0}
    lexicon = toxicity.Lexicon(terms, {"lowei": 4.0})

    def near(a, b):
        return a == b or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1

    for w in ["idiot", "idot", "idiiot", "idi0t", "xidiot", "stupidd", "stpuid", "scum", "scun", "loweixyz", "lowe", "", "the"]:
        want = (4.0, 0) if w.startswith("lowei") else (terms[w], 0) if w in terms else next(((v, 1) for t, v in terms.items() if len(t) >= 5 and near(w, t)), None)
        assert lexicon.match(w) == want, w


def test_scorer_sees_disguised_words_and_long_quotations():
    terms = {"idiot": 1.0, "stupid": 2.0, "scum": 3.0}
    scorer = toxicity.Scorer(terms, {})
    weight = lambda t: round(np.expm1(scorer.features(t)[0]), 6)
    assert [weight(f"you {w} there") for w in ("idi0t", "(st@pid)!", "sc*m,", "stpuid", "idiot,st@pid", "st.pid", "idiot's")] == [1, 2, 3, 2, 3, 2, 1]
    assert [weight(f"you {w} there") for w in ("scun", "sucm", "s**m", "st@p1d", "2024", "***")] == [0] * 6
    quoted = lambda t: round(np.expm1(scorer.features(t)[5]), 6)
    filler = "word4 " * 60
    assert quoted(f'a "b {filler} idiot c {filler} scum d" e') == 4
    assert quoted(f"a „b {filler} idiot c“ {filler} scum d") == 1
    assert quoted(f'idiot "b c" {filler} scum 5" wide {filler} stupid') == 0
    assert quoted(f'a "b {filler} idiot never closed') == 0

    def near(a, b):
        swaps = any(a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] == b for i in range(len(a) - 1))
        return swaps or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1

    for w in {t[:i] + x + t[j:] for t in ("idiot", "stupid") for i in range(7) for j in range(7) for x in ("", "i", "ut", "pu", "to")}:
        want = (terms[w], 0) if w in terms else next(((v, 1) for t, v in terms.items() if len(t) >= 5 and near(w, t)), None)
        assert scorer.lexicon.match(w) == want, w


def brute_features(text, terms):
    """What the scorer should see, from every term and every word, without automaton, cache or running sums."""

    def look(w):
        if w in terms:
            return terms[w], 0
        near = []
        for t, weight in terms.items():
            same = len(w) == len(t) and sum(a != b for a, b in zip(w, t))
            if len(t) < 5:
                mask = [a for a, b in zip(w, t) if a != b] if len(w) == len(t) else []
                if len(mask) == 1 and not mask[0].isalpha() and mask[0] not in "'’":
                    near.append(weight)
            elif same == 1 or any(w[:i] + w[i + 1 :] == t for i in range(len(w))) or any(t[:i] + t[i + 1 :] == w for i in range(len(t))) or any(t[:i] + t[i + 1] + t[i] + t[i + 2 :] == w for i in range(len(t) - 1)):
                near.append(weight)
        return (max(near), 1) if near else None

    chunks = text.lower().split()
    hits = [(i, h) for i, c in enumerate(chunks) if (h := look(c))]
    if not hits:
        return [0.0] * toxicity.FEATURES
    most = max(sum(w for j, (w, _) in hits if i - 2 * toxicity.CONTEXT <= j <= i) for i, _ in hits)
    quoted = sum(w for i, (w, _) in hits if set(chunks[max(0, i - toxicity.BEFORE) : i]) & toxicity.REPORTING)
    weight, fuzzy = sum(w for _, (w, _) in hits), sum(w for _, (w, d) in hits if d)
    return [np.log1p(weight), np.log1p(len(hits)), np.log1p(len({chunks[i] for i, _ in hits})), np.log1p(most), np.log1p(fuzzy), np.log1p(quoted), 1.0, len(hits) / np.sqrt(len(chunks))]


def test_whole_toxicity_query_equals_brute_force(spark):
    ship_package(spark)
    random, terms = np.random.default_rng(9), {"idiot": 1.5, "stupid": 2.0, "scum": 3.0, "moron": 1.25}
    pool = ["idiot", "idiots", "idoit", "stupd", "scum", "sc*m", "scam", "moron", "morron", "said", "word", "plain", "text", "filler", "and"] + [f"w{k}" for k in range(30)]
    texts = [(i, " ".join(random.choice(pool, int(n)))) for i, n in enumerate(random.integers(0, 200, 60))] + [(70, None), (70, None), (71, ""), (72, "plain text " * 20_000 + "idiot " * 50), (None, "stupid idiot")]
    weights = (np.array([0.5, 0.2, 0.1, 0.4, -0.2, -0.7, 0.3, 0.1, -2.0]), np.full(8, 0.1), np.full(8, 1.5))
    model = toxicity.Model(terms, {}, weights)
    want = []
    for i, t in texts:
        f = np.array(brute_features(t or "", terms))
        score = 1 / (1 + np.exp(-(((f - weights[1]) / weights[2]) @ weights[0][:-1] + weights[0][-1]))) if f[6] else 0.001
        want.append((i, i is not None and crc32(str(i).encode()) % 3 == 1, round(float(score), 9), int(score >= 0.7)))
    got = toxicity.score(spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, score string"), model).collect()
    assert sorted(((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in got), key=str) == sorted(want, key=str)


def brute_lexicon(rows):
    """Terms and stems with their weights from (text, toxic) rows, by counting."""
    pos, neg = {}, {}
    for text, y in rows:
        for w in set(re.findall(r"[^\W\d_]+", text.lower())):
            side = pos if y else neg
            side[w] = side.get(w, 0) + 1
    weight = lambda p, n: np.log((p + 0.5) / (n + 0.5))
    every = {w: (pos.get(w, 0), neg.get(w, 0)) for w in {*pos, *neg}}
    terms = {w: weight(p, n) for w, (p, n) in every.items() if len(w) >= 3 and p >= 4 and p >= 12 * n}
    stems = {}
    for w, (p, n) in every.items():
        for k in range(4, min(7, len(w) - 1) + 1 if len(w) >= 5 else 0):
            a, b, c = stems.get(w[:k], (0, 0, 0))
            stems[w[:k]] = (a + p, b + n, c + (p >= 1))
    return terms, {t: weight(p, n) for t, (p, n, c) in stems.items() if c >= 4 and p >= 10 and p >= 25 * n}


def test_toxicity_is_learned_as_brute_force_does(spark):
    """Which rows teach, the lexicon of each half and of all, and the steps of the logistic model, against plain loops."""
    ship_package(spark)
    random = np.random.default_rng(8)
    plain, foul = "the report was fine today and river stone".split(), ["idiot", "stupid", "scumbag", *[f"lowlif{c}" for c in "abcdefgh"]]

    def text(y):
        words = [str(random.choice(foul)) if y and random.random() < 0.3 else str(random.choice(plain)) for _ in range(random.integers(4, 25))]
        return " ".join(words)

    labelled = [(i, int(random.random() < 0.4)) for i in range(500)]
    docs = [(i, text(y)) for i, y in labelled] + [(1000, "a copy of idiot idiot"), (1001, "a copy of idiot idiot"), (1002, None), (1003, "no label")]
    labels = labelled + [(1000, 1), (1001, 1), (1002, 0), (None, 1), (3, 7), (4, None), (5, 1), (5, 0)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"))

    truth = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and crc32(str(i).encode()) % 3 != 1:
            truth[i] = max(y, truth.get(i, 0))
    first = {}
    for i, t in docs:
        if i in truth:
            key = (t or "", truth[i])
            first[key] = min(i, first.get(key, i))
    half = {r["i"]: r["half"] for r in spark.createDataFrame([(i,) for i in first.values()], "i long").selectExpr("i", "pmod(xxhash64(i, 5), 2) as half").collect()}
    terms, stems = brute_lexicon(first)
    assert model.terms == pytest.approx(terms) and model.stems == pytest.approx(stems) and "idiot" in terms and "lowl" in stems
    scorer = toxicity.Scorer(*brute_lexicon([k for k, i in first.items() if half[i] == 0]))
    rows = sorted((i, scorer.features(t), y) for (t, y), i in first.items() if half[i] == 1)
    x, y = np.array([f for _, f, _ in rows]), [t for *_, t in rows]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = np.zeros(toxicity.FEATURES + 1)
    for _ in range(60):
        g, h = 0.05 * w, 0.05 * np.eye(len(w))
        for f, t in zip(x, y):
            z = np.append((f - mean) / scale, 1.0)
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(z @ w)))))
            g, h = g + (p - t) * z, h + max(p * (1 - p), 1e-6) * np.outer(z, z)
        w = w - np.linalg.solve(h, g)
    for got, want in zip(model.weights, (w, mean, scale)):
        assert got == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_all_unlabelled_rows_teach(spark):
    ship_package(spark)
    good, bad = "alpha beta gamma delta", "one two three four"
    known = [(i, good if i % 2 else bad, f"s{i % 3}", i % 2) for i in range(-400, 0)]
    # source ``rare`` only where the former hashed sample of 6,000 rows did not look; the other rows say nothing
    outside = {r["i"] for r in spark.range(12_000).selectExpr("id as i", "pmod(xxhash64(id, 11), 1000000) as h").filter("h >= 600000").orderBy("i").limit(40).collect()}
    free = [(i, good, "rare", None) if i in outside else (i, "alpha one beta two", f"s{i % 3}", None) for i in range(12_000)]
    table = spark.createDataFrame(known + free, "doc_id long, text string, source string, quality int")
    models = cotraining.fit(table, table.filter("quality is not null").select("doc_id", "quality"))
    place = crc32(b"srare") % 40
    assert place not in {crc32(f"ss{k}".encode()) % 40 for k in range(3)}
    assert models[1][0][0][place] > 0.01


def brute_margin(model, x):
    w, mean, scale = model
    return min(30.0, max(-30.0, sum(float(w[k]) * (float(x[k]) - float(mean[k])) / float(scale[k]) for k in range(len(x))) + float(w[-1])))


def brute_calibration(m, y):
    a = [1.0, 0.0]
    for _ in range(30):
        h, g = np.array([[0.5, 0.0], [0.0, 0.5]]), np.array([0.5 * (a[0] - 1), 0.5 * a[1]])
        for x, t in zip(m, y):
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, a[0] * x + a[1]))))
            z, v = np.array([x, 1.0]), max(p * (1 - p), 1e-6)
            g, h = g + z * (p - t), h + v * np.outer(z, z)
        a = a - np.linalg.solve(h, g)
    return max(float(a[0]), 1e-3), float(a[1])


def brute_co_train(views, y, pool, check):
    """The rounds row by row: every rule is looked up for every row of the pool, and every step adds up single rows."""
    own = [[v[i] for i in range(len(y)) if not check[i]] for v in views]
    truth = [int(t) for i, t in enumerate(y) if not check[i]]
    kept = [[v[i] for i in range(len(y)) if check[i]] for v in views]
    asked, n_own, share = [int(t) for i, t in enumerate(y) if check[i]], len(truth), sum(truth) / len(truth)
    models = []
    for k in range(2):
        every = np.array(own[k] + list(pool[k]), dtype=np.float64)
        models.append([np.zeros(every.shape[1] + 1), every.mean(axis=0), np.sqrt(np.maximum((every**2).mean(axis=0) - every.mean(axis=0) ** 2, 0)) + 1e-2])
    rules, taught = [], [np.zeros(2), np.zeros(2)]
    bin_of = lambda m: min(int((m + 30) * (cotraining.BINS / 60)), cotraining.BINS - 1)

    def mark(i):
        """(view that learns, label) of a row of the pool by the first rule that takes it."""
        for teacher, model, low, high in rules:
            b = bin_of(brute_margin(model, pool[teacher][i]))
            if b <= low or b >= high:
                return 1 - teacher, int(b >= high)
        return None

    def fitted(steps):
        for _ in range(steps):
            marks, largest = [mark(i) for i in range(len(pool[0]))], 0.0
            for k in range(2):
                less = min(1.0, n_own / max(taught[k].sum(), 1))
                classes = np.array([n_own * (1 - share), n_own * share]) + less * taught[k]
                one = min(max(classes[1] / classes.sum(), 1e-3), 1 - 1e-3)
                weigh = [0.5 / (1 - one), 0.5 / one]
                w, mean, scale = models[k]
                rows = [(x, t, weigh[t]) for x, t in zip(own[k], truth)] + [(pool[k][i], m[1], less * weigh[m[1]]) for i, m in enumerate(marks) if m and m[0] == k]
                g, h = 3.0 * w, 3.0 * np.eye(len(w))
                for x, t, c in rows:
                    z = np.append((np.array(x, dtype=np.float64) - mean) / scale, 1.0)
                    p = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(z @ w)))))
                    g, h = g + c * (p - t) * z, h + c * max(p * (1 - p), 1e-5) * np.outer(z, z)
                step = np.linalg.solve(h, g)
                models[k] = [w - step, mean, scale]
                largest = max(largest, float(np.abs(step).max()))
            if largest < 1e-3:
                break

    fitted(15)
    for _ in range(cotraining.ROUNDS):
        for teacher in (0, 1):
            free = sorted(bin_of(brute_margin(models[teacher], pool[teacher][i])) for i in range(len(pool[0])) if mark(i) is None)
            good, bad = max(1, int(cotraining.PART * len(pool[0]) * share)), max(1, int(cotraining.PART * len(pool[0]) * (1 - share)))
            a, c = brute_calibration([brute_margin(models[teacher], x) for x in kept[teacher]], asked)
            at = lambda odds: int((min(30.0, max(-30.0, (odds - c) / a)) + 30) * cotraining.BINS / 60)
            low = min(free[bad - 1] if len(free) >= bad else cotraining.BINS, at(-cotraining.SURE) - 1)
            high = max(free[-good] if len(free) >= good else -1, at(cotraining.SURE) + 1)
            new = np.array([sum(b <= low for b in free), sum(b >= high for b in free)], dtype=float)
            if new.sum():
                taught[1 - teacher] += new
                rules.append((teacher, list(models[teacher]), low, high))
        fitted(cotraining.STEPS)
    prior = float(np.log(np.mean(asked) / (1 - np.mean(asked))))
    return models, [brute_calibration([brute_margin(models[k], x) for x in kept[k]], asked) for k in range(2)], prior


def test_co_training_equals_brute_force(spark, monkeypatch):
    """Views, rules, steps and calibration against plain loops on a small table, whole query included."""
    random = np.random.default_rng(3)
    monkeypatch.setattr(cotraining, "PART", 0.1)
    monkeypatch.setattr(cotraining.co_train, "__defaults__", (cotraining.ROUNDS, 0.1, 3.0))
    words = ["solid careful clear reason proof".split(), "buy cheap click now free".split(), "the of and to in".split()]

    def text(y):
        return " ".join(random.choice(words[2] if random.random() < 0.6 else words[1 - y] if random.random() < 0.85 else words[y]) for _ in range(random.integers(5, 30)))

    quality = [int(random.random() < 0.4) for _ in range(260)]
    table = [(i, text(y), f"s{(y if random.random() < 0.8 else 1 - y) * 3 + i % 2}", "en" if i % 3 else None, i * 7 % 90 if i % 5 else None) for i, y in enumerate(quality)] + [(900, None, None, None, None), (901, "", "s1", "en", 0)]
    labels = [(i, quality[i]) for i in range(120)] + [(3, 1 - quality[3]), (5, None), (7, 4)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    got = {r["doc_id"]: r for r in cotraining.score(docs, cotraining.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()}

    def meta(source, lang, size):
        out = np.zeros(cotraining.META, dtype=np.float32)
        out[crc32(f"s{source or ''}".encode()) % 40] = 1
        out[40 + crc32(f"l{lang or ''}".encode()) % 16] = 1
        if size is not None:
            out[56], out[57 + min(14, int(np.log2(size + 1)))] = np.log1p(size) / 12, 1
        return out

    def content(t):
        out, ws = np.zeros(cotraining.CONTENT, dtype=np.float32), (t or "").lower().split()
        for w in set(ws):
            out[crc32(w.encode()) % (cotraining.CONTENT - 8)] += ws.count(w)
        n = len(ws)
        if n:
            out = (np.log1p(out) / np.log1p(n)).astype(np.float32)
            out[-8:] = [len(set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n, len(re.findall(r"[^\w\s]", t)) / len(t), np.log1p(n) / 10, sum(map(len, ws)) / n / 20, max(map(len, ws)) / 100, sum(w.isalpha() for w in ws) / n, sum(c.isdigit() for c in t) / len(t)]
        return out

    known = {}
    for i, y in labels:
        if y in (0, 1) and crc32(str(i).encode()) % 3 != 1:
            known[i] = max(y, known.get(i, 0))
    own = {i: (content(t), meta(s, la, n)) for i, t, s, la, n in table}
    ids = sorted(known)
    check = [k % 4 == 0 for k in range(len(ids))]
    rest = [own[i] for i in own if i not in known]
    models, calibration, prior = brute_co_train([[own[i][k] for i in ids] for k in (0, 1)], [known[i] for i in ids], [[r[k] for r in rest] for k in (0, 1)], check)
    for i, views in own.items():
        odds = [calibration[k][0] * brute_margin(models[k], views[k]) + calibration[k][1] for k in (0, 1)]
        want = [1 / (1 + np.exp(-o)) for o in (*odds, sum(odds) - prior)]
        assert [got[i]["content_score"], got[i]["meta_score"], got[i]["score"]] == pytest.approx(want, abs=2e-3), i


def test_models_on_held_out_rows(spark, docs, empty):
    ship_package(spark)
    con = duckdb.connect()
    sf = "/root/testdata/sf0.1"
    labels = dict(con.sql(f"select doc_id, (toxic, quality) from '{sf}/labels.parquet'").fetchall())
    for name, k in (("op2_toxicity", 0), ("op9_quality", 1)):
        got = [(r["predicted"], labels[r["doc_id"]][k]) for r in queries.queries()[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        assert sum(p == y for p, y in got) >= 0.98 * len(got), name
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).filter("predicted = 0").count() == len(TEXTS)
    assert cotraining.score(docs, cotraining.fit(docs, none)).count() == len(TEXTS)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_contract_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    found = out.collect()
    check_places(found, 2048)
    con = duckdb.connect()
    texts = dict(con.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    kept = {r["doc_id"] for r in found}
    assert kept and kept <= set(texts)
    assert len({" ".join((texts[i] or "").split()) for i in kept}) == len(kept)


def pipeline_tables(spark, folder):
    """Made-up documents with nulls, repeats, ties, near copies, benchmark passages, toxic texts and clashing columns."""
    random = np.random.default_rng(21)
    word = lambda n: " ".join(f"w{k}" for k in random.integers(0, 2000, n))
    bench = [(1, word(30)), (2, "short item only"), (3, None)]
    docs = [(i, word(int(random.integers(20, 80)))) for i in range(300)]
    docs += [(400 + i, f"{word(30)} vermin filth scum garbage {word(5)}") for i in range(120)]
    docs += [(600 + i, docs[i][1].replace(" ", "  ", 3)) for i in range(20)] + [(5, docs[5][1]), (None, docs[6][1]), (None, word(25)), (700, None), (701, None), (702, ""), (703, "one")]
    docs += [(800 + i, docs[40 + i][1] + f" e{i}") for i in range(20)] + [(830, docs[40][1] + " e0"), (831, word(3000))]
    docs += [(900, f"{word(10)} {bench[0][1]} {word(10)}"), (901, "a short-item only b"), (902, " ".join(bench[0][1].split()[:9]))]
    labels = [(i, 1, int(400 <= i < 520)) for i, _ in docs if i is not None and i < 600]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, i) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, h string, own_0 int, kept long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage against a plain loop, on what the stage before left; packing against the tokenizer. Clean documents stay."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, bench, labels = pipeline_tables(spark, str(tmp_path))
    left, table = docs, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)

    table = stages["toxicity"](spark, table, str(tmp_path))
    left = [(i, t) for i, t in left if i is None or not 400 <= i < 520]
    assert table.columns == columns and ids(table) == sorted(left, key=str)

    table = stages["exact_dedup"](spark, table, str(tmp_path))
    first = {}
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    left = list(first.values())
    assert table.columns == columns
    assert sorted((i is None, i or 0) for i, _ in ids(table)) == sorted((i is None, i or 0) for i, _ in left)

    table = stages["near_dedup"](spark, table, str(tmp_path))
    left = [(i, t) for (i, t), (j, _, c) in zip(sorted(left, key=lambda r: str((r[0], 0))), sorted(brute_near(left, 5, 80), key=lambda r: str((r[0], 0)))) if i == j and (i == c or c is None or not (t or "").split())]
    assert table.columns == columns and sorted(str(i) for i, _ in ids(table)) == sorted(str(i) for i, _ in left)

    table = stages["decontaminate"](spark, table, str(tmp_path))
    left = [(i, t) for i, t in left if not brute_matches(t, bench, 10)]
    assert table.columns == columns and sorted(str(i) for i, _ in ids(table)) == sorted(str(i) for i, _ in left)
    assert 902 in {i for i, _ in left} and not {900, 901, 800, 830, 600, 400} & {i for i, _ in left}

    packed = stages["packing"](spark, table, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in left:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want += [(str(i), k // 2048, min(2048, n - k)) for k in range(0, n, 2048)]
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in packed) == sorted(want)
    check_places(packed, 2048)
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, packed))


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, f"{tmp_path}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
