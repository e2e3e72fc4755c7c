"""MinHash near-deduplication by a signature-coordinate inverted join.

1. Each document's set of word shingles becomes a signature of ``COORDINATES`` minima. Documents with equal sets are one class
   from here on, so copies are never expanded.
2. Classes are posted under their (coordinate, value) pairs. Two sets at the least similarity agree in far more than
   ``MATCHES`` coordinates (see ``MATCHES``), so it is enough to post each class under its ``COORDINATES - MATCHES + 1`` rarest
   pairs: two classes with that many matches share one of those (prefix skipping). Pairs that only one class has count as
   rarest and need no post.
3. In each list every class is first paired with the most central one only (the one whose coordinates are most shared). Pairs
   whose signatures collide often enough are confirmed on the full sets. That joins a group of thousands by as many pairs.
4. Lists that still hold several components are then compared in full across components, in blocks of classes, with their
   texts at hand: pairs with enough collisions are confirmed where they meet.
5. Components of the confirmed links come from alternating large and small stars over tables in the shared folder.

Everything is keyed joins; hot lists and hot centres are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from turnledger.llm.text import ASCII_LOWER, Learned, id_text, release, split_by_bitmap
from turnledger.session import stored

COORDINATES = 48
#: Sets of similarity 0.8 agree in 38.4 of 48 coordinates on average; fewer than 25 has a chance of about 4 in a million.
MATCHES = 25
#: Classes of one block in full comparisons, and members that one task confirms against a centre.
BLOCK = 800
MEMBERS = 400
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes() -> Learned:
    """Hashes of words, kept by one task."""
    return Learned(xxh3_64_intdigest)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int, hashes: Learned) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``size`` are one shingle; no words, none."""
    words = text.encode().translate(ASCII_LOWER).split()
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(codes))
    if not n:
        return codes
    out = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=1)
def factors() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    return random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each (not empty) set."""
    a, b = factors()
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((joined * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def features(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, n, set_id, signature) of each row of (doc_id, text); h: hash of the text; set_id: 128 bits of the set, null
    without words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            sets = [shingle_set(t, size, hashes) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            ids, sigs = [None] * len(sets), [None] * len(sets)
            for k in range(0, len(full), 64):
                some = full[k : k + 64]
                for i, sig in zip(some, signatures([sets[i] for i in some])):
                    ids[i] = set_identity(sets[i])
                    sigs[i] = sig.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "h", "n", "set_id", "signature"])
        release()

    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, n long, set_id binary, signature binary")


def coordinates(signature: Column) -> Column:
    """The pairs of a signature as longs: the coordinate above, the value below."""
    part = lambda k: F.conv(F.hex(F.substring(signature, 4 * k + 1, 4)), 16, 10).cast("long") + (k << 32)
    return F.array(*[part(k) for k in range(COORDINATES)])


def posts(classes: DataFrame, matches: int) -> DataFrame:
    """(key, nid, central): each class under the rarest of its shared coordinate pairs. The counts are written before they meet the pairs, so that
    both sides of the join are plain shuffles and a hot pair can be split."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("nid").to_numpy(), COORDINATES)), pa.array((sig.astype(np.int64) | high).ravel())], names=["nid", "key"])

    every = classes.select("nid", "signature").mapInArrow(pairs, "nid long, key long")
    shared = stored(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    ranked = every.join(shared, "key").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"))
    room = COORDINATES - matches + 1 - (COORDINATES - F.size("pairs"))
    ranked = ranked.filter(room > 0).select("nid", F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.log1p(p["n"].cast("double"))).alias("central"), F.slice("pairs", F.lit(1), room).alias("pairs"))
    return ranked.select("nid", "central", F.explode("pairs.key").alias("key"))


def colliding(pairs: DataFrame, classes: DataFrame, matches: int, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose set sizes and signatures allow the least similarity."""
    own = classes.select("nid", "n", "signature")
    both = pairs.join(own.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a")), "a").filter("n_a > 0")
    both = both.join(own.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b")), "b")
    both = both.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4").reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= matches))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Pairs come to the texts by centre b, in
    salted parts of about ``MEMBERS``, as one sorted stream: a task holds one centre's set and one member's at a time."""
    parts = pairs.groupBy("b").agg(F.expr(f"cast(ceil(count(*) / {MEMBERS}) as int)").alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.hash("a"), F.col("parts"))).drop("parts")
    need = dealt.select(F.col("a").alias("nid"), "b", "part", F.lit(1).alias("kind")).unionByName(dealt.select(F.col("b").alias("nid"), "b", "part", F.lit(0).alias("kind")).distinct())
    need = stored(need.join(classes.select("nid", "rep", "set_id"), "nid"), "needed")
    rows, _ = split_by_bitmap(rows, F.xxhash64("doc_id"), need, F.xxhash64("rep"))
    texts = need.join(rows, need["rep"].eqNullSafe(rows["doc_id"])).select("b", "part", "kind", "nid", "set_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held, last = None, None, None
        hashes = word_hashes()
        for batch in batches:
            a, b = [], []
            for c, part, kind, nid, set_id, text in zip(*(batch.column(k).to_pylist() for k in ("b", "part", "kind", "nid", "set_id", "text"))):
                if kind and last == (c, part, nid) or not kind and centre == (c, part):
                    continue
                s = shingle_set(text, size, hashes)
                if not len(s) or set_identity(s) != set_id:
                    continue  # another row of the same id
                if not kind:
                    centre, held = (c, part), s
                    continue
                last = (c, part, nid)
                if centre == (c, part) and similar(held, s, percent):
                    a.append(nid)
                    b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return texts.repartition("b", "part").sortWithinPartitions("b", "part", "kind", "nid").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(nid, root): the least node that each linked node reaches, by alternating large and small stars."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "edges")
        if (now := fingerprint(small)) == before:
            return small.select(F.col("u").alias("nid"), F.col("v").alias("root"))
        edges, before = small, now


def fingerprint(edges: DataFrame) -> tuple:
    """Three numbers that tell whether two tables hold the same edges, each once."""
    both = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(both.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def set_identity(s: np.ndarray) -> bytes:
    return int(s.sum()).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mixed(s + MIX_2))).to_bytes(8, "big")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


class Roots(dict):
    """Components within one meeting, joined as links are confirmed."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            x = up
        return x


def across(lists: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int, matches: int) -> DataFrame:
    """Confirmed links (a, b) between different components of one list.

    Pairs whose signatures collide often enough are confirmed on the full sets right where they meet, the most alike first, and
    only while their components are still apart and only in the first list that both are in, so a meeting returns fewer links than it has classes.

    Lists of two are done (their only pair was tried), and of lists with the same classes one is enough. A list's largest
    component is compared with the others only; blocks of about ``BLOCK`` classes meet in one task each.
    """
    open_lists = lists.groupBy("key").agg(F.count("*").alias("all"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("nid").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("nid", F.lit(3))).alias("x"))
    open_lists = open_lists.filter("all > 2 and low <> high").groupBy("all", "s", "x").agg(F.min("key").alias("key")).select("key", "all")
    own = stored(lists.join(open_lists, "key"), "open_lists")
    counts = own.groupBy("key", "root", "all").agg(F.count("*").alias("n"))
    most = counts.groupBy("key", "all").agg(F.max(F.struct("n", "root")).alias("main"))
    blocks = most.select("key", F.col("main.root").alias("main"), F.expr(f"cast(ceil(main.n / {BLOCK}) as int)").alias("main_blocks"), F.expr(f"cast(ceil((all - main.n) / {BLOCK}) as int)").alias("blocks"))
    dealt = own.drop("all").join(blocks, "key")
    outside = F.col("root") != F.col("main")
    block = F.pmod(F.hash("nid"), F.when(outside, F.col("blocks")).otherwise(F.col("main_blocks")))
    dealt = dealt.withColumns({"outside": outside, "block": block})
    meet = lambda both, i, j: F.struct(F.lit(both).alias("both"), i.alias("i"), j.alias("j"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: meet(True, F.least(j, F.col("block")), F.greatest(j, F.col("block"))))
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: meet(False, F.col("block"), j))
    as_main = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: meet(False, i, F.col("block")))
    whole = F.array(meet(True, F.lit(0), F.lit(0)))  # small lists meet once, in one block
    at = F.when((F.col("blocks") == 1) & (F.col("main_blocks") == 1), whole).when(F.col("outside"), F.concat(other, with_main)).otherwise(as_main)
    meets = dealt.select("key", "nid", "root", "outside", F.explode(at).alias("at")).select("key", "nid", "root", "outside", "at.*")
    least = percent / 100
    posted = own.groupBy("nid").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most one for each coordinate
    known = posted.join(classes, "nid").select("nid", "keys", "n", "signature", "set_id", "rep")
    sorts = ("key", "both", "i", "j", "n", "nid")

    def alike(m: Meeting) -> np.ndarray:
        """(collisions, x, y) of the pairs that may be similar and have this list as the first that both are in."""
        found, keys = [], [frozenset(k) for k in m.column("keys")]
        n, root, outside, sig = m.n, m.root, m.outside, m.signatures()
        upto = np.searchsorted(n, np.floor(n / least + 1e-9), side="right")
        step = max(1, 400_000 // (len(n) * COORDINATES))
        for lo in range(0, len(n), step):
            x, y = np.nonzero(np.arange(len(n))[None, :] < upto[lo : lo + step, None])
            x += lo
            free = (x < y) & (root[x] != root[y])
            if not m.both:
                free &= outside[x] != outside[y]
            x, y = x[free], y[free]
            same = (sig[x] == sig[y]).sum(axis=1)
            good = same >= matches
            found.append(np.column_stack([same[good], x[good], y[good]]))
        pairs = np.concatenate(found)
        home = [min(keys[x] & keys[y]) == m.key for _, x, y in pairs.tolist()]
        return pairs[np.array(home, dtype=bool)]

    def involved(m: Meeting) -> pa.Table:
        pairs = alike(m)
        return m.table.take(pa.array(np.unique(pairs[:, 1:]))).select(["key", "nid", "root", "outside", "both", "i", "j"])

    def linked(m: Meeting) -> pa.Table:
        a, b, roots, sets, hashes = [], [], Roots(), {}, word_hashes()
        texts, set_ids = m.column("text"), m.column("set_id")

        def own_set(k: int) -> np.ndarray:
            if k not in sets:
                s = shingle_set(texts[k], size, hashes)
                sets[k] = s if len(s) and set_identity(s) == set_ids[k] else s[:0]  # another row of the same id has no set here
            return sets[k]

        pairs = alike(m)
        for _, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            u, v = roots.find(m.root[x]), roots.find(m.root[y])
            if u != v and similar(own_set(x), own_set(y), percent):
                roots[u] = v
                a.append(m.nid[x])
                b.append(m.nid[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    meets = meets.join(known.drop("set_id", "rep"), "nid").repartition("key", "both", "i", "j").sortWithinPartitions(*sorts)
    again = meets.mapInArrow(streamed(involved), "key long, nid long, root long, outside boolean, both boolean, i int, j int")
    again = stored(again, "involved")  # texts go only to the lists where their pairs are decided
    wanted = stored(known.join(again.select("nid").distinct(), "nid"), "wanted")
    rows, _ = split_by_bitmap(rows, F.xxhash64("doc_id"), wanted, F.xxhash64("rep"))
    texts = wanted.join(rows, F.col("rep").eqNullSafe(rows["doc_id"])).select("nid", "keys", "n", "signature", "set_id", "text")
    return again.join(texts, "nid").repartition("key", "both", "i", "j").sortWithinPartitions(*sorts).mapInArrow(streamed(linked), "a long, b long")


class Meeting:
    """The classes that meet in one block of one list, by size."""

    def __init__(self, table: pa.Table):
        self.table, self.key, self.both = table, table.column("key")[0].as_py(), table.column("both")[0].as_py()
        self.n, self.nid, self.root, self.outside = (table.column(c).to_numpy() for c in ("n", "nid", "root", "outside"))

    def column(self, name: str) -> list:
        return self.table.column(name).to_pylist()

    def signatures(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.column("signature")), dtype="<u4").reshape(-1, COORDINATES)


def streamed(decide):
    """Runs ``decide`` over each meeting of a sorted stream; one meeting is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def ready(table: pa.Table, last: bool) -> tuple[pa.Table, list[pa.Table]]:
            marks = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "both", "i", "j")])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            at, out = 0, []
            for end in [*cuts.tolist(), *([len(marks)] if last else [])]:
                if end - at > 1:
                    out.append(decide(Meeting(table.slice(at, end - at))))
                at = end
            return table.slice(at), out

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rest, out = ready((table if rest is None else pa.concat_tables([rest, table])).combine_chunks(), False)
                yield from (b for t in out for b in t.to_batches())
        if rest is not None and rest.num_rows:
            yield from (b for t in ready(rest, True)[1] for b in t.to_batches())

    return run


def found_components(rows: DataFrame, size: int, percent: int, matches: int) -> DataFrame:
    """(doc_id, h, n, set_id, component_id) of each row of (doc_id, text); component_id is null without words."""
    least = percent / 100
    found = stored(features(rows, size), "features")
    classes = found.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max(F.struct("n", "signature")).alias("s"))
    classes = stored(classes.select("set_id", "rep", "s.n", "s.signature", F.monotonically_increasing_id().alias("nid")), "classes")
    lists = stored(posts(classes, matches), "posts")
    centre = lists.groupBy("key").agg(F.max_by("nid", F.struct("central", "nid")).alias("b"), F.count("*").alias("held")).filter("held > 1").drop("held")
    pairs = lists.join(centre, "key").filter("nid <> b").select(F.greatest("nid", "b").alias("x"), F.least("nid", "b").alias("y"), "nid", "b")
    pairs = pairs.groupBy("x", "y").agg(F.max(F.struct("b", "nid")).alias("p")).select(F.col("p.nid").alias("a"), "p.b")
    tried = stored(colliding(pairs, classes, matches, least), "tried")
    links = stored(confirmed(tried, classes, rows, size, percent), "links")
    roots = components(links)
    rest = lists.join(roots, "nid", "left").select("key", "nid", F.coalesce("root", "nid").alias("root"))
    further = stored(across(rest, classes, rows, size, percent, matches), "further")
    if further.limit(1).count():
        roots = components(further.unionByName(roots.select(F.col("nid").alias("a"), F.col("root").alias("b"))))
    grouped = classes.join(roots, "nid", "left").select("set_id", "rep", F.coalesce("root", "nid").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = grouped.join(lowest, "root").select("set_id", "component_id")
    return found.drop("signature").join(named, "set_id", "left")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of ``size`` words (a
    shorter text is one shingle). Sets are linked from ``percent`` hundredths of similarity; component_id is the smallest
    doc_id reachable. Texts without words, and nulls, are linked with nothing and stay. Rows that share a doc_id are rows of
    their own; a null id never is a component's id unless all its rows have none. Long texts are taken whole, an empty table gives an empty
    result, and other columns are ignored.
    """
    found = found_components(id_text(docs, id_col, text_col), size, percent, matches)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component, all columns as they were.

    What goes is told by id and text together, so rows that share an id are decided each for itself; rows with the same id and
    the same text cannot be told apart and stay or go together, and all rows that carry a component's id stay. Texts without words and nulls stay; null ids go only where
    their component has another id; an empty table gives an empty result. Only rows that a fixed-size bitmap of the lost ones
    names are shuffled.
    """
    found = found_components(id_text(docs, id_col, text_col), size, percent, MATCHES)
    lost = stored(found.filter(F.col("set_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("lost_id"), F.col("h").alias("lost_h")).distinct(), "lost")
    own_h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    maybe, surely_kept = split_by_bitmap(docs, F.xxhash64(F.col(id_col), own_h), lost, F.xxhash64("lost_id", "lost_h"))
    return surely_kept.unionByName(maybe.join(lost, maybe[id_col].eqNullSafe(lost["lost_id"]) & (F.xxhash64(F.coalesce(maybe[text_col], F.lit(""))) == lost["lost_h"]), "left_anti"))
