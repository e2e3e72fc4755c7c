"""Benchmark decontamination with suffix arrays over the training documents.

1. Training documents become shards of bounded size. A task numbers a shard's words, ends every document with a number of its
   own and sorts all suffixes by doubling: the shard's suffix array. The arrays are stored once.
2. Every suffix of every benchmark item is looked up in every shard's array by binary search, word by word, for all suffixes at
   once, until a window of words is matched or nothing is left. Suffixes that begin with the same window share one search.
3. The slots of a window's range are the places that it hits. Windows that follow each other in both texts are one verbatim match:
   only pairs whose windows before differ begin one, and only pairs whose windows after differ end one, so repeated words give as
   many pairs as there are matches. Its length is exact, however long, and it comes with its item and its places in both.

The benchmark goes to the tasks in blocks of bounded size, one after the other; a block is forgotten when its results are stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from turnledger.llm.text import Learned, id_text, release
from turnledger.session import BATCH_ROWS, stored

WINDOW = 10
#: Bytes of benchmark text in one block, and of documents in one shard (one longer document is a shard of its own).
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 4_000_000
#: Rows in a row group of the stored arrays: writers and readers hold a whole one, and a row is a shard.
GROUP_ROWS = 1
#: Bytes of a word, A-Z lower-cased: 0-9, a-z and everything beyond ASCII; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_hashes(text: str, hashes: Learned) -> np.ndarray:
    words = text.encode().translate(WORD_BYTES).split()
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


class Shard:
    """Documents as one array of word numbers. ``vocabulary`` holds the sorted word hashes; a number beyond it ends a document."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, order: np.ndarray, ends: np.ndarray):
        self.vocabulary, self.codes, self.order, self.ends = vocabulary, codes, order, ends

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Shard:
        vocabulary, numbers = np.unique(np.concatenate(texts), return_inverse=True) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        codes = np.empty(int(sizes.sum()) + len(texts), dtype=np.int32)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends] = False
        codes[inside] = numbers
        codes[ends] = len(vocabulary) + np.arange(len(texts))
        return cls(vocabulary, codes, suffix_array(codes), ends)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order. No two suffixes are equal, as each document ends with its own number.

    Suffixes are sorted by one word, then by two, four and so on; only those that are still level with others are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    level = np.concatenate([[True], codes[order][1:] != codes[order][:-1]]) if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(level, np.arange(n), 0))
    k = 1
    while True:
        tied = np.flatnonzero(~(level & np.concatenate([level[1:], [True]])))  # slots that share their rank
        if not len(tied):
            return order.astype(np.int32)
        places = order[tied]
        after = places + k
        both = rank[places] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(both, kind="stable")
        order[tied], both = places[sort], both[sort]
        level[tied] = np.concatenate([[True], both[1:] != both[:-1]])
        starts = np.maximum.accumulate(np.where(level[tied], np.arange(len(tied)), 0))
        rank[order[tied]] = tied[starts]
        k *= 2


class Items:
    """One block of the benchmark as word numbers, and the windows that it looks up. A window belongs to all suffixes that begin with it;
    of an item shorter than a window, the whole item is one, of a kind of its own."""

    def __init__(self, items: list[tuple], window: int):
        hashes = Learned(xxh3_64_intdigest)
        texts = [word_hashes(t, hashes) for _, t in items]
        self.ids, self.window = [i for i, _ in items], window
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.vocabulary, codes = np.unique(np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.kinds = self._kinds()

    def _kinds(self) -> np.ndarray:
        """A number for the window at each suffix, equal where windows are; -1 where the item has too few words left."""
        starts, needs, _ = self.suffixes()
        rank, n = self.codes.astype(np.int64), len(self.codes)
        if not n:
            return np.zeros(0, dtype=np.int32)
        length, ranks = 1, {1: rank}
        while 2 * length <= self.window:  # ranks of 1, 2, 4, ... words, then of any number as two that overlap
            after = np.minimum(np.arange(n) + length, n - 1)
            _, rank = np.unique(rank * n + rank[after], return_inverse=True)
            length *= 2
            ranks[length] = rank
        out = np.full(n, -1, dtype=np.int64)
        for need in np.unique(needs).tolist():
            own = starts[needs == need]
            half = max(k for k in ranks if k <= need)
            _, kind = np.unique(ranks[half][own] * n + ranks[half][own + need - half], return_inverse=True)
            out[own] = kind + out.max() + 1
        return out.astype(np.int32)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, words needed, item) of each suffix that is long enough."""
        needs = np.minimum(self.sizes, self.window)
        count = np.where(needs > 0, self.sizes - needs + 1, 0)
        owner = np.repeat(np.arange(len(self.sizes)), count)
        first = np.cumsum(self.sizes) - self.sizes
        start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return start, needs[owner], owner


def bound(keys: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, above: bool) -> np.ndarray:
    """For each range of slots (their ``keys`` are sorted inside it), the first slot whose key is not below (or is above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_at := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_at] + hi[open_at]) >> 1
        found = keys(middle)
        right = found <= wanted[open_at] if above else found < wanted[open_at]
        lo[open_at[right]] = middle[right] + 1
        hi[open_at[~right]] = middle[~right]
    return lo


class Hits:
    """What a shard and a block share: the kinds of windows that occur, with their ranges of slots."""

    def __init__(self, shard: Shard, items: Items):
        self.shard, self.items = shard, items
        starts, needs, owners = items.suffixes()
        kinds = items.kinds[starts]
        order = np.argsort(kinds, kind="stable")
        self.tests, self.owners, self.test_kinds = starts[order], owners[order], kinds[order]
        every, one = np.unique(self.test_kinds, return_index=True)  # a suffix for each kind
        self.lo, self.hi = self._search(self.tests[one], needs[order][one])
        self.kinds = every[self.hi > self.lo]
        self.lo, self.hi = self.lo[self.hi > self.lo], self.hi[self.hi > self.lo]
        self.doc_first = np.concatenate([[0], shard.ends[:-1] + 1]) if len(shard.ends) else np.zeros(0, dtype=np.int64)

    def _search(self, starts: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of slots whose suffixes begin with the window at each start; empty where none does."""
        shard, items = self.shard, self.items
        at = np.searchsorted(shard.vocabulary, items.vocabulary)
        known = at < len(shard.vocabulary)
        known[known] = shard.vocabulary[at[known]] == items.vocabulary[known]
        numbers, n = np.where(known, at, -1), len(shard.codes)
        low, high = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        # in the order of their words, as the shard has them: neighbours then look at neighbouring slots
        ahead = [numbers[items.codes[np.minimum(starts + d, len(items.codes) - 1)]] for d in range(3)] if len(starts) else []
        alive = np.lexsort(ahead[::-1]) if ahead else np.zeros(0, dtype=np.int64)
        alive = alive[ahead[0][alive] >= 0] if ahead else alive
        depth, lo, hi = 0, None, None
        while len(alive):
            wanted = numbers[items.codes[starts[alive] + depth]]
            if depth:
                keys = lambda slots, d=depth: shard.codes[np.minimum(shard.order[slots] + d, n - 1)]
                lo = bound(keys, lo, hi, wanted, False)
                hi = bound(keys, lo, hi, wanted, True)
            else:
                lo, hi = (np.searchsorted(shard.codes, wanted, side, sorter=shard.order) for side in ("left", "right"))
            depth += 1
            there = (lo < hi) & (wanted >= 0)
            done = there & (needs[alive] == depth)
            low[alive[done]], high[alive[done]] = lo[done], hi[done]
            there &= ~done
            alive, lo, hi = alive[there], lo[there], hi[there]
        return low, high

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, which of the kinds) of each window in the shard, by kind."""
        count = self.hi - self.lo
        slots = np.repeat(self.lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.shard.order[slots].astype(np.int64), np.repeat(np.arange(len(count)), count)

    def hit_words(self) -> np.ndarray:
        """Whether each place of the shard is inside a window."""
        places, which = self.places()
        needs = np.minimum(self.items.sizes[self.owners], self.items.window)[np.searchsorted(self.test_kinds, self.kinds)] if len(self.kinds) else np.zeros(0, dtype=np.int64)
        edge = np.bincount(places, minlength=len(self.shard.codes) + 1) - np.bincount(places + needs[which], minlength=len(self.shard.codes) + 1)
        return np.cumsum(edge)[:-1] > 0

    def matches(self) -> tuple[np.ndarray, ...]:
        """(place, item, place in the item, words) of maximal verbatim matches, by place."""
        places, which = self.places()
        own = np.isin(self.test_kinds, self.kinds)
        tests, owners, test_which = self.tests[own], self.owners[own], np.searchsorted(self.kinds, self.test_kinds[own])
        in_shard, in_items = np.full(len(self.shard.codes), -1), np.full(len(self.items.codes), -1)
        long = self.items.sizes[owners] >= self.items.window
        in_items[tests[long]] = test_which[long]
        windows = np.isin(which, test_which[long])  # whole short items stand for themselves
        in_shard[places[windows]] = which[windows]
        first = np.cumsum(self.items.sizes) - self.items.sizes
        begin, end = (self._pairs(places, which, tests, test_which, in_shard, in_items, step) for step in (-1, 1))
        whole = self.items.sizes[owners] < self.items.window
        begin, end = ([np.concatenate([p, q]) for p, q in zip(x, self._short(places, which, tests[whole], test_which[whole]))] for x in (begin, end))
        # on one diagonal matches do not overlap, so the first beginning goes with the first end
        parts = []
        for p, t in (begin, end):
            order = np.lexsort([p, p - t])
            parts.append((p[order], t[order]))
        (p, t), (q, _) = parts
        item = np.searchsorted(first, t, "right") - 1
        words = q - p + np.minimum(self.items.sizes[item], self.items.window)
        order = np.lexsort([t, p])
        return p[order], item[order], (t - first[item])[order], words[order]

    def _short(self, places: np.ndarray, which: np.ndarray, tests: np.ndarray, test_which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place and a whole item shorter than a window, which is a match of its own."""
        lo, hi = np.searchsorted(which, test_which, "left"), np.searchsorted(which, test_which, "right")
        count = hi - lo
        return places[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())], np.repeat(tests, count)

    def _pairs(self, places, which, tests, test_which, in_shard, in_items, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place and a suffix with the same window whose neighbours (``step`` places on) do not share one."""

        def grouped(at: np.ndarray, kind: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
            """Positions by (kind, kind of the neighbour), and where each such group begins."""
            keep = inside[at] == kind
            at, kind = at[keep], kind[keep]
            beside = at + step
            there = (beside >= 0) & (beside < len(inside))
            near = np.where(there, inside[np.clip(beside, 0, max(len(inside) - 1, 0))], -1) if len(inside) else np.zeros(0, dtype=np.int64)
            order = np.lexsort([near, kind])
            at, kind, near = at[order], kind[order], near[order]
            new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (near[1:] != near[:-1])])) if len(at) else np.zeros(0, dtype=np.int64)
            return at, kind[new], near[new], new, np.diff(np.concatenate([new, [len(at)]]))

        a, a_kind, a_near, a_at, a_n = grouped(places, which, in_shard)
        b, b_kind, b_near, b_at, b_n = grouped(tests, test_which, in_items)
        lo, hi = np.searchsorted(b_kind, a_kind, "left"), np.searchsorted(b_kind, a_kind, "right")
        count = hi - lo
        x = np.repeat(np.arange(len(a_kind)), count)  # pairs of groups of one kind
        y = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        apart = (a_near[x] != b_near[y]) | (a_near[x] < 0)
        x, y = x[apart], y[apart]
        size = a_n[x] * b_n[y]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x, y = np.repeat(x, size), np.repeat(y, size)
        return a[a_at[x] + k // b_n[y]], b[b_at[y] + k % b_n[y]]


def shards_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, Shard]]:
    """The rows of a task in parts of about ``SHARD_BYTES`` of text, each with its shard."""
    hashes, rows, texts, size = Learned(xxh3_64_intdigest), [], [], 0

    def cut() -> tuple[pa.Table, Shard]:
        return pa.Table.from_batches(rows), Shard.of(texts)

    for b in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for k, text in enumerate(b.column(column)):
            text = text.as_py() or ""
            if texts and size + sizes[k] > SHARD_BYTES:
                rows.append(b.slice(at, k - at))
                yield cut()
                rows, texts, size, at = [], [], 0, k
            size += sizes[k]
            texts.append(word_hashes(text, hashes))
        rows.append(b.slice(at))
    if texts:
        yield cut()
    release()


def suffix_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards: (shard, doc_ids, ends, vocabulary, codes, suffixes), one row each."""
    rows = id_text(docs, id_col, text_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table, s in shards_of(batches, 1):
            ids = table.column("doc_id").combine_chunks()
            data = [pa.array([a.tobytes()], pa.binary()) for a in (s.vocabulary, s.codes, s.order)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([s.ends.tolist()], pa.list_(pa.int64())), *data], names=["shard", "doc_ids", "ends", "vocabulary", "codes", "suffixes"])
            number += 1

    return rows.mapInArrow(build, f"shard long, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>, ends array<long>, vocabulary binary, codes binary, suffixes binary")


def blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in parts of about ``block_bytes``; one is on the driver at a time. Copies of an item count once."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        yield Items([(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)


MATCH, SPAN = "struct<item:string,start:long,item_start:long,words:long>", "struct<start:long,end:long>"


def structs(**columns: np.ndarray | pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """``values``, in the order of their owners, as one list for each of the ``n`` owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def spans_of(hit: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of hit places. Runs end with their document, as its last place is never hit."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def found_in(shards: DataFrame, items: Items) -> DataFrame:
    """(shard, at, doc_id, n_words, items, matches, spans) of each document of the shards; at: its place in the shard."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([str(i) for i in items.ids], pa.string())
        for b in batches:
            for r in range(b.num_rows):
                vocabulary, codes, order = (np.frombuffer(b.column(c)[r].as_py(), dtype=t) for c, t in (("vocabulary", np.uint64), ("codes", np.int32), ("suffixes", np.int32)))
                ids, ends = b.column("doc_ids")[r].values, b.column("ends")[r].values.to_numpy()
                hits, n = Hits(Shard(vocabulary, codes, order, ends), items), len(ends)
                place, item, item_start, words = hits.matches()
                first, doc = hits.doc_first, np.searchsorted(ends, place)
                own = np.unique(doc * max(len(names), 1) + item)
                start, end = spans_of(hits.hit_words(), hits.shard)
                at = np.searchsorted(ends, start)
                columns = {
                    "shard": pa.array(np.full(n, b.column("shard")[r].as_py())), "at": pa.array(np.arange(n), pa.int32()), "doc_id": ids, "n_words": pa.array(ends - first),
                    "items": lists(own // max(len(names), 1), n, names.take(pa.array(own % max(len(names), 1)))),
                    "matches": lists(doc, n, structs(item=names.take(pa.array(item)), start=place - first[doc], item_start=item_start, words=words)),
                    "spans": lists(at, n, structs(start=start - first[at], end=end - first[at])),
                }
                yield from pa.Table.from_pydict(columns).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)
        release()

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(look, f"shard long, at int, doc_id {kind}, n_words long, items array<string>, matches array<{MATCH}>, spans array<{SPAN}>")


def united(parts: DataFrame) -> DataFrame:
    """One row for each document from its rows of all blocks; spans that touch become one."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.names.index("spans")
            start, end, owner = [], [], []
            for k, spans in enumerate(b.column(at)):
                s, e = (spans.values.field(f).to_numpy() for f in (0, 1))
                order = np.argsort(s, kind="stable")
                s, reach = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > reach[:-1]]) if len(s) else np.zeros(0, dtype=bool)
                start.append(s[new])
                end.append(reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] if len(s) else reach)
                owner.append(np.full(len(start[-1]), k))
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
            yield b.set_column(at, "spans", lists(join(owner), b.num_rows, structs(start=join(start), end=join(end))))

    gather = lambda c: F.flatten(F.collect_list(c)).alias(c)
    one = parts.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *map(gather, ("items", "matches", "spans")))
    return one.mapInArrow(unite, one.schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), matches (item, start in the document,
    start in the item, words: maximal verbatim matches of ``window`` words or more, or of a whole shorter item), spans (start
    and end of what they cover, in words), longest (words of the longest match; 0: none).

    A null or empty text has no words. Items without words match nothing; items shorter than ``window`` must occur whole. Repeated
    rows are searched each for itself; very long texts are a shard of their own; other columns are ignored. Without a benchmark
    no document is hit; an empty table gives an empty result.
    """
    shards, parts = stored(suffix_arrays(docs, id_col, text_col), "suffix_arrays", group_rows=GROUP_ROWS), None
    for items in blocks(benchmark, window, item_col, item_text_col, block_bytes):
        part = stored(found_in(shards, items), "matches")
        parts = part if parts is None else parts.unionByName(part)
    one = parts if parts is part else united(parts)  # each block has a row for every document
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return one.select("doc_id", "n_words", size.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("item_ids"), F.array_sort("matches").alias("matches"), "spans", F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"))


def drop_hit(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns and other rows as they were.

    Null and empty texts stay, repeated rows stay or go together, very long texts are a shard of their own, an empty table
    stays empty. The rows are not shuffled: a shard's suffix array is searched where its documents are read. Each block of a
    benchmark over ``block_bytes`` takes what the one before left, from a stored table.
    """
    at, held = docs.columns.index(text_col), None

    def in_block(items: Items):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, shard in shards_of(batches, at):
                hit = np.zeros(len(table), dtype=bool)
                hit[np.searchsorted(shard.ends, Hits(shard, items).places()[0])] = True
                yield from table.filter(pa.array(~hit)).to_batches(max_chunksize=BATCH_ROWS)

        return clean

    for items in blocks(benchmark, window, item_col, item_text_col, block_bytes):
        if held is not None:
            docs = stored(held, "clean")
        held = docs.mapInArrow(in_block(items), docs.schema)
    return held
