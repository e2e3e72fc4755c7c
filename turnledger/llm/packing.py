"""Best-fit packing by linear grouping.

Documents become pieces of at most ``limit`` tokens. Pieces are dealt evenly to tasks; each task packs its own share, and
only its last few sequences can be left partly empty. Inside a task, pieces above a size are sorted and put into groups of
equal cardinality, and each counts as its group's largest; the best mix of configurations (multisets of few sizes that fit) is
found by column generation; the configurations are filled with the actual pieces, and those that stay too empty are given up;
the rest goes, longest first, to the fullest sequence that still has room. A share never takes more sequences than best fit alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from turnledger.llm.text import id_text, release
from turnledger.llm.tokens import word_encoder
from turnledger.session import stored

LIMIT = 2048
#: Pieces that one task packs.
SHARE = 60_000
GROUPS = 24
#: Pieces of more than this part of the limit are large.
LARGE = 1 / 8
#: Tokens that a sequence filled by a configuration may leave empty.
SLACK = 1


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut only where it exceeds the limit.
    A null or empty text is the single id 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        encoder.forget()
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(encoder.encode(b.column("text").to_pylist())):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids), 4 * limit):
                    part = ids[k : k + 4 * limit]
                    at.append(i)
                    rows.append((k // (4 * limit), k // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()
        release()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_column(sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: a knapsack over the number of pieces, few as all sizes are large."""
    useful = np.flatnonzero(values > 1e-9)
    best, chosen = np.zeros(limit + 1), []
    for _ in range(limit // int(sizes.min())):
        grown, pick = best.copy(), np.full(limit + 1, -1)
        for g in useful:
            s = sizes[g]
            with_g = best[:-s] + values[g]
            better = with_g > grown[s:] + 1e-12
            grown[s:][better] = with_g[better]
            pick[s:][better] = g
        chosen.append(pick)
        if np.array_equal(grown, best):
            break
        best = grown
    column, room = np.zeros(len(sizes)), limit
    for pick in reversed(chosen):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(values @ column), column


def configurations(sizes: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and amounts of a least-cost mix that holds ``counts`` pieces of each size (amounts are fractions)."""
    basis = np.diag([float(limit // s) for s in sizes])
    amount = counts / np.diag(basis)
    for _ in range(40 * len(sizes)):
        inverse = np.linalg.inv(basis)
        amount = inverse @ counts
        value, column = best_column(sizes, inverse.sum(axis=0), counts, limit)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(amount, 0) / np.where(rising, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis, amount


class Unplaced:
    """Pieces by length; the bits of ``mask`` are the lengths that are left."""

    def __init__(self, lengths: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for i, n in enumerate(lengths.tolist()):
            self.by.setdefault(n, []).append(i)
        self.mask = sum(1 << n for n in self.by)

    def longest(self, room: int) -> int:
        """The greatest length up to ``room``, or -1."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1

    def take(self, n: int) -> int:
        own = self.by[n]
        i = own.pop()
        if not own:
            self.mask ^= 1 << n
        return i

    def give_back(self, i: int, n: int) -> None:
        self.by[n].append(i)
        self.mask |= 1 << n


def planned(lengths: np.ndarray, limit: int, groups: int, large: float) -> list[list[tuple[int, int]]]:
    """The configurations to fill, most used first: for each sequence the (least, greatest) length of each place."""
    big = np.sort(lengths[(lengths > limit * large) & (lengths < limit)])[::-1]
    if len(big) <= groups:
        return []
    cut = [g for g in np.array_split(big, groups)]
    sizes = np.array([g[0] for g in cut])
    basis, amount = configurations(sizes, np.array([len(g) for g in cut], dtype=float), limit)
    out = []
    for j in np.argsort(-amount):
        places = [(int(cut[g][-1]), int(cut[g][0])) for g in range(groups) for _ in range(int(basis[g, j]))]
        out.extend([places] * int(amount[j] + 1e-9))
    return out


def filled(lengths: np.ndarray, limit: int, plan: list[list[tuple[int, int]]], slack: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence numbers, places and the number of sequences, for one plan of configurations."""
    bins, offsets = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left, used = Unplaced(lengths), []  # used: tokens in each sequence

    def place(members: list[int]) -> None:
        at = 0
        for i in members:
            bins[i], offsets[i] = len(used), at
            at += int(lengths[i])
        used.append(at)

    for i in left.by.pop(limit, []):
        place([i])
    left.mask &= (1 << limit) - 1
    for places in plan:
        members, room = [], limit
        for k, (least, greatest) in enumerate(places):
            n = left.longest(room if k == len(places) - 1 else min(room, greatest))
            if n < (1 if k == len(places) - 1 else least):
                break
            members.append(left.take(n))
            room -= n
        while 0 < room and (n := left.longest(room)) > 0 and members:
            members.append(left.take(n))
            room -= n
        if members and room <= slack:
            place(members)
        else:
            for i in members:
                left.give_back(i, int(lengths[i]))
    open_at: dict[int, list[int]] = {}
    mask = 0
    while left.mask:
        n = left.mask.bit_length() - 1
        i = left.take(n)
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask ^= 1 << room
        else:
            room, b = limit, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            open_at.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins, offsets, len(used)


def pack(lengths: np.ndarray, limit: int = LIMIT, groups: int = GROUPS, large: float = LARGE, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to limit) its sequence number and its place in it.

    Each planned configuration takes actual pieces of its groups; its last place goes to the longest piece that fits. A
    sequence that this leaves emptier than the slack gives its pieces back, and best fit places them with the small ones. The plan
    is tried with several slacks, and without any configuration (best fit alone); of these the fewest sequences count, so that
    there are never more than best fit needs. It stops as soon as the lower bound is met.
    """
    least, plan, best = -(-int(lengths.sum()) // limit), planned(lengths, limit, groups, large), None
    for own, room in ((plan, slack), (plan, 0), (plan, 8 * slack), (plan[: len(plan) // 2], slack), ([], 0)):
        found = filled(lengths, limit, own, room)
        if best is None or found[2] < best[2]:
            best = found
        if best[2] <= least:
            break
    return best[0], best[1]


def packed(found: DataFrame, limit: int = LIMIT, share: int = SHARE) -> DataFrame:
    """Adds sequence_id and offset to pieces. ``found`` is read twice: give a stored table."""
    tasks = max(1, math.ceil(found.count() / share))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            table = pa.Table.from_batches(own)
            bins, offsets = pack(table.column("length").to_numpy(), limit)
            first = TaskContext.get().partitionId() << 40
            yield from table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).combine_chunks().to_batches()
        release()

    return found.repartition(tasks).mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and null ids are packed like any other row; a null or empty text is one piece of one token, a very long text
    becomes as many pieces as it needs; an empty table gives an empty result; other columns are ignored. Sequence numbers are unique but not
    dense.
    """
    return packed(stored(pieces(docs, vocabulary, limit, id_col, text_col), "pieces"), limit)
