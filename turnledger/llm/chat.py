"""Chat formatting at token level.

Every turn is encoded by segments: its role and its text separately, so no token spans a border. Reserved ids, beyond the
vocabulary, stand for the control strings and are spliced between the segments; positions and loss masks come from prefix sums
over the segments' lengths. Control strings that occur inside a text are escaped reversibly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.tokens import byte_encoder

#: Control strings and their reserved ids; the vocabulary ends at 50,255.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
RESERVED = {TURN: 50257, SAYS: 50258, END: 50259}


def escape(text: str) -> str:
    """After this, ``<`` only follows a backslash, so no control string is left."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\<", "<") for p in parts)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_turns(rows: DataFrame, vocabulary: str, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text, ids, lengths, learned): each turn's ids, and its segments' lengths and loss flags in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = byte_encoder(vocabulary).encode_ordinary
        for b in batches:
            ids, lengths, learned = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                segments = [[RESERVED[TURN]], plain(escape(role)), [RESERVED[SAYS]], plain(escape(text)), [RESERVED[END]]]
                ids.append([i for s in segments for i in s])
                lengths.append([len(s) for s in segments])
                learned.append([0, 0, 0, int(role in roles), 0])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, ints) for x in (ids, lengths, learned)]], names=[*b.schema.names, "ids", "lengths", "learned"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(encode, kinds + ", ids array<int>, lengths array<int>, learned array<int>")


def format_turns(conversations: DataFrame, vocabulary: str, roles: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """One row for each turn, each conversation's rows together and in order: conv_id, turn, ids, start (the turn's place in
    its conversation, in ids), loss (start and end of the masked ids inside the turn).

    Turns are ordered by turn, role and text, null turns first, so ties have one defined order; repeated rows are turns of
    their own. A null text or role is empty; a null conv_id is a conversation like another. Turns are encoded before the
    shuffle, and a conversation is streamed afterwards, never held, however long it is; a turn is held whole. An empty table gives an
    empty result. Other columns are ignored.
    """
    encoded = encode_turns(turns(conversations, **columns), vocabulary, roles)
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for b in batches:
            starts, loss = [], []
            for conv, lengths, learned in zip(*(b.column(c).to_pylist() for c in ("conv_id", "lengths", "learned"))):
                ends = np.cumsum(lengths)  # of the segments; the mask follows from these sums
                total = total if conv == last else 0
                last = conv
                starts.append(total)
                total += int(ends[-1])
                at = learned.index(1) if 1 in learned else None
                loss.append({"start": int(ends[at] - lengths[at]), "end": int(ends[at])} if at is not None else None)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("ids"), pa.array(starts, pa.int64()), pa.array(loss, pa.struct([("start", pa.int64()), ("end", pa.int64())]))], names=["conv_id", "turn", "ids", "start", "loss"])

    conv, turn = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return ordered.mapInArrow(assemble, f"conv_id {conv}, turn {turn}, ids array<int>, start long, loss struct<start:long,end:long>")


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``format_turns``'s rows alone: ids are
    decoded, cut at the reserved ids and unescaped. Hashes run along the stream, so a conversation is never held.

    Empty texts and roles add nothing but their line ends; repeated turns count each; a turn is held whole, however long; rows of a null
    conv_id are one conversation; an empty table gives an empty result.
    """
    control = {i: s for s, i in RESERVED.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_encoder(vocabulary).decode_bytes
        state, last = None, None
        out: list[tuple] = []

        def close() -> None:
            if state:
                out.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        conv_type = None
        for b in batches:
            conv_type = b.column("conv_id").type
            for conv, ids, start, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "start", "loss"))):
                if start == 0:
                    close()
                    state, last = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                says = ids.index(RESERVED[SAYS])
                role, text = (decode(part).decode() for part in (ids[1:says], ids[says + 1 : -1]))
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[4] += sum(len(control[i]) for i in (ids[0], ids[says], ids[-1])) + len(role) + len(text)
                if loss:
                    learned = unescape(decode(ids[loss["start"] : loss["end"]]).decode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    conv = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
