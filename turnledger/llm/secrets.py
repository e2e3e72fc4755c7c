"""Secret scan: fixed patterns, plus values in credential context whose guess cost is high.

The guess cost of a value is the least cost, as log10 guesses, over all segmentations into dictionary words (also with digits for
letters), dates, repeats, sequences, keyboard walks and brute-force spans, found by dynamic programming over its characters.
Spans of the last kinds grow by one character (or one unit) from the span before, so the least cost is exact for values of any
length in time linear in the length. Costs end at ``MOST_COST``, far beyond any search; a repeat of more characters than that costs
more for its first copy alone, so every shorter unit is tried and no other can matter.

The dictionary is ranked: frequent parts of passwords, then the words of the corpus by the number of documents that hold them, which
Spark counts over all documents.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.text import id_text, release
from turnledger.operators.runs import numbered
from turnledger.session import stored

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What makes a name a credential's: one of these anywhere in it (``DB_PASSWORD``, ``client_secret``), the short ones as a part of their own.
CREDENTIAL = re.compile(r"password|passwd|passphrase|passcode|pwd|secret|token|credential|(?:api|access|private)[_-]?key|(?<![A-Za-z0-9])(?:pass|auth)(?![A-Za-z0-9])", re.IGNORECASE)
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SIGN = re.compile("[:=]")
VALUE = re.compile(r"\x20*(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;<>]{6,}))")
#: Least log10 guesses of a value that counts as a secret.
LEAST_COST = 9.0
#: Costs are not told apart beyond this.
MOST_COST = 100.0
#: Longest dictionary word, corpus words in the dictionary, and documents that must hold one.
LONGEST_WORD, DICTIONARY, LEAST_DOCS = 24, 50_000, 5
#: What each span costs for being one, and what a repeat's count, a sequence (start, direction, length) and a walk cost.
SPAN, COUNT, SEQUENCE, WALK_START, WALK_STEP = 0.3, 1.5, 2.4, 1.7, 0.5
#: Frequent parts of passwords, most frequent first.
WORDS = (
    "password admin welcome letmein qwerty dragon monkey master login hello secret test user root guest default changeme example token "
    "love princess football baseball sunshine shadow superman batman michael jordan charlie summer winter spring autumn freedom "
    "whatever trustno hunter ranger buster soccer hockey killer george thomas andrew robert daniel jessica ashley nicole pepper ginger "
    "cookie cheese banana orange purple yellow silver golden diamond flower angel devil heaven computer internet server system database "
    "public private access key pass word my your the this that api app web dev prod demo temp foo bar baz dummy sample none null true false placeholder"
).split()
UNLEET = str.maketrans("4@831!05$7", "aabeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEAR: dict[str, set[str]] = {}
for r, row in enumerate(ROWS):
    for k, c in enumerate(row):
        NEAR.setdefault(c, set()).update(x for rr in (r - 1, r, r + 1) if 0 <= rr < len(ROWS) for x in ROWS[rr][max(0, k - 1) : k + 2])
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
YEAR_COST, DATE_COST = 2.1, 4.6


def ranks(words: list[str] = []) -> dict[str, int]:  # noqa: B006
    """The dictionary: the fixed words, then the given ones, by rank from 1."""
    out = {w: i + 1 for i, w in enumerate(WORDS)}
    for w in words:
        out.setdefault(w, len(out) + 1)
    return out


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, least_docs: int = LEAST_DOCS) -> list[str]:
    """The ``most`` words (3 to ``LONGEST_WORD`` letters a-z) that most documents hold, ``least_docs`` at least, in order; of words that equally many
    documents hold the first by letters. Counts cover all documents and are added up before the shuffle; how many words have each count says
    which counts are in whole, and only of the one after them a part is taken, by range partitions. That list, of bounded length, reaches the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"(?<![a-z])([a-z]{{3,{LONGEST_WORD}}})(?![a-z])"), F.lit(1)))
    held = stored(docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs), "words")
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))  # one row for each count that occurs
    counts = held.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto)
    whole = counts.filter(F.col("upto") <= most).agg(F.min("n").alias("least"), F.max("upto").alias("words")).first()
    least, room = whole["least"], most - (whole["words"] or 0)
    kept = held.filter(F.col("n") >= least).collect() if least is not None else []
    split = counts.filter(F.col("upto") > most).agg(F.max("n")).first()[0] if room > 0 else None
    if split is not None:
        kept += numbered(held.filter(F.col("n") == split), "word").filter(F.col("place") < room).collect()
    return [r["word"] for r in sorted(kept, key=lambda r: (-r["n"], r["word"]))]


def alphabet(part: str) -> int:
    return max(10, 26 * any("a" <= c <= "z" for c in part) + 26 * any("A" <= c <= "Z" for c in part) + 10 * any(c.isdigit() for c in part) + 33 * any(not c.isalnum() for c in part))


def word_cost(part: str, dictionary: dict[str, int]) -> float | None:
    """Of a dictionary word, also in capitals or with digits for letters; None of anything else."""
    low = part.lower()
    plain = low.translate(UNLEET)
    rank = dictionary.get(plain)
    if rank is None:
        return None
    cased = 0 if part == low else math.log10(len(part) + 1) if part[0].isupper() else math.log10(2) * len(part)
    return SPAN + math.log10(rank + 1) + cased + (SPAN if plain != low else 0)


def guess_cost(value: str, dictionary: dict[str, int]) -> float:
    """log10 of the guesses, at most ``MOST_COST``; 0 for the empty value."""
    n, low, letter, none = len(value), value.lower(), math.log10(alphabet(value)), math.inf
    if n == 0 or len(low) != n:
        return min(MOST_COST, letter * n)
    best, plain = [0.0] + [none] * n, low.translate(UNLEET)
    units = range(1, min(int(MOST_COST / letter), n // 2) + 1)
    back = max(LONGEST_WORD, 10, 2 * len(units) + 1)  # characters that a span reaches back at most where it begins
    most = len(units)
    same, met = [0] * (most + 1), [0] * (most + 1)  # for each unit, how many characters up to the place ``met`` equal those one unit before
    places: dict[str, deque[int]] = {}  # of each character, among the last ones
    repeat: list[list[float]] = [[none] * u for u in (1, *units)]  # least cost of a repeat of the unit that ends here, by place modulo unit
    rising = falling = walking = none  # least cost of a sequence or walk that ends here
    up = down = walk = 1  # their lengths in characters
    for j in range(1, n + 1):
        cost = best[j - 1] + letter
        c, p = low[j - 1], low[j - 2] if j > 1 else ""
        step = ord(c) - ord(p) if p and c.isalnum() and p.isalnum() else 0
        up, down = (up + 1 if step == 1 else 1), (down + 1 if step == -1 else 1)
        rising = min(rising, best[j - 3] + SPAN + SEQUENCE) if up >= 3 else none
        falling = min(falling, best[j - 3] + SPAN + SEQUENCE) if down >= 3 else none
        walk = walk + 1 if p and c != p and c in NEAR.get(p, ()) else 1
        walking = min(walking + WALK_STEP, best[j - 4] + SPAN + WALK_START + 4 * WALK_STEP) if walk >= 4 else none
        cost = min(cost, rising, falling, walking)
        before = places.setdefault(value[j - 1], deque())
        while before and before[0] < j - most:
            before.popleft()
        for q in reversed(before):
            u = j - q
            if u > 1 and same[1] >= 2 * u - 1 and met[1] == j:
                continue  # one character over and over, which the unit of one covers for less
            same[u], met[u] = same[u] + 1 if met[u] == j - 1 else 1, j
            copies = 3 if u == 1 else 2
            if same[u] >= (copies - 1) * u:
                longer = repeat[u][j % u] if same[u] >= copies * u else none
                repeat[u][j % u] = longer = min(longer, best[j - copies * u] + SPAN + COUNT + letter * u)
                cost = min(cost, longer)
        before.append(j)
        for i in range(max(0, j - LONGEST_WORD), j - 1):
            if plain[i:j] in dictionary:
                cost = min(cost, best[i] + word_cost(value[i:j], dictionary))
        if c.isdigit():
            for i in range(max(0, j - 10), j - 3):
                if DATE.fullmatch(value, i, j):
                    cost = min(cost, best[i] + SPAN + (YEAR_COST if j - i == 4 else DATE_COST))
        best[j] = min(cost, MOST_COST)
        if j % 512 == 0 and best[j] == MOST_COST and min(rising, falling, walking, *best[max(0, j - back) : j], *map(min, repeat)) >= MOST_COST:
            return MOST_COST  # nothing that a longer span could grow from costs less
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each value of six characters or more that is given to a credential: ``name = value`` or ``"name": "value"``.
    Names are read backwards from the sign, so every character is met a bounded number of times."""
    done = 0
    for sign in SIGN.finditer(text):
        at = sign.start()
        if at < done:
            continue
        while at and text[at - 1] == " ":
            at -= 1
        if at and text[at - 1] in "\"'":
            at -= 1
        start = at
        while start and text[start - 1] in NAME:
            start -= 1
        if start < at and CREDENTIAL.search(text, start, at) and (m := VALUE.match(text, sign.end())):
            yield m.span(m.lastindex)
            done = m.end()


def guessed_spans(text: str, dictionary: dict[str, int], least: float = LEAST_COST) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of values in credential context that cost at least ``least``."""
    spans = [(start, 3, end, guess_cost(text[start:end], dictionary)) for start, end in credential_values(text)]
    return [s for s in spans if s[3] >= least]


def named(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COST, words: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_spans, spans, n_guess, most_cost.

    Spans are kind:start:end in code points, by start and kind, comma-joined. Null and empty texts have none; very long texts and
    values are weighed whole; repeated rows are searched each for itself; an empty table gives an empty result; other columns are
    ignored. ``words`` are the ranked words of the dictionary, by default those of ``docs``.
    """
    words = corpus_words(docs, text_col) if words is None else words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = ranks(words)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base, more = base_spans(text), guessed_spans(text, dictionary, least)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), named(base), named(sorted(base + [x[:3] for x in more])), len(more), max((x[3] for x in more), default=0.0)))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_guess", "most_cost"])
        release()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_guess long, most_cost double")
