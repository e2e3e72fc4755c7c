"""Toxicity scores from a learned lexicon, matched fuzzily, in context.

The lexicon is learned from labelled rows: words (and word beginnings shared by several such words) that toxic documents hold
and others do not. It becomes a trie that is intersected with a Levenshtein automaton of distance one; the product automaton is
built lazily, state by state, so a word costs a few dictionary steps and most words end in the dead state early. Each hit adds
its weight to the window of words around it; hits inside quotations or after a reporting word count apart, so that the
final logistic model can tell quotation from abuse. Words are looked up with the digits and symbols inside them, two swapped
letters are one edit, and short terms may have one letter masked by a digit or symbol. The model learns on one half of the labelled
rows with a lexicon from the other half, so that chance words of the lexicon get no credit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.text import Learned, held_out, id_text, release
from turnledger.session import stored

#: Labelled rows used at most to fit; above it, an evenly hashed part of them.
FIT_ROWS = 16_000
#: Automaton states that a task keeps; beyond them it builds them anew.
STATES = 100_000
THRESHOLD = 0.7
#: Words on either side of a hit that count as its context, and words before it that can report or negate.
CONTEXT, BEFORE = 12, 4
#: Words that report speech.
REPORTING = frozenset("said says wrote called quote quoted quotes quoting word term cited sagte schrieb zitat wort dit écrit citation mot dijo escribió cita palabra".split())
WORD = re.compile(r"[^\W\d_]+")
#: Punctuation that parts words without white space, and what a word begins and ends with.
PARTS, INNER = re.compile(r"[,;:.?…/—–()\[\]{}<>\"“”„«»]+"), re.compile(r"[^\W_]")
QUOTES = frozenset("\"'“”„«»‹›‘’`")
#: Marks that open a quotation that can run over several words, and those that close it.
MARKS, CLOSES = re.compile("[\"“”„«»‹›‘’]"), {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’"}
FEATURES = 8


class Lexicon:
    """Terms and stems with weights, as a trie; ``match`` gives (weight, distance) of a word, or None.

    With ``disguises``, two swapped letters are one edit too, and terms shorter than ``fuzzy_from`` match a word that has a digit
    or symbol in place of one letter. States hold pairs of a node and 0 (no edit yet), 1 (edit spent), -1 (mask spent) or the
    letter that must follow to complete a swap.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy_from: int = 5, disguises: bool = False):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem, self.fuzzy, self.short, self.disguises = {}, {}, {}, {}, disguises
        for entries, kind in ((terms, self.term), (stems, self.stem)):
            for entry, weight in entries.items():
                node = 0
                for c in entry:
                    node = self.next[node].get(c) or self._grow(node, c)
                kind[node] = max(weight, kind.get(node, 0))
                if kind is self.term:
                    (self.fuzzy if len(entry) >= fuzzy_from else self.short)[node] = weight
        # only branches with fuzzy terms below them may spend the edit, and only those with short terms the mask
        self.below: set[int] = self._mark(0, self.fuzzy)
        self.masked: set[int] = self._mark(0, self.short) if disguises else set()
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.absorbs: list[tuple[float, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset(self._closed({(0, 0)})))

    def _grow(self, node: int, c: str) -> int:
        self.next.append({})
        self.next[node][c] = len(self.next) - 1
        return len(self.next) - 1

    def _mark(self, root: int, ends: dict[int, float]) -> set[int]:
        stack, order, below = [root], [], set()
        while stack:
            order.append(x := stack.pop())
            stack.extend(self.next[x].values())
        for x in reversed(order):
            if x in ends or any(y in below for y in self.next[x].values()):
                below.add(x)
        return below

    def _closed(self, pairs: set[tuple[int, int | str]]) -> set[tuple[int, int | str]]:
        """With the letters that the word may lack."""
        return pairs | {(y, 1) for x, e in pairs if not e for y in self.next[x].values() if y in self.below}

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            exact = [self.term[x] for x, e in pairs if not e and x in self.term]
            near = [self.fuzzy[x] for x, e in pairs if e == 1 and x in self.fuzzy] + [self.short[x] for x, e in pairs if e == -1 and x in self.short]
            self.accepts.append((max(exact), 0) if exact else (max(near), 1) if near else None)
            stems = [self.stem[x] for x, e in pairs if not e and x in self.stem]
            self.absorbs.append((max(stems), 0) if stems else None)
        return self.states[pairs]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int | str]] = set()
        mask = not c.isalpha() and c not in "'’"
        for x, e in self.sets[state]:
            if isinstance(e, str):
                if c == e:
                    out.add((x, 1))
                continue
            if c in self.next[x]:
                y = self.next[x][c]
                if not e or y in (self.below if e == 1 else self.masked):
                    out.add((y, e))
            if not e and x in self.below:
                out.add((x, 1))
                out.update((y, 1) for y in self.next[x].values() if y in self.below)
                if self.disguises:
                    out.update((z, d) for d, y in self.next[x].items() if d != c and (z := self.next[y].get(c)) in self.below)
            if not e and mask and x in self.masked:
                out.update((y, -1) for y in self.next[x].values() if y in self.masked)
        to = self.moves[state][c] = self._state(frozenset(self._closed(out)))
        return to

    def match(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return None
            if self.absorbs[state]:
                return self.absorbs[state]
        return self.accepts[state]


def quotations(chunks: list[str]) -> list[tuple[int, int]]:
    """First and last chunk of each quotation of the text, in order. One that is never closed does not count, so that a stray
    mark hides nothing; a mark right after a letter or digit opens none, and an apostrophe inside a word closes none."""
    out, opened, closing = [], 0, ""
    for i, c in enumerate(chunks):
        if not MARKS.search(c):
            continue
        for m in MARKS.finditer(c):
            k, mark = m.start(), m.group()
            if closing:
                if mark in closing and (mark != "’" or not c[k + 1 : k + 2].isalnum()):
                    out.append((opened, i))
                    closing = ""
            elif mark in CLOSES and not (k and c[k - 1].isalnum()):
                opened, closing = i, CLOSES[mark]
    return out


def core(part: str) -> str:
    """Without the symbols around it. Both ends are found by one scan each, so that long runs of symbols cost no more than others."""
    first = INNER.search(part)
    return part[first.start() : len(part) - INNER.search(part[::-1]).start()] if first else ""


class Scorer:
    """Features of a text. Words are looked up by chunk between white space, in a bounded cache.

    Of a chunk, its runs of letters count; a part between punctuation without such a hit, and then a whole chunk without any, is
    looked up with what stands inside it (``idi0t``, ``sc*m``, ``st.pid``).
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.lexicon, self.found = Lexicon(terms, stems, disguises=True), Learned(self._look, 32 << 20)

    def _hits(self, chunk: str) -> list[tuple[float, int]]:
        if chunk.isalpha():
            return [h] if (h := self.lexicon.match(chunk)) else []
        out = []
        for part in PARTS.split(chunk):
            words = WORD.findall(part)
            hits = [h for w in words if (h := self.lexicon.match(w))]
            inner = core(part)
            if not hits and words and not inner.isalpha() and (h := self.lexicon.match(inner)):
                hits.append(h)
            out += hits
        if not out and (h := self.lexicon.match(core(chunk))):
            out.append(h)
        return out

    def _look(self, chunk: str) -> tuple | None:
        hits = self._hits(chunk)
        return (sum(w for w, _ in hits), sum(w for w, d in hits if d), QUOTES.intersection(chunk)) if hits else None

    def features(self, text: str) -> list[float]:
        chunks = text.lower().split()
        hits = [(i, chunks[i], found) for i, found in enumerate(map(self.found.__getitem__, chunks)) if found]
        if not hits:
            return [0.0] * FEATURES
        spans, at = quotations(chunks) if MARKS.search(text) else [], 0
        quoted = fuzzy = weight = 0.0
        for i, c, (w, near, marks) in hits:
            while at < len(spans) and spans[at][1] < i:
                at += 1
            reported = marks or any(x.strip(",.:;") in REPORTING for x in chunks[max(0, i - BEFORE) : i]) or at < len(spans) and spans[at][0] <= i
            weight += w
            fuzzy += near
            quoted += w if reported else 0
        places, most, lo = [i for i, _, _ in hits], 0.0, 0
        window = 0.0
        for hi, (i, _, (w, _, _)) in enumerate(hits):
            window += w
            while i - places[lo] > 2 * CONTEXT:
                window -= hits[lo][2][0]
                lo += 1
            most = max(most, window)
        distinct = len({c.strip('.,:;!?"') for _, c, _ in hits})
        return [math.log1p(weight), math.log1p(len(hits)), math.log1p(distinct), math.log1p(most), math.log1p(fuzzy), math.log1p(quoted), 1.0, len(hits) / math.sqrt(len(chunks))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps; returns (weights with the intercept last, means, scales)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


class Model:
    def __init__(self, terms: dict[str, float], stems: dict[str, float], weights: tuple | None):
        self.terms, self.stems, self.weights = terms, stems, weights

    def scores(self, features: list[list[float]]) -> np.ndarray:
        if self.weights is None or not features:
            return np.zeros(len(features))
        w, mean, scale = self.weights
        x = np.array(features)
        return np.where(x[:, 6] > 0, 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30))), 0.001)


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems of toxic texts, with their log-odds: all that the counts support. ``rows`` are a bounded sample, which
    bounds what comes back."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), F.lit(1))))
    counts = rows.select("toxic", found.alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    terms = counts.filter("length(word) >= 3 and pos >= 4 and pos >= 12 * neg").collect()
    longer = counts.filter("length(word) >= 5").select("word", "pos", "neg", F.explode(F.sequence(F.lit(4), F.least(F.lit(7), F.length("word") - 1))).alias("k"))
    stems = longer.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("stem")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") >= 1).cast("int")).alias("words"))
    stems = stems.filter("words >= 4 and pos >= 10 and pos >= 25 * neg").collect()
    weight = lambda r: math.log((r["pos"] + 0.5) / (r["neg"] + 0.5))
    return {r["word"]: weight(r) for r in sorted(terms)}, {r["stem"]: weight(r) for r in sorted(stems)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows that are not held out, at most about ``fit_rows`` of them. Without both labels among them,
    the model scores every text 0. Labels other than 0 and 1, and null ids, teach nothing; copies of a text count once for each
    label (under their smallest id), so that chance words in them do not look like evidence. Of conflicting labels of one id the greater counts;
    null texts are empty, long ones are taken whole; an empty table gives a model that scores 0. The sample is stored once, and the
    same rows always give the same model."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(own.count(), 1))
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # own: at most about fit_rows rows
    rows = rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))
    rows = stored(rows, "labelled")
    model = Model(*lexicon(rows.filter("half = 0")), None)
    half = rows.filter("half = 1").select("doc_id", "text", "toxic")
    table = half.mapInArrow(featured(model), "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toPandas().sort_values("doc_id", kind="stable").drop(columns="doc_id")
    if len(table) and 0 < table["toxic"].sum() < len(table):
        model.weights = logistic(table.drop(columns="toxic").to_numpy(), table["toxic"].to_numpy())
        model.terms, model.stems = lexicon(rows)  # the weights hold for a lexicon from all of them
    return model


def featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems)
        for b in batches:
            x = np.array([scorer.features(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *[pa.array(x[:, i]) for i in range(FEATURES)]], names=["doc_id", "toxic", *[f"f{i}" for i in range(FEATURES)]])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score as texts without hits. Very long texts are scored whole. Each row counts for itself, repeated or
    not; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.terms, model.stems)
        for b in batches:
            s = model.scores([scorer.features(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])
        release()

    rows = id_text(docs, id_col, text_col)
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and repeated rows as they were. Null and empty texts have
    no hits and stay, long texts are scored whole, copies of a row stay or go together, an empty table stays empty."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = Scorer(model.terms, model.stems), names.index(text_col)
        for b in batches:
            s = model.scores([scorer.features(t or "") for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s < threshold, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
