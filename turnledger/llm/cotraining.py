"""Quality scores by co-training two views.

One view reads the content (hashed words), the other never does: it has only metadata columns (source, language, recorded size).
Each view's classifier labels the unlabelled rows it is surest of, and the other view learns from them in the next round; both
are then calibrated on labelled rows neither of them saw, and their log-odds, less the one prior that both hold, add up to the score. Labelled rows are a bounded sample;
all other documents are the unlabelled side. Each round scores all of them on Spark, takes the surest by the histogram of their
log-odds, and learns from sums of gradient and Hessian; few tasks add these up, so only models and a bounded number of sums reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.text import Learned, held_out, release
from turnledger.session import stored

#: Labelled rows that fitting uses at most (an evenly hashed part beyond); the unlabelled side is all other rows.
LABELLED = 6_000
#: Rounds, the part of the unlabelled rows that a view labels in each, and Newton steps over all rows in each.
ROUNDS, PART, STEPS = 4, 0.05, 3
#: Tasks that add up the sums of all others; so many rows reach the driver.
SUMMING = 16
#: Bins of log-odds from -30 to 30, and the calibrated log-odds from which a row can be labelled (19 to 1).
BINS, SURE = 6_000, 2.94
CONTENT, META = 256, 72
SYMBOL = re.compile(r"[^\w\s]")


def bucket(word: str) -> int:
    return crc32(word.encode()) % (CONTENT - 8)


def content_view(text: str, buckets: Learned) -> np.ndarray:
    words = text.lower().split()
    out = np.zeros(CONTENT, dtype=np.float32)
    n = len(words)
    if n:
        counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=n), minlength=CONTENT - 8)
        out[: CONTENT - 8] = np.log1p(counts) / np.log1p(n)
        distinct = len(set(words))
        symbols = len(SYMBOL.findall(text))
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        out[CONTENT - 8 :] = [distinct / n, repeats / n, symbols / len(text), np.log1p(n) / 10, sum(map(len, words)) / n / 20, max(map(len, words)) / 100 if n else 0, sum(w.isalpha() for w in words) / n, sum(c.isdigit() for c in text) / len(text)]
    return out


def meta_view(source: str, lang: str, size: int | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[crc32(("s" + source).encode()) % 40] = 1
    out[40 + crc32(("l" + lang).encode()) % 16] = 1
    if size is not None and size >= 0:
        out[56] = np.log1p(size) / 12
        out[57 + min(14, int(np.log2(size + 1)))] = 1
    return out


def sums(model: tuple, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss."""
    w, mean, scale = model
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))]).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (weight * (p - y)), (z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z


def margin(model: tuple, x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return np.clip(x @ (w[:-1] / scale) + (w[-1] - mean @ (w[:-1] / scale)), -30, 30)


def bins(model: tuple, x: np.ndarray) -> np.ndarray:
    return np.minimum(((margin(model, x) + 30) * (BINS / 60)).astype(np.int64), BINS - 1)


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of log-odds."""
    a = np.array([1.0, 0.0])
    z = np.column_stack([m, np.ones(len(m))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        a -= np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 0.5 * np.eye(2), z.T @ (p - y) + 0.5 * (a - [1, 0]))
    return float(max(a[0], 1e-3)), float(a[1])


def replay(rules: list[tuple], views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows no rule has labelled, and for each view the labels that it learns from (-1: none).

    A rule (teacher, model, low, high) labels what is free: 0 up to bin ``low``, 1 from bin ``high`` on.
    """
    free, marks = np.ones(len(views[0]), dtype=bool), [np.full(len(views[0]), -1) for _ in views]
    for teacher, model, low, high in rules:
        b = bins(model, views[teacher])
        bad, good = free & (b <= low), free & (b >= high)
        marks[1 - teacher][bad], marks[1 - teacher][good] = 0, 1
        free &= ~(bad | good)
    return free, marks


def packed(arrays: list[np.ndarray]) -> list[bytes]:
    """Hessians (the only square arrays) only steer the steps: upper half, single precision."""
    return [(a[np.triu_indices(len(a))].astype(np.float32) if a.ndim == 2 else a).tobytes() for a in arrays]


def loosened(data: list[bytes], sides: list[int]) -> list[np.ndarray]:
    out = []
    for part, side in zip(data, sides):
        if side:
            half = np.zeros((side, side))
            half[np.triu_indices(side)] = np.frombuffer(bytes(part), dtype=np.float32)
            out.append(half + np.triu(half, 1).T)
        else:
            out.append(np.frombuffer(bytes(part), dtype=np.float64))
    return out


def added(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    return b if a is None else [p + q for p, q in zip(a, b)]


def total(pool: DataFrame, work: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums of the arrays that ``work`` makes of each batch of the pool. A task's sums are one row; ``SUMMING`` tasks add the rows of all, and only
    their rows reach the driver. Sums of reruns agree but for the last bits of rounding."""
    kinds = "part int, arrays array<binary>, sides array<int>"

    def row(part: int, out: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(out)], pa.list_(pa.binary())), pa.array([[len(a) if a.ndim == 2 else 0 for a in out]], pa.list_(pa.int32()))], names=["part", "arrays", "sides"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                out = added(out, work(unpacked(b)))
        if out is not None:
            yield row(TaskContext.get().partitionId(), out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for data, sides in zip(b.column("arrays").to_pylist(), b.column("sides").to_pylist()):
                out = added(out, loosened(data, sides))
        if out is not None:
            yield row(TaskContext.get().partitionId(), out)

    rows = pool.mapInArrow(run, kinds).repartition(SUMMING, "part").mapInArrow(add, kinds)
    out = None
    for r in sorted(rows.collect(), key=lambda r: r["part"]):  # at most SUMMING rows
        out = added(out, loosened(r["arrays"], r["sides"]))
    return out


def co_train(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, check: np.ndarray, rounds: int = ROUNDS, part: float = PART, ridge: float = 3.0) -> list[tuple]:
    """Views' models with calibration. ``check`` marks the labelled rows kept for calibration; ``pool`` holds the views of all
    unlabelled rows. Classes weigh the same, and the rows that a view was taught weigh together at most what labelled rows do."""
    own, truth = [v[~check].astype(np.float64) for v in views], y[~check].astype(float)
    n_own, share = len(truth), float(truth.mean())
    moments = lambda vs: [np.array([float(len(vs[0]))])] + [f(v.astype(np.float64)).sum(axis=0) for v in vs for f in (lambda x: x, np.square)]
    found = total(pool, moments)
    every = [p + q for p, q in zip(moments(own), found)] if found else moments(own)
    n_pool = int(found[0][0]) if found else 0
    shapes = []
    for k in range(2):
        mean = every[1 + 2 * k] / every[0][0]
        shapes.append((mean, np.sqrt(np.maximum(every[2 + 2 * k] / every[0][0] - mean**2, 0)) + 1e-2))
    taught = [np.zeros(2), np.zeros(2)]  # rows of each class that each view was taught
    rules: list[tuple] = []

    def weights(k: int) -> tuple[np.ndarray, float]:
        """Weight of a row by class, and what a taught row weighs against a labelled one."""
        less = min(1.0, n_own / max(taught[k].sum(), 1))
        classes = np.array([n_own * (1 - share), n_own * share]) + less * taught[k]
        of_one = min(max(classes[1] / classes.sum(), 1e-3), 1 - 1e-3)
        return np.array([0.5 / (1 - of_one), 0.5 / of_one]), less

    def fitted(models: list[tuple], steps: int) -> list[tuple]:
        for _ in range(steps):
            fixed, by_class = list(rules), [weights(k) for k in range(2)]

            def work(vs: list[np.ndarray], models=models) -> list[np.ndarray]:
                _, marks = replay(fixed, vs)
                on = [m >= 0 for m in marks]
                return [a for k in range(2) for a in sums(models[k], vs[k][on[k]], marks[k][on[k]], by_class[k][1] * by_class[k][0][marks[k][on[k]]])]

            more = total(pool, work) if rules else None
            new, largest = [], 0.0
            for k, model in enumerate(models):
                g, h = sums(model, own[k], truth, by_class[k][0][truth.astype(int)])
                if more:
                    g, h = g + more[2 * k], h + more[2 * k + 1]
                step = np.linalg.solve(h + ridge * np.eye(len(g)), g + ridge * model[0])
                largest = max(largest, float(np.abs(step).max()))
                new.append((model[0] - step, *model[1:]))
            models = new
            if largest < 1e-3:
                break
        return models

    def sure_bins(k: int) -> tuple[int, int]:
        """The last bin of sure 0 and the first of sure 1, by how the view does on rows it never learned from. A view that knows
        nothing is sure of nothing and teaches nothing."""
        a, c = calibrate(margin(models[k], views[k][check]), y[check])
        at = lambda odds: (np.clip((odds - c) / a, -30, 30) + 30) * BINS / 60
        return int(at(-SURE)) - 1, int(at(SURE)) + 1

    models = fitted([(np.zeros(v.shape[1] + 1), *shapes[k]) for k, v in enumerate(own)], 15)
    for _ in range(rounds):
        for teacher in (0, 1):

            def histogram(vs: list[np.ndarray], model=models[teacher], before=list(rules), k=teacher) -> list[np.ndarray]:  # noqa: B006
                free, _ = replay(before, vs)
                return [np.bincount(bins(model, vs[k][free]), minlength=BINS).astype(np.float64)]

            h = (total(pool, histogram) or [np.zeros(BINS)])[0]
            good, bad = max(1, int(part * n_pool * share)), max(1, int(part * n_pool * (1 - share)))
            sure_0, sure_1 = sure_bins(teacher)
            low = min(int(np.searchsorted(np.cumsum(h), bad)), sure_0)
            high = max(BINS - 1 - int(np.searchsorted(np.cumsum(h[::-1]), good)), sure_1)
            new = np.array([h[: max(low + 1, 0)].sum(), h[high:].sum()])
            if new.sum():
                taught[1 - teacher] += new
                rules.append((teacher, models[teacher], low, high))
        models = fitted(models, STEPS)
    prior = float(np.log(y[check].mean() / (1 - y[check].mean())))
    return [(m, calibrate(margin(m, v[check]), y[check]), prior) for m, v in zip(models, views)]


def viewed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    empty = F.lit("")
    have = {c.lower() for c in docs.columns}
    size = F.col("n_chars").try_cast("long") if "n_chars" in have else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), empty).alias("text"), *[(F.coalesce(F.col(c).cast("string"), empty) if c in have else empty).alias(c) for c in ("source", "lang")], size.alias("size"))


def both_views(b: pa.RecordBatch, buckets: Learned) -> tuple[np.ndarray, np.ndarray]:
    texts, *meta = (b.column(c).to_pylist() for c in ("text", "source", "lang", "size"))
    return np.array([content_view(t, buckets) for t in texts]).reshape(-1, CONTENT), np.array([meta_view(*m) for m in zip(*meta)]).reshape(-1, META)


def unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.float32).reshape(-1, k) for c, k in (("content", CONTENT), ("meta", META))]


def view_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and both views, as bytes, of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Learned(bucket)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r.tobytes() for r in v], pa.binary()) for v in both_views(b, buckets)]], names=["doc_id", "content", "meta"])
        release()

    rows = viewed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary, meta binary")


def stored_views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``view_rows`` in the shared folder, for ``fit`` and ``score`` to share."""
    return stored(view_rows(docs, id_col, text_col), "views")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, views: DataFrame | None = None) -> list[tuple] | None:
    """Two calibrated models from at most about ``labelled`` labelled rows and all other rows; None without both labels.
    ``views`` are the stored views of ``docs``, where the caller has them.

    Labels other than 0 and 1 and null ids teach nothing; of conflicting labels of one id the greater counts; rows that share a labelled id all
    have its label. Null and empty texts are viewed as empty, long texts whole; an empty table gives None.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 62)) < int(min(1.0, labelled / max(own.count(), 1)) * (1 << 62)))
    rows = (stored_views(docs, id_col, text_col) if views is None else views).filter("doc_id is not null")
    table = rows.join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id", kind="stable")  # known: at most about ``labelled`` rows
    y = table["y"].to_numpy()
    check = np.arange(len(y)) % 4 == 0
    if len(y) < 8 or len({*y[check].tolist()}) < 2 or len({*y[~check].tolist()}) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(table["doc_id"].tolist()))], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    pool = rows.join(F.broadcast(ids), "doc_id", "left_anti").select("content", "meta")
    return co_train(unpacked(pa.RecordBatch.from_pandas(table[["content", "meta"]], preserve_index=False)), y, pool, check)


def score(docs: DataFrame, models: list[tuple] | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, views: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, content_score, meta_score, score (0 to 1, higher: better), predicted.

    Without a model (too few labels) every score is 0.5. Null and empty texts are scored as empty; repeated rows each for
    themselves; long texts whole. Of other columns, only ``source``, ``lang`` and ``n_chars`` are read, where they exist, as
    metadata (null or unusable: unknown). An empty table gives an empty result. ``views`` are as for ``fit``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [a * margin(m, v) + c for (m, (a, c), _), v in zip(models, unpacked(b))] if models else [np.zeros(b.num_rows)] * 2
            both = odds[0] + odds[1] - (models[0][2] if models else 0)  # each view counts the classes' shares; once is enough
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(1 / (1 + np.exp(-np.clip(o, -30, 30))), pa.float64()) for o in (*odds, both)]], names=["doc_id", "content_score", "meta_score", "score"])

    rows = view_rows(docs, id_col, text_col) if views is None else views
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content_score double, meta_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "meta_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
