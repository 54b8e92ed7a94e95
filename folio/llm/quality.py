"""Quality scores: Naive Bayes support vectors over byte n-gram indicators."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.hashing import U64, ascii_words, fmix, segments, shingles, utf8

#: Cells of the feature space: every byte n-gram falls into one of the first HASHED by its hash, every pair of words in a row into
#: one of the next. The last ones are for runs of two to four words by which of them are equal (AA, AB, AAB, ABAB and so on).
HASHED = 1 << 18
EQUAL = {2: 2 * HASHED, 3: 2 * HASHED + 2, 4: 2 * HASHED + 10}
CELLS = 2 * HASHED + 74
#: Orders of the byte n-grams.
ORDERS = (2, 3, 4)
#: At most so many labelled texts of each label are learned from, whole.
PER_LABEL = 3000
#: The score at which a text counts as good; the calibration puts the decision there.
DECISION = 0.3


def equalities(words: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` words a number that says which of them are equal."""
    runs = max(0, len(words) - n + 1)
    out = np.zeros(runs, np.int64)
    for a in range(n):
        for b in range(a + 1, n):
            out = 2 * out + (words[a : a + runs] == words[b : b + runs])
    return out


class Indicators:
    """The sorted cells of all n-grams of a text: of bytes, of words, and of words by which are equal."""

    def __init__(self):
        self.mark = np.zeros(CELLS, bool)
        self.table = (fmix(np.arange(1, 257, dtype=U64)) & U64(0xFFFFFFFF)).astype(np.uint32)
        self.hasher = ascii_words()

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(data):
            for first in range(0, len(data), 1 << 20):
                self.fill(self.table[data[first : first + (1 << 20) + max(ORDERS) - 1]])
            _, _, words, _ = self.hasher.words(np.array([0, len(data)]), data)
            if len(words) > 1:
                self.mark[HASHED + (shingles(words, 2) >> U64(64 - 18)).astype(np.int64)] = True
            for n, cell in EQUAL.items():
                self.mark[cell + np.unique(equalities(words, n))] = True
        cells = np.flatnonzero(self.mark).astype(np.int32)
        self.mark[cells] = False
        return cells

    def fill(self, codes: np.ndarray) -> None:
        state = np.zeros(len(codes), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            state = state[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in ORDERS:
                mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                self.mark[mixed >> np.uint32(32 - 18)] = True


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of each cell's share among the texts of label 1 and of label 0."""
    counts = [np.ones(CELLS), np.ones(CELLS)]
    for row, y in zip(rows, labels, strict=True):
        counts[int(y)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, labels: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last one the bias) of the hinge loss with squared weights; rows hold cells, ``values`` a cell's value."""
    w, alpha, sign = np.zeros(CELLS + 1), np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    norms = np.array([float(values[r] @ values[r]) + 1 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = values[rows[i]]
            gradient = sign[i] * (w[rows[i]] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[rows[i]] += step * sign[i] * x
                w[-1] += step * sign[i]
                moved = max(moved, abs(step) * norms[i])
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float, float]:
    """Weight of each cell, the margin at the decision and the scale of margins.

    Two halves check each other: each is scored by the weights of the other, and the decision goes
    where both labels' shares of errors are equal on those margins.
    """
    each = np.where(labels > 0, (labels == 0).sum(), (labels > 0).sum()) / max(1, len(labels)) * 2 * cost

    def train(part: np.ndarray) -> np.ndarray:
        some = [rows[i] for i in part]
        ratios = log_count_ratios(some, labels[part])
        w = dual_coordinate_descent(some, ratios, labels[part], each[part])
        return np.append(w[:-1] * ratios, w[-1])

    everyone = np.arange(len(rows))
    margins = np.zeros(len(rows))
    for half in (0, 1):
        w = train(everyone[everyone % 2 != half])
        for i in everyone[everyone % 2 == half]:
            margins[i] = w[rows[i]].sum() + w[-1]
    good, bad = np.sort(margins[labels > 0]), np.sort(margins[labels == 0])
    at = np.sort(margins)
    missed, passed = np.searchsorted(good, at) / max(1, len(good)), 1 - np.searchsorted(bad, at) / max(1, len(bad))
    balanced = np.flatnonzero(np.abs(missed - passed) == np.abs(missed - passed).min()) if len(at) else []
    cut = float(np.median(at[balanced])) if len(balanced) else 0.0
    return train(everyone), cut, float(np.std(margins)) or 1.0


def _fit_task(batches):
    mark, rows, labels = Indicators(), [], []
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        labels += batch.column(2).to_pylist()
        rows += [mark(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if len(set(labels)) == 2:
        w, cut, scale = fit(rows, np.array(labels))
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([cut]), pa.array([scale])], ["weights", "cut", "scale"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> tuple[np.ndarray, float, float] | None:
    """A model from at most ``per_label`` labelled texts of each label, those with the least hash of their id.

    The bound holds for every table, so the sample's ids can be broadcast and one task can fit.  Of the
    texts of one id the least by hash is taken, so an id that repeats on many rows is one text.
    Rows of ``labels`` with nulls are left out, and ids with both labels; ``None`` unless both labels occur.
    """
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    clean = clean.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other").drop("_other")
    chosen = None
    for y in (0, 1):
        some = clean.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = texts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("id", "text", "y")
    found = sample.mapInArrow(_fit_task, "weights array<double>, cut double, scale double").first()
    return (np.array(found["weights"]), found["cut"], found["scale"]) if found else None


def _score(batches, model):
    mark = Indicators()
    weights, cut, scale = model.value
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for first, last in segments(offsets):
            margins = np.array([weights[mark(data[a:b])].sum() + weights[-1] for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True)])
            shift = np.log(DECISION / (1 - DECISION))
            score = 1 / (1 + np.exp(-np.clip(3 * (margins - cut) / scale + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(score)], ["record", "score"])


def score_quality(docs: DataFrame, model, text_col: str = "text", carried: Column | None = None) -> DataFrame:
    """(record, score): ``carried`` (all columns, unless given) and a score from 0 to 1; at 0.3 or more a text is good.

    Whole texts; null and empty ones get the bias's score.  Without a model every score is 1.
    """
    carried = F.struct("*") if carried is None else carried
    source = docs.select(carried.alias("record"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return source.select("record", F.lit(1.0).alias("score"))
    schema = T.StructType([source.schema["record"], T.StructField("score", T.DoubleType())])
    return source.mapInArrow(partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), schema)
