"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-gram indicators: words, and runs of one to three word
shapes (letters, capitals, digits and punctuation, repeats squeezed).  Indicators are
scaled by the log-ratio of their smoothed class counts, and a linear hinge-loss model
is fitted to them by dual coordinate descent.  Margins become probabilities by a
logistic fitted on a part of the rows that the model has not seen.

The model is fitted on a bounded sample, ``sample`` labelled rows taken by a hash of
doc_id; everything is scored.  Only the text goes into a score.

Defined cases: null, empty and blank texts have only the indicators of an empty text;
null labels and doc_ids labelled both ways are not learnt from; of equal doc_ids the
least text is learnt from; equal texts score alike; without rows of both classes each
score is the share of label 1 (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import give_back

#: Indicators are held in so many slots.
SLOTS = 1 << 18
_SHAPES = bytes(b"a"[0] if 97 <= b < 123 or b >= 128 else b"A"[0] if 65 <= b < 91 else b"0"[0] if 48 <= b < 58 else b
                for b in range(256))
_RUNS = re.compile(rb"(.)\1+")


def indicators(text: str | None) -> np.ndarray:
    """Sorted slots of the text's indicators."""
    raw = (text or "").encode()
    words = raw.lower().split()
    found = {zlib.crc32(w) for w in set(words)}
    shapes = _RUNS.sub(rb"\1", raw.translate(_SHAPES)).split()
    for n in (1, 2, 3):
        found.update(zlib.crc32(b" ".join(g), n) for g in set(zip(*[shapes[i:] for i in range(n)])))
    # how often words, and pairs of words, come again
    for n in (1, 2):
        grams = max(1, len(words) - n + 1)
        found.add(zlib.crc32(b"%d" % (len(set(zip(*[words[i:] for i in range(n)]))) * 10 // grams), 10 + n))
    found.add(zlib.crc32(b"%d" % len(words).bit_length(), 20))
    return np.unique(np.fromiter(found, np.uint32) & np.uint32(SLOTS - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weights[x].sum(dtype=np.float64) for x in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, SLOTS), smoothing)
    for x, label in zip(rows, y):
        counts[label, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int, seed: int):
    """Dual coordinate descent for the hinge loss: (weights, bias) on the scaled indicators."""
    rng = np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    # both classes weigh the same together
    most = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum()))) * cost
    values = [scale[x] for x in rows]
    curve = np.array([(v * v).sum() + 1 for v in values])
    w, b, dual = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slack = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(dual[i] - slack / curve[i], 0.0), most[i])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, c) if np.isfinite([a, c]).all() and a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 0.05, rounds: int = 30, mix: float = 0.25, seed: int = 7) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(SLOTS, np.float32), 0.0, 1.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -50, 50)))
    aside = np.random.default_rng(seed).permutation(len(rows)) % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside[:] = False

    def model(on: np.ndarray) -> Model:
        own = [rows[i] for i in np.flatnonzero(on)]
        r = log_ratios(own, y[on])
        w, b = descend(own, y[on], r, cost, rounds, seed)
        # interpolation between naive Bayes and the support vectors' weights
        w = (1 - mix) * np.abs(w).sum() / max(1, np.count_nonzero(w)) + mix * w
        return Model((w * r).astype(np.float32), b * mix, 1.0, 0.0)

    tried, seen = model(~aside), aside if aside.any() else ~aside
    margins = np.array([tried.weights[rows[i]].sum() for i in np.flatnonzero(seen)]) + tried.bias
    out = model(np.ones(len(rows), bool)) if aside.any() else tried
    out.slope, out.offset = logistic(margins, y[seen])
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2 (a null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000, most_chars: int = 400_000) -> Model:
    """A model from at most ``sample`` labelled rows that aren't held out, with texts of at most ``most_chars``."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("y").cast("int").alias("y"))
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(
        F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [indicators(t).tobytes() for t in pdf["text"]]})
    kind = dict(texts.dtypes)["doc_id"]
    got = texts.mapInPandas(run, f"doc_id {kind}, y int, x binary").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(x, np.int32) for x in got["x"]], got["y"].to_numpy(np.int64))


def score(model: Model, text: Column) -> Column:
    """The probability of label 1."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.scores([indicators(t) for t in part]))
            del part
            give_back()
    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (score >= threshold)."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")).select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted"))
