"""Quality scores by naive Bayes support vectors.

A text's features say which n-grams it has, not how often, hashed into a fixed number of buckets: n-grams
of its bytes, and n-grams of how its words repeat (each word a symbol that says whether it equals the one,
two or three before it). Each feature is scaled by the log ratio of its smoothed counts in the two classes, the
vector is divided by the square root of its length, so that margins grow with evidence but slowly, and a
linear hinge-loss model is fitted by dual coordinate descent. Platt's
sigmoid, fitted on margins from models that have not seen the text, turns margins into probabilities.

The model is fitted on at most about ``sample_docs`` labelled documents, drawn by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import slices
from heddle.session import ship

GRAMS = (1, 2, 3, 4)
BITS = 17
SAMPLE_DOCS = 2400
FOLDS = 3
EPOCHS = 60
TOLERANCE = 1e-4
COST = 1.0
ALPHA = 1.0
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray  # of the scaled features, times their scale
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float


def features(text: str | None) -> np.ndarray:
    """The ascending buckets of the text's n-grams; an empty text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    has = np.zeros(1 << BITS, bool)
    _mark(has, np.frombuffer(raw, np.uint8).astype(np.uint32), 0)
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    repeats = np.full(len(words), 16, np.uint32)
    for back in (1, 2, 3):
        repeats[back:] += (hashes[back:] == hashes[:-back]) * np.uint32(1 << back)
    _mark(has, repeats, 1)
    return np.flatnonzero(has)


def _mark(has: np.ndarray, symbols: np.ndarray, stream: int) -> None:
    code = symbols
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | symbols[n - 1 :]
        if not len(code):
            break
        if n in GRAMS:
            has[(code * np.uint32(0x9E3779B1) + np.uint32((2 * n + stream) * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True


def _ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    p, q = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    for row, is_good in zip(rows, good, strict=True):
        (p if is_good else q)[row] += 1
    return (np.log(p / (max(good.sum(), 1) + 2 * ALPHA)) - np.log(q / (max((~good).sum(), 1) + 2 * ALPHA))).astype(np.float64)


def _dual_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; each class has the same total cost."""
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) * len(y) * COST
    w, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(y)):
            row, x = rows[i], values[i]
            gradient = y[i] * (w[row] @ x + bias) - 1
            new = min(max(dual[i] - gradient / (x @ x + 1.0), 0.0), cost[i])
            if step := (new - dual[i]) * y[i]:
                w[row] += step * x
                bias += step
                most = max(most, abs(step))
                dual[i] = new
        if most < TOLERANCE:
            break
    return w, bias


def _scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    values = [ratios[row] for row in rows]
    return [v / ((v @ v) ** 0.25 or 1.0) for v in values]


def _platt(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid with Platt's smoothed targets, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x @ (p - target) + 1e-6 * np.array([a, b])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), gradient)
        step *= min(1.0, 4 / (np.abs(step).max() or 1.0))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Labels are 1 (good) or 0. With one class only or no rows, every score is that class's smoothed share."""
    good, rows = np.array(labels, bool), [features(t) for t in texts]
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        flat = np.zeros(1 << BITS)
        return Model(flat, flat, 0.0, 1.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        own = [rows[i] for i in np.flatnonzero(fold != k)]
        if good[fold != k].all() or not good[fold != k].any():
            continue
        ratios = _ratios(own, good[fold != k])
        w, bias = _dual_descent(own, _scaled(own, ratios), good[fold != k])
        other = np.flatnonzero(fold == k)
        margins[other] = [w[rows[i]] @ x + bias for i, x in zip(other, _scaled([rows[i] for i in other], ratios), strict=True)]
    slope, offset = _platt(margins, good)
    ratios = _ratios(rows, good)
    w, bias = _dual_descent(rows, _scaled(rows, ratios), good)
    return Model(w * ratios, ratios, bias, slope, offset)


def score(text: str | None, model: Model) -> float:
    """The probability of a good text; null is empty."""
    row = features(text)
    r = model.ratios[row]
    margin = model.weights[row].sum() / ((r @ r) ** 0.25 or 1.0) + model.bias
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Fits on a sample of the documents that ``labels`` marks 0 or 1; rows without a label or id are left out.

    An id that has several labels counts as good only if none of them is 0. The driver gets the sample alone.
    """
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    n = marks.count()
    share = min(1.0, sample_docs / n) if n else 0.0
    drawn = marks.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    ).join(drawn, "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "text").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("label").to_pylist())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row; null and empty texts have the score of no features.

    Ids may be null or repeat; other columns aren't read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts):
        own = shared.value
        for part in (p for whole in parts for p in slices(whole, 1)):
            got = np.fromiter((score(t.as_py(), own) for t in part.column(1)), np.float64, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(batches, f"doc_id {dict(kept.dtypes)['doc_id']}, score double, predicted int")
