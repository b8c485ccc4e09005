"""Quality classifier: naive Bayes support vectors.

A document is the set of its word n-grams (1 and 2) and of the n-grams (1 to 3) of its tokens' shapes, hashed to 2^bits
indicators. Each indicator is scaled by its class log-count ratio; a linear hinge-loss model is then fitted to the
unit-length rows by dual coordinate descent and pulled towards its mean weight. A logistic curve, fitted to documents that
the model has not seen, turns margins into scores from 0 to 1.

The fit uses a bounded sample: the max_labelled labelled rows of lowest hash, in half by class where both have enough.
Labels are taken from rows with a non-null id and label; several labels of one id count with their majority (ties: 1).
Documents of one id count once (the smallest text). Scoring covers every row and the whole text: a null or empty text has
no features and is scored by the bias alone. Without labels, or with one class, every score is the share of label 1 (0.5 if
there are none). Columns pass through unless they have an output's name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, fold, ship, table
from .vocabulary import Memo

BITS = 18
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """Letters by case, digits, or the first sign with whether it repeats."""
    c = token[0]
    if c.isalpha():
        case = "x" if token.islower() else "X" if token.isupper() else "Xx" if token[0].isupper() else "xX"
        return case + ("1" if len(token) == 1 else "")
    if c.isdigit():
        return "9"
    return c + ("+" if len(token) > 1 else "")


class Features:
    """Text to sorted distinct indicator numbers; tokens are hashed once per worker."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.memo = Memo(self._token)

    @staticmethod
    def _token(token: str) -> int:
        """Word hash in the upper half, shape hash in the lower."""
        return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 31 | zlib.crc32(shape(token).encode("utf-8", "surrogatepass")) >> 1

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text) if text else []
        if not tokens:
            return np.empty(0, np.int32)
        both = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens)).astype(np.uint64)
        w, s = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
        a, b, c, d = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
        grams = [w * a, (w[:-1] * b + w[1:]) * a, s * c, (s[:-1] * d + s[1:]) * c, ((s[:-2] * d + s[1:-1]) * d + s[2:]) * b]
        every = (np.concatenate(grams) >> np.uint64(40)) & np.uint64(self.mask)
        seen = np.zeros(self.mask + 1, bool) if len(every) > 20_000 else None
        if seen is not None:
            seen[every] = True
            return np.flatnonzero(seen).astype(np.int32)
        return np.unique(every.astype(np.int32))


class NBSVM:
    """weights (already times the log-count ratios), bias and the logistic curve (slope, shift)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(1, len(features)))) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -50, 50))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, dims: int, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(dims, smooth), np.full(dims, smooth)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def hinge_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, c: float = 1.0, sweeps: int = 30, tolerance: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss: each step solves one dual variable exactly and updates the weights. The bias is a constant feature."""
    y = np.where(labels > 0, 1.0, -1.0)
    w, bias = np.zeros(len(ratios), np.float32), 0.0
    alpha = np.zeros(len(rows))
    values = [ratios[x] / np.sqrt(max(1, len(x))) for x in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            change = (new - alpha[i]) * y[i]
            if change:
                worst = max(worst, abs(change))
                alpha[i] = new
                w[x] += change * v
                bias += change
        if worst < tolerance:
            break
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray, dims: int, pull: float = 0.25, c: float = 1.0, seed: int = 0) -> NBSVM:
    """Fit on nine tenths and the logistic curve on the rest."""
    labels = np.asarray(labels, int)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return NBSVM(np.zeros(dims, np.float32), float(np.log(p / (1 - p))))
    order = np.random.default_rng(seed).permutation(len(rows))
    held, own = (order[: len(order) // 10], order[len(order) // 10 :]) if len(order) >= 200 else (order, order)
    if len(set(labels[own].tolist())) < 2:
        own = order
    pick = lambda ix: [rows[i] for i in ix]
    ratios = log_count_ratios(pick(own), labels[own], dims)
    w, bias = hinge_descent(pick(own), ratios, labels[own], c, seed=seed)
    seen = np.zeros(dims, bool)
    for i in own:
        seen[rows[i]] = True
    w = np.where(seen, (1 - pull) * float(np.abs(w[seen]).mean()) + pull * w, 0.0)
    model = NBSVM((w * ratios).astype(np.float32), bias)
    m = np.array([model.margin(rows[i]) for i in held])
    scale = float(np.abs(m).mean()) or 1.0
    a, b, t = 1.0 / scale, 0.0, labels[held]
    for _ in range(50):  # Newton steps for the curve, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        g = np.array([((p - t) * m).sum() + 1e-2 * (a - 1 / scale) * scale**2, (p - t).sum()])
        q = p * (1 - p) + 1e-6
        h = np.array([[(q * m * m).sum() + 1e-2 * scale**2, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(a, 1e-3), b
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of max_labelled documents at most: by class, the ids of lowest hash."""
    ship(docs.sparkSession)
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    half = max_labelled // 2
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(half) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # max_labelled rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def make():
        f = Features()
        return lambda texts: [[f(t).tobytes() for t in texts]]

    got = arrow_map(texts, ["text"], "x binary", make, keep=["id", "y"]).orderBy("id").select("y", "x").collect()
    return [np.frombuffer(r["x"], np.int32) for r in got], np.array([r["y"] for r in got], int)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000) -> NBSVM:
    rows, y = labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled)
    return train(rows, y, 1 << BITS)


def score_quality(docs: DataFrame, model: NBSVM, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold, else 0)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights

    def make():
        m, f = sent.value, Features()

        def work(texts):
            scores = [m.score(f(t)) for t in texts]
            return scores, [int(s >= threshold) for s in scores]

        return work

    return arrow_map(docs, [text_col], "score double, predicted int", make, keep)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score_quality(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), model, keep=["doc_id", "held_out"])
