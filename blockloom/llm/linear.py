"""Small linear models that are fitted on the driver from bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sigmoid

FOLDS = 5
CHUNK = 2048


class Logistic:
    """Ridge logistic regression by Newton's method; one class only gives the constant."""

    def __init__(self, ridge: float = 1.0, steps: int = 15):
        self.ridge, self.steps = ridge, steps
        self.weights, self.bias = np.zeros(0), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        n, d = x.shape
        prior = (y.sum() + 0.5) / (n + 1.0)
        self.weights, self.bias = np.zeros(d), float(np.log(prior / (1 - prior)))
        if n == 0 or y.min() == y.max():
            return self
        w = np.append(self.weights, self.bias)
        keep = np.append(np.full(d, self.ridge), 1e-6)
        for _ in range(self.steps):
            gradient, hessian = keep * w, np.diag(keep)
            for at in range(0, n, CHUNK):  # few rows at once, to hold no second copy of x
                part = np.column_stack([x[at : at + CHUNK], np.ones(len(x[at : at + CHUNK]))]).astype(np.float64)
                p = sigmoid(part @ w)
                gradient = gradient + part.T @ (p - y[at : at + CHUNK])
                hessian = hessian + (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 10.0 / (np.abs(step).max() + 1e-12))
            w = w - step
            if np.abs(step).max() < 1e-5:
                break
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def sample_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> list:
    """At most ``most`` ids, the same ones whenever asked: those of least hash."""
    ids = rows.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return [r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").limit(most).collect()]


def fold_of(ids: Sequence, folds: int = FOLDS) -> np.ndarray:
    """A fold for each id, by a hash; ids that are no integers count by how they are written."""
    whole = [i if isinstance(i, int | np.integer) else xxhash.xxh3_64_intdigest(str(i).encode("utf-8", "surrogatepass")) >> 1 for i in ids]
    h = np.array(whole, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(folds)).astype(np.int64)


def held_out(x: np.ndarray, y: np.ndarray, folds: np.ndarray, ridge: float) -> np.ndarray:
    """Logits of each row by a model that was fitted without its fold."""
    out = np.zeros(len(y))
    for f in np.unique(folds):
        out[folds == f] = Logistic(ridge).fit(x[folds != f], y[folds != f]).logit(x[folds == f])
    return out
