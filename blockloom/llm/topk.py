"""Exact top-k inner products by norm buckets.

A shard's vectors are sorted by length and cut into buckets. A query walks the
buckets from the longest. Its current k-th best score, divided by its length
and the bucket's, is the cosine that a candidate there must reach. Above one,
this bucket and all later ones are pruned. A high local threshold calls for
coordinate pruning: on the query's largest coordinates a candidate's direction
must lie within bounds that follow from the threshold. A low one calls for
length pruning only. What remains is verified by its integer product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import finite, search

BUCKET = 512
#: Query coordinates that bound a candidate's direction.
FOCUS = 5
#: Local cosine thresholds from here on are pruned by coordinates.
BY_COORDINATE = 0.6
SHARD_ROWS = 16_384
_EASE = 1e-9
_LEAST = np.iinfo(np.int64).min


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner product of each row of ``a`` with the same of ``b``, exactly; a score beyond 64 bits is an error.

    Sums of 64-bit products wrap around, so a score that fits is right whatever
    its terms are. Where floating point cannot tell that it fits, Python's
    integers do.
    """
    out = np.einsum("ij,ij->i", a, b)
    wide = a.astype(np.float64), b.astype(np.float64)
    sizes = np.einsum("ij,ij->i", np.abs(wide[0]), np.abs(wide[1]))
    about, error = np.einsum("ij,ij->i", *wide), sizes * a.shape[1] * 2.0**-50
    for i in np.flatnonzero(np.abs(about) + error >= 2.0**63):
        score = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True))
        if not -(1 << 63) <= score < 1 << 63:
            raise ArithmeticError("a score does not fit 64 bits")
        out[i] = score
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer inner products, exactly; a score beyond 64 bits is an error."""
    wide = a.astype(np.float64), b.astype(np.float64)
    bound = float(np.abs(wide[0]).max(initial=0)) * float(np.abs(wide[1]).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (wide[0] @ wide[1].T).astype(np.int64)
    out = a @ b.T
    # Only vectors whose lengths allow for it have scores that may not fit.
    long = np.sqrt((wide[0] ** 2).sum(1))[:, None] * np.sqrt((wide[1] ** 2).sum(1))[None, :] * (1 + 1e-9)
    rows, cols = np.nonzero(long >= 2.0**63)
    if len(rows):
        out[rows, cols] = _pairs(a[rows], b[cols])
    return out


class NormBuckets:
    def __init__(self, vectors: np.ndarray, least: np.ndarray, k: int):
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.order = np.lexsort((least, -length))
        self.vectors, self.least, self.length = vectors[self.order], least[self.order], length[self.order]
        self.unit = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self.k = k

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and scores of the k best vectors; ties go to the smaller least id."""
        b, k = len(queries), self.k
        size = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        unit = queries / np.maximum(size, 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), 1)[:, :FOCUS]
        index = np.full((b, k), -1, np.int64)
        score = np.full((b, k), _LEAST, np.int64)
        active = np.arange(b)
        for at in range(0, len(self.vectors), BUCKET):
            vec, long = self.vectors[at : at + BUCKET], self.length[at : at + BUCKET]
            bar = score[active, -1].astype(np.float64)
            some = index[active, -1] >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(some & (size[active] * long[0] > 0), bar / (size[active] * long[0]), -np.inf)
            local = np.where(some & (size[active] * long[0] == 0) & (bar > 0), np.inf, local)
            active, local = active[local <= 1 + _EASE], local[local <= 1 + _EASE]
            if not len(active):
                break
            keep = self._keep(active, local, bar_of(score, index, active), size, unit, focus, at, long)
            rows, cols = np.nonzero(keep)
            if len(rows) * 4 > keep.size:
                products = np.where(keep, _products(queries[active], vec), _LEAST)
            else:
                products = np.full(keep.shape, _LEAST, np.int64)
                if len(rows):
                    products[rows, cols] = _pairs(queries[active[rows]], vec[cols])
            better = np.flatnonzero((products >= score[active, -1:]).any(1) & keep.any(1))
            if len(better):
                self._merge(active[better], products[better], keep[better], at, index, score)
        out = np.where(index >= 0, self.order[np.maximum(index, 0)], -1)
        return out, score

    def _keep(self, active, local, bar, size, unit, focus, at, long) -> np.ndarray:
        """Which of the bucket's vectors each query must verify."""
        direction = self.unit[at : at + BUCKET]
        with np.errstate(invalid="ignore"):
            keep = ~(size[active, None] * long[None, :] * (1 + _EASE) + _EASE < bar[:, None])  # length pruning
        sharp = np.flatnonzero(local >= BY_COORDINATE)
        if len(sharp):
            t = np.minimum(local[sharp] * (1 - _EASE) - _EASE, 1.0)
            rest = np.sqrt(np.maximum(1 - t * t, 0))
            inside = np.ones((len(sharp), len(long)), bool)
            for f in range(focus.shape[1]):
                c = focus[active[sharp], f]
                q = unit[active[sharp], c]
                spread = rest * np.sqrt(np.maximum(1 - q * q, 0)) + _EASE
                values = direction.T[c]
                # A direction at a smaller angle than the threshold may lie closer to the axis than q itself.
                high = np.where(q >= t, 1.0, q * t + spread)
                low = np.where(-q >= t, -1.0, q * t - spread)
                inside &= (values >= low[:, None]) & (values <= high[:, None])
            keep[sharp] &= inside
        return keep

    def _merge(self, rows, products, keep, at, index, score) -> None:
        n = products.shape[1]
        here = np.where(keep, np.arange(at, at + n)[None, :], -1)
        all_index = np.concatenate([index[rows], here], 1)
        all_score = np.concatenate([score[rows], products], 1)
        first = np.where(all_index >= 0, self.least[np.maximum(all_index, 0)], np.iinfo(np.int64).max)
        # Descending scores: the bitwise complement reverses the order of all 64-bit integers.
        order = np.lexsort((first, ~all_score, all_index < 0), axis=1)[:, : self.k]
        index[rows] = np.take_along_axis(all_index, order, 1)
        score[rows] = np.take_along_axis(all_score, order, 1)


def bar_of(score: np.ndarray, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The score that a candidate must reach, -inf until there are k."""
    return np.where(index[rows, -1] >= 0, score[rows, -1].astype(np.float64), -np.inf)


def exact_top_k(
    spark: SparkSession, rows: DataFrame, queries: DataFrame | None = None, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Each query's k largest inner products of floor(scale * x): ``query_id, rank, vec_id, score``.

    ``queries`` (default: rows whose id is divisible by 20) have the same
    columns as ``rows``; the row with the query's id is left out. Exact: ties
    go to the smaller id, and equal vectors are all considered.

    Vectors that are null or empty, or hold null or non-finite components, and
    rows without an id take no part; zero vectors do. Equal rows count once.
    Vectors are compared with those of their own dimension. With k candidates
    or fewer all are returned; without rows there is no result. A score beyond
    64 bits is an error. Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        vec = F.col(f"`{vec_col}`")
        whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
        return df.where(finite(vec) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), whole.alias("vec"))

    found = clean(rows)
    asked = found.where("id % 20 = 0") if queries is None else clean(queries)
    most = k + 1

    def make(vectors: np.ndarray, least: np.ndarray):
        return NormBuckets(vectors, least, most).find

    return search(spark, found, asked, k, shard_rows, make, "bigint")
