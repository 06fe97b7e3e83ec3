"""Approximate nearest neighbours in robust-pruned directed graphs, one per shard.

Points are inserted in batches that grow with the graph: a greedy beam search
proposes each point's neighbours, and relaxed distance pruning keeps those
that no kept neighbour is nearer to by the factor ``ALPHA``, so edges stay
diverse. Edges are made mutual, and a point with too many is pruned again.
Queries search every shard's graph by beam.

The largest inner product is the least distance after each vector gets one
more coordinate that brings all to the length of the longest; vectors of very
different lengths are kept in graphs of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import finite, search

DEGREE = 32
BUILD_BEAM = 64
QUERY_BEAM = 96
BEAM_PER_DIMENSION = 2
ALPHA = 1.2
#: Points that a beam expands at once.
WIDTH = 4
BATCH = 256
#: The least length of a group of vectors, as a share of its greatest.
LENGTHS = 0.8
SHARD_ROWS = 16_384


class Graph:
    """The graph over the rows of ``x`` (float32, one coordinate added)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x, self.degree, self.alpha = x, degree, alpha * alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.size = np.zeros(n, np.int32)
        self.norm = (x * x).sum(1)
        middle = x.mean(0)
        self.entry = int(np.argmin(((x - middle) ** 2).sum(1)))
        order = np.random.default_rng(seed).permutation(n)
        order = order[order != self.entry]
        at = 0
        while at < len(order):
            batch = order[at : at + min(BATCH, max(1, at // 2))]
            self._insert(batch, beam)
            at += len(batch)
        self._connect()

    def _connect(self) -> None:
        """Makes every point reachable from the entry: one that is not becomes a neighbour of one that is."""
        reached = np.zeros(len(self.x), bool)
        reached[self.entry] = True
        front = np.array([self.entry])
        while True:
            while len(front):
                next_ = np.unique(self.edges[front])
                front = next_[(next_ >= 0) & ~reached[next_]]
                reached[front] = True
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            if not (spare := reached & (self.size < self.edges.shape[1])).any():
                self.edges = np.column_stack([self.edges, np.full(len(self.x), -1, np.int32)])
                spare = reached
            near = np.flatnonzero(spare)
            at = near[np.argmin(self.norm[near] - 2 * self.x[near] @ self.x[lost[0]])]
            self.edges[at, self.size[at]] = lost[0]
            self.size[at] += 1
            front = lost[:1]
            reached[front] = True

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        pool, dist = self.beam(self.x[batch], beam)
        self._set(batch, *self._prune(batch, pool, dist))
        source = np.repeat(batch, self.degree)
        target = self.edges[batch].ravel()
        some = target >= 0
        source, target = source[some], target[some]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        full: list[tuple[int, np.ndarray]] = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(target)], strict=True):
            v, have = int(target[a]), int(self.size[target[a]])
            new = source[a:b]
            if have + len(new) <= self.degree:
                self.edges[v, have : have + len(new)] = new
                self.size[v] = have + len(new)
            else:
                full.append((v, np.concatenate([self.edges[v, :have], new])))
        full.sort(key=lambda f: len(f[1]))
        for i in range(0, len(full), BATCH):
            part = full[i : i + BATCH]
            wide = max(len(p) for _, p in part)
            points = np.array([v for v, _ in part])
            pool = np.full((len(part), wide), -1, np.int64)
            for j, (_, p) in enumerate(part):
                pool[j, : len(p)] = p
            dist = self._distances(self.x[points], pool)
            order = np.argsort(dist, 1, kind="stable")
            self._set(points, *self._prune(points, np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)))

    def _set(self, points: np.ndarray, edges: np.ndarray, size: np.ndarray) -> None:
        self.edges[points], self.size[points] = edges, size

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.norm[ids] - 2 * np.einsum("bcd,bd->bc", self.x[ids], q) + (q * q).sum(1)[:, None]
        d[ids < 0] = np.inf
        return d

    def _prune(self, points: np.ndarray, pool: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Robust pruning of candidate lists that are sorted by distance."""
        b = len(points)
        edges, size = np.full((b, self.degree), -1, np.int32), np.zeros(b, np.int32)
        vec = self.x[pool]
        norm = self.norm[pool]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
        alive = (pool >= 0) & (pool != points[:, None])
        rows = np.arange(b)
        for _ in range(self.degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            r, f = rows[some], first[some]
            edges[r, size[r]] = pool[r, f]
            size[r] += 1
            alive[r] &= self.alpha * between[r, f] > dist[r]
            alive[r, f] = False
        return edges, size

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest points found for each query, nearest first, and their squared distances."""
        b, n = len(q), len(self.x)
        ids = np.full((b, width), -1, np.int64)
        ids[:, 0] = self.entry
        dist = np.full((b, width), np.inf, np.float32)
        dist[:, 0] = self._distances(q, ids[:, :1])[:, 0]
        done = np.ones((b, width), bool)
        done[:, 0] = False
        seen = np.zeros((b, n), bool)
        seen[:, self.entry] = True
        active = np.arange(b)
        while len(active):
            a_ids, a_dist, a_done = ids[active], dist[active], done[active]
            open_ = np.where(a_done, np.inf, a_dist)
            pick = np.argsort(open_, 1)[:, :WIDTH] if width > WIDTH else np.argsort(open_, 1)
            ok = np.isfinite(np.take_along_axis(open_, pick, 1))
            np.put_along_axis(a_done, pick, True, 1)
            hubs = np.where(ok, np.take_along_axis(a_ids, pick, 1), -1)
            new = np.where(hubs[:, :, None] >= 0, self.edges[hubs], -1).reshape(len(active), -1).astype(np.int64)
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            known = np.take_along_axis(seen[active], np.maximum(new, 0), 1)
            new[known] = -1
            rows, cols = np.nonzero(new >= 0)
            seen[active[rows], new[rows, cols]] = True
            fresh = np.full(new.shape, np.inf, np.float32)
            if len(rows):
                target = new[rows, cols]
                who = active[rows]
                fresh[rows, cols] = self.norm[target] - 2 * np.einsum("ed,ed->e", self.x[target], q[who]) + (q[who] ** 2).sum(1)
            all_dist = np.concatenate([a_dist, fresh], 1)
            order = np.argsort(all_dist, 1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(np.concatenate([a_ids, new], 1), order, 1)
            dist[active] = np.take_along_axis(all_dist, order, 1)
            done[active] = np.take_along_axis(np.concatenate([a_done, np.zeros(new.shape, bool)], 1), order, 1)
            left = ~(done[active] | np.isinf(dist[active])).all(1)
            active = active[left]
        ids[np.isinf(dist)] = -1
        return ids, dist


class _Group:
    """Vectors of about one length, in a graph."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        self.rows, self.vectors = rows, vectors
        length = (vectors * vectors).sum(1)
        self.longest = float(np.sqrt(length.max()))
        unit = vectors / self.longest
        more = np.sqrt(np.maximum(1 - length / self.longest**2, 0))
        self.graph = Graph(np.column_stack([unit, more]).astype(np.float32))

    def find(self, queries: np.ndarray, size: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        asked = np.column_stack([queries / size[:, None], np.zeros(len(queries))]).astype(np.float32)
        index, _ = self.graph.beam(asked, min(beam, len(self.rows)))
        score = np.einsum("bcd,bd->bc", self.vectors[index], queries)
        return np.where(index >= 0, self.rows[index], -1), np.where(index >= 0, score, -np.inf)


def beam_for(dim: int, k: int) -> int:
    """The width of a query's beam: neighbourhoods of vectors without structure need a wider one in more dimensions."""
    return max(QUERY_BEAM, 2 * k, BEAM_PER_DIMENSION * dim)


def _searcher(original: np.ndarray, k: int):
    """Largest inner products over one shard.

    With lengths far apart a graph leads to long vectors badly, so each range
    of lengths has a graph of its own. The longest come first, and a query
    skips those whose length rules out what it has found already.
    """
    beam = beam_for(original.shape[1], k)
    vectors = original / (float(np.abs(original).max()) or 1.0)
    length = np.sqrt((vectors * vectors).sum(1))
    order = np.argsort(-length, kind="stable")
    groups, at = [], 0
    while at < len(order):
        to = at + int(np.searchsorted(-length[order[at:]], -length[order[at]] * LENGTHS, side="right"))
        groups.append(_Group(order[at:to], vectors[order[at:to]]))
        at = to

    def find(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.sqrt((queries * queries).sum(1))
        index, score = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -np.inf)
        for g in groups:
            open_ = np.flatnonzero(size * g.longest >= score[:, min(k, beam - 1)])
            if not len(open_):
                break
            i, s = g.find(queries[open_], size[open_], beam)
            i, s = np.concatenate([index[open_], i], 1), np.concatenate([score[open_], s], 1)
            best = np.argsort(-s, 1, kind="stable")[:, :beam]
            index[open_], score[open_] = np.take_along_axis(i, best, 1), np.take_along_axis(s, best, 1)
        # Scores that count are taken from the vectors as they were.
        return index, np.where(index >= 0, np.einsum("bcd,bd->bc", original[index], queries), -np.inf)

    return find


def nearest(
    spark: SparkSession, rows: DataFrame, queries: DataFrame | None = None, k: int = 20, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest rows found by inner product: ``query_id, rank, vec_id, score``.

    ``queries`` (default: rows whose id is divisible by 20) have the same
    columns as ``rows``. Every row is indexed. Scores are computed in double
    precision on the original vectors; ties go to the smaller id; the row with
    the query's id is left out.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows without an id take no part. Equal rows count once;
    equal vectors share a place in the graph and are all returned. Vectors are
    compared with those of their own dimension. With k candidates or fewer all
    are returned; without rows there is no result. Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        vec = F.col(f"`{vec_col}`")
        good = finite(vec) & F.exists(vec, lambda x: x != 0) & F.col(f"`{id_col}`").isNotNull()
        return df.where(good).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.cast("array<double>").alias("vec"))

    found = clean(rows)
    asked = found.where("id % 20 = 0") if queries is None else clean(queries)
    return search(spark, found, asked, k, shard_rows, lambda vectors, least: _searcher(vectors, k), "double")
