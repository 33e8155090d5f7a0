"""k-means on executors: k-means|| seeding and Lloyd rounds whose sums are formed where the vectors lie.

The driver holds centroids only, never vectors by the row or a matrix of distances. Several codebooks (the sub-vectors of product codes) are
fitted in the same passes: vectors are seen as ``books`` parts of equal length, and each part has its own ``k`` centroids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import matrix

#: Entries of a distance matrix that a task makes at once: 32 MB.
STEP = 4_000_000
SEED_ROUNDS = 3
#: Lloyd rounds end when the sum of squared distances falls by less than this share.
LEAST_GAIN = 0.002


def nearest(x: np.ndarray, c: np.ndarray, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (or the one with the largest product) of each row, ties to the first, and the squared distance to it; made in steps of bounded size."""
    who, far, half = np.empty(len(x), np.int64), np.empty(len(x)), (c * c).sum(axis=1) / 2
    step = max(1, STEP // max(len(c), 1))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        score = part @ c.T
        who[at : at + step] = near = (score if inner else score - half).argmax(axis=1)
        far[at : at + step] = np.maximum((part * part).sum(axis=1) - 2 * (score[np.arange(len(part)), near] - half[near]), 0)
    return who, far


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id and salt, the same at every run."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _ship(df: DataFrame, view: Callable, model, fn: Callable, schema: str) -> DataFrame:
    """What ``fn(model)`` gathers of the ids and parts of a task's vectors, seen in bounded slices, as rows; the model is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = [f.split() for f in schema.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches):
        fold = fn(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fold.add(part.column(0).to_numpy(), view(matrix(part.column(1), part.column(0))))
        out = fold.rows()
        if out and len(out[0]):
            yield pa.RecordBatch.from_pydict({name: pa.array(c if kind != "array<double>" else list(c), arrow[kind]) for c, (name, kind) in zip(out, kinds)})

    return df.mapInArrow(run, schema)


class _Seeds:
    """Of one task: points drawn by their distance to the centroids so far, and the sum of these distances, for each book."""

    def __init__(self, model):
        self.books, self.cost, self.wanted, self.salt = model
        self.total, self.found = np.zeros(len(self.books)), []

    def add(self, ids, parts):
        for j, c in enumerate(self.books):
            _, far = nearest(parts[:, j], c)
            self.total[j] += far.sum()
            if self.cost is not None and self.cost[j] > 0:
                drawn = _uniform(ids, self.salt * 1009 + j) < self.wanted * far / self.cost[j]
                self.found += [(j, p, 0.0) for p in parts[drawn, j]]

    def rows(self):
        return list(zip(*self.found, *[(j, np.zeros(0), t) for j, t in enumerate(self.total.tolist())]))


class _Sums:
    """Of one task: the sum and number of the points nearest to each centroid, and the farthest point, for each book."""

    def __init__(self, model):
        self.books, self.inner = model
        self.sums, self.counts = [np.zeros_like(c) for c in self.books], [np.zeros(len(c), np.int64) for c in self.books]
        self.worst, self.cost = [(-1.0, None)] * len(self.books), np.zeros(len(self.books))

    def add(self, ids, parts):
        for j, c in enumerate(self.books):
            who, far = nearest(parts[:, j], c, self.inner)
            np.add.at(self.sums[j], who, parts[:, j])
            self.counts[j] += np.bincount(who, minlength=len(c))
            self.cost[j] += far.sum()
            at = int(far.argmax())
            self.worst[j] = max(self.worst[j], (float(far[at]), parts[at, j]), key=lambda w: w[0])

    def rows(self):
        out = [(j, int(k), int(n[k]), 0.0, self.sums[j][k]) for j, n in enumerate(self.counts) for k in np.flatnonzero(n)]
        out += [(j, -1, 1, w, p) for j, (w, p) in enumerate(self.worst) if p is not None]
        out += [(j, -2, 0, float(c), self.sums[j][0] * 0) for j, c in enumerate(self.cost)]
        return list(zip(*out))


def _added(batches):
    """Sums of the tasks' sums, by book and centroid; farthest points (centroid -1) pass, costs (-2) are added."""
    sums: dict[tuple[int, int], list] = {}
    for b in batches:
        book, cell, n, far, v = (b.column(k).to_numpy(zero_copy_only=False) if k < 4 else matrix(b.column(4)) for k in range(5))
        for at in range(b.num_rows):
            key = (int(book[at]), int(cell[at]))
            if key[1] == -1:
                key += (float(far[at]),)
            own = sums.setdefault(key, [0, 0.0, 0.0])
            own[0], own[1], own[2] = own[0] + int(n[at]), own[1] + float(far[at]), own[2] + v[at]
    if sums:
        keys, values = list(sums), list(sums.values())
        yield pa.RecordBatch.from_pydict({
            "book": pa.array([k[0] for k in keys], pa.int32()), "cell": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([v[0] for v in values], pa.int64()),
            "far": pa.array([v[1] for v in values]), "v": pa.array([v[2].tolist() for v in values], pa.list_(pa.float64())),
        })


def _weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the candidates by k-means++ with weights; one vector of distances at a time. Too few candidates are all taken, with repeats."""
    if len(points) <= k:
        return points[np.arange(k) % len(points)]
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        p = far * weights
        total = p.sum()
        pick = int(rng.choice(len(points), p=p / total)) if total > 0 else int(rng.integers(len(points)))
        chosen.append(pick)
        far = np.minimum(far, ((points - points[pick]) ** 2).sum(axis=1))
    return points[chosen]


def _whole(x: np.ndarray) -> np.ndarray:
    return x[:, None, :]


def fit(points: DataFrame, k: int, rounds: int = 10, seed: int = 0, spherical: bool = False, view: Callable[[np.ndarray], np.ndarray] = _whole) -> np.ndarray:
    """Centroids ``(books, k, length)`` of ``(id, vector)`` rows; ``view(matrix)`` gives each row's parts as ``(rows, books, length)``.

    Seeding (Bahmani et al., "Scalable K-Means++", 2012) draws about ``k / 2`` candidates in each of ``SEED_ROUNDS`` passes with a probability that grows
    with the squared distance; candidates are weighted by the points they are nearest to, and the driver picks ``k`` of them. Each Lloyd round
    is one pass and one shuffle of at most ``books * k`` sums a task. Centroids without points take the farthest points of tasks.
    Spherical centroids have unit length and take what has the largest product. Ids are unique; the same table and seed give the same
    draws, however the table is dealt to tasks.
    """
    rng, ids = np.random.default_rng(seed), points.columns[0]
    # The start: the row with the least seeded hash.
    first = points.orderBy(F.xxhash64(F.lit(seed), F.col(ids)), ids).limit(1).collect()
    if not first:
        raise ValueError("there are no vectors to fit centroids on")
    start = view(np.array([first[0][1]], np.float64))[0]
    books, cost = [s[None] for s in start], None
    for r in range(SEED_ROUNDS + 1):
        rows = _ship(points, view, (books, cost, max(k / 2, 8.0), seed * 31 + r), _Seeds, "book int, v array<double>, cost double")
        found = rows.groupBy("book", F.size("v").alias("d"), "v").agg(F.sum("cost").alias("cost")).collect()  # about k / 2 candidates a book, and its cost
        cost = np.array([sum(f.cost for f in found if f.book == j and f.d == 0) for j in range(len(books))])
        new = sorted(((f.book, f.v) for f in found if f.d), key=lambda f: (f[0], f[1]))
        books = [np.array([*c.tolist(), *[v for j, v in new if j == b]]) for b, c in enumerate(books)]
    counts = _lloyd(points, books, view, False)[0]
    books = [_weighted_seeds(c, counts[j] + 1e-9, k, rng) for j, c in enumerate(books)]
    before = np.inf
    for _ in range(rounds):
        counts, means, worst, cost = _lloyd(points, books, view, spherical)
        settled, before = cost > (1 - LEAST_GAIN) * before, cost
        for j, c in enumerate(books):
            new = np.where(counts[j][:, None] > 0, means[j], c)
            empty = np.flatnonzero(counts[j] == 0)
            for at, (_, p) in zip(empty, sorted(worst[j], key=lambda w: (-w[0], w[1]))):
                new[at] = p
            if spherical:
                new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            settled &= not len(empty)
            books[j] = new
        if settled:
            break
    return np.stack(books)


def _lloyd(points: DataFrame, books: list[np.ndarray], view, inner: bool):
    """Of each book: how many points each centroid has, their means, and farthest points of tasks."""
    schema = "book int, cell int, n long, far double, v array<double>"
    parts = _ship(points, view, (books, inner), _Sums, schema)
    rows = parts.repartition("book", "cell").mapInArrow(_added, schema).collect()  # the centroids, and a point a task and book
    counts, means, worst, cost = [np.zeros(len(c), np.int64) for c in books], [np.array(c) for c in books], [[] for _ in books], 0.0
    for r in rows:
        if r.cell == -2:
            cost += r.far
        elif r.cell == -1:
            worst[r.book].append((r.far, r.v))
        else:
            counts[r.book][r.cell], means[r.book][r.cell] = r.n, np.array(r.v) / r.n
    return counts, means, worst, cost
