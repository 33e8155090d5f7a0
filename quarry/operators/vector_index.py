"""Vector search for many queries at once: exact inner product, inverted file, product quantisation, navigable graphs.

Queries are the small side: they are shipped to the tasks in blocks of a checked size, so a corpus is scanned once for each block and never
shuffled; every task keeps its best ``k`` for each query, and only those are merged. Orders are total: score descending,
then id ascending. Indexes are tables, built once and searched often: cells and codes are columns, centroids and codebooks are small arrays fitted on
a bounded sample, graphs are rows of a table, one for each shard of vectors. Inverted files that are written by cell are read only where a block's queries probe.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import dot, matrix
from quarry.operators import clustering
from quarry.operators.clustering import nearest
from quarry.sources.checkpoints import checkpointed

QUERY_BLOCK, BLOCKS_A_PLAN = 4096, 16
#: Queries of a cell from which on decoded vectors and one matrix product cost less than a table of distances for each query.
DECODED_FROM = 16
HITS = "query_id long, vector_id long, score double"
BUILD_PARAMS = {"flat_ip": set(), "ivf_flat": {"nlist", "train_size", "train_seed"}, "ivf_pq": {"nlist", "m", "nbits", "train_size", "train_seed"}, "hnsw": {"m", "ef_construction"}}
SEARCH_PARAMS = {"flat_ip": set(), "ivf_flat": {"nprobe", "max_codes"}, "ivf_pq": {"nprobe", "max_codes"}, "hnsw": {"ef_search"}}


def check_params(kind: str, build: dict | None = None, search: dict | None = None, dimension: int | None = None) -> dict:
    """The search parameters with their defaults; raises on unknown kinds and names, and on impossible values."""
    build, search = dict(build or {}), dict(search or {})
    if kind not in BUILD_PARAMS:
        raise ValueError(f"no index of kind {kind}")
    unknown = (set(build) - BUILD_PARAMS[kind]) | (set(search) - SEARCH_PARAMS[kind])
    if unknown:
        raise ValueError(f"{kind} doesn't take {sorted(unknown)}")
    for name, value in (build | search).items():
        low = 0 if name in ("max_codes", "train_seed") else 1
        if isinstance(value, bool) or not isinstance(value, int) or value < low:
            raise ValueError(f"{name} must be an integer of {low} or more")
    nlist = build.get("nlist", 1024)
    if kind.startswith("ivf"):
        search.setdefault("nprobe", min(16, nlist))
        search.setdefault("max_codes", 0)
        if search["nprobe"] > nlist:
            raise ValueError("nprobe can't be more than nlist")
    if kind == "ivf_pq":
        if build.get("nbits", 8) > 16:
            raise ValueError("nbits is 16 at most")
        if dimension is not None and dimension % build.get("m", 48):
            raise ValueError("the dimension must be a multiple of m")
    if kind == "hnsw":
        search.setdefault("ef_search", 64)
    return search


def query_blocks(queries: DataFrame):
    """The queries as blocks of at most ``QUERY_BLOCK`` ids and vectors on the driver, one block at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        ids.append(r[0]), rows.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def _best(qids, ids, scores, k):
    """The best ``k`` of a score matrix (rows are corpus vectors), for each query, as hit columns.

    Matrix products of equal vectors can differ in the last bits; on nine places they tie, and ids decide.
    """
    scores, n = np.round(scores, 9), len(ids)
    if n > k:
        # All that tie with the k-th stay candidates, so that ids decide.
        cut = np.partition(scores, n - k, axis=0)[n - k]
        row, col = np.nonzero(scores >= cut)
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    s, i = scores[row, col], ids[row]
    order = np.lexsort((i, -s, col))
    col, s, i = col[order], s[order], i[order]
    first = np.searchsorted(col, np.arange(len(qids)))
    keep = np.arange(len(col)) - first[col] < k
    return {"query_id": qids[col[keep]], "vector_id": i[keep], "score": s[keep]}


def rank(hits: DataFrame, k: int) -> DataFrame:
    """Adds 1-based ranks and keeps the first ``k`` of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vector_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(corpus: DataFrame, queries: DataFrame, k: int, kernel, wanted=None, repeats: bool = False) -> DataFrame:
    """Runs ``kernel(batches, qids, qmat)`` over the corpus for each query block and merges the tasks' best; ``wanted(qmat)`` is a
    condition on the rows that a block has to read. With ``repeats``, tasks may find the same vector."""
    spark, parts = corpus.sparkSession, []
    for qids, qmat in query_blocks(queries):
        shared = spark.sparkContext.broadcast((qids, qmat))  # QUERY_BLOCK vectors at most
        read = corpus if wanted is None else corpus.where(wanted(qmat))
        part = read.mapInArrow(lambda batches, shared=shared: kernel(batches, *shared.value), HITS)
        part = part.groupBy("query_id", "vector_id").agg(F.max("score").alias("score")) if repeats else part
        parts.append(part)
        if len(parts) == BLOCKS_A_PLAN:  # so many scans make one table before more are added
            parts = [checkpointed(rank(reduce(DataFrame.unionAll, parts), k).drop("rank"))]
    return rank(reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], HITS), k)


def _merged(found: list[dict], k: int, repeats: bool = False):
    """One batch with the best ``k`` of each query among partial hits; with ``repeats``, a vector may be in several."""
    q, i, s = (np.concatenate([f[c] for f in found]) for c in ("query_id", "vector_id", "score"))
    if repeats:
        order = np.lexsort((-s, i, q))
        q, i, s = q[order], i[order], s[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, s = q[first], i[first], s[first]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    at = np.arange(len(q)) - np.searchsorted(q, q)
    keep = at < k
    return {"query_id": q[keep], "vector_id": i[keep], "score": s[keep]}


def flat_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner-product top ``k``: ``(query_id, vector_id, score, rank)`` from ``(vector_id, embedding)`` and ``(query_id, embedding)``."""

    def kernel(batches, qids, qmat):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, step := max(1, clustering.STEP // len(qids))):
                piece = b.slice(at, step)
                x = matrix(piece.column(1), piece.column(0), qmat.shape[1]).astype(np.float64)
                part = _best(qids, piece.column(0).to_numpy(), x @ qmat.T, k)
                held = part if held is None else _merged([held, part], k)
        if held is not None:
            yield pa.RecordBatch.from_pydict(held)

    return _scan(corpus.select("vector_id", "embedding"), queries, k, kernel)


def training_positions(n: int, size: int, seed: int) -> np.ndarray:
    """Which of ``n`` positions, in order, a seeded draw of ``size`` without replacement takes, as NumPy's generator makes it."""
    return np.arange(n) if size >= n else np.sort(np.random.default_rng(seed).choice(n, size=size, replace=False))


def training_sample(corpus: DataFrame, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows ``(vector_id, embedding)``, those at the drawn positions in the order of their ids; the rows stay on executors.

    The ids are sorted in ranges, of which the driver gets one number each; each range has the drawn positions that lie in it.
    """
    ids = checkpointed(corpus.select("vector_id").repartitionByRange("vector_id").sortWithinPartitions("vector_id").withColumn("part", F.spark_partition_id()))
    counts = {r.part: r["count"] for r in ids.groupBy("part").count().collect()}
    if sum(counts.values()) <= size:
        return corpus.select("vector_id", "embedding")
    drawn, begin, at = training_positions(sum(counts.values()), size, seed), {}, 0
    for part in sorted(counts):
        begin[part] = at
        at += counts[part]
    shared = corpus.sparkSession.sparkContext.broadcast((begin, drawn))  # `size` numbers

    def run(key, rows):
        begin, drawn = shared.value
        mine = np.sort(rows.column("vector_id").to_numpy())
        first = begin[key[0].as_py()]
        inside = drawn[np.searchsorted(drawn, first) : np.searchsorted(drawn, first + len(mine))]
        return pa.table({"vector_id": mine[inside - first]})

    picked = ids.groupBy("part").applyInArrow(run, "vector_id long")
    return corpus.select("vector_id", "embedding").join(picked, "vector_id", "left_semi")


@dataclass(frozen=True)
class InvertedFile:
    """Cells by coarse centroids; with ``books``, residual codes of ``m`` sub-vectors instead of vectors."""

    centroids: np.ndarray
    books: np.ndarray | None = None  # m x 2^nbits x (dimension / m)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        rest = (x - self.centroids[cell]).reshape(len(x), m, d)
        return np.stack([nearest(rest[:, j], self.books[j])[0] for j in range(m)], axis=1)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + np.concatenate([self.books[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)

    def probes(self, q: np.ndarray, nprobe: int) -> np.ndarray:
        """The cells nearest to each query, nearest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :nprobe]

    def scores(self, codes: np.ndarray, cell: int, q: np.ndarray) -> np.ndarray:
        """Inner products of a cell's coded vectors (rows) with queries, by tables of each query's products with the codebooks."""
        if len(q) >= DECODED_FROM:
            return self.decode(codes, np.full(len(codes), cell)) @ q.T
        m, _, d = self.books.shape
        table = np.einsum("qmd,mcd->mcq", q.reshape(len(q), m, d), self.books)
        return self.centroids[cell] @ q.T + sum(table[j][codes[:, j]] for j in range(m))


class Residuals:
    """How vectors are seen when codebooks are fitted: what their cell's centroid leaves, in ``m`` parts."""

    def __init__(self, centroids: np.ndarray, m: int):
        self.centroids, self.m = centroids, m

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centroids[nearest(x, self.centroids, True)[0]]).reshape(len(x), self.m, -1)


def train_ivf(corpus: DataFrame, nlist: int = 1024, m: int | None = None, nbits: int = 8, train_size: int = 200_000, train_seed: int = 20260731, rounds: int = 10) -> InvertedFile:
    """Centroids, and codebooks of the residuals if there is ``m``, fitted on executors from the seeded training sample; the driver holds no vectors of it."""
    rows = checkpointed(training_sample(corpus, train_size, train_seed))
    n = rows.count()
    if n < nlist or m is not None and n < 1 << nbits:
        raise ValueError("there are fewer training vectors than centroids")
    if m is not None and len(rows.first()[1]) % m:
        raise ValueError("the dimension must be a multiple of m")
    centroids = clustering.fit(rows, nlist, rounds, train_seed, spherical=True)[0]
    if m is None:
        return InvertedFile(centroids)
    return InvertedFile(centroids, clustering.fit(rows, 1 << nbits, rounds, train_seed + 1, view=Residuals(centroids, m)))


def build_ivf(corpus: DataFrame, index: InvertedFile) -> DataFrame:
    """``(vector_id, cell, embedding | codes)`` of every vector; write it partitioned by cell to prune cells at reading."""
    shared = corpus.sparkSession.sparkContext.broadcast(index)  # centroids and codebooks

    def run(batches):
        index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), b.column(0), index.centroids.shape[1]).astype(np.float64)
            cell = nearest(x, index.centroids, True)[0]
            out = {"vector_id": b.column(0), "cell": pa.array(cell.astype(np.int32))}
            if index.books is None:
                out["embedding"] = b.column(1).cast(pa.list_(pa.float32()))
            else:
                codes = index.encode(x, cell).astype(np.int32)
                out["codes"] = pa.array(list(codes), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    what = "embedding array<float>" if index.books is None else "codes array<int>"
    return corpus.select("vector_id", "embedding").mapInArrow(run, f"vector_id long, cell int, {what}")


def _cell_sizes(table: DataFrame, nlist: int) -> np.ndarray:
    sizes = np.zeros(nlist, np.int64)
    for r in table.groupBy("cell").count().collect():  # nlist rows at most
        sizes[r.cell] = r["count"]
    return sizes


def _probed(index: InvertedFile, qmat: np.ndarray, nprobe: int, sizes: np.ndarray | None, max_codes: int) -> np.ndarray:
    """Which cells (rows) which queries (columns) visit; with sizes, as many as :func:`ivf_search` allows."""
    probed = np.zeros((len(index.centroids), len(qmat)), bool)
    for q, cells in enumerate(index.probes(qmat, nprobe)):
        if sizes is not None:
            cells = cells[np.cumsum(sizes[cells]) - sizes[cells] < max_codes]
        probed[cells, q] = True
    return probed


def ivf_visits(table: DataFrame, index: InvertedFile, queries: DataFrame, nprobe: int = 16, max_codes: int = 0) -> DataFrame:
    """``(query_id, visited)``: how many vectors :func:`ivf_search` visits, which is how many hits it has if ``k`` is as large; queries that visit
    none have no row.

    Tasks count their vectors by cell and send a number a query, so rows grow with the queries and not with the pairs.
    """
    if not 0 < nprobe <= len(index.centroids):
        raise ValueError("nprobe is from 1 to nlist")
    spark, parts, nlist = table.sparkSession, [], len(index.centroids)
    sizes = _cell_sizes(table, nlist) if max_codes else None
    for qids, qmat in query_blocks(queries):
        shared = spark.sparkContext.broadcast((index, qids, qmat))  # QUERY_BLOCK vectors at most

        def run(batches, shared=shared):
            index, qids, qmat = shared.value
            here = np.zeros(nlist, np.int64)
            for b in batches:
                here += np.bincount(b.column(0).to_numpy(), minlength=nlist)
            if here.any():
                visited = here @ _probed(index, qmat, nprobe, sizes, max_codes)
                yield pa.RecordBatch.from_pydict({"query_id": qids[visited > 0], "visited": visited[visited > 0]})

        parts.append(table.select("cell").mapInArrow(run, "query_id long, visited long"))
        if len(parts) == BLOCKS_A_PLAN:  # so many scans make one table before more are added
            parts = [checkpointed(_summed(parts))]
    return _summed(parts) if parts else spark.createDataFrame([], "query_id long, visited long")


def _summed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts).groupBy("query_id").agg(F.sum("visited").alias("visited"))


def ivf_search(table: DataFrame, index: InvertedFile, queries: DataFrame, k: int, nprobe: int = 16, max_codes: int = 0) -> DataFrame:
    """Top ``k`` among the ``nprobe`` cells nearest to each query; all cells give the exact result for whole vectors.

    ``max_codes`` over 0 limits how many vectors a query may visit: cells are taken nearest first, and one that would begin
    at or beyond the limit is left out.
    """
    nlist = len(index.centroids)
    if not 0 < nprobe <= nlist:
        raise ValueError("nprobe is from 1 to nlist")
    shared = table.sparkSession.sparkContext.broadcast(index)
    sizes = _cell_sizes(table, nlist) if max_codes else None
    coded = index.books is not None

    def kernel(batches, qids, qmat):
        index = shared.value
        probed = _probed(index, qmat, nprobe, sizes, max_codes)
        held = None
        for b in batches:
            cell = b.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                use = np.flatnonzero(probed[c])
                if not len(use):
                    continue
                mine = pa.array(np.flatnonzero(cell == c))
                ids = b.column(0).take(mine).to_numpy()
                x = matrix(b.column(2).take(mine))
                scores = index.scores(x.astype(np.int64), c, qmat[use]) if coded else x.astype(np.float64) @ qmat[use].T
                part = _best(qids[use], ids, scores, k)
                held = part if held is None else _merged([held, part], k)
        if held is not None:
            yield pa.RecordBatch.from_pydict(held)

    def wanted(qmat):
        return F.col("cell").isin([int(c) for c in np.unique(index.probes(qmat, nprobe))])

    return _scan(table.select("vector_id", "cell", "codes" if coded else "embedding"), queries, k, kernel, None if nprobe == nlist else wanted)


def rescored(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of coarse hits by their whole vectors; only the hits' vectors are read into the join."""
    both = found.select("query_id", "vector_id").join(corpus.select("vector_id", "embedding"), "vector_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return rank(both.select("query_id", "vector_id", F.round(dot(F.col("embedding"), F.col("q")), 9).alias("score")), k)


class Graph:
    """A hierarchical navigable small world (Malkov and Yashunin, 2016) over the inner products of one shard.

    Nodes link to the best of those that come before them, as if they were inserted one after another; a shard's size is bounded, so the candidates
    of all nodes come from one product of its vectors instead of a search for each.
    """

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers  # of each layer the nodes, where their links begin, and all links
        self.place = []
        for nodes, _, _ in layers:
            at = np.full(len(x), -1)
            at[nodes] = np.arange(len(nodes))
            self.place.append(at)

    @classmethod
    def built(cls, x: np.ndarray, m: int, ef: int, seed: int = 0) -> "Graph":
        n = len(x)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(max(m, 2))).astype(int)
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k)
            linked = _linked(x[nodes], m, 2 * m if k == 0 else m, ef)
            layers.append((nodes, np.cumsum([0, *map(len, linked)]), nodes[np.array([o for part in linked for o in part], np.int64)]))
        return cls(x, layers)

    def links(self, node: int, layer: int) -> list[int]:
        _, starts, to = self.layers[layer]
        at = self.place[layer][node]
        return to[starts[at] : starts[at + 1]].tolist()

    def _reach(self, q: np.ndarray, start: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` best nodes found from ``start``, best first."""
        seen, kept = set(start), [(float(self.x[s] @ q), s) for s in start]
        todo = [(-d, s) for d, s in kept]
        heapq.heapify(todo), heapq.heapify(kept)
        while todo and (len(kept) < ef or -todo[0][0] >= kept[0][0]):
            fresh = [o for o in self.links(heapq.heappop(todo)[1], layer) if o not in seen]
            seen.update(fresh)
            for s, o in zip((self.x[fresh] @ q).tolist() if fresh else [], fresh):
                if len(kept) < ef:
                    heapq.heappush(kept, (s, o)), heapq.heappush(todo, (-s, o))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, o)), heapq.heappush(todo, (-s, o))
        return sorted(kept, key=lambda b: (-b[0], b[1]))

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if not len(self.x):
            return []
        start = [int(self.layers[-1][0][0])]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = [self._reach(q, start, 1, layer)[0][1]]
        return self._reach(q, start, max(ef, k), 0)[:k]


def _spread(order: np.ndarray, to: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of nodes, best first, those that are nearer to the node than to each other, then others; ``to`` are the products with the node."""
    chosen: list[int] = []
    for o in order.tolist():
        if len(chosen) == most:
            return chosen
        if not chosen or (between[o, chosen] <= to[o]).all():
            chosen.append(o)
    taken = set(chosen)
    return chosen + [o for o in order.tolist() if o not in taken][: most - len(chosen)]


def _linked(x: np.ndarray, m: int, most: int, ef: int) -> list[list[int]]:
    """Each node's links: ``m`` of the best ``ef`` before it, and back; ``most`` at most."""
    near = x @ x.T
    links: list[list[int]] = [[] for _ in x]
    for i in range(1, len(x)):
        to = near[i, :i]
        best = np.argpartition(-to, ef)[:ef] if i > ef else np.arange(i)
        own = _spread(best[np.argsort(-to[best], kind="stable")], near[i], near, m)
        links[i] += own
        for o in own:
            links[o].append(i)
    for i, mine in enumerate(links):
        if len(mine) > most:
            mine = np.array(mine)
            links[i] = _spread(mine[np.argsort(-near[i, mine], kind="stable")], near[i], near, most)
    return links


GRAPHS = "shard string, cell int, dimension int, ids binary, vectors binary, sizes array<int>, nodes binary, starts binary, links binary"


def _graph_row(ids: np.ndarray, x: np.ndarray, m: int, ef: int, cell: int) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, np.float32)
    g = Graph.built(x.astype(np.float64), m, ef)
    flat = [np.concatenate([np.asarray(layer[j], np.int32) for layer in g.layers]).tobytes() for j in range(3)]
    return pa.RecordBatch.from_pydict({
        "shard": [f"{ids.min()}-{ids.max()}"], "cell": pa.array([cell], pa.int32()), "dimension": pa.array([x.shape[1]], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "vectors": [x.tobytes()],
        "sizes": pa.array([[len(layer[0]) for layer in g.layers]], pa.list_(pa.int32())), "nodes": [flat[0]], "starts": [flat[1]], "links": [flat[2]],
    })


def build_graphs(corpus: DataFrame, m: int = 32, ef_construction: int = 200, shard: int = 4096) -> DataFrame:
    """A row for each ``shard`` vectors of a task: their ids, vectors and graph; to be written, or checkpointed, and searched. Every query visits every graph, see :func:`build_routed`."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, shard):
                piece = b.slice(at, shard)
                yield _graph_row(piece.column(0).to_numpy(), matrix(piece.column(1), piece.column(0)), m, ef_construction, 0)

    return corpus.select("vector_id", "embedding").mapInArrow(run, GRAPHS)


@dataclass(frozen=True)
class Router:
    """Which shards a query visits: a graph over the shards' centroids, small enough for every task."""

    centroids: np.ndarray
    graph: Graph

    @classmethod
    def over(cls, centroids: np.ndarray, m: int = 16) -> "Router":
        return cls(centroids, Graph.built(centroids, m, 4 * m))

    def visits(self, q: np.ndarray, most: int) -> list[np.ndarray]:
        """The cells whose centroids have the largest products with each query, as the graph finds them."""
        return [np.array([n for _, n in self.graph.search(v, most, max(4 * most, 32))], np.int64) for v in q]


def train_router(corpus: DataFrame, shards: int, train_size: int = 200_000, train_seed: int = 20260731, rounds: int = 10) -> Router:
    """Centroids of the shards, fitted on executors from the seeded sample, and the graph over them."""
    rows = checkpointed(training_sample(corpus, train_size, train_seed))
    return Router.over(clustering.fit(rows, shards, rounds, train_seed, spherical=True)[0])


def build_routed(corpus: DataFrame, router: Router, m: int = 32, ef_construction: int = 200, shard: int = 4096, border: float = 0.05) -> DataFrame:
    """``GRAPHS`` of shards around centroids. A vector near the border to a second centroid (their products differ by less than ``border``)
    is a node of both shards, so that ways lead across.

    A cell of more vectors than ``shard`` is dealt to several graphs by a hash, which a query visits together.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(router.centroids)

    def assign(batches):
        c = shared.value
        for b in batches:
            for at in range(0, b.num_rows, step := max(1, clustering.STEP // len(c))):
                piece = b.slice(at, step)
                score = matrix(piece.column(1), piece.column(0), c.shape[1]).astype(np.float64) @ c.T
                rows = np.arange(len(score))
                first = score.argmax(axis=1)
                best = score[rows, first]
                score[rows, first] = -np.inf
                second = score.argmax(axis=1)
                cells = [[int(x)] + ([int(y)] if len(c) > 1 and near < border else []) for x, y, near in zip(first, second, best - score[rows, second])]
                yield pa.RecordBatch.from_pydict({"vector_id": piece.column(0), "embedding": piece.column(1).cast(pa.list_(pa.float32())), "cells": pa.array(cells, pa.list_(pa.int32()))})

    assigned = checkpointed(corpus.select("vector_id", "embedding").mapInArrow(assign, "vector_id long, embedding array<float>, cells array<int>"))
    rows = assigned.select("vector_id", "embedding", F.explode("cells").alias("cell"))
    parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("parts")))  # a row a centroid
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vector_id"), "parts"))

    def run(key, table):
        table = table.sort_by("vector_id")
        return pa.Table.from_batches([_graph_row(table.column("vector_id").to_numpy(), matrix(table.column("embedding"), table.column("vector_id")), m, ef_construction, key[0].as_py())])

    return dealt.groupBy("cell", "part").applyInArrow(run, GRAPHS)


def routed_search(graphs: DataFrame, router: Router, queries: DataFrame, k: int, ef_search: int = 64, visits: int | None = None) -> DataFrame:
    """Approximate top ``k``: each query visits the ``visits`` shards that the router finds for it (a quarter of them, one at least, by default); a block reads only the shards that its queries visit."""
    visits = visits or max(1, len(router.centroids) // 4)
    shared = graphs.sparkSession.sparkContext.broadcast(router)

    def kernel(batches, qids, qmat):
        asked: dict[int, list[int]] = {}
        for q, cells in enumerate(shared.value.visits(qmat, visits)):
            for c in cells.tolist():
                asked.setdefault(c, []).append(q)
        held = None
        for b in batches:
            for row in b.to_pylist():
                mine = asked.get(row["cell"])
                if mine:
                    part = _graph_hits(row, qids[mine], qmat[mine], k, ef_search)
                    held = part if held is None else _merged([held, part], k, True)
        if held is not None:
            yield pa.RecordBatch.from_pydict(held)

    def wanted(qmat):
        return F.col("cell").isin([int(c) for c in np.unique(np.concatenate(router.visits(qmat, visits)))])

    return _scan(graphs, queries, k, kernel, wanted, True)


def visited_shards(router: Router, queries: DataFrame, visits: int) -> DataFrame:
    """``(query_id, cell)`` of the shards that each query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        for b in batches:
            found = shared.value.visits(matrix(b.column(1), b.column(0)).astype(np.float64), visits) if b.num_rows else []
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_pydict({"query_id": b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), "cell": pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32())})

    return queries.select("query_id", "embedding").mapInArrow(run, "query_id long, cell int")


def _opened(row: dict) -> tuple[np.ndarray, Graph]:
    x = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dimension"]).astype(np.float64)
    nodes, starts, links = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("nodes", "starts", "links"))
    layers, a, s, t = [], 0, 0, 0
    for n in row["sizes"]:
        begin = starts[s : s + n + 1]
        layers.append((nodes[a : a + n], begin, links[t : t + begin[-1]]))
        a, s, t = a + n, s + n + 1, t + begin[-1]
    return np.frombuffer(row["ids"], np.int64), Graph(x, layers)


def _graph_hits(row: dict, qids: np.ndarray, qmat: np.ndarray, k: int, ef: int) -> dict:
    ids, graph = _opened(row)
    q, s, i = (np.array(c) for c in zip(*[(q, s, ids[n]) for q, v in zip(qids.tolist(), qmat) for s, n in graph.search(v, k, ef)]))
    return {"query_id": q.astype(np.int64), "vector_id": i.astype(np.int64), "score": np.round(s.astype(np.float64), 9)}


def graph_search(graphs: DataFrame, queries: DataFrame, k: int, ef_search: int = 64) -> DataFrame:
    """Approximate top ``k`` over a table of graphs: each is searched, the best merged."""

    def kernel(batches, qids, qmat):
        held = None
        for b in batches:
            for row in b.to_pylist():
                part = _graph_hits(row, qids, qmat, k, ef_search)
                held = part if held is None else _merged([held, part], k)
        if held is not None:
            yield pa.RecordBatch.from_pydict(held)

    return _scan(graphs, queries, k, kernel)


def hnsw_search(corpus: DataFrame, queries: DataFrame, k: int, m: int = 32, ef_construction: int = 200, ef_search: int = 64, block: int = 4096) -> DataFrame:
    """Graphs built for this search alone; :func:`build_graphs` keeps them for others."""
    return graph_search(checkpointed(build_graphs(corpus, m, ef_construction, block)), queries, k, ef_search)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the mean share of each query's exact hits that were found, and the least."""
    both = exact.select("query_id", "vector_id").join(found.select("query_id", "vector_id", F.lit(1).alias("hit")), ["query_id", "vector_id"], "left")
    each = both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return each.agg(F.count("*").alias("queries"), F.avg("r").alias("mean_recall"), F.min("r").alias("least_recall"))


def id_violations(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Ids that occur twice in a batch, or in the index already."""
    twice = new.groupBy("vector_id").count().where("count > 1").select("vector_id")
    return twice if old is None else twice.union(new.select("vector_id").join(old.select("vector_id"), "vector_id", "left_semi")).distinct()
