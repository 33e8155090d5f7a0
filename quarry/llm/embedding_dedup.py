"""Near-duplicate embeddings by product quantisation: coarse inverted lists, residual codes, table lookups, exact cosine rerank.

1. Rows with the same label and vector are one member with a count, merged before they are shuffled. 2. Coarse centroids and residual codebooks are
fitted on executors on at most ``FIT_ROWS`` members, those with the least hash of their vector; every member is indexed: it lies in the list of its nearest centroid, with a code of
``PARTS`` sub-vectors and the exact length of what the code leaves. 3. Members probe other lists of their label. Two unit vectors of cosine ``c`` are ``sqrt(2 - 2c)`` apart, so
at least one of them is within half of that of the plane between their two centroids: a member probes every list whose plane is so near,
which is sufficient, as no link can be missed; the number of probes isn't capped. 4. In a list, tables of products of a query's sub-vectors with the
codebooks give a member's product with the query up to the length of what its code leaves (Cauchy-Schwarz), so only members that can't reach the
threshold are dropped. 5. The others are compared by their whole vectors in double precision. A pair met in two lists counts in the lower one.

Large lists are cut into parts of about ``PART_ROWS`` members, and pairs of parts are compared in different tasks. Links aren't emitted: a block returns for each vector
how many links it has, weighted by copies, and one edge of a forest that connects what is linked. Connected components of these give the classes.
Comparing the members of one group of different, near vectors takes a number of products that is the square of their number; nothing else grows so.

Edge cases: rows whose label or vector is null, whose vector is empty, zero or has null or non-finite entries link with nothing and are their own
component; vectors of different length never link; repeated ids are rows of their own; a null id comes out as null, is a component's id only if no other id is in it, and is kept only there;
very long vectors are padded with zeros to whole parts; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import matrix
from quarry.llm.common import checkpointed, components, spread_join
from quarry.operators import clustering

FIT_ROWS, FIT_ROWS_A_TASK, FIT_ROUNDS = 65_536, 4096, 4
#: Members a list should have, over all labels, and the bounds of the number of lists: each task holds all centroids.
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 512, 4, 4096
PARTS, CODES = 8, 256
PART_ROWS = 1024
#: Queries whose tables a task makes at once, and pairs that it reranks at once.
TABLES, PAIRS = 128, 16_384
SLACK = 1e-9
SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"
MEMBER = "u long, home int, probes array<int>, code binary, rest double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, also of very large and very small entries."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


class UnitRows:
    """How vectors are seen when coarse centroids are fitted."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return unit(x)[:, None, :]


class UnitRests:
    """How they are seen when codebooks are fitted: what the nearest centroid leaves, in parts."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def __call__(self, x: np.ndarray) -> np.ndarray:
        u = unit(x)
        return _padded(u - self.centroids[clustering.nearest(u, self.centroids)[0]]).reshape(len(u), PARTS, -1)


def probes(u: np.ndarray, centroids: np.ndarray, apart: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's nearest centroid, and the others whose bisector with it is within half of ``apart``."""
    home, near = clustering.nearest(u, centroids)[0], []
    between = np.sqrt(np.maximum((centroids**2).sum(axis=1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(axis=1), 0))
    step = max(1, clustering.STEP // len(centroids))
    for at in range(0, len(u), step):
        mine = home[at : at + step]
        half = (centroids**2).sum(axis=1) / 2 - u[at : at + step] @ centroids.T
        # |x - c_j|^2 - |x - c_i|^2 is twice the distance to the bisector times the centroids' distance.
        close = half - half[np.arange(len(mine)), mine][:, None] <= (apart / 2 + SLACK) * between[mine]
        close[np.arange(len(mine)), mine] = False
        near += [np.flatnonzero(row) for row in close]
    return home, near


def valid(label: str, vector: str):
    """Whether a row can link with any."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def _members(distinct: DataFrame, apart: float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``MEMBER`` of all vectors ``(u, v)`` of one length, with the centroids and codebooks that they are coded by."""
    n = distinct.count()
    few = checkpointed(distinct.orderBy(F.xxhash64("v"), "u").limit(FIT_ROWS)) if n > FIT_ROWS else distinct
    few = few.coalesce(max(1, min(n, FIT_ROWS) // FIT_ROWS_A_TASK))  # a bounded table; each task returns its sums for every centroid
    lists = max(1, min(n, MOST_LISTS, max(LEAST_LISTS, n // LIST_ROWS)))
    centroids = clustering.fit(few, lists, FIT_ROUNDS, view=UnitRows())[0]
    books = clustering.fit(few, min(CODES, n), FIT_ROUNDS, seed=1, view=UnitRests(centroids))
    shared = distinct.sparkSession.sparkContext.broadcast((centroids, books))  # MOST_LISTS + CODES vectors at most

    def run(batches):
        centroids, books = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                u = unit(matrix(part.column(1), part.column(0)))
                home, near = probes(u, centroids, apart)
                rest = _padded(u - centroids[home]).reshape(len(u), PARTS, -1)
                code = np.stack([clustering.nearest(rest[:, j], books[j])[0] for j in range(PARTS)], axis=1).astype(np.uint8)
                left = np.sqrt(((rest - np.stack([books[j][code[:, j]] for j in range(PARTS)], axis=1)) ** 2).sum(axis=(1, 2)))
                yield pa.RecordBatch.from_pydict({"u": part.column(0), "home": pa.array(home.astype(np.int32)), "probes": pa.array(near, pa.list_(pa.int32())), "code": pa.array([c.tobytes() for c in code], pa.binary()), "rest": pa.array(left)})

    return distinct.mapInArrow(run, MEMBER), centroids, books


def linked_pairs(q: np.ndarray, y: np.ndarray, code: np.ndarray, rest: np.ndarray, centroid: np.ndarray, books: np.ndarray, cosine: float, ahead: bool):
    """Pairs ``(row of q, row of y)`` with the cosine or more, in bounded steps; with ``ahead``, ``y`` is ``q`` and only later rows count."""
    parts = books.shape[0]
    for at in range(0, len(q), TABLES):
        some = q[at : at + TABLES]
        table = np.einsum("qmd,mkd->mqk", _padded(some).reshape(len(some), parts, -1), books)
        most = (some @ centroid)[:, None] + rest[None, :] + SLACK
        for j in range(parts):
            most += table[j][:, code[:, j]]
        can = most >= cosine
        if ahead:
            can &= np.arange(at, at + len(some))[:, None] < np.arange(len(y))
        i, k = np.nonzero(can)
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], k[s : s + PAIRS]
            hit = np.einsum("nd,nd->n", some[a], y[b]) >= cosine
            yield a[hit] + at, b[hit]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of ``n`` over links ``(a, b)``: minima are passed on and ways halved until nothing changes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(key, table: pa.Table, model, cosine: float) -> pa.Table:
    """``(u, n, other)`` of the vectors of one block that have links: their number, and an edge to another."""
    centroids, books = model
    cell, left, right = (key[k].as_py() for k in (1, 2, 3))
    part, home, mult = (table.column(c).to_numpy() for c in ("part", "home", "mult"))
    x = unit(matrix(table.column("v"), table.column("u")))
    member = home == cell
    code = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()]).reshape(len(x), -1)
    rest, u = table.column("rest").to_numpy(), table.column("u").to_numpy()
    sides = [(np.flatnonzero(member & (part == left)), np.flatnonzero(member & (part == right)), left == right)]
    if left == right:
        sides.append((np.flatnonzero(~member), sides[0][1], False))
    probed = table.column("probes").to_pylist()
    found = []
    for qs, ys, ahead in sides:
        for a, b in linked_pairs(x[qs], x[ys], code[ys], rest[ys], centroids[cell], books, cosine, ahead):
            a, b = qs[a], ys[b]
            # A visitor that the member visits as well is counted where it lies if that list comes first.
            once = np.array([h == cell or h > cell or h not in probed[k] for h, k in zip(home[a].tolist(), b.tolist())], bool)
            found.append((a[once], b[once]))
    a, b = (np.concatenate([f[s] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for s in (0, 1))
    links = np.zeros(len(x), np.int64)
    np.add.at(links, a, mult[b]), np.add.at(links, b, mult[a])
    root = forest(len(x), a, b)
    own = np.flatnonzero(links)
    return pa.table({"u": u[own], "n": links[own], "other": u[root[own]]})


def _links(members: DataFrame, model, cosine: float) -> DataFrame:
    """``(u, n, other)`` of all blocks; ``members`` are ``MEMBER`` with label, mult and v."""
    spark = members.sparkSession
    lists = members.groupBy("label", "home").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    lists = lists.select(F.xxhash64("label", "home").alias("list"), F.col("label").alias("_label"), F.col("home").alias("cell"), "parts")
    own = F.struct(F.col("home").alias("cell"), F.lit(True).alias("lies"))
    visits = F.transform("probes", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("lies")))
    at = members.select("u", "label", F.explode(F.concat(F.array(own), visits)).alias("at")).withColumn("list", F.xxhash64("label", "at.cell"))
    # A list of a third of all rows is split at run time; vectors join when it is known where they go.
    met = spread_join(at, lists, "list").where((F.col("label") == F.col("_label")) & (F.col("at.cell") == F.col("cell")))
    part = F.pmod(F.xxhash64("u"), F.col("parts").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(every, lambda p: F.struct(F.least(p, part).alias("a"), F.greatest(p, part).alias("b")))
    alone = F.transform(every, lambda p: F.struct(p.alias("a"), p.alias("b")))
    sent = met.select("u", "cell", part.alias("part"), F.explode(F.when(F.col("at.lies"), pairs).otherwise(alone)).alias("block"))
    blocks = sent.join(members, "u").select("label", "cell", "block.a", "block.b", "part", "u", "home", "probes", "mult", "v", "code", "rest")
    shared = spark.sparkContext.broadcast(model)
    return blocks.groupBy("label", "cell", "a", "b").applyInArrow(lambda key, table: _block(key, table, shared.value, cosine), "u long, n long, other long")


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``SCHEMA``, a row for each input row; ``cosine`` is over 0."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine is over 0 and at most 1")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", valid("label", "v"))
    keys = [F.when(F.col("ok"), F.xxhash64(F.lit(k), "label", "v")).alias(f"k{k}") for k in (1, 2)]
    keyed = rows.select("vec_id", "label", "v", "ok", *keys)
    distinct = keyed.where("ok").groupBy("k1", "k2").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    distinct = checkpointed(distinct.withColumn("u", F.monotonically_increasing_id()))
    found, apart = None, math.sqrt(2 - 2 * cosine)
    for d in [r.d for r in distinct.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]:  # nearly always one length
        same = distinct.where(F.size("v") == d)
        members, centroids, books = _members(same.select("u", "v"), apart)
        links = _links(checkpointed(members.join(same.select("u", "label", "mult", "v"), "u")), (centroids, books), cosine)
        found = links if found is None else found.union(links)
    if found is None:
        found = df.sparkSession.createDataFrame([], "u long, n long, other long")
    found = checkpointed(found)
    roots = components(found.select("u", "other"), "u", "other").withColumnRenamed("node", "u")
    classes = distinct.select("u", "k1", "k2", "mult", "least").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    named = spread_join(classes, least, "root").join(counts, "u", "left")
    named = named.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "ok", "k1", "k2").join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
