"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id counts as where ids are ordered.
NULL_ID = (1 << 63) - 1


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set, read only through Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session, or our own where it is unset and the session is local.

    A cluster without such a folder raises: what one machine writes to its own disk, the others can't read.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join("/tmp", "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Whether what a query has shuffled goes from the local disks when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so a lost executor costs no recomputation; nothing needs what was shuffled for it then, so that goes at once."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is taken where a query is made
    finally:
        spark.conf.set(CLEANUP, before)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one pruned scan, one number to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]


def blocks_for(df: DataFrame, text: str, target: int) -> int:
    """How many blocks of about ``target`` bytes of text the input makes; grows with the input."""
    return max(4, -(-text_bytes(df, text) // target))


#: Tasks of a stage that deals with blocks, at most: beyond, a task has more blocks, one after another, and needs no more memory for it.
MOST_TASKS = 200_000


def tasks_for(spark: SparkSession, blocks: int) -> int:
    """How many tasks blocks are dealt to: two blocks a task, so that what a task reads stays level, and no core without one where there are enough."""
    return max(1, min(MOST_TASKS, -(-blocks // 2)), min(blocks, spark.sparkContext.defaultParallelism))


def in_batches(fn, rows: int = 256):
    """Wraps ``fn(RecordBatch) -> dict of arrays`` for mapInArrow over bounded slices, so that a
    Python worker holds few texts at a time however large Arrow's batches are."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), so that low and high bits are equally random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """The rows with the columns that an aggregate by ``key`` has for theirs.

    An aggregate's rows lie by its key, and a join that relies on that can't split a frequent key. Both sides are dealt by a hash of the
    key instead, so that the rows of such a key are split at run time.
    """
    by = lambda k: F.xxhash64(F.lit(3), F.col(k)).alias("_by")
    found = keyed.select(by(key), F.col(key).alias("_key"), *[c for c in keyed.columns if c != key])
    return rows.select("*", by(key)).join(found, "_by").where(F.col(key) == F.col("_key")).drop("_by", "_key")


#: Edges, of two longs each, that a task joins in memory at once.
EDGES_AT_ONCE = 500_000


def _forest(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    """``(u, v)`` edges, u > v, that connect what the given edges connect: each node with the least reachable; union by the smaller, with path halving."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    nodes = [n for n in root if find(n) != n]
    return pa.RecordBatch.from_pydict({"u": pa.array(nodes, pa.int64()), "v": pa.array([find(n) for n in nodes], pa.int64())})


def joined_edges(batches):
    """A task's edges as forests, of a bounded number of edges each: fewer edges and shorter ways, with the same components."""
    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        if len(held) >= EDGES_AT_ONCE:
            yield _forest(held)
            held = []
    if held:
        yield _forest(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as ``(node, root)``, root the smallest node reachable.

    Each task joins the edges it has; then large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014) until the edge set stays as it is, the same way at every size. Every step aggregates before it shuffles
    and is checkpointed to the shared folder; the driver sees two numbers a round. A root with very many nodes is split at
    run time. Edge lists without rows give no rows. Self-loops and repeated edges are ignored. Each round shortens the longest way to a root
    by a constant factor; after ``most_rounds`` rounds, far more than a graph of 2 ** 50 nodes takes, it raises ``RuntimeError``.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    e = checkpointed(e.mapInArrow(joined_edges, "u long, v long").distinct())
    seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds if seen[0] else 0):
        both = e.union(e.select("v", "u"))  # u's neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread_join(large, down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
