"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (itself and its 64 one-bit
flips for radius 2). Two fingerprints within the radius share a variant, so one shuffle on the
variant finds every link; a variant's bucket holds at most 65 distinct fingerprints, however many
documents carry them. Within a bucket each fingerprint is linked to the next smaller one after its
Hamming distance is verified; other pairs of the bucket are connected through these.

Components end with an error, not a wrong answer, should they not settle (:func:`~quarry.llm.common.components`).

Edge cases: very long texts are hashed whole, their counts in slices; null or empty texts have fingerprint zero and link like any other; texts of fewer than
three words hash their whole word sequence; rows with the same ``doc_id`` are rows of their own; null ids
come out as null and never become a component's id unless no other id is in it; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, components, in_batches, spread_join

VARIANTS_A_TASK = 1_000_000
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=">u8")
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        counts += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, tie)``: the fingerprint of each whole text as a signed long, and Spark's hash of the text."""

    def run(batch):
        fps = [simhash(t, shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "tie": batch.column(2)}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    return picked.mapInArrow(in_batches(run), "doc_id long, fp long, tie long")


def ball(radius: int) -> list[int]:
    """XOR masks, as signed longs, of all variants within ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct_fp: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits.

    ``radius`` is even; a bucket's members lie within ``radius`` of each other, so a chain through them
    loses no connection.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    # Each row becomes many: the number of tasks follows the rows that are made, not the few bytes that are read.
    tasks = max(4, -(-distinct_fp.count() * len(ball(radius // 2)) // VARIANTS_A_TASK))
    spread = distinct_fp.select("fp").repartition(tasks, "fp")
    variants = spread.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id, tie)``, one row per input row; ``tie``, a hash of the text, tells rows of one id apart.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` differing
    bits, the document's own included.
    """
    docs = fingerprints(df, id_col, text_col, shingle)
    docs = checkpointed(docs)  # the texts are read once
    distinct_fp = docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct_fp.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = distinct_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spread_join(classes, least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id", "tie")
