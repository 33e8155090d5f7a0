"""Near-duplicates by the Jaccard similarity of word shingles: SimHash blocks that meet in the middle find pairs, whole shingle sets verify them.

At a similarity of 0.8 two fingerprints differ in up to 15.2% of their bits, about 10 of 64, and a half-radius ball of that has millions of
variants. So a fingerprint is wide and cut into blocks, and the balls are those of the blocks.

1. Texts without company are left out exactly: of two sets with the similarity, each has a known number of the other's shingles among its least ones, so
these are looked up first, and whole sets only of the texts that are left. 2. A SimHash has ``BLOCKS`` blocks of ``WIDTH`` bits; a bit is the
sign of the sum of a signed byte for each shingle, so it follows the angle of the sets also where they are small. 3. Every text emits all variants of each
block within one bit; two texts with a block in which at most two bits differ share a variant. At 0.8 a block is such a one with a
probability of 0.27, so a pair is missed about 5 times in 10,000, and less often above (0.85: 8 in a million); this is the only loss.
4. Pairs that share a variant are within the sizes' bounds, differ in at most ``MOST_BITS`` bits of the whole fingerprint (3.5 deviations above the mean at 0.8: 2 pairs in 10,000 have more), and aren't connected yet are
verified by the exact similarity of their sets. Where such pairs would be many (a large group of edited copies), texts are first linked to a neighbour in their
bucket, in another order each time; what is still apart is then compared. 5. Connected components of the verified links.

Edge cases: very long texts have all their shingles, summed in slices; null, empty and blank texts have no shingle and link with each other only; texts of fewer words
than a shingle have their whole word sequence as the one shingle; rows with the same ``doc_id`` are rows of their own; null ids come out as null and
never become a component's id unless no other id is in it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, components, in_batches, mix64, spread_join
from quarry.llm.minhash_dedup import _longs, homes, shingle_sets, shingles, verified, with_company
from quarry.llm.simhash_dedup import VARIANTS_A_TASK

BLOCKS, WIDTH = 24, 24
#: Bits in which the whole fingerprints of a pair differ at most.
MOST_BITS = 117
#: Seeds of the hashes that a shingle's bytes are made of.
SEEDS = mix64(np.arange(1, BLOCKS * WIDTH // 8 + 1, dtype=np.uint64))
#: Shingles whose bytes are summed at once.
SLICE = 1024
#: The share of a set's shingles beyond the shortest prefix that is looked up: a longer prefix leaves fewer texts.
MORE = 0.1
#: Pairs a bucket row up to which all are compared at once, and the most rounds that link neighbours only.
PAIRS_A_MEMBER, NEIGHBOUR_ROUNDS = 16, 2


def blocks(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes, as ``BLOCKS`` integers of ``WIDTH`` bits."""
    total = np.full(BLOCKS * WIDTH, len(hashes), np.int64)  # twice the sum of bytes that are -0.5 on average
    for at in range(0, len(hashes), SLICE):
        total += 2 * mix64(hashes[at : at + SLICE, None] ^ SEEDS).view(np.int8).sum(axis=0, dtype=np.int64)
    return (total > 0).reshape(BLOCKS, WIDTH) @ (1 << np.arange(WIDTH))


def looked_up(n: int, similarity: float) -> tuple[int, int]:
    """How many of the least of ``n`` shingles are looked up, and how many of them any set with the similarity has among its own looked up.

    The sets share at least ``similarity`` of the larger's shingles, so the k-th least that they share lies among the first ``n - similarity * n + k`` of either.
    """
    up = lambda x: math.ceil(x - 1e-9)
    return min(n, n - up(similarity * n) + max(1, up(MORE * n))), max(1, up(MORE * similarity * n))


def masks() -> Column:
    """The XOR masks of all variants of a block within one bit."""
    return F.array(*[F.lit(m) for m in (0, *(1 << b for b in range(WIDTH)))])


def bucketed(marked: DataFrame) -> DataFrame:
    """``(key, tie, value, n, size, shared, blocks)`` of all variants that several texts have; ``n`` is how many have it.

    What a text's pairs are judged by travels with its variants, so that no row of a bucket is joined with its text or its bucket again.
    """
    tasks = max(4, -(-marked.count() * BLOCKS * (WIDTH + 1) // VARIANTS_A_TASK))
    own = ["tie", "size", "shared", "blocks"]
    each = marked.select(own).repartition(tasks, "tie").select(*own, F.posexplode("blocks").alias("block", "value"))
    each = each.select(*own, "block", "value", F.explode(masks()).alias("mask")).withColumn("variant", F.col("value").bitwiseXOR(F.col("mask")))
    key = (F.shiftleft(F.col("block").cast("long"), 32) + F.col("variant")).alias("key")
    rows = each.select(key, *own, "value").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    return checkpointed(rows.select("key", "tie", "value", "n", "size", "shared", "blocks"))


def links(distinct: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(node, root)`` of all texts of ``distinct`` (tie, need, least) that are linked to another."""
    spark = distinct.sparkSession
    each = distinct.select("tie", "need", F.explode("least").alias("x")).withColumn("others", F.count("*").over(Window.partitionBy("x")) > 1)
    wanted = checkpointed(each.where("others").groupBy("tie", "need").count().where("count >= need").select("tie"))
    sets = shingle_sets(texts, wanted, shingle)
    company = with_company(sets, similarity)

    def run(batch):
        lists = batch.column(1)
        values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
        return {"tie": batch.column(0), "blocks": pa.array([blocks(values[a:b]).tolist() for a, b in zip(ends, ends[1:])], pa.list_(pa.int32()))}

    marked = sets.join(company.select("tie"), "tie", "left_semi").mapInArrow(in_batches(run), "tie long, blocks array<int>")
    marked = checkpointed(marked.join(company, "tie"))
    members = bucketed(marked)
    n_members = members.count()
    places = homes(members)
    found, roots = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")

    def near(p: str, q: str) -> Column:
        """Whether two sets can be as similar, by their sizes and by what either shares with any other."""
        most = F.least(F.col(f"{p}shared"), F.col(f"{q}shared"))
        return most >= F.lit(similarity) * (F.col(f"{p}size") + F.col(f"{q}size") - most)

    def apart(p: str, q: str) -> Column:
        """The bits that differ, by block."""
        return F.zip_with(f"{p}blocks", f"{q}blocks", lambda x, y: F.bit_count(x.bitwiseXOR(y)))

    for k in range(NEIGHBOUR_ROUNDS + 1):
        if k == 0:  # nothing is connected yet, so all rows of all buckets are apart
            left = members.withColumn("root", F.col("tie"))
            n_pairs = members.agg(F.coalesce(F.sum((F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        else:
            named = members.join(roots.withColumnRenamed("node", "tie"), "tie", "left").withColumn("root", F.coalesce("root", "tie"))
            bucket = Window.partitionBy("key")
            named = named.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)})
            left = checkpointed(named.where("low < high").drop("low", "high"))
            members = left.drop("root")  # a bucket of one group stays one
            counted = left.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
            n_pairs = counted.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        if n_pairs == 0:
            break
        last = n_pairs <= PAIRS_A_MEMBER * n_members or k == NEIGHBOUR_ROUNDS
        if last:
            other = left.select("key", *[F.col(c).alias(f"b_{c}") for c in ("tie", "value", "size", "shared", "root", "blocks")])
            # A pair with several keys is made once: in the first block that is near, at the lesser of the variants that are shared.
            variant, both = F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), F.col("value").bitwiseXOR(F.col("b_value"))
            lesser = F.when(both == 0, variant == F.col("value")).otherwise(variant < variant.bitwiseXOR(both))
            first = F.array_position(F.transform(apart("", "b_"), lambda d: d <= 2), True) == F.shiftright("key", 32) + 1
            close = F.aggregate(apart("", "b_"), F.lit(0), lambda s, d: s + d) <= MOST_BITS
            pairs = left.join(other, "key").where((F.col("tie") < F.col("b_tie")) & (F.col("root") != F.col("b_root")) & lesser & near("", "b_") & first & close)
            pairs = pairs.select(F.col("tie").alias("a"), F.col("b_tie").alias("b"))
        else:
            order = Window.partitionBy("key").orderBy(F.xxhash64("tie", F.lit(k)))
            before = left.withColumn("p", F.lag(F.struct("tie", "size", "shared", "root", "blocks")).over(order)).where("p is not null and p.root <> root")
            close = F.aggregate(apart("", "p."), F.lit(0), lambda s, d: s + d) <= MOST_BITS
            pairs = before.where(near("", "p.") & close).select(F.least("tie", "p.tie").alias("a"), F.greatest("tie", "p.tie").alias("b"))
        pairs = checkpointed(pairs.distinct())
        found = checkpointed(found.union(verified(pairs, sets, places, similarity)))
        roots = components(found)
        if last:
            break
    return roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id, tie)``, one row per input row; ``tie``, a hash of the text, tells rows of one id apart.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at least ``similarity``, the document's own included.
    """

    def run(batch):
        need, least = [], []
        for t in batch.column(1).to_pylist():
            s = shingles(t, shingle)
            most, few = looked_up(len(s), similarity)
            need.append(few)
            least.append(s[:most] if len(s) else np.zeros(1, np.uint64))  # texts without a shingle have each other's company
        return {"doc_id": batch.column(0), "tie": batch.column(2), "need": pa.array(need, pa.int32()), "least": _longs(least)}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    docs = checkpointed(picked.mapInArrow(in_batches(run), "doc_id long, tie long, need int, least array<long>"))
    distinct = docs.groupBy("tie").agg(F.min("doc_id").alias("least_id"), F.first("need").alias("need"), F.first("least").alias("least"))
    distinct = checkpointed(distinct)
    roots = links(distinct, picked.select("tie", "text"), shingle, similarity).withColumnRenamed("node", "tie")
    classes = distinct.select("tie", "least_id").join(roots, "tie", "left").withColumn("root", F.coalesce("root", "tie"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spread_join(classes, least, "root").select("tie", "component_id")
    return docs.select("doc_id", "tie").join(named, "tie").select("doc_id", "component_id", "tie")
