"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find pairs, whole shingle sets verify them.

A text's set holds the hashes of its ``shingle``-word shingles, lower-cased as in ``simhash_dedup``. SimHash can't find
such pairs by balls: at a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, and a half-radius ball of that has
millions of variants.

1. Every distinct text emits ``BANDS`` keys of ``ROWS`` minima each. A pair of similarity s shares none with probability
(1 - s ** ROWS) ** BANDS, 3 in a million at 0.8 and less above; this is the only loss. 2. Of texts that share a key with another, those are
left out that can't be similar to any: too few of their shingles are in a second set. What a set shares with any other also bounds
the similarity of a pair, so edited copies of one text, each too far from the others, make few pairs. 3. Pairs that share a key, are within
the bounds and aren't connected yet are verified by the exact similarity of their sets. Where such pairs would be many (a large group
of copies), texts are first linked to a neighbour in their bucket, in another order each time, which connects most of the group; what
is still apart is then compared. 4. Connected components of the verified links.

Edge cases: very long texts have all their shingles, multiplied in slices; null, empty and blank texts have no shingle and link with each other only; texts of fewer words than a shingle have their
whole word sequence as the one shingle; rows with the same ``doc_id`` are rows of their own; null ids come out as null and never become a
component's id unless no other id is in it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, components, in_batches, mix64, spread_join, tasks_for
from quarry.llm.simhash_dedup import LOWER

BANDS, ROWS = 32, 5
#: Odd multipliers, one a minimum; shingle hashes are random already.
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingles multiplied at once.
SLICE = 2048
#: Pairs a bucket member up to which all are compared at once, and the most rounds that link neighbours only.
PAIRS_A_MEMBER, NEIGHBOUR_ROUNDS = 4, 2
#: Shingles of the sets that are looked for in one place: 8 MB.
SHINGLES_A_HOME = 1_000_000
#: How often sets without company are left out.
COMPANY_ROUNDS = 2


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes, sorted, of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` signed longs; sets without a shingle share all of theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + SLICE]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix64(key ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(tie, sh)``, the shingle sets of the wanted ones of ``(tie, text)``, once each."""

    def run(batch):
        return {"tie": batch.column(0), "sh": _longs([shingles(t, shingle) for t in batch.column(1).to_pylist()])}

    return checkpointed(texts.join(wanted, "tie").dropDuplicates(["tie"]).mapInArrow(in_batches(run), "tie long, sh array<long>"))


def with_company(sets: DataFrame, similarity: float, rounds: int = COMPANY_ROUNDS) -> DataFrame:
    """``(tie, size, shared)``: how many of its shingles a set shares with any other. Sets that share too few to be similar to any are left out, and
    then those that shared with them."""
    left = None
    for _ in range(rounds):
        rows = sets if left is None else sets.join(left.select("tie"), "tie", "left_semi")
        each = rows.select("tie", F.size("sh").alias("size"), F.explode_outer("sh").alias("x"))
        counted = each.withColumn("others", F.count("*").over(Window.partitionBy("x")) > 1)
        left = counted.groupBy("tie", "size").agg(F.count_if(F.col("others") & F.col("x").isNotNull()).alias("shared"))
        left = checkpointed(left.where(F.col("shared") >= F.lit(similarity) * F.col("size")))
    return left


def homes(members: DataFrame) -> DataFrame:
    """``(tie, home)``: a place where a text's sets are looked for, shared by the texts of its most frequent key, a bounded number of shingles each."""
    own = members.groupBy("tie", "size").agg(F.max(F.struct("n", "key")).alias("most")).select("tie", "size", F.col("most.key").alias("key"))
    parts = own.groupBy("key").agg(F.ceil(F.sum("size") / SHINGLES_A_HOME).alias("parts"))
    return checkpointed(spread_join(own, parts, "key").select("tie", "size", F.xxhash64("key", F.pmod(F.xxhash64("tie"), F.greatest("parts", F.lit(1)))).alias("home")))


def verified(pairs: DataFrame, sets: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets have the similarity or more; ``places`` are the texts' :func:`homes`.

    Pairs of the same two homes are verified together: a set travels once to where any of its pairs are, not with each pair.
    """
    place = lambda side: places.select(F.col("tie").alias(side), F.col("home").alias(f"{side}_home"))
    cells = pairs.join(place("a"), "a").join(place("b"), "b").select("a", "b", F.xxhash64("a_home", "b_home").alias("cell"))
    cells = checkpointed(cells)
    side = lambda name: cells.select("cell", F.col(name).alias("tie")).distinct()
    needed = checkpointed(side("a").union(side("b")).distinct().join(places.select("tie", "size"), "tie"))
    total = needed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(4, -(-total // SHINGLES_A_HOME))
    group = F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int").alias("group")
    shipped = needed.select("tie", group).distinct().join(sets, "tie").select("group", "tie", "sh")

    def run(key, asked, held):
        ties = held.column("tie").to_pylist()
        lists = held.column("sh").combine_chunks()
        values, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        known = {t: values[x:z].view(np.uint64) for t, x, z in zip(ties, ends, ends[1:])}
        a, b = asked.column("a").to_numpy(), asked.column("b").to_numpy()
        alike = np.array([_similarity(known[x], known[y]) >= similarity for x, y in zip(a.tolist(), b.tolist())], bool)
        return pa.table({"a": a[alike], "b": b[alike]})

    tasks = tasks_for(pairs.sparkSession, groups)
    return cells.select("a", "b", group).repartition(tasks, "group").groupBy("group").cogroup(shipped.repartition(tasks, "group").groupBy("group")).applyInArrow(run, "a long, b long")


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; two empty ones are alike."""
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 1.0
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def links(distinct: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(node, root)`` of all texts of ``distinct`` (tie, keys) that are linked to another."""
    spark = distinct.sparkSession
    members = distinct.select("tie", F.explode("keys").alias("key"))
    members = checkpointed(members.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "tie"))
    sets = shingle_sets(texts, members.select("tie").distinct(), shingle)
    company = with_company(sets, similarity)
    members = members.join(company, "tie").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "tie", "size", "shared", "n")
    members = checkpointed(members)
    n_members = members.count()
    places = homes(members)
    found, roots = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")

    def near(p: str, q: str) -> Column:
        """Whether two sets can be as similar, by their sizes and by what either shares with any other."""
        most = F.least(F.col(f"{p}shared"), F.col(f"{q}shared"))
        return most >= F.lit(similarity) * (F.col(f"{p}size") + F.col(f"{q}size") - most)

    for k in range(NEIGHBOUR_ROUNDS + 1):
        named = members.join(roots, F.col("tie") == F.col("node"), "left").select("key", "tie", "size", "shared", F.coalesce("root", "tie").alias("root"))
        counted = named.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own")).where("n * n > own")
        counted = checkpointed(counted)
        n_pairs = counted.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        if n_pairs == 0:
            break
        apart = named.join(counted.select("key"), "key")
        last = n_pairs <= PAIRS_A_MEMBER * n_members or k == NEIGHBOUR_ROUNDS
        if last:
            apart = checkpointed(apart.join(distinct.select("tie", "keys"), "tie"))
            other = apart.select("key", *[F.col(c).alias(f"b_{c}") for c in ("tie", "size", "shared", "root", "keys")])
            # A pair with several keys is made once, at the least of them.
            once = F.col("key") == F.array_min(F.array_intersect("keys", "b_keys"))
            pairs = apart.join(other, "key").where((F.col("root") != F.col("b_root")) & (F.col("tie") < F.col("b_tie")) & near("", "b_") & once).select(F.col("tie").alias("a"), F.col("b_tie").alias("b"))
        else:
            order = Window.partitionBy("key").orderBy(F.xxhash64("tie", F.lit(k)))
            before = apart.withColumn("p", F.lag(F.struct("tie", "size", "shared", "root")).over(order)).where("p is not null and p.root <> root")
            pairs = before.where(near("", "p.")).select(F.least("tie", "p.tie").alias("a"), F.greatest("tie", "p.tie").alias("b"))
        found = checkpointed(found.union(verified(checkpointed(pairs.distinct()), sets, places, similarity)))
        roots = components(found)
        if last:
            break
    return roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id, tie)``, one row per input row; ``tie``, a hash of the text, tells rows of one id apart.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at least ``similarity``, the document's own included.
    """

    def run(batch):
        sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "tie": batch.column(2), "keys": _longs([band_keys(s) for s in sets])}

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    docs = checkpointed(picked.mapInArrow(in_batches(run), "doc_id long, tie long, keys array<long>"))
    distinct = checkpointed(docs.groupBy("tie").agg(F.min("doc_id").alias("least_id"), F.first("keys").alias("keys")))
    roots = links(distinct, picked.select("tie", "text"), shingle, similarity).withColumnRenamed("node", "tie")
    classes = distinct.select("tie", "least_id").join(roots, "tie", "left").withColumn("root", F.coalesce("root", "tie"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spread_join(classes, least, "root").select("tie", "component_id")
    return docs.select("doc_id", "tie").join(named, "tie").select("doc_id", "component_id", "tie")
