"""BM25 search that scores few postings and yet finds the exact best ``k``: blocks of postings with their largest weights.

Postings lie in blocks, one for a term and a range of ids of about one document length, each with its largest weight; each term's heaviest postings are its head. A search

1. takes from the heads a few promising documents a query and scores them whole: the ``k``-th best of them is a floor that any hit must reach;
2. splits a query's terms: those whose largest weights together stay below the floor can't make a hit on their own, so only the others propose documents;
3. drops the blocks where all largest weights of a query's terms together stay below the floor, without reading their postings;
4. sums the proposing terms' postings in the blocks left, of each only those that can reach the floor with the other terms' largest weights, and drops
   documents that the terms that don't propose can't lift to it;
5. looks the other terms up in the blocks of what is left only.

Each step is a join by equality, its bounds are sums of positive numbers, so nothing that could be a hit, ties included, is ever dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.bm25 import ROWS_A_FILE, Bm25Index, dealt_by_bucket, kept, term_bucket, terms, weight
from quarry.sources.checkpoints import checkpointed

#: Ids of a block's range, of which it has those of one class of lengths, postings of a head, documents a hit that are scored for the floor, and what sums may differ by.
BLOCK, HEAD, TRIED, SLACK = 512, 64, 4, 1e-6


def _block(vector_id: str, length: str) -> Column:
    """Documents of about one length and one range of ids: a term's weight falls with the length, so what is alike in it has a largest weight that tells something."""
    kind = F.least(F.floor(3 * F.log2(F.col(length) + 1)), F.lit(63))
    return F.floor(F.col(vector_id) / BLOCK) * 64 + kind


@dataclass
class BlockIndex:
    """``listed (bucket, term, block, share, n, counts)``, ``heads (bucket, term, df, most, postings)`` and the index's numbers.

    Counts are ``(tf, dl, vector_id)``, ``share`` is the largest weight without its idf; heads' postings are ``(weight, vector_id, block)``.
    """

    listed: DataFrame
    heads: DataFrame
    buckets: int
    count: int
    avgdl: float
    k1: float
    b: float

    @property
    def blocks(self) -> DataFrame:
        """``(bucket, term, block, most, n, postings)`` of all terms."""
        rows = self.listed.join(self.heads.select("bucket", "term", "df"), ["bucket", "term"])
        return rows.select("bucket", "term", "block", F.array_max(F.transform("counts", lambda p: self._weight(p))).alias("most"), "n", self.postings().alias("postings"))

    def _weight(self, p: Column) -> Column:
        return weight(self, F.col("df"), p["tf"], p["dl"])

    def postings(self) -> Column:
        """Of a row with ``counts``, its ``block`` and its term's ``df``."""
        return F.transform("counts", lambda p: F.struct(self._weight(p).alias("weight"), p["vector_id"].alias("vector_id"), F.col("block").alias("block")))

    def most(self) -> Column:
        """The largest weight of a row with ``share`` and its term's ``df``, to the last bits."""
        return F.log(1 + (F.lit(self.count) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("share")

    def write(self, path: str) -> None:
        """Blocks come in tasks as they are to lie in files; heads are made of the written ones."""
        self.listed.sortWithinPartitions("term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        written = replace(self, listed=self.listed.sparkSession.read.parquet(f"{path}/blocks"))
        heads = written._heads()
        sizes = heads.groupBy("bucket").agg(F.ceil(F.count("*") / 500_000).alias("_files"))
        dealt_by_bucket(heads, "term", kept(sizes, "sizes")).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/heads")
        numbers = [(self.count, float(self.avgdl), float(self.k1), float(self.b))]
        self.listed.sparkSession.createDataFrame(numbers, "count long, avgdl double, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")

    @classmethod
    def read(cls, spark: SparkSession, path: str, buckets: int) -> "BlockIndex":
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/heads"), buckets, *spark.read.parquet(f"{path}/numbers").first())

    def _heads(self) -> DataFrame:
        """The ``HEAD`` heaviest postings of each term.

        They lie in the ``HEAD`` blocks with the largest weights: each of these has a posting at least as heavy as any of another block. So a task sends at
        most so many blocks of a term, and none ever has all postings of a term.
        """
        share = lambda p: p["tf"] / (p["tf"] + self.k1 * (1 - self.b + self.b * p["dl"] / F.lit(self.avgdl or 1.0)))
        heavy = F.transform("counts", lambda p: F.struct(share(p).alias("share"), p["vector_id"].alias("vector_id"), p["tf"].alias("tf"), p["dl"].alias("dl"), F.col("block").alias("block")))
        first = Window.partitionBy("bucket", "term").orderBy(F.desc("share"), "block")
        rows = self.listed.select("bucket", "term", "block", "share", F.slice(F.sort_array(heavy, asc=False), 1, HEAD).alias("heavy"))
        rows = rows.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= HEAD)
        lists = rows.groupBy("bucket", "term").agg(F.max("share").alias("share"), F.slice(F.sort_array(F.flatten(F.collect_list("heavy")), asc=False), 1, HEAD).alias("heavy"))
        df = self.listed.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        whole = lists.join(df, ["bucket", "term"])
        postings = F.transform("heavy", lambda p: F.struct(self._weight(p).alias("weight"), p["vector_id"].alias("vector_id"), p["block"].alias("block")))
        whole = whole.select("bucket", "term", "df", F.sort_array(postings, asc=False).alias("postings"))
        return whole.select("bucket", "term", "df", F.get("postings", F.lit(0))["weight"].alias("most"), "postings")


def blocked(index: Bm25Index) -> BlockIndex:
    """The blocks and heads of an index with integer ids; made when they are written or searched.

    Counts are dealt to tasks once, by bucket and range of ids, so that no task has all postings of a frequent term.
    """
    buckets = index.buckets or index.number_of_buckets()
    sizes = index.terms.groupBy(term_bucket("term", buckets).alias("bucket")).agg(F.ceil(F.sum("df") / ROWS_A_FILE).alias("_files"))
    rows = index.counts.withColumn("bucket", term_bucket("term", buckets)).withColumn("block", _block("vector_id", "dl"))
    slices = rows.join(F.broadcast(sizes), "bucket").withColumn("_slice", F.expr("pmod(xxhash64(block), _files)")).repartition("bucket", "_slice")
    tf, dl = F.col("tf"), F.col("dl")
    share = tf / (tf + index.k1 * (1 - index.b + index.b * dl / F.lit(index.avgdl or 1.0)))
    one = F.struct(tf.cast("int").alias("tf"), dl.cast("int").alias("dl"), F.col("vector_id").cast("long").alias("vector_id"))
    # Rows lie by the first two keys already, so they are grouped where they are.
    made = slices.groupBy("bucket", "_slice", "term", "block").agg(F.max(share).alias("share"), F.count("*").cast("int").alias("n"), F.collect_list(one).alias("counts"))
    found = BlockIndex(made.drop("_slice"), None, buckets, index.count, index.avgdl, index.k1, index.b)
    return replace(found, heads=found._heads())


def _looked_up(index: BlockIndex, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(query_id, vector_id, part)``: postings of the terms ``(query_id, bucket, term, qtf, df)`` in documents ``(query_id, vector_id, block)``, as addends of scores."""
    ranges = wanted.groupBy("query_id", "block").agg(F.collect_set("vector_id").alias("ids"))  # at most BLOCK ids
    places = asked.join(ranges, "query_id").join(index.listed.select("bucket", "term", "block", "counts"), ["bucket", "term", "block"])
    mine = F.filter(index.postings(), lambda p: F.array_contains("ids", p["vector_id"]))
    return places.select("query_id", "qtf", F.explode(mine).alias("p")).select("query_id", F.col("p.vector_id").alias("vector_id"), (F.col("qtf") * F.col("p.weight")).alias("part"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vector_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Found:
    """``hits (query_id, vector_id, score, rank)``, as an unpruned search has them, and ``work (query_id, postings, scored)``: how many postings the query's terms
    have, and how many were added to a score, those for the floor included."""

    hits: DataFrame
    work: DataFrame


def search(index: BlockIndex, queries: DataFrame, k: int, query_col: str = "query") -> Found:
    """The best ``k`` with a positive score; fewer if fewer have one. Queries without a known term have neither hits nor work."""
    asked = queries.select("query_id", F.explode(terms(query_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.withColumn("bucket", term_bucket("term", index.buckets))
    known = checkpointed(asked.join(index.heads, ["bucket", "term"]).select("query_id", "bucket", "term", "qtf", "df", (F.col("qtf") * F.col("most")).alias("bound"), "postings"))
    plain = known.drop("postings")
    # Only blocks of asked terms are dealt to joins; the names are few enough, and of a known size, to be broadcast.
    names = kept(known.select("bucket", "term").distinct(), "names")
    index = replace(index, listed=index.listed.join(names, ["bucket", "term"], "left_semi"))

    # 1. A floor of each query.
    head = known.select("query_id", "qtf", F.explode("postings").alias("p")).groupBy("query_id", F.col("p.vector_id").alias("vector_id")).agg(F.sum(F.col("qtf") * F.col("p.weight")).alias("score"), F.first("p.block").alias("block"))
    tried = checkpointed(_best(head, TRIED * k).select("query_id", "vector_id", "block"))
    first = checkpointed(_looked_up(index, plain.select("query_id", "bucket", "term", "qtf", "df"), tried).groupBy("query_id", "vector_id").agg(F.sum("part").alias("score"), F.count("*").alias("n")))
    floors = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    # 2. Terms that may propose documents.
    rising = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    with_floor = plain.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    split = checkpointed(with_floor.withColumn("proposes", F.sum("bound").over(rising) >= F.col("floor")))

    # 3. Blocks that can hold a hit, by the blocks' largest weights.
    lifts = split.join(index.listed.select("bucket", "term", "block", "share"), ["bucket", "term"]).withColumn("lift", F.col("qtf") * index.most())
    ranges = lifts.groupBy("query_id", "block").agg(F.sum("lift").alias("all"), F.coalesce(F.sum(F.when(~F.col("proposes"), F.col("lift"))), F.lit(0.0)).alias("rest"), F.max("proposes").alias("proposed"), F.first("floor").alias("floor"))
    ranges = ranges.where(F.col("proposed") & (F.col("all") >= F.col("floor"))).select("query_id", "block", "all", "rest", "floor")

    # 4. Proposed documents, by the terms that may. A posting that stays below the floor with all other terms' largest weights is of no hit, and so are those after it.
    places = split.where("proposes").select("query_id", "bucket", "term", "qtf", "df").join(ranges, "query_id").join(index.listed.select("bucket", "term", "block", "share", "counts"), ["bucket", "term", "block"])
    places = places.withColumn("most", index.most()).withColumn("postings", index.postings())
    heavy = F.filter("postings", lambda p: F.col("all") - F.col("qtf") * (F.col("most") - p["weight"]) >= F.col("floor"))
    parts = places.select("query_id", "rest", "floor", "qtf", F.explode(heavy).alias("p"))
    proposed = parts.groupBy("query_id", F.col("p.vector_id").alias("vector_id")).agg(F.sum(F.col("qtf") * F.col("p.weight")).alias("score"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("floor").alias("floor"), F.first("p.block").alias("block"))
    proposed = checkpointed(proposed)
    left = proposed.where(F.col("score") + F.col("rest") >= F.col("floor")).select("query_id", "vector_id", "block", "score")

    # 5. The other terms, in these documents.
    others = checkpointed(_looked_up(index, split.where(~F.col("proposes")).select("query_id", "bucket", "term", "qtf", "df"), left).groupBy("query_id", "vector_id").agg(F.sum("part").alias("part"), F.count("*").alias("n")))
    whole = left.join(others.drop("n"), ["query_id", "vector_id"], "left")
    scores = whole.select("query_id", "vector_id", F.round(F.col("score") + F.coalesce("part", F.lit(0.0)), 9).alias("score")).where("score > 0")

    counted = None
    for rows in (head_sizes(known), first.select("query_id", "n"), proposed.select("query_id", "n"), others.select("query_id", "n")):
        counted = rows if counted is None else counted.unionByName(rows)
    counted = counted.groupBy("query_id").agg(F.sum("n").alias("scored"))
    work = plain.groupBy("query_id").agg(F.sum("df").alias("postings")).join(counted, "query_id")
    return Found(_best(scores, k), work)


def head_sizes(known: DataFrame) -> DataFrame:
    return known.select("query_id", F.size("postings").cast("long").alias("n"))
