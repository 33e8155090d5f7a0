"""BM25 lexical search: index tables, scoring of many queries, top-k.

weight = idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a query's score is the sum over its terms, each
as often as it stands there. The index keeps tf and dl, small numbers, and a search makes the weights of the postings that it reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.checkpoints import cleared, shared_dir

# English stop words.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

#: Postings of a stored bucket, and of one of its files.
ROWS_A_BUCKET, ROWS_A_FILE = 20_000_000, 4_000_000
#: Passes in which an index of more than one file is stored; each shuffles its own buckets only, and that goes before the next.
PASSES = 2


def terms(c: Column | str) -> Column:
    """Lower-cased words of two or more letters, numbers and underscores, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


@dataclass
class Bm25Index:
    """Counts ``(term, vector_id, tf, dl)``, documents ``(vector_id, dl)``, terms ``(term, df, cf)`` and four numbers."""

    counts: DataFrame
    documents: DataFrame
    terms: DataFrame
    count: int
    avgdl: float
    k1: float
    b: float
    buckets: int | None = None  # where the counts are stored by bucket
    folders: list[str] = field(default_factory=list)  # of the tables that a built index is made of

    @property
    def postings(self) -> DataFrame:
        """``(term, vector_id, tf, weight)`` of all terms."""
        return self.counts.join(self.terms, "term").select("term", "vector_id", "tf", self.weight().alias("weight"))

    def weight(self) -> Column:
        """The weight of a row with ``tf``, ``dl`` and its term's ``df``."""
        return weight(self, F.col("df"), F.col("tf"), F.col("dl"))

    def number_of_postings(self) -> int:
        return self.terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    def number_of_buckets(self) -> int:
        return max(8, -(-self.number_of_postings() // ROWS_A_BUCKET))

    def write(self, path: str, buckets: int | None = None) -> None:
        """Counts in files by a hash of the term, so that a query's terms prune files.

        The number of buckets follows the postings, and a bucket's files its own rows, so that a term of very many documents is in many files. Terms tell
        the sizes, so each posting is shuffled once, in the pass of its bucket.
        """
        if buckets is None:
            buckets = self.number_of_buckets()
        passes = min(PASSES, buckets) if self.number_of_postings() > ROWS_A_FILE else 1
        sizes = self.terms.groupBy(term_bucket("term", buckets).alias("bucket")).agg(F.ceil(F.sum("df") / ROWS_A_FILE).alias("_files"))
        spread = self.counts.withColumn("bucket", term_bucket("term", buckets))
        for n in range(passes):
            with cleared(self.terms.sparkSession):
                mine = spread.where(F.col("bucket") % passes == n) if passes > 1 else spread
                dealt_by_bucket(mine, "vector_id", sizes).sortWithinPartitions("term").write.mode("append" if n else "overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        numbers = [(self.count, float(self.avgdl), float(self.k1), float(self.b), buckets)]
        self.terms.sparkSession.createDataFrame(numbers, "count long, avgdl double, k1 double, b double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")

    def discard(self) -> None:
        """Deletes the tables that :func:`build` has made; for an index that is used as it is written."""
        sc = self.terms.sparkSession.sparkContext
        for folder in self.folders:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Bm25Index":
        table = lambda name: spark.read.parquet(f"{path}/{name}")
        n = table("numbers").first()
        return cls(table("postings"), table("documents"), table("terms"), n["count"], n["avgdl"], n["k1"], n["b"], n["buckets"])


def dealt_by_bucket(rows: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """Rows with a ``bucket`` dealt to tasks by it, and by ``by`` as well where a bucket has several ``_files``; ``sizes`` has a row a bucket."""
    slices = rows.join(F.broadcast(sizes), "bucket").withColumn("_slice", F.expr(f"pmod(xxhash64({by}), _files)"))
    return slices.repartition("bucket", "_slice").drop("_files", "_slice")


def weight(numbers, df: Column, tf: Column, dl: Column) -> Column:
    """A posting's weight by an index's ``count``, ``avgdl``, ``k1`` and ``b``."""
    idf = F.log(1 + (F.lit(numbers.count) - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + numbers.k1 * (1 - numbers.b + numbers.b * dl / F.lit(numbers.avgdl or 1.0)))


def kept(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """Written to the shared folder and read again: compressed, and of a size that the optimizer knows, so that what is small is broadcast.

    What was shuffled for it goes at once; ``folders`` is told the table's folder.
    """
    path = f"{shared_dir(df.sparkSession)}/bm25-{name}-{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.select("*").write.parquet(path, compression="zstd")
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.parquet(path)


def term_bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(listed: DataFrame) -> DataFrame:
    """``(vector_id, dl, words)`` of ``(vector_id, terms)``: a row's distinct terms with how often each stands there, without a shuffle."""
    in_order = listed.select("vector_id", F.sort_array(F.coalesce("terms", F.array().cast("array<string>"))).alias("s")).withColumn("dl", F.size("s"))
    last = F.filter(F.transform("s", lambda x, i: F.struct(x.alias("term"), i.alias("i"))), lambda p: ~p["term"].eqNullSafe(F.get("s", p["i"] + 1)))
    ends = in_order.select("vector_id", "dl", last.alias("ends"))
    words = F.transform("ends", lambda p, j: F.struct(p["term"].alias("term"), (p["i"] - F.coalesce(F.get("ends", j - 1)["i"], F.lit(-1))).cast("long").alias("tf")))
    return ends.select("vector_id", "dl", words.alias("words"))


def build(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, id_col: str = "vector_id", text_col: str = "text") -> Bm25Index:
    """The texts are cut into terms once; all tables come from the counts, which are kept in the shared folder, a row a text. Rows alike in id and
    length count as one text."""
    if not (1e-6 <= k1 <= 100 and 0 <= b <= 1):
        raise ValueError("k1 is from 1e-6 to 100, b from 0 to 1")
    folders: list[str] = []
    texts = kept(_counted(chunks.select(F.col(id_col).alias("vector_id"), terms(text_col).alias("terms"))), "texts", folders)
    n, total, ids = texts.agg(F.count("*"), F.sum("dl"), F.count_distinct(F.struct("vector_id"))).first()
    avgdl = (total or 0) / n if n else 0.0
    if ids < n:
        one = texts.groupBy("vector_id", "dl").agg(F.count("*").alias("rows"), F.flatten(F.collect_list("words")).alias("words"))
        again = F.flatten(F.transform("words", lambda w: F.array_repeat(w["term"], w["tf"].cast("int"))))
        merged = _counted(one.where("rows > 1").select(F.struct("vector_id", "dl").alias("vector_id"), again.alias("terms")))
        texts = kept(one.where("rows = 1").drop("rows").unionByName(merged.select("vector_id.*", "words")), "merged", folders)
    counts = texts.select("vector_id", "dl", F.inline("words")).select("term", "vector_id", "tf", "dl")
    df = kept(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "terms", folders)
    documents = texts.select("vector_id", "dl").dropDuplicates(["vector_id"]) if ids < n else texts.select("vector_id", "dl")
    return Bm25Index(counts, documents, df, n, avgdl, k1, b, folders=folders)


def search(index: Bm25Index, queries: DataFrame, k: int, query_col: str = "query") -> DataFrame:
    """``(query_id, vector_id, score, rank)``: the best ``k`` with a positive score; fewer if fewer have one."""
    asked = queries.select("query_id", F.explode(terms(query_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = kept(asked, "asked")
    words = index.terms.select("term", "df").join(asked, "term", "left_semi").withColumn("number", F.monotonically_increasing_id())
    words, by = kept(words, "words"), ["term"]
    asked = kept(asked.join(words, "term").select("number", "query_id", "qtf", "df"), "known")
    if index.buckets is not None:  # the few buckets of the asked terms are all that is read
        words, by = words.withColumn("bucket", term_bucket("term", index.buckets)), ["bucket", "term"]
    # A document's postings of all asked terms meet in one task, each once, and are given to the queries there: rows of a query and a document are never shuffled.
    met = index.counts.join(words.drop("df"), by).select("number", "vector_id", "tf", "dl").repartition("vector_id")
    scores = met.join(asked, "number").groupBy("query_id", "vector_id").agg(F.sum(F.col("qtf") * index.weight()).alias("score"))
    # Sums depend on the order of their terms in the last bits; ties are decided on nine places.
    scores = scores.withColumn("score", F.round("score", 9)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vector_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
