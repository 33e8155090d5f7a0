"""A corpus pipeline of the training-data operators; every stage's output is written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars). Null and repeated rows, empty tables and extra
columns are treated as the operators say; extra columns of ``docs`` are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, line_dedup, pack, simhash_similar
from quarry.llm.common import NULL_ID, load, shared_dir
from quarry.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose best language scores lower have too little evidence for any; a one-letter text has 0.35.
LEAST_LANGUAGE_SCORE = 0.3
#: Documents that a packed sequence holds at most.
MOST_DOCS = 32
#: Words from which on a repeated line goes even if its neighbours don't repeat.
LONG_WORDS = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without text or of no learned language go."""
    named = language_id.predict(docs, language_id.learn(docs), carry=COLUMNS)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("carried.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two lines, and lines of at least ``LONG_WORDS`` words, that an earlier place has go; a document that loses all its lines goes
    whole."""
    left = line_dedup.remove_runs(docs, run_lines=2, carry=["lang", "source", "n_chars"], long_words=LONG_WORDS)
    left = left.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("carried.n_chars"))
    return left.select("doc_id", "text", "carried.lang", "carried.source", n_chars.cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 of five-word shingles stays; of rows alike in id and
    text, one. Groups without any id keep each different text."""
    found = simhash_similar.near_duplicates(docs, shingle=5, similarity=0.8).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("keep"), "tie").distinct()
    own = docs.select(*COLUMNS).withColumn("keep", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("tie", F.xxhash64("text"))
    # The rows lie by these keys already, so repeated ones meet without another shuffle.
    return own.join(found, ["keep", "tie"], "left_semi").dropDuplicates(["keep", "tie"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 1024 tokens and ``MOST_DOCS`` documents as best fit finds."""
    return pack.pack(pack.pieces(docs, tokenizer_path(), capacity=1024, end_id=2), capacity=1024, most_docs=MOST_DOCS)


#: (name, function of (spark, docs, sf_dir)), in the order they run.
STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]
#: The classifier of the first stage can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is a table in the shared folder, which goes when the next one's is whole."""
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return docs
