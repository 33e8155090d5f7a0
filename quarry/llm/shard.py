"""Two-pass external shuffle into shards.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of the record;
pass two sorts a bucket (so that its order doesn't depend on arrival), Fisher-Yates shuffles it with a
seed of its own and gives each record its place in the global permutation: the bucket's offset plus its
place in the bucket. Shard ``s`` takes the places from ``ceil(s * n / shards)`` on, so shard sizes
differ by one row at most. Everything is a function of the records, the seed and the bucket count:
a task that runs again gives the same rows.

Edge cases: null text has size 8 and the CRC of no bytes; very long texts are whole records, and their bucket is as much larger; null ids are
scattered by their text; repeated rows are separate records, and those alike in id and text share a bucket (copies of a text under different ids
do not); an empty table gives no rows; extra columns are left out by both ``assignments`` and ``write_shards``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import blocks_for, tasks_for


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of ``range(n)``; NumPy's ``permutation`` is the Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def assignments(df: DataFrame, shards: int = 24, seed: int = 20260731, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, keep_text: bool = False) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot[, text])`` of every record; slots are gapless from 0."""
    records = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = blocks_for(records, "text", bucket_bytes)
    scatter = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(buckets)).cast("int")
    scattered = records.withColumn("bucket", scatter)
    sizes = scattered.groupBy("bucket").count()
    blocks = -(-buckets // 1024)
    # The number of tasks of pass two follows the buckets, so that what a task reads does not grow with the input.
    # Offsets in two levels, so that no task orders all buckets: blocks of 1024, then buckets in a block.
    per_block = sizes.groupBy((F.col("bucket") / 1024).cast("int").alias("block")).agg(F.sum("count").alias("n"))
    starts, total = {}, 0
    for block, n in sorted(map(tuple, per_block.collect())):  # a row per 1024 buckets of 8 MB
        starts[block] = total
        total += n
    spark = df.sparkSession
    known = spark.createDataFrame([(b, starts.get(b, 0)) for b in range(blocks)], "block int, block_start long")
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("block", (F.col("bucket") / 1024).cast("int")).join(known, "block")
        .select(F.col("bucket").alias("of"), (F.col("block_start") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("at"))
    )

    def second(key, table, begin):
        bucket, n = key[0].as_py(), table.num_rows
        texts = table.column("text").to_pylist()
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        crc = np.fromiter(map(zlib.crc32, raw), np.int64, n)
        size = np.fromiter(map(len, raw), np.int64, n) + 8
        ids = table.column("doc_id")
        absent = np.asarray(pc.is_null(ids))
        plain = np.asarray(pc.fill_null(ids, 0))
        empty = np.array([t is None for t in texts])
        order = np.lexsort((empty, size, crc, plain, absent))[fisher_yates(n, seed, bucket)]
        place = begin.column("at")[0].as_py() + np.arange(n)
        shard = place * shards // total
        first = -(-shard * total // shards)
        out = {"doc_id": ids.take(pa.array(order)), "size": size[order], "text_crc32": crc[order], "shard": pa.array(shard, pa.int32()), "slot": place - first}
        if keep_text:
            out["text"] = table.column("text").take(pa.array(order))
        return pa.table(out)

    schema = "doc_id long, size long, text_crc32 long, shard int, slot long" + ", text string" * keep_text
    tasks = tasks_for(spark, buckets)
    return scattered.repartition(tasks, "bucket").groupBy("bucket").cogroup(offsets.repartition(tasks, "of").groupBy("of")).applyInArrow(second, schema)


def write_shards(df: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Writes the shuffled records under ``path``, a folder for each shard.

    The tasks of pass two write what they shuffled: no task holds a shard, a bucket's rows go to one or
    two folders, in slot order.
    """
    assignments(df, shards, keep_text=True, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
