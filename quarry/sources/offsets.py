"""Point lookups of records in JSON lines by a table of offsets: only the asked lines are read, in ranges.

The table has a row a record, ``(vector_id, file, offset, length)``. It is made in one scan of the lines: a line begins where those before it in its split
end, and a split where those before it in its file do. A lookup joins the asked ids with the table, deals the places to tasks by stretches of
files, and each task reads its places in order, places that nearly touch by one read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources import writers
from quarry.sources.files import opened

#: Bytes of a file whose places one group of rows holds, bytes between two places that are rather read than skipped, and bytes of one read.
STRETCH, GAP, READ = 64 << 20, 4096, 8 << 20


def line_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, length, value)`` of all lines below ``path`` that aren't blank, in UTF-8 without a byte-order mark; lines end with a line feed.

    No window has more rows than a split has lines, or a file splits, and lines themselves aren't shuffled for it: their lengths are.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), "value"
    )
    return _with_offsets(lines).where(F.trim("value") != "").select("file", "offset", "length", "value")


def _with_offsets(lines: DataFrame) -> DataFrame:
    size = F.octet_length("value").cast("long")
    by_split, by_file = Window.partitionBy("file", "start").orderBy("number"), Window.partitionBy("file").orderBy("start")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = lines.withColumn("length", size)
    splits = sized.groupBy("file", "start").agg(F.sum(F.col("length") + 1).alias("bytes")).withColumn("base", before("bytes", by_file)).select("file", "start", "base")
    inside = sized.withColumn("inside", before(F.col("length") + 1, by_split))
    return inside.join(F.broadcast(splits), ["file", "start"]).withColumn("offset", F.col("base") + F.col("inside"))  # a row a split


def sequence_violations(offsets: DataFrame) -> DataFrame:
    """``(vector_id, problem)``: ids that stand more than once, negative or null ones, and those at which the sequence from 0 has a gap before them."""
    ids = offsets.groupBy("vector_id").agg(F.count("*").alias("n"))
    bad = ids.select("vector_id", F.when(F.col("vector_id").isNull(), "null").when(F.col("vector_id") < 0, "negative").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")
    whole = ids.where("vector_id >= 0")
    # The id before each must be there: a join by equality in place of a window over all ids.
    before = whole.select((F.col("vector_id") + 1).alias("vector_id"))
    gaps = whole.where("vector_id > 0").select("vector_id").join(before, "vector_id", "left_anti").select("vector_id", F.lit("gap").alias("problem"))
    return bad.union(gaps)


@dataclass
class OffsetStore:
    """Records of JSON lines by ``vector_id``."""

    spark: SparkSession
    path: str
    offsets: DataFrame
    count: int
    schema: StructType

    @classmethod
    def build(cls, spark: SparkSession, path: str, table: str, schema: StructType) -> "OffsetStore":
        """Scans the lines of ``path`` once and writes the table of offsets; ids that aren't the sequence from 0 raise.

        The manifest beside it has the number of rows and the stamp of the files, by which :meth:`open` sees that they are the same.
        """
        key = F.get_json_object("value", "$.vector_id").try_cast("long")
        rows = line_offsets(spark, path).select(key.alias("vector_id"), "file", "offset", "length")
        rows.repartitionByRange("vector_id").sortWithinPartitions("vector_id").write.mode("overwrite").parquet(f"{table}/offsets")
        stored = spark.read.parquet(f"{table}/offsets")
        if bad := sequence_violations(stored).first():
            raise ValueError(f"chunk id {bad.vector_id}: {bad.problem}")
        writers.write_manifest(spark, f"{table}/manifest.json", {"count": stored.count(), "stamp": writers.stamp(spark, path)})
        return cls.open(spark, path, table, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, table: str, schema: StructType) -> "OffsetStore":
        """Raises if the files are others than those the table was made of, or the table has lost rows."""
        manifest, offsets = writers.read_manifest(spark, f"{table}/manifest.json"), spark.read.parquet(f"{table}/offsets")
        if manifest["stamp"] != writers.stamp(spark, path):
            raise ValueError("the chunks have changed since their offsets were written")
        count = offsets.count()
        if count != manifest["count"]:
            raise ValueError("the offsets are not as many as the manifest says")
        return cls(spark, path, offsets, count, schema)

    def lines(self, ids: DataFrame) -> DataFrame:
        """``(vector_id, length, value, fetched)`` of each distinct id of ``ids``; ``fetched`` is the bytes of the read that a row began, 0 in rows that shared it.

        An id that isn't in the store, null included, raises.
        """
        asked = ids.select(F.col("vector_id").cast("long")).distinct()
        found = asked.join(self.offsets, "vector_id", "left")
        file = F.when(F.col("file").isNotNull(), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no chunk has the id "), F.coalesce(F.col("vector_id").cast("string"), F.lit("null")))).cast("string"))
        placed = found.withColumn("file", file).withColumn("stretch", F.floor(F.col("offset") / STRETCH))
        dealt = placed.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("vector_id", "file", "offset", "length")
        return dealt.mapInArrow(_fetch, "vector_id long, length long, value string, fetched long")

    def get_many(self, ids: DataFrame) -> DataFrame:
        """The records of ``(position, vector_id)``, in order of position: repeated ids give a row each, each line is read once.

        A line that isn't the record of its id (it has another id, or doesn't parse) raises.
        """
        read = self.lines(ids).withColumn("_r", F.from_json("value", self.schema, {"mode": "FAILFAST"}))
        same = F.when(F.col("_r.vector_id") == F.col("vector_id"), F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("the line at the offset is not of chunk "), F.col("vector_id").cast("string"))).cast(self.schema))
        records = read.withColumn("_r", same).select("vector_id", *[F.col("_r")[c].alias(c) for c in self.schema.names if c != "vector_id"])
        # A left join, so that null ids reach the check too.
        return ids.select("position", F.col("vector_id").cast("long").alias("vector_id")).join(records, "vector_id", "left").orderBy("position")


def _reads(offsets: list[int], lengths: list[int], files: list[str]):
    """``(first, last + 1)`` of consecutive places that one read takes."""
    at = 0
    while at < len(offsets):
        end, stop = at + 1, offsets[at] + lengths[at]
        while end < len(offsets) and files[end] == files[at] and offsets[end] - stop <= GAP and offsets[end] + lengths[end] - offsets[at] <= READ:
            stop = offsets[end] + lengths[end]
            end += 1
        yield at, end
        at = end


def _fetch(batches):
    name, handle = None, None
    for b in batches:
        ids, files, offsets, lengths = (b.column(k).to_pylist() for k in range(4))
        for first, end in _reads(offsets, lengths, files):
            if files[first] != name:
                if handle is not None:
                    handle.close()
                name = files[first]
                system, path = opened(name)
                handle = system.open_input_file(path)
            begin = offsets[first]
            content = handle.read_at(offsets[end - 1] + lengths[end - 1] - begin, begin)
            values = [content[offsets[k] - begin : offsets[k] - begin + lengths[k]] for k in range(first, end)]
            fetched = [len(content)] + [0] * (end - first - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first:end], pa.int64()), pa.array(lengths[first:end], pa.int64()), pa.array(values, pa.binary()).cast(pa.string()), pa.array(fetched, pa.int64())],
                ["vector_id", "length", "value", "fetched"],
            )
    if handle is not None:
        handle.close()
