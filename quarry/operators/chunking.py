"""Chunks: presegmented passages and sentence-packed windows, dense ids, statistics and checks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import SENTENCE_ENDS, token_count, tokens
from quarry.sources.checkpoints import checkpointed

#: The Python form of the token pattern.
_TOKEN = re.compile(r"\w+|[^\w\s]")
CHUNKS_A_BATCH = 1000

CHUNK_SCHEMA = "chunk_id string, doc_id string, source string, chunk_no int, page_start int, page_end int, text string, token_count int"


def dense_ids(df: DataFrame, group: str, order: list[Column], name: str = "vector_id") -> DataFrame:
    """Numbers rows from 0 in the order of ``group`` and, in a group, of ``order``.

    Groups are counted and laid out by ranges first: a range-partitioned sort of the groups gives each partition's offset
    (one number a partition to the driver), so that no task orders all groups. The rows of a null group come first.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    ranged = checkpointed(sizes.repartitionByRange(group).withColumn("part", F.spark_partition_id()))
    totals = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for part in sorted(totals):
        starts.append((part, at))
        at += totals[part]
    begin = F.broadcast(spark.createDataFrame(starts, "part int, part_start long"))
    before = Window.partitionBy("part").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.join(begin, "part").select(F.col(group).alias("_group"), (F.col("part_start") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("group_start"))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    numbered = df.withColumn("in_group", inside).join(offsets, F.col(group).eqNullSafe(F.col("_group")))
    return numbered.withColumn(name, (F.col("group_start") + F.col("in_group")).cast("long")).drop("in_group", "group_start", "_group")


def named_pages(pages: DataFrame) -> DataFrame:
    """The pages; one without a ``doc_id`` raises, as its chunks would have no name."""
    known = F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.raise_error(F.lit("a page has no doc_id")).cast(pages.schema["doc_id"].dataType))
    return pages.withColumn("doc_id", known)


def presegmented(pages: DataFrame) -> DataFrame:
    """One chunk for each page of ``(doc_id, source, page, text)`` that has a token, never cut."""
    # Counted once and kept, as both the numbers and the rows need the result.
    counted = checkpointed(named_pages(pages).select("doc_id", "source", "page", "text", token_count("text").alias("token_count"))).where("token_count > 0")
    numbered = dense_ids(counted, "doc_id", [F.col("page")])
    return numbered.select(F.col("doc_id").alias("chunk_id"), "vector_id", "doc_id", "source", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text", "token_count")


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size is positive and the overlap at least 0 and below the size")


def sentence_units(text: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of a page, as arrays of their first and last characters' places and their token counts.

    A unit is a sentence, or ``size`` tokens of a longer one. A token begins a sentence if white space lies before it and an end mark before that;
    tokens cover all else than white space, so a unit's text goes from its first token to its last.
    """
    spans = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    if not len(spans):
        return (np.zeros(0, np.int64),) * 3
    begin, end = spans[:, 0], spans[:, 1]
    breaks = np.ones(len(spans), bool)
    breaks[1:] = [gap and text[z - 1] in SENTENCE_ENDS for gap, z in zip((begin[1:] > end[:-1]).tolist(), end[:-1].tolist())]
    since = np.arange(len(spans)) - np.maximum.accumulate(np.where(breaks, np.arange(len(spans)), 0))
    heads = np.flatnonzero(since % size == 0)
    counts = np.diff([*heads, len(spans)])
    return begin[heads], end[heads + counts - 1], counts


def chunk_bounds(counts, size: int, overlap: int) -> list[tuple[int, int]]:
    """Which units ``(first, end)`` each chunk holds, found on the running sum of the units' tokens.

    From its first unit on, a chunk takes all units whose tokens are within ``size``. The next one begins in its tail: as far back as ``overlap`` allows
    and, where the chunk isn't exactly full, as the next unit leaves room for. After a full chunk the tail is taken whole, so
    it may be a chunk by itself if the next unit doesn't fit beside it; at the end of the document it is none.
    """
    total = np.concatenate([[0], np.cumsum(counts)]).tolist()
    last, out, first, seen = len(total) - 1, [], 0, 0
    while seen < last:
        end = bisect_right(total, total[first] + size) - 1
        out.append((first, end))
        full = total[end] - total[first] == size
        room = overlap if full or end == last else min(overlap, size - (total[end + 1] - total[end]))
        first, seen = max(first, bisect_left(total, total[end] - room)), end
    return out


class _Document:
    """The pages of one document, in order, as they stream by."""

    def __init__(self, doc, source):
        self.doc, self.source = doc, source
        self.texts, self.pages, self.counts = [], [], []

    def add(self, page: int, text: str | None, size: int) -> None:
        text = text or ""
        for a, z, n in zip(*(x.tolist() for x in sentence_units(text, size))):
            self.texts.append(text[a:z]), self.pages.append(page), self.counts.append(n)

    def chunks(self, size: int, overlap: int):
        for number, (a, z) in enumerate(chunk_bounds(self.counts, size, overlap), 1):
            low, high = min(self.pages[a:z]), max(self.pages[a:z])
            yield f"{self.doc}_p{low}_c{number:04d}", self.doc, self.source, number, low, high, " ".join(self.texts[a:z]), sum(self.counts[a:z])


def fixed_sentence(pages: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Sentence-packed chunks of ``(doc_id, source, page, text)``.

    Documents meet in one task each, sorted by page, and stream through it: a task holds the units of one document and a batch of chunks.
    """
    check_window(size, overlap)
    kind = _arrow(CHUNK_SCHEMA)

    def fold(batches):
        held, rows = None, []
        for batch in batches:
            for doc, source, page, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held is None or held.doc != doc:
                    rows += held.chunks(size, overlap) if held else ()
                    held = _Document(doc, source)
                held.add(page, text, size)
                if len(rows) >= CHUNKS_A_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                    rows = []
        rows += held.chunks(size, overlap) if held else ()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    ordered = named_pages(pages).select("doc_id", "source", F.col("page").cast("int").alias("page"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "page")
    return ordered.mapInArrow(fold, CHUNK_SCHEMA)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def token_summary(chunks: DataFrame) -> DataFrame:
    c = F.col("token_count")
    return chunks.agg(F.count("*").alias("chunks"), F.min(c).alias("min_tokens"), F.avg(c).alias("avg_tokens"), F.max(c).alias("max_tokens"))


def page_summary(pages: DataFrame, one_page_documents: bool = False) -> DataFrame:
    """One row: the numbers of pages and documents; where every page is a document, ids aren't counted apart."""
    documents = F.count("*") if one_page_documents else F.count_distinct("doc_id")
    return pages.agg(F.count("*").alias("num_pages"), documents.alias("num_documents"))


def overlaps(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """For neighbouring chunks of a document, the most tokens by which the end of one is the start of the other.

    Lengths up to the shorter chunk's are compared; on repetitive text an overlap may exceed the budget of the chunks. ``most``
    limits the lengths, and so the result.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    toks = chunks.select("doc_id", "chunk_no", tokens("text").alias("t"))
    if most is None:
        ends = toks.select("doc_id", "chunk_no", F.col("t").alias("head"), F.col("t").alias("tail"))
    else:
        ends = toks.select("doc_id", "chunk_no", F.slice("t", 1, most).alias("head"), F.slice("t", F.greatest(F.size("t") - most + 1, F.lit(1)), most).alias("tail"))
    pairs = ends.withColumn("before", F.lag("tail").over(order)).where("before is not null")
    room = F.least(F.size("before"), F.size("head"))
    # Whole parts are compared only where their first tokens are the same.
    fits = lambda n: F.get("before", F.size("before") - n).eqNullSafe(F.get("head", F.lit(0))) & (F.slice("before", F.size("before") - n + 1, n) == F.slice("head", 1, n))
    lengths = F.filter(F.sequence(F.lit(0), room), lambda n: (n == 0) | fits(F.greatest(n, F.lit(1))))
    return pairs.select("doc_id", "chunk_no", F.array_max(lengths).alias("overlap"))


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """Counts and moments of the overlaps; all zero without pairs."""
    o = F.col("overlap")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.agg(F.count("*").alias("pairs"), zero(F.min(o).cast("double")).alias("min_overlap"), zero(F.avg(o)).alias("avg_overlap"), zero(F.median(o)).alias("median_overlap"), zero(F.max(o).cast("double")).alias("max_overlap"), F.count_if(o == 0).alias("zero_count"))


def chunk_violations(chunks: DataFrame, size: int | None = None) -> DataFrame:
    """Rows that break the rules of a chunk table, with the rule's name; none for a sound one."""
    rules = {
        "blank": F.trim("text") == "", "no tokens": F.col("token_count") <= 0, "page order": F.col("page_end") < F.col("page_start"),
        "page below 1": F.col("page_start") < 1, "negative id": F.col("vector_id") < 0,
    }
    if size is not None:
        rules["over budget"] = F.col("token_count") > size
    broken = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return chunks.withColumn("broken", broken).where(F.size("broken") > 0)


def contiguous(chunks: DataFrame, key: str = "vector_id") -> DataFrame:
    """One row: whether the ids are exactly 0 to n - 1."""
    c = F.col(key)
    return chunks.agg(((F.count(c) == 0) | ((F.min(c) == 0) & (F.max(c) == F.count(c) - 1) & (F.count_distinct(c) == F.count(c)))).alias("contiguous"))
