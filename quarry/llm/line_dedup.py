"""Line deduplication by winnowing over line hashes; DataFrame functions only.

A run is ``run_lines`` or more consecutive lines. A line is removed if it lies in a run whose lines also
occur, in this order and without a gap, at an earlier place: in a smaller ``doc_id``, or earlier in the document. With
``long_words``, one line of at least as many words is a run too, in texts of one line as well.

1. Winnowing: of every ``run_lines`` neighbouring line hashes the least is selected (the leftmost of equals). Every
   run holds a selected fingerprint, at the same offset in all its copies. 2. Positions are joined on fingerprints that
   occur more than once. 3. Each such position is extended both ways by the lines a shortest run around it can
   have; the extensions are compared with the earliest place that has the same one, never pair by pair.
   Long lines are compared by themselves, without winnowing. 4. Overlapping and touching matches merge to maximal runs, which are deleted from the text.

Edge cases: very long texts are arrays of line hashes, whole; null texts have no lines and stay null; an empty text is one empty line; texts of fewer lines than a run
stay (but for long lines); rows that share a ``doc_id`` are ordered by a hash of their text, and rows alike in both count as one place, so
neither is the later one; null ids sort last; other columns go through ``carry`` as a struct; an empty table
gives no rows. Documents may lose all their lines: the text is then empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID


def long_lines(docs: DataFrame, words: int) -> DataFrame:
    """``(run, run2, did, tie, pos)`` of every line of at least so many words of ``docs`` (did, tie, text)."""
    # Only lines with room for so many words are cut into words.
    long = lambda x: (F.length(x) >= 2 * words - 1) & (F.size(F.array_remove(F.split(x, r"\s+"), "")) >= words)
    lines = docs.where(F.length("text") >= 2 * words - 1).select("did", "tie", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(long(F.col("line")))
    return lines.select(F.xxhash64(F.lit(2), "line").alias("run"), F.xxhash64(F.lit(3), "line").alias("run2"), "did", "tie", "pos")


def remove_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = 2, carry: list[str] | None = None, long_words: int | None = None) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed[, carried])``, a row per input row, ``text`` without repeated runs."""
    t = run_lines
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    docs = docs.withColumn("did", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("tie", F.xxhash64("text"))

    hashed = docs.where(F.contains("text", F.lit("\n")) if t > 1 else F.col("text").isNotNull()).select(
        "did", "tie", F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x)).alias("hs")
    )
    hashed = hashed.where(F.size("hs") >= t)
    least = lambda i: F.array_position(F.slice("hs", i + 1, t), F.array_min(F.slice("hs", i + 1, t))) - 1
    selected = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("hs") - t), lambda i: (i + least(i)).cast("int")))
    from_line = F.greatest(F.col("p") - (t - 1), F.lit(0))
    prints = (
        hashed.select("did", "tie", "hs", F.explode(selected).alias("p")).withColumn("from_line", from_line)
        .select("did", "tie", "from_line", F.get("hs", F.col("p")).alias("fp"), F.slice("hs", F.col("from_line") + 1, F.least(F.col("p") + t, F.size("hs")) - F.col("from_line")).alias("around"))
    )

    # An aggregate's rows lie by its key, and a join that relies on that can't split a frequent key. Joins are on a hash of
    # the key instead: the few rows of the aggregate are dealt once more, and both sides can be split at run time.
    repeated = prints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fp").alias("by"))
    matched = prints.withColumn("by", F.xxhash64("fp")).join(repeated, "by")
    run = F.slice("around", F.col("o") + 1, t)
    # Two hashes of the run as its key, without the fingerprint: a frequent fingerprint's rows are dealt anew by their runs.
    places = matched.select("fp", "did", "tie", "from_line", "around", F.explode(F.sequence(F.lit(0), F.size("around") - t)).alias("o")).select(
        F.xxhash64("fp", run).alias("run"), F.xxhash64(F.lit(1), run).alias("run2"), "did", "tie", (F.col("from_line") + F.col("o")).alias("pos")
    )
    if long_words is not None:
        places = places.withColumn("n", F.lit(t)).unionByName(long_lines(docs, long_words).withColumn("n", F.lit(1)))
    place = F.struct("did", "tie", "pos")
    earliest = places.groupBy("run", "run2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    earliest = earliest.select(F.xxhash64("run", "run2").alias("by"), F.col("run").alias("run_1"), F.col("run2").alias("run_2"), "first")
    again = places.withColumn("by", F.xxhash64("run", "run2")).join(earliest, "by").where("run = run_1 and run2 = run_2")
    later = again.where(place > F.col("first"))
    line = Window.partitionBy("did", "tie").orderBy("pos")
    if long_words is None:
        later = later.select("did", "tie", "pos").distinct()
        ends, end = F.lag("pos").over(line) + t, F.max("pos") + t
    else:
        later = later.groupBy("did", "tie", "pos").agg((F.col("pos") + F.max("n")).alias("z"))
        ends, end = F.max("z").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.max("z")
    fresh = (F.col("pos") > F.coalesce(ends, F.lit(-1))).cast("int")
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line)).groupBy("did", "tie", "run").agg(F.struct(F.min("pos").alias("a"), end.alias("z")).alias("span"))
    gone = runs.groupBy("did", "tie").agg(F.sort_array(F.collect_list("span")).alias("spans"))

    joined = docs.join(gone, ["did", "tie"], "left").withColumn("lines", F.split("text", "\n", -1))
    before = lambda k: F.when(k > 0, F.get("spans", k - 1)["z"]).otherwise(0)
    heads = F.transform(F.sequence(F.lit(0), F.size("spans") - 1), lambda k: F.slice("lines", before(k) + 1, F.get("spans", k)["a"] - before(k)))
    tail = F.slice("lines", F.element_at("spans", -1)["z"] + 1, F.size("lines"))
    kept = F.array_join(F.flatten(F.concat(heads, F.array(tail))), "\n")
    removed = F.aggregate("spans", F.lit(0), lambda s, x: s + x["z"] - x["a"])
    return joined.select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), *(["carried"] if carry else []),
    )
