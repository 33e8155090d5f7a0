"""Benchmark preparation: question selection, context resolution, hard negatives, reservoir sampling, the selected corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import question_id, seed_of, selection_hash, splitmix64
from quarry.functions.text import normalize_text, strip
from quarry.sources.checkpoints import checkpointed

#: The default protocol, whose name is the default seed.
PROTOCOL = "nq_open_dpr_wiki_1m_gold_preserving_v1"
DEFAULTS = {"target_passages": 1_000_000, "calibration_questions": 500, "evaluation_questions": 1500, "hard_negatives_per_question": 50, "seed": PROTOCOL}


def answers(c: Column) -> Column:
    """Stripped, non-blank answers, once each, in order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda a: a != ""))


def passage_id(ctx: Column) -> Column:
    """A context's id as canonical decimal text: ``passage_id``, else ``id``; null if neither is there. Impossible ids raise."""
    raw = strip(F.coalesce(ctx["passage_id"].cast("string"), ctx["id"].cast("string")))
    number = raw.try_cast("long")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(number > 0, number.cast("string")).otherwise(F.raise_error(F.concat(F.lit("invalid passage id "), raw)).cast("string"))


def select_questions(source: DataFrame, total: int, seed: str = PROTOCOL, calibration: int = 0, hard_negatives: int | None = None) -> DataFrame:
    """The ``total`` questions of ``(position, question, ...)`` with the least seeded hash, their order, and ``split``: the first
    ``calibration`` are for calibration.

    A bounded top-k; no full sort. Other columns are carried; ``hard_negative_ctxs`` is cut to ``hard_negatives``.
    """
    named = source.withColumn("normalized", normalize_text("question"))
    named = named.withColumn("question_id", question_id("normalized")).withColumn("selection_hash", selection_hash(seed, "normalized"))
    if hard_negatives is not None:
        named = named.withColumn("hard_negative_ctxs", F.slice("hard_negative_ctxs", 1, hard_negatives))
    best = checkpointed(named.orderBy("selection_hash", "position").limit(total))  # total rows, numbered below in one small window
    numbered = best.withColumn("selection_no", F.row_number().over(Window.orderBy("selection_hash", "position")))
    return numbered.withColumn("split", F.when(F.col("selection_no") <= calibration, "calibration").otherwise("evaluation"))


def duplicate_questions(source: DataFrame) -> DataFrame:
    """Normal forms that occur more than once, blank ones included at any count; any row here is an error of the source."""
    n = source.select(normalize_text("question").alias("normalized"))
    return n.groupBy("normalized").count().where((F.col("count") > 1) | (F.col("normalized") == ""))


def resolve_contexts(contexts: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds ``resolved_id`` and ``problem`` to ``(ctx_no, passage_id, title, text)`` from ``(id, title, text)``.

    A context with an id must equal that passage in normal form; one without must equal exactly one passage. ``problem`` is null, or one
    of ``absent``, ``mismatch``, ``none``, ``many``.
    """
    wiki = passages.select(F.col("id").cast("string").alias("wiki_id"), normalize_text("title").alias("wt"), normalize_text("text").alias("wx"))
    ctx = contexts.withColumn("ct", normalize_text("title")).withColumn("cx", normalize_text("text"))
    by_id = ctx.where("passage_id is not null").join(wiki, F.col("passage_id") == F.col("wiki_id"), "left")
    problem = F.when(F.col("wiki_id").isNull(), "absent").when((F.col("ct") != F.col("wt")) | (F.col("cx") != F.col("wx")), "mismatch")
    by_id = by_id.select(*contexts.columns, F.col("passage_id").alias("resolved_id"), problem.alias("problem"))
    keys = ctx.where("passage_id is null").select("ct", "cx").distinct()
    counted = wiki.join(keys, (F.col("wt") == F.col("ct")) & (F.col("wx") == F.col("cx"))).groupBy("ct", "cx").agg(F.count("*").alias("n"), F.min("wiki_id").alias("only"))
    by_text = ctx.where("passage_id is null").join(counted, ["ct", "cx"], "left").na.fill(0, ["n"])
    by_text = by_text.select(*contexts.columns, F.when(F.col("n") == 1, F.col("only")).alias("resolved_id"), F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "many").alias("problem"))
    return by_id.unionByName(by_text)


def title_expansion(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """Ids of all passages whose normal title is among the positives' ``title``."""
    wanted = titles.select(normalize_text("title").alias("t")).distinct()
    return passages.withColumn("t", normalize_text("title")).join(wanted, "t", "left_semi").select(F.col("id").cast("string").alias("id"))


def round_robin(negatives: DataFrame, excluded: DataFrame, most: int, per_question: int) -> DataFrame:
    """``(id, pick_no)``: passages of ``(selection_no, pos, id)`` taken in turns, all first ones in question order, then all second ones, and so
    on; without excluded ones, each once, ``most`` at most."""
    left = negatives.where(F.col("pos") < per_question).join(excluded.select("id").distinct(), "id", "left_anti")
    first = left.groupBy("id").agg(F.min(F.struct("pos", "selection_no")).alias("turn"))
    top = first.orderBy("turn", "id").limit(most)
    return checkpointed(top).withColumn("pick_no", F.row_number().over(Window.orderBy("turn", "id"))).select("id", "pick_no")


def draws(i: np.ndarray, target: int, start: int, breaks: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``(slot drawn, whether the draw is refused)`` of rows ``i``, from 1, beyond the first ``target``; ``breaks`` are the rows, in order, of the draws
    refused so far, each of which shifts its own row's draw and all later ones by one."""
    at = i.astype(np.uint64)
    value = splitmix64(at - np.uint64(target) + np.searchsorted(breaks, i, side="right").astype(np.uint64), start)
    if bits < 64:
        value &= np.uint64((1 << bits) - 1)
        spare, top = np.uint64(1 << bits) % at, np.uint64((1 << bits) - 1)
    else:
        spare, top = (np.uint64(0) - at) % at, np.uint64(0xFFFFFFFFFFFFFFFF)
    # Refused are the last 2^bits mod i values.
    return (value % at).astype(np.int64), (spare > 0) & (value > top - spare)


def refused_rows(spark: SparkSession, total: int, target: int, start: int, bits: int = 64) -> np.ndarray:
    """The rows, in order, whose draws the rejection rule refuses; one pass over the row numbers after each.

    Of ``n`` rows about ``n ** 2 / 2 ** 65`` are refused: none below a billion rows, a few at ten billion.
    """
    breaks: list[int] = []
    while True:
        known = np.array(breaks, np.int64)

        def refused(batches, known=known):
            for b in batches:
                i = b.column(0).to_numpy()
                _, bad = draws(i, target, start, known, bits)
                if bad.any():
                    yield pa.RecordBatch.from_pydict({"i": pa.array([int(i[bad].min())], pa.int64())})

        begin = max(target + 1, breaks[-1] if breaks else 0)
        if begin > total:
            return known
        first = spark.range(begin, total + 1).mapInArrow(refused, "i long").agg(F.min("i")).first()[0]
        if first is None:
            return known
        breaks.append(first)


def reservoir(eligible: DataFrame, target: int, seed: str, id_col: str = "id", bits: int = 64) -> DataFrame:
    """``(slot, id)``: Algorithm R over the ids in numeric order, with SplitMix64 draws, computed for all rows at once.

    The generator's state after ``n`` draws is known in closed form, and row ``i`` beyond the first ``target`` makes draw ``i - target``, later by
    one for each draw refused before; a slot holds the last row that drew it. Rows are numbered by ranges, not in one task. ``bits`` under 64 narrows the
    generator, for tests of refused draws.
    """
    from quarry.operators.chunking import dense_ids

    start = seed_of(f"{seed}\0background")
    rows = eligible.select(F.col(id_col).cast("long").alias("n"), F.col(id_col).cast("string").alias("id"))
    # Ranges of ids are the groups, so that group order is id order.
    numbered = dense_ids(rows.withColumn("g", F.floor(F.col("n") / 4096)), "g", [F.col("n")], "i").withColumn("i", F.col("i") + 1)
    if target <= 0:
        return numbered.limit(0).select(F.col("i").alias("slot"), "id")
    numbered = checkpointed(numbered.select("i", "id"))
    breaks = refused_rows(eligible.sparkSession, numbered.count(), target, start, bits)

    @F.pandas_udf("long")
    def drawn(i: pd.Series) -> pd.Series:
        return pd.Series(draws(i.to_numpy(np.int64), target, start, breaks, bits)[0])

    head = numbered.where(F.col("i") <= target).select((F.col("i") - 1).alias("slot"), "i", "id")
    later = numbered.where(F.col("i") > target).withColumn("slot", drawn("i")).where(F.col("slot") < target).select("slot", "i", "id")
    return head.union(later).groupBy("slot").agg(F.max_by("id", "i").alias("id"))


def background(passages: DataFrame, excluded: DataFrame, target: int, seed: str = PROTOCOL) -> DataFrame:
    """Ids of a reservoir of ``target`` passages that are not excluded; fewer eligible ones than that raise."""
    eligible = checkpointed(passages.select(F.col("id").cast("string").alias("id")).join(excluded.select("id").distinct(), "id", "left_anti"))
    if eligible.count() < target:
        raise ValueError("there are fewer eligible passages than the background needs")
    return reservoir(eligible, target, seed).select("id")


def ids_digest(ids: DataFrame, col: str = "id", numeric: bool = True) -> DataFrame:
    """One row: the number of distinct ids and their order-free digest, SHA-256 of the sorted ids, each with a line end.

    The ids are sorted by ranges on the executors and packed into blocks; the driver hashes the blocks as they come, one at a time.
    """
    c = F.col(col).cast("string")
    ordered = ids.select(c.alias("id")).distinct().orderBy(*([F.col("id").cast("long")] if numeric else []), "id")

    def packed(batches):
        for b in batches:
            listed = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(listed)], pa.int64()), "block": ["".join(f"{i}\n" for i in listed).encode()]})

    n, h = 0, hashlib.sha256()
    for r in ordered.mapInArrow(packed, "n long, block binary").toLocalIterator():
        n += r.n
        h.update(r.block)
    return ids.sparkSession.createDataFrame([(n, h.hexdigest())], "n long, sha256 string").coalesce(1)


def selected_corpus(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """The selected passages, exactly ``(id, title, text)``, in numeric order."""
    chosen = passages.join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    return chosen.select(F.col("id").cast("string").alias("id"), "title", "text").orderBy(F.col("id").cast("long"))


def question_rows(selected: DataFrame) -> DataFrame:
    """Prepared questions from ``(question_id, question, answers, positive_ids)``."""
    keys = F.array_distinct(F.transform("positive_ids", lambda i: F.concat(F.lit("dpr_wiki_passage:"), i)))
    return selected.select("question_id", strip("question").alias("question"), answers(F.col("answers")).alias("answers"), F.lit(True).alias("answerable"), F.lit("nq_open").alias("question_type"), F.array(F.struct(keys.alias("alternatives"))).alias("evidence"))
