"""Plans by query, hits with their chunks, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_violations(plans: DataFrame) -> DataFrame:
    """Plans ``(query_id, enabled, candidate_k, final_k)`` that are off but ask for hits, or on with impossible depths."""
    off = ~F.col("enabled") & ((F.col("candidate_k") != 0) | (F.col("final_k") != 0))
    on = F.col("enabled") & ((F.col("final_k") <= 0) | (F.col("candidate_k") < F.col("final_k")))
    return plans.where(off | on)


def gated(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """Only queries whose plan retrieves; the others never reach a scan."""
    return queries.join(plans.where("enabled and candidate_k > 0").select("query_id"), "query_id", "left_semi")


def limit_by_plan(ranked: DataFrame, plans: DataFrame, depth: str, most: int) -> DataFrame:
    """Hits within each query's own depth. The literal ``most`` lets ranks beyond any plan be cut early."""
    return ranked.where(F.col("rank") <= most).join(plans.select("query_id", depth), "query_id").where(F.col("rank") <= F.col(depth)).drop(depth)


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns; after the top-k, so only returned texts are read into the join. A hit without a chunk raises.

    Chunks are first reduced to those of hits: a left join alone can't ship the hits, and would shuffle all texts.
    """
    mine = chunks.join(hits.select("vector_id").distinct(), "vector_id", "left_semi")
    found = hits.join(mine.withColumn("_there", F.lit(True)), "vector_id", "left")
    known = F.when(F.col("_there"), F.col("vector_id")).otherwise(F.raise_error(F.concat(F.lit("no chunk has the id "), F.col("vector_id").cast("string"))).cast(hits.schema["vector_id"].dataType))
    return found.withColumn("vector_id", known).drop("_there")


def chunks_by_id(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of ``(position, vector_id)``, in order of position; repeated ids give a row each, unknown ones raise."""
    return with_chunks(ids.select("position", "vector_id"), chunks).orderBy("position")


def missing_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks.select("vector_id"), "vector_id", "left_anti")


def traces(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a query with its hits as an array in rank order; gated queries have an empty one."""
    columns = [c for c in ranked.columns if c != "query_id"]
    hit = F.struct("rank", *[c for c in columns if c != "rank"])
    grouped = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("results"))
    empty = F.array().cast(grouped.schema["results"].dataType)
    return queries.join(grouped, "query_id", "left").withColumn("results", F.coalesce("results", empty))


def truncate_rank(ranked: DataFrame, final_k: int | None) -> DataFrame:
    """The reranker that keeps the order: the first ``final_k`` of each query."""
    return ranked if final_k is None else ranked.where(F.col("rank") <= final_k)


def rerank(candidates: DataFrame, scorer: Column, final_k: int | None = None) -> DataFrame:
    """Adds ``rerank_score``, ``rerank_rank`` and ``selected``. Equal scores keep the candidates' order; ``final_k`` beyond their number
    selects all. Scores that aren't finite raise."""
    finite = F.when(scorer.isNotNull() & ~F.isnan(scorer) & (F.abs(scorer) != float("inf")), scorer).otherwise(F.raise_error(F.lit("a score isn't finite")).cast("double"))
    scored = candidates.withColumn("rerank_score", finite)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order))
    return ranked.withColumn("selected", F.lit(True) if final_k is None else F.col("rerank_rank") <= final_k)


def model_scorer(load, query: str = "query", text: str = "text", batch: int = 64) -> Column:
    """A scorer column by a cross-encoder: ``load()`` runs once a task and returns a function of (query, text) pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            pairs = list(zip(q, t))
            parts = [np.asarray(model(pairs[at : at + batch]), np.float64) for at in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col(query), F.col(text))


def overlap_scorer(query: str = "query", text: str = "text") -> Column:
    """A lexical stand-in for a model: distinct words of the query that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.size(F.array_intersect(words(query), words(text))).cast("double")
