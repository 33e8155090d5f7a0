"""The composed plans: build an index, answer a batch of questions, run an evaluation with resume."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import answering, bm25, chunking, embedding, retrieval, runs, vector_index
from quarry.plans.config import Config
from quarry.sources import writers
from quarry.sources.checkpoints import checkpointed


#: Vectors of a graph's shard on average.
SHARD = 4096


@dataclass
class Built:
    """A corpus with its index, ready for batches of questions."""

    config: Config
    chunks: DataFrame
    vectors: DataFrame | None = None
    inverted: vector_index.InvertedFile | None = None
    graphs: DataFrame | None = None
    router: vector_index.Router | None = None
    lexical: bm25.Bm25Index | None = None


def chunk(pages: DataFrame, config: Config) -> DataFrame:
    """Chunks with dense ids over documents in text order of their id."""
    if config.chunker == "presegmented":
        return chunking.presegmented(pages)
    folded = chunking.fixed_sentence(pages, config.chunk_size, config.chunk_overlap)
    return chunking.dense_ids(checkpointed(folded), "doc_id", [F.col("chunk_no")]).drop("chunk_no")


def _embedded(df: DataFrame, id_col: str, text_col: str, c: Config, prefix: str, encode) -> DataFrame:
    if c.embedder == "model":
        if encode is None:
            raise ValueError("a model embedder needs encode, a function that loads the model")
        return embedding.model_embed(df, id_col, text_col, encode, prefix)
    return embedding.hashing_embed(df, id_col, text_col, c.dimension, c.normalize, prefix)


def build(pages: DataFrame, config: Config, encode=None) -> Built:
    """The index of a corpus; ``encode`` loads the model where the embedder is one."""
    chunks = checkpointed(chunk(pages, config))
    if config.retrieval == "bm25":
        return Built(config, chunks, lexical=bm25.build(chunks, config.bm25_k1, config.bm25_b))
    vectors = checkpointed(_embedded(chunks, "vector_id", "text", config, config.document_prefix, encode))
    if embedding.embedding_violations(vectors, config.dimension, config.normalize).limit(1).count():
        raise ValueError("a vector has another dimension, a value that isn't finite, or isn't of unit length")
    built = Built(config, chunks, vectors)
    if config.index.startswith("ivf"):
        p = config.build_params()
        built.inverted = vector_index.train_ivf(vectors, p["nlist"], p.get("m"), p.get("nbits", 8), p["train_size"], p["train_seed"])
        built.vectors = checkpointed(vector_index.build_ivf(vectors, built.inverted))
    elif config.index == "hnsw":
        p = config.build_params()
        built.router = vector_index.train_router(vectors, max(1, -(-vectors.count() // SHARD)))
        built.graphs = checkpointed(vector_index.build_routed(vectors, built.router, p["m"], p["ef_construction"], 2 * SHARD))
    return built


class Clock:
    """Milliseconds of the stages of a batch; a stage ends when its table is in the shared folder."""

    def __init__(self, on: bool):
        self.on, self.ms = on, {}

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        if not self.on:
            return df
        began = time.perf_counter()
        df = checkpointed(df)
        self.ms[name] = self.ms.get(name, 0.0) + (time.perf_counter() - began) * 1000
        return df


def retrieve(built: Built, questions: DataFrame, k: int, encode=None, space: dict | None = None, clock: Clock | None = None) -> DataFrame:
    """The best ``k`` hits of ``(query_id, question)`` with chunk columns. ``space`` is that of the queries' embedder, if it isn't the index's own."""
    c, clock = built.config, clock or Clock(False)
    if built.lexical is not None:
        hits = clock.stage("index_search_ms", bm25.search(built.lexical, questions, k, "question"))
    else:
        embedding.same_space(c.space(), space or c.space())
        asked = clock.stage("query_embedding_ms", _embedded(questions, "query_id", "question", c, c.query_prefix, encode))
        search = c.plan().search
        if c.index == "flat_ip":
            hits = vector_index.flat_search(built.vectors, asked, k)
        elif c.index == "hnsw":
            # A few shards are all visited; of many, a quarter.
            shards = len(built.router.centroids)
            hits = vector_index.routed_search(built.graphs, built.router, asked, k, search["ef_search"], max(min(shards, 4), shards // 4))
        else:
            hits = vector_index.ivf_search(built.vectors, built.inverted, asked, k, search["nprobe"], search["max_codes"])
        hits = clock.stage("index_search_ms", hits)
    return clock.stage("chunk_mapping_ms", retrieval.with_chunks(hits, built.chunks))


def answer(built: Built, questions: DataFrame, scorer=None, encode=None, generate=None, space: dict | None = None, timed: bool = False) -> DataFrame:
    """A row per question of ``(query_id, question)``: results, context, prompt, answer, usage, status and error.

    ``scorer``, ``encode`` and ``generate`` are the models that the configuration names. ``timed`` adds ``timings_ms``: each stage's time for the whole batch over the
    number of its questions.
    """
    c = built.config
    if c.reranker == "cross_encoder" and scorer is None:
        raise ValueError("a cross-encoder needs a scorer column")
    if c.generator == "model" and generate is None:
        raise ValueError("a model generator needs generate, a function that loads the model")
    plan, clock = c.plan(), Clock(timed)
    found = retrieve(built, questions, plan.candidate_k, encode, space, clock)
    if c.reranker == "cross_encoder":
        ranked = retrieval.rerank(found.join(questions.select("query_id", F.col("question").alias("query")), "query_id"), scorer, plan.final_k).where("selected")
        found = ranked.withColumn("score", F.col("rerank_score")).withColumn("rank", F.col("rerank_rank")).drop("query", "rerank_score", "rerank_rank", "selected")
    else:
        found = retrieval.truncate_rank(found, plan.final_k)
    found = clock.stage("rerank_ms", found) if timed else checkpointed(found)
    context = answering.build_context(questions, found, c.context_tokens)
    rows = retrieval.traces(questions, found).join(context, "query_id")
    if c.generator == "model":
        rows = answering.build_prompt(rows, c.prompt)
        rows = rows.join(checkpointed(answering.model_answers(rows, generate)), "query_id")
        rows = answering.estimated_usage(rows).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))
    else:
        # Answers see what the context holds: hits that were left out or cut there are so here.
        used = answering.context_parts(found, c.context_tokens).where("included").withColumn("text", F.col("kept")).select(*found.columns)
        answers = answering.extractive_answers(questions, used, c.max_output_tokens)
        rows = answering.estimated_usage(answering.build_prompt(rows.join(answers, "query_id"), c.prompt))
        rows = rows.withColumn("error", F.lit(None).cast("struct<type:string,message:string>")).withColumn("status", F.lit("success"))
    if not c.save_retrieved_text:
        rows = rows.withColumn("results", F.transform("results", lambda r: r.dropFields("text")))
    if timed:
        n = max(questions.count(), 1)
        rows = rows.withColumn("timings_ms", F.struct(*[F.lit(ms / n).alias(name) for name, ms in clock.ms.items()]))
    return rows


def run(built: Built, questions: DataFrame, path: str, rows_per_attempt: int | None = None, **models) -> DataFrame:
    """Answers what has no successful row under ``path`` yet, appends it there, and returns all rows in question order."""
    spark = questions.sparkSession
    done = spark.read.parquet(path) if writers.exists(spark, path) else None
    left = questions if done is None else runs.pending(questions.withColumnRenamed("query_id", "question_id"), done.withColumnRenamed("query_id", "question_id")).withColumnRenamed("question_id", "query_id")
    if rows_per_attempt is not None:
        left = left.orderBy("query_id").limit(rows_per_attempt)
    left = checkpointed(left)
    if left.limit(1).count():
        runs.safe_rows(answer(built, left, **models)).write.mode("append").parquet(path)
    return spark.read.parquet(path).orderBy("query_id")
