"""Built indexes on disk: content-addressed, committed by rename, verified when they're opened.

An artifact's name is the digest of what changes results: the configuration and the corpus's inventory. The same build again finds the
artifact and verifies it; a build that loses a race uses the winner's. Row counts, dense ids, id agreement between chunks and vectors, and vector
rules are checked by queries; nothing data-sized comes to the driver.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, chunking, embedding, vector_index
from quarry.plans.config import Config
from quarry.plans.engine import Built, build
from quarry.sources import writers

FORMAT = 2
#: Vectors by which a stored exact index is searched after it is built.
CHECKED_QUERIES = 3


def artifact_name(config: Config, inventory: dict) -> str:
    kind = "bm25" if config.retrieval == "bm25" else "build"
    return writers.identity(kind, {"format": FORMAT, "config": config.recorded(), "corpus": inventory["sha256"]})


def _write(built: Built, path: str, manifest: dict) -> None:
    spark = built.chunks.sparkSession
    built.chunks.write.parquet(f"{path}/chunks")
    counts = {"chunks": spark.read.parquet(f"{path}/chunks").count()}
    if built.lexical is not None:
        built.lexical.write(f"{path}/bm25")
        manifest |= {"bm25": {"count": built.lexical.count, "avgdl": built.lexical.avgdl}}
    else:
        writer = built.vectors.write
        (writer.partitionBy("cell") if built.inverted else writer).parquet(f"{path}/vectors")
        counts["vectors"] = spark.read.parquet(f"{path}/vectors").count()
        if built.graphs is not None:
            built.graphs.write.parquet(f"{path}/graphs")
        if built.inverted is not None or built.router is not None:
            arrays = [("centroids", (built.inverted or built.router).centroids)] + ([("books", built.inverted.books)] if built.inverted and built.inverted.books is not None else [])
            rows = [(name, list(a.shape), a.astype(float).ravel().tolist()) for name, a in arrays]
            spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.parquet(f"{path}/trained")
    writers.write_manifest(spark, f"{path}/manifest.json", manifest | {"rows": counts})


def verify(built: Built, rows: dict) -> None:
    """Raises ``ValueError`` at the first rule that the tables break."""
    c = built.config
    if built.chunks.count() != rows["chunks"] or not chunking.contiguous(built.chunks).first().contiguous:
        raise ValueError("chunks are missing, or their ids have gaps")
    if chunking.chunk_violations(built.chunks, c.chunk_size if c.chunker == "fixed_sentence" else None).limit(1).count():
        raise ValueError("a chunk breaks its rules")
    if built.lexical is not None:
        if built.lexical.count != rows["chunks"] or built.lexical.postings.where("weight <= 0 or tf <= 0").limit(1).count():
            raise ValueError("the lexical index belongs to other chunks")
        return
    if built.vectors.count() != rows["vectors"] or rows["vectors"] != rows["chunks"] or built.vectors.select("vector_id").join(built.chunks.select("vector_id"), "vector_id", "left_anti").limit(1).count():
        raise ValueError("vectors and chunks differ")
    if "embedding" in built.vectors.columns and embedding.embedding_violations(built.vectors, c.dimension, c.normalize).limit(1).count():
        raise ValueError("a vector breaks its rules")


def open_artifact(spark: SparkSession, path: str, config: Config) -> Built:
    """A verified artifact; another configuration's raises."""
    manifest = writers.read_manifest(spark, f"{path}/manifest.json")
    if manifest.get("format") != FORMAT or manifest["config"] != json.loads(writers.canonical_json(config.recorded())):
        raise ValueError("the artifact was built with another configuration")
    built = Built(config, spark.read.parquet(f"{path}/chunks"))
    if "bm25" in manifest:
        built.lexical = bm25.Bm25Index.read(spark, f"{path}/bm25")
    else:
        built.vectors = spark.read.parquet(f"{path}/vectors")
        if config.index != "flat_ip":
            arrays = {r.name: np.array(r.data).reshape(r.shape) for r in spark.read.parquet(f"{path}/trained").collect()}
        if config.index == "hnsw":
            built.graphs, built.router = spark.read.parquet(f"{path}/graphs"), vector_index.Router.over(arrays["centroids"])
        if config.index.startswith("ivf"):
            built.inverted = vector_index.InvertedFile(arrays["centroids"], arrays.get("books"))
    verify(built, manifest["rows"])
    return built


def build_or_open(spark: SparkSession, corpus_path: str, read, config: Config, root: str, encode=None) -> tuple[str, Built]:
    """``(path, index)`` of the corpus below ``corpus_path``, whose pages ``read(spark, path)`` gives.

    The corpus is inventoried before and after a build; if it changed meanwhile, the build is dropped.
    """
    before = writers.inventory(spark, corpus_path)
    path = f"{root.rstrip('/')}/{artifact_name(config, before)}"
    if not writers.exists(spark, path):
        built = build(read(spark, corpus_path), config, encode)
        manifest = {"format": FORMAT, "config": config.recorded(), "corpus": before, "spark": spark.version}

        def write(staging: str) -> None:
            _write(built, staging, manifest)
            if writers.inventory(spark, corpus_path) != before:
                raise ValueError("the corpus changed while it was indexed")
            if config.retrieval == "dense" and config.index == "flat_ip":
                asked = built.vectors.where(F.col("vector_id") < CHECKED_QUERIES).select(F.col("vector_id").alias("query_id"), "embedding")
                stored = open_artifact(spark, staging, config)
                if exactness(stored, asked).first().wrong:
                    raise ValueError("the stored index isn't exact")

        writers.commit(spark, path, write)
    return path, open_artifact(spark, path, config)


def exactness(built: Built, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row: how many hits of an exact index differ from a plain dot product over all vectors; for a check after a build on few queries."""
    from quarry.functions.vectors import dot
    from quarry.operators.retrieval import missing_chunks

    found = vector_index.flat_search(built.vectors, queries, k)
    scored = found.join(built.vectors, "vector_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    wrong = F.abs(dot(F.col("embedding"), F.col("q")) - F.col("score")) > 1e-6 + 1e-5 * F.abs("score")
    lost = missing_chunks(found, built.chunks).count()
    return scored.agg(F.count("*").alias("hits"), (F.count_if(wrong) + lost).alias("wrong"))
