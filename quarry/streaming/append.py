"""Incremental index growth: new vectors are appended as they arrive, ids once only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.vector_index import InvertedFile, build_ivf, id_violations
from quarry.sources.writers import exists


def append_vectors(stream: DataFrame, path: str, checkpoint: str, index: InvertedFile | None = None, **trigger) -> StreamingQuery:
    """Starts a query that appends ``(vector_id, embedding)`` of each micro-batch to the index table at ``path``.

    A batch that is replayed after a failure writes its own folder again, so nothing is there twice; ids that another batch has
    brought, or that a batch brings twice, fail the query.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = spark.read.parquet(path).where(f"batch <> {number}") if exists(spark, path) else None
        if id_violations(batch, others).limit(1).count():
            raise ValueError(f"batch {number} holds ids that are there already")
        rows = batch.select("vector_id", "embedding") if index is None else build_ivf(batch, index)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
