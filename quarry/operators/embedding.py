"""Embeddings of texts: signed token hashing, a hook for models, and checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import token_hash

#: What counts as a token of a lower-cased text.
EMBEDDED = re.compile(r"[A-Za-z0-9_]+")
TEXTS_AT_ONCE = 512


class TokenHashes:
    """``token -> BLAKE2b-64`` of what a task has met, forgotten when it's too much."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        for t in set(tokens) - self.known.keys():
            self.known[t] = token_hash(t)
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))


def hashing_embed(df: DataFrame, id_col: str, text_col: str, dimension: int = 384, normalize: bool = True, prefix: str = "") -> DataFrame:
    """``(id, embedding)``, a row per input row: signed token counts in ``dimension`` buckets. Nothing is shuffled.

    A token's hash gives its bucket and, by its highest bit, its sign. A null text, and one without tokens, has the zero vector; rows that share an id
    are embedded each on its own.
    """

    def dense(batches):
        hashes = TokenHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                tokens = [[] if t is None else EMBEDDED.findall((prefix + t).lower()) for t in part.column(1).to_pylist()]
                v = hashes([t for row in tokens for t in row])
                place = np.repeat(np.arange(len(tokens)), [len(row) for row in tokens]) * dimension + (v % np.uint64(dimension)).astype(np.int64)
                x = np.bincount(place, np.where(v >> np.uint64(63), -1.0, 1.0), len(tokens) * dimension).astype(float).reshape(-1, dimension)
                if normalize:
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x /= np.where(norm == 0, 1, norm)
                flat = pa.array(x.astype(np.float32).ravel())
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dimension), flat)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(dense, f"`{id_col}` {kind}, embedding array<float>")


def model_embed(df: DataFrame, id_col: str, text_col: str, encode: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> DataFrame:
    """``(id, embedding)`` by a model: ``encode()`` is called once a task and returns a function of a batch of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for texts in batches:
            yield pd.Series(list(np.asarray(model([prefix + t for t in texts]), np.float32)))

    return df.select(id_col, run(F.col(text_col)).alias("embedding"))


def embedding_violations(df: DataFrame, dimension: int, normalized: bool, col: str = "embedding") -> DataFrame:
    """Rows whose vector has another dimension, a value that isn't finite, or, if asked, another length than 1 (zero vectors excepted)."""
    v = F.col(col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    bad = F.size(v) != dimension
    bad |= F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if normalized:
        bad |= (norm != 0) & (F.abs(norm - 1) > 1e-5 + 1e-4)
    return df.where(v.isNull() | bad)


def same_space(a: dict, b: dict) -> None:
    """Raises if two embedding spaces differ; the query prefix isn't part of a space."""
    different = [k for k in sorted({*a, *b} - {"query_prefix"}) if a.get(k) != b.get(k)]
    if different:
        raise ValueError(f"the embedding spaces differ in {different}")
