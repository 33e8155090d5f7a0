"""Token counts and cuts by a tokenizer file of the tokenizers library, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _count(path: str, text: str) -> int:
    return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)


def windows(path: str, text: str, most: int) -> list[str]:
    """Decoded pieces of at most ``most`` tokens each; where a decoded piece has more tokens when it's encoded again, it ends earlier."""
    tokenizer = _tokenizer(path)
    left, out = tokenizer.encode(text, add_special_tokens=False).ids, []
    while left:
        for n in range(min(most, len(left)), 0, -1):
            piece = tokenizer.decode(left[:n], skip_special_tokens=True).strip()
            if n == 1 or _count(path, piece) <= most:
                break
        out += [piece] if piece else []
        left = left[n:]
    return out


def count_tokens(path: str, c: Column | str) -> Column:
    @F.pandas_udf(IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _count(path, t)).astype("Int32")

    return run(c)


def split_tokens(path: str, c: Column | str, most: int) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else windows(path, t, most))

    return run(c)


def truncate_to_tokens(path: str, c: Column | str, most: int) -> Column:
    return F.coalesce(F.get(split_tokens(path, c, most), F.lit(0)), F.lit(""))
