"""Digests and the deterministic generator of the sampling operators."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SplitMix64 generator.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)


def selection_hash(seed: str, question: Column | str) -> Column:
    """SHA-256 of the seed, a zero character and the normal form of a question; fixed width, so its text order is its order."""
    question = F.col(question) if isinstance(question, str) else question
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), question).cast("binary"), 256)


def question_id(question: Column | str) -> Column:
    question = F.col(question) if isinstance(question, str) else question
    return F.concat(F.lit("nq_"), F.sha2(question.cast("binary"), 256))


def list_digest(ordered: Column) -> Column:
    """SHA-256 of the elements, each with a line end; of nothing for an empty array."""
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)


def splitmix64(n: np.ndarray, seed: int) -> np.ndarray:
    """The ``n``-th values (from 1) of SplitMix64, whose state after ``n`` steps is ``seed + n * GAMMA``."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + n.astype(np.uint64) * np.uint64(GAMMA)
        for shift, factor in zip(SHIFTS, MULTIPLIERS):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(SHIFTS[2]))


def seed_of(name: str) -> int:
    """The first eight bytes, big-endian, of a name's SHA-256."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


def token_hash(token: str) -> int:
    """The BLAKE2b-64 of a token, little-endian."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def sequence_digest(count: int) -> str:
    """SHA-256 of the JSON array ``[0,1,...,count-1]``, a block of numbers at a time."""
    if isinstance(count, bool) or not isinstance(count, int) or count < 0:
        raise ValueError("the count is an integer of 0 or more")
    h, block = hashlib.sha256(b"["), 1 << 16
    for at in range(0, count, block):
        h.update(("," * (at > 0) + ",".join(map(str, range(at, min(at + block, count))))).encode())
    h.update(b"]")
    return h.hexdigest()
