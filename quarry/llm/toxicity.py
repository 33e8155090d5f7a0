"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs inside words to the letters they stand
for, all else to a space. Lexicon entries are whole words or beginnings of words. Occurrences within an exception
phrase don't count. The hits' weights, as a sum and normalised by the text's length, go through a logistic model.

``learn`` finds entries and weights from labelled texts: those that are much more frequent in toxic texts (a log-odds of
``min_weight`` or more and at least ``min_docs`` toxic texts). It learns exceptions too: two-word phrases with
an entry that only clean texts have, ``min_docs`` times or more; none is given by hand. All such entries and phrases are kept; what bounds them is the
sample: the classifier is fitted on at most ``most_rows`` labelled rows (those
with the least hash of their id). Scoring covers every whole text.

Edge cases: very long texts are matched whole, in one pass of the automaton; null and empty texts get the score of a text without hits; without toxic or clean labels the lexicon is empty and the score
is the share of toxic labels; equal texts score alike; rows that share a ``doc_id`` are scored each on its own; null ids aren't
held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches

# Look-alikes and what they stand for.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁɡαεικνορτυχ０１３４５７", "abekmhopctyxijsdgaeiknoptux013457")
# Digits and signs that replace letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"$": "s", "@": "a", "!": "i", "|": "l", "+": "t"}

OTHER_SCRIPT = re.compile("[ɐ-ԯ＀-￯]")
SIGN = re.compile(r"[$@!|+](?=[^\W\d_])")
ASCII = bytes(b + 32 if 65 <= b <= 90 else ord(SUBSTITUTES.get(chr(b), " ")) if b < 128 and not 97 <= b <= 122 else b for b in range(256))
#: Lengths of the beginnings of words that may be entries; whole words of any length may.
PREFIXES = (4, 5, 6)


def fold(text: str | None) -> str:
    """The folded text between two spaces."""
    if not text:
        return " "
    t = text.lower()
    if OTHER_SCRIPT.search(t):
        t = t.translate(HOMOGLYPHS)
    if SIGN.search(t):
        t = SIGN.sub(lambda m: SIGNS[m[0]], t)
    return " " + t.encode("utf-8", "surrogatepass").translate(ASCII).decode("utf-8", "surrogatepass") + " "


def candidates(folded: str) -> set[str]:
    """Possible entries: ``" word "`` and ``" begin"``."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for n in PREFIXES for w in words if len(w) > n}


@dataclass(frozen=True, eq=False)
class Model:
    """What the driver ships to the executors: the entries and phrases that a bounded sample gave, and three coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = 0.0
    by_sum: float = 0.0
    by_rate: float = 0.0


@lru_cache(maxsize=4)
def _automaton(model: Model):
    """Built once for a model, which a task gets once."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in model.weights.items():
        a.add_word(term, (len(term), weight))
    for phrase in model.exceptions:
        folded = fold(phrase)
        a.add_word(folded, (len(folded), None)) if folded not in a else None
    if len(a):
        a.make_automaton()
    return a


def hits(folded: str, model: Model) -> list[tuple[int, float]]:
    """``(start, weight)`` of each word with an entry, outside exception phrases; of several entries at a word the heaviest."""
    a = _automaton(model)
    if not len(a):
        return []
    found: dict[int, float] = {}
    harmless = []
    for end, (n, weight) in a.iter(folded):
        at = end - n + 1
        if weight is None:
            harmless.append((at, end))
        else:
            found[at] = max(weight, found.get(at, 0.0))
    return sorted((at, w) for at, w in found.items() if not any(a <= at < z for a, z in harmless))


def features(folded: str, model: Model) -> tuple[float, float, int]:
    """Log of the hits' weight, of the weight for each 100 words, and the number of hits."""
    found = hits(folded, model)
    if not found:
        return 0.0, 0.0, 0
    total = sum(w for _, w in found)
    return float(np.log1p(total)), float(np.log1p(100 * total / len(folded.split()))), len(found)


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.bias + x @ np.array([model.by_sum, model.by_rate]), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Bias and coefficients by Newton's method."""
    x1 = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x1.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(texts: DataFrame, min_weight: float = 2.5, min_docs: int = 3, min_share: float = 0.002, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from ``(text, toxic)`` rows with ``toxic`` 0 or 1; the rows are a bounded sample. ``exceptions`` are phrases known beforehand."""
    rows = texts.select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")

    def counted(keep):
        def run(batches):
            for batch in batches:
                seen = {0: Counter(), 1: Counter()}
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if keep is not None or toxic:
                        c = candidates(fold(text))
                        seen[toxic].update(c if keep is None else c & keep)
                    seen[toxic][""] += 1
                for toxic, counts in seen.items():
                    if counts:
                        yield pa.RecordBatch.from_pydict({"term": list(counts), "toxic": pa.array([toxic] * len(counts), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

        return rows.mapInArrow(run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        p = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Model(bias=float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    least = max(min_docs, int(min_share * n1))
    frequent = {r.term for r in counted(None).where((F.col("toxic") == 1) & (F.col("n") >= least) & (F.col("term") != "")).select("term").collect()}
    counts = {(r.term, r.toxic): r.n for r in counted(frequent).collect()}
    odds = {t: np.log((counts.get((t, 1), 0) + 0.5) / (n1 + 1)) - np.log((counts.get((t, 0), 0) + 0.5) / (n0 + 1)) for t in frequent}
    best = sorted(((w, t) for t, w in odds.items() if w >= min_weight), key=lambda x: (-x[0], x[1]))
    first = Model({t: float(w) for w, t in best}, tuple(exceptions))

    def phrased(batches):
        for batch in batches:
            out: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                for at, _ in hits(folded, first):
                    before, after = folded[:at].split()[-1:], folded[at:].split()[:2]
                    for phrase in {" ".join([*before, after[0]]) if before else "", " ".join(after) if len(after) == 2 else ""} - {""}:
                        out[phrase, toxic] += 1
            if out:
                yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in out], "toxic": pa.array([t for _, t in out], pa.int32()), "n": pa.array(list(out.values()), pa.int64())})

    phrases = rows.mapInArrow(phrased, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.max("toxic").alias("worst"))
    learned = [r.phrase for r in phrases.where((F.col("worst") == 0) & (F.col("clean") >= min_docs)).select("phrase").collect()]
    second = Model(first.weights, tuple(sorted({*first.exceptions, *learned})))

    def measured(batch):
        x = [features(fold(t), second) for t in batch.column(0).to_pylist()]
        return {"a": [v[0] for v in x], "b": [v[1] for v in x], "toxic": batch.column(1)}

    points = rows.mapInArrow(in_batches(measured), "a double, b double, toxic int").groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "toxic").count().toPandas()
    again = points.loc[points.index.repeat(points["count"])]
    bias, by_sum, by_rate = fit_logistic(again[["a", "b"]].to_numpy(float), again["toxic"].to_numpy(float))
    return Model(second.weights, second.exceptions, float(bias), float(by_sum), float(by_rate))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted, n_hits)`` of every whole text."""

    def run(batch):
        x = np.array([features(fold(t), model) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
        p = probability(x[:, :2], model)
        return {"doc_id": batch.column(0), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32)), "n_hits": pa.array(x[:, 2].astype(np.int64))}

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(in_batches(run), "doc_id long, score double, predicted int, n_hits long")


def held_out(id_col: str, parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept for evaluation: the CRC-32 of its id, as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``(text, toxic)`` of at most ``most_rows`` labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
