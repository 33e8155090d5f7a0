"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: two texts are as alike as the character n-grams of length 1 to ``n``
that both have, normalised by how many each has. N-grams are of lower-cased letters, with one gap
between words, and are hashed to ``2 ** SLOT_BITS`` slots; the n-grams of the landmarks are the vocabulary. Nyström landmarks
approximate the kernel, one-versus-rest ridge regression in their feature space is the classifier, and because it's linear in the
presence matrix, whole batches are scored by one matrix product.

The classifier is fitted on at most ``per_class`` labelled rows of each language (chosen by a hash of id and text), of however many languages there are;
the number of landmarks grows with the languages. Executors turn the fitted rows into features and sums; the driver holds the landmarks' n-grams, a kernel
matrix of their number squared and the sums, never the rows. Prediction covers every whole text.

Edge cases: very long texts are whole rows of the presence matrix, whose width is the vocabulary; null texts and texts without a letter are ``und`` with score 0; without any labels all are ``und``; with one label all
others get it; equal texts get equal results; repeated rows give a row each; null ids aren't held out; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, in_batches
from quarry.llm.toxicity import held_out

SLOT_BITS = 18
LETTER = regex.compile(r"\p{L}")
GAP = 1


def _letters() -> np.ndarray:
    """A number for each code point of the basic plane: itself for letters and marks, ``GAP`` for all else."""
    import unicodedata

    points = np.arange(65536, dtype=np.int64)
    keep = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(65536)])
    return np.where(keep, points + 2, GAP).astype(np.int64)


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The letters' numbers, every run of other characters as one gap, a gap at both ends."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points > 65535
    out = _TABLE[0][np.where(wide, 0x4E00, points)] if wide.any() else _TABLE[0][points]
    gap = out == GAP
    again = gap[1:] & gap[:-1]
    return out[np.concatenate([[True], ~again])] if again.any() else out


def slots(symbol: np.ndarray, n: int) -> list[np.ndarray]:
    """The slots of all n-grams of 1 to ``n`` symbols, an array for each length."""
    out, code = [], np.zeros(len(symbol), np.uint64)
    s = symbol.astype(np.uint64)
    for k in range(1, min(n, len(s)) + 1):
        code = code[: len(s) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + s[k - 1 :]
        out.append((((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return out


def presence(text: str, n: int) -> np.ndarray:
    """The sorted, distinct slots of a text."""
    return np.unique(np.concatenate(slots(symbols(text), n)))


@dataclass(frozen=True)
class Model:
    n: int
    classes: tuple[str, ...]
    columns: np.ndarray  # slot -> column of the presence matrix, or the last, unused one
    product: np.ndarray  # presence matrix -> unnormalised class scores


@dataclass(frozen=True)
class Basis:
    """Nyström landmarks: which have an n-gram (``owners`` from ``starts`` on, column by column), and the inverse root of their kernel matrix."""

    columns: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray
    root: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """The kernel of each set of slots with each landmark, over the landmarks' n-grams."""
        out, width = np.zeros((len(sets), len(self.sizes))), len(self.starts) - 1
        for k, s in enumerate(sets):
            c = self.columns[s]
            c = c[c < width]
            n = self.starts[c + 1] - self.starts[c]
            at = np.repeat(self.starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[k] = np.bincount(self.owners[at], minlength=len(self.sizes)) / np.sqrt(max(len(c), 1))
        return out / np.sqrt(self.sizes)

    def features(self, sets: list[np.ndarray]) -> np.ndarray:
        """Nyström features and a constant."""
        return np.column_stack([self.kernel(sets) @ self.root, np.ones(len(sets))])


def basis(marks: list[np.ndarray]) -> Basis:
    vocabulary = np.unique(np.concatenate(marks))
    columns = np.full(1 << SLOT_BITS, len(vocabulary), np.int32)
    columns[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    column = np.concatenate([columns[m] for m in marks])
    owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    order = np.argsort(column, kind="stable")
    starts = np.searchsorted(column[order], np.arange(len(vocabulary) + 1))
    sizes = np.array([max(len(m), 1) for m in marks], float)
    plain = Basis(columns, starts, owner[order], sizes, np.eye(len(marks)))
    values, vectors = np.linalg.eigh(plain.kernel(marks))
    keep = values > 1e-6 * values.max()
    return Basis(columns, starts, owner[order], sizes, vectors[:, keep] / np.sqrt(values[keep]))


def sums(b: Basis, sets: list[np.ndarray], which: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted products of the features, and their weighted sums for each class; ``which`` are the rows' classes."""
    f = b.features(sets)
    w = weights[which][:, None]
    per_class = np.zeros((len(weights), f.shape[1]))
    np.add.at(per_class, which, f * w)
    return f.T @ (f * w), per_class


def solved(b: Basis, classes: tuple[str, ...], products: np.ndarray, per_class: np.ndarray, rows: int, n: int, ridge: float) -> Model:
    """One-versus-rest ridge regression from the sums over all rows."""
    targets = 2 * per_class - per_class.sum(axis=0)  # 1 for a row's own class, -1 for the others
    beta = np.linalg.solve(products + ridge * rows * np.eye(len(products)), targets.T)
    by_mark = (b.root @ beta[:-1]) / np.sqrt(b.sizes)[:, None]
    product = np.zeros((len(b.starts), len(classes)), np.float32)
    column = np.repeat(np.arange(len(b.starts) - 1), np.diff(b.starts))
    for c in range(len(classes)):
        product[:-1, c] = np.bincount(column, by_mark[b.owners, c], len(b.starts) - 1)
    # The bias goes into the product's last row, which the unused column reads.
    product[-1] = beta[-1]
    return Model(n, classes, b.columns, product)


def class_weights(counts: list[int]) -> np.ndarray:
    """Classes count alike."""
    return sum(counts) / (len(counts) * np.array(counts, float))


def train(sets: list[np.ndarray], langs: list[str], n: int = 3, landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """A model from rows held here; ``learn`` does the same over executors."""
    classes = tuple(sorted(set(langs)))
    by_class = [[k for k, x in enumerate(langs) if x == c] for c in classes]
    # Landmarks are dealt from the classes in turn, in the given order.
    turns = sorted((j, k) for rows in by_class for j, k in enumerate(rows))
    b = basis([sets[k] for _, k in turns[: max(landmarks, 2 * len(classes))]])
    which = np.searchsorted(np.array(classes), np.array(langs))
    return solved(b, classes, *sums(b, sets, which, class_weights([len(r) for r in by_class])), len(sets), n, ridge)


def class_scores(texts: list[str], model: Model) -> np.ndarray:
    """The regression's outputs, a row for each text."""
    m = np.zeros((len(texts), len(model.product)), np.float32)
    for k, t in enumerate(texts):
        row = m[k]
        for s in slots(symbols(t), model.n):
            row[model.columns[s]] = 1
    m[:, -1] = 0
    size = np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    return (m @ model.product) / size + model.product[-1]


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", n: int = 3, per_class: int = 300, landmarks: int = 128, ridge: float = 1e-3) -> Model | None:
    """A model from labelled rows whose id isn't held out; ``None`` without any. ``landmarks`` are at least two a language."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 5, 0)).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    # A frequent language's rows are thinned before they meet, to about twice what is taken.
    share = F.least(F.lit(1.0), (F.lit(2.0) * per_class + 20) / F.col("n"))
    thinned = known.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64(F.lit(7), "h"), F.lit(1 << 30)) < share * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = thinned.withColumn("r", nth).where(F.col("r") <= per_class).select("lang", "text", "h", "r")

    def run(batch):
        texts = batch.column(1).to_pylist()
        sets = [presence(t, n).astype(np.int32).tobytes() if LETTER.search(t) else None for t in texts]
        return {"lang": batch.column(0), "set": pa.array(sets, pa.binary()), "h": batch.column(2), "r": batch.column(3)}

    rows = checkpointed(picked.mapInArrow(in_batches(run), "lang string, set binary, h long, r int").where("set is not null"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    classes = tuple(sorted(sizes))
    marks = [np.frombuffer(r.set, np.int32) for r in rows.orderBy("r", "h", "lang").limit(max(landmarks, 2 * len(classes))).collect()]
    spark, width = docs.sparkSession, 1000
    shared = spark.sparkContext.broadcast((basis(marks), {c: k for k, c in enumerate(classes)}, class_weights([sizes[c] for c in classes])))

    def partial(batches):
        b, number, weights = shared.value
        total = None
        for batch in batches:
            sets = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            more = sums(b, sets, np.array([number[x] for x in batch.column(0).to_pylist()]), weights)
            total = more if total is None else (total[0] + more[0], total[1] + more[1])
        if total is not None:
            yield pa.RecordBatch.from_pydict({"products": [total[0].tobytes()], "per_class": [total[1].tobytes()]})

    def summed(batches):
        total = None
        for batch in batches:
            for parts in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                more = [np.frombuffer(x) for x in parts]
                total = more if total is None else [a + b for a, b in zip(total, more)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"products": [total[0].tobytes()], "per_class": [total[1].tobytes()]})

    parts = -(-sum(sizes.values()) // width)
    kinds = "products binary, per_class binary"
    each = rows.repartition(parts, F.pmod("h", F.lit(parts))).sortWithinPartitions("h", "lang").select("lang", "set").mapInArrow(partial, kinds)
    whole = each.repartition(1).mapInArrow(summed, kinds).first()
    b = shared.value[0]
    d = b.root.shape[1] + 1
    return solved(b, classes, np.frombuffer(whole.products).reshape(d, d), np.frombuffer(whole.per_class).reshape(-1, d), sum(sizes.values()), n, ridge)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, lang_pred, score[, carried])``, a row per input row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # slots x 4 bytes, and the landmarks' vocabulary (at most all slots) x classes x 4
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []

    def run(batch):
        model, texts = shared.value, batch.column(1).to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        here = [k for k, t in enumerate(texts) if model is not None and t is not None and LETTER.search(t)]
        if here:
            f = class_scores([texts[k] for k in here], model)
            best = f.argmax(axis=1)
            top = np.clip((1 + f[np.arange(len(here)), best]) / 2, 0, 1)
            for k, b, p in zip(here, best.tolist(), top.tolist()):
                lang[k], score[k] = model.classes[b], round(float(p), 6)
        out = {"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
        return out | ({"carried": batch.column(2)} if carry else {})

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    schema = "doc_id long, lang_pred string, score double"
    if carry:
        schema += f", carried {picked.schema['carried'].dataType.simpleString()}"
    return picked.mapInArrow(in_batches(run), schema)
