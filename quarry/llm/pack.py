"""Best-fit packing of documents into sequences, under vector capacities.

A piece has a load of three: tokens, one document, and an attention cost (its length squared). Pieces are
packed longest first; each goes to the open bin, among those where it fits in every dimension, with the
smallest norm of the residuals left (or the largest dot product of load and residual); all three have a weight, tokens the largest.
A limit on documents binds from below ``capacity`` on; one on attention only below ``capacity`` squared, which a full piece needs, so only where
pieces are shorter.

All pieces of one length are alike, so the decisions need only how many pieces each length has: that
histogram (at most ``capacity`` rows) is all the driver sees. It packs runs of equal bins at once and
gives a table of slots ``(length, first rank, end, first sequence, pieces a bin, offset)``, whose size depends on
the capacity and not on the corpus. Executors rank the pieces of each length (in sub-groups dealt by a hash of the row's number, so that a hot
length and rows alike in all are split; their number follows the pieces) and look their slot up. The packing is therefore one global best-fit
decreasing, at any scale.

Edge cases: null and empty texts are the end token alone; very long texts are tokenised whole and give many pieces; equal documents are separate pieces; rows that share
a ``doc_id`` are separate documents; null ids are packed and come out null; extra columns are ignored; an empty table
gives no rows; ``capacity`` is an upper limit always kept.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, in_batches

#: How byte-level BPE splits a text before it merges bytes.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without two white-space characters in a row; free of look-ahead, it takes half the time.
PRETOKEN_SINGLE_GAPS = PRETOKEN.replace(r"\s+(?!\S)|\s+", r"\s")
DOUBLE_GAP = re.compile(r"[\s\x85]{2}")
# The settings of a tokenizer file, and of its model, for which the rank-based encoder gives the library's ids.
PLAIN_FILE = {"normalizer": None, "truncation": None, "padding": None}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
#: Pieces of a sub-group for ranking.
RANKED_TOGETHER = 1_000_000


def is_plain(settings: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose ids follow the order of the merges and that changes no text before or after."""
    model, split = settings["model"], settings.get("pre_tokenizer") or {}
    rules = [(settings, PLAIN_FILE), (split, PLAIN_SPLIT), ({"type": "BPE"} | model, PLAIN_MODEL)]
    if any((got.get(k, want) or None) != (want or None) for got, wanted in rules for k, want in wanted.items()) or "type" not in split or "merges" not in model:
        return False
    ranks = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return ranks == sorted(ranks)


@lru_cache(maxsize=2)
def encoder(path: str):
    """``text -> little-endian uint32 ids`` for a byte-level BPE file of the tokenizers library.

    Where ids follow the order of the merges and the file asks for nothing else (:func:`is_plain`), a rank-based encoder gives the library's
    ids in less time; the library encodes with all other files, and texts that hold an added token's string.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model = settings["model"]

    def whole(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    slow = fast = whole
    if is_plain(settings):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        table = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        slow, fast = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary for p in (PRETOKEN, PRETOKEN_SINGLE_GAPS))

    def encode(text: str) -> bytes:
        if any(c in text for c in added):
            ids = whole(text)
        else:
            ids = (slow if DOUBLE_GAP.search(text) else fast)(text)
        return array("I", ids).tobytes()

    return encode


def pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: whole texts as ids plus the end id, cut where longer
    than ``capacity`` so that only the first piece is shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        encode = encoder(tokenizer)
        at, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = encode(text) + end if text else end
            n = len(raw) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                at.append(i), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(raw[a * 4 : b * 4]))
                if keep_ids:
                    ids.append(raw[a * 4 : b * 4])
        out = {"doc_id": batch.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        return out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(in_batches(run), schema)


def plan(histogram: dict[int, int], capacity: int = 1024, most_docs: int | None = None, most_attention: int | None = None, weights=(1.0, 0.5, 0.5), select: str = "norm") -> pd.DataFrame:
    """Best-fit decreasing over a histogram of lengths, as slots.

    Open bins are kept as groups of equal bins. A length takes from the best group bin by bin; where a bin
    takes ``q`` pieces before it is no longer feasible, whole bins take ``q`` and one takes what is left.
    """
    most_docs = most_docs or capacity
    most_attention = most_attention or capacity * capacity
    weight = np.array(weights, float) / np.array([capacity, most_docs, most_attention], float) ** (1 if select == "norm" else 2)
    slots: list[tuple[int, int, int, int, int, int]] = []
    # Groups: residual tokens, documents, attention; bins; first sequence; offset. Sequence numbers of a group are consecutive.
    res = np.zeros((0, 3), np.int64)
    bins, first, used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        load = np.array([length, 1, length * length], np.int64)
        if length > capacity or (load > [capacity, most_docs, most_attention]).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            ok = np.flatnonzero((res >= load).all(axis=1))
            if len(ok):
                if select == "norm":
                    score = (((res[ok] - load) * weight) ** 2).sum(axis=1)
                    g = int(ok[np.argmin(score)])
                else:
                    g = int(ok[np.argmax((res[ok] * load * weight).sum(axis=1))])
            else:
                per = int(min(capacity // length, most_docs, most_attention // (length * length)))
                count = -(-left // per)
                res = np.vstack([res, [[capacity, most_docs, most_attention]]])
                bins, first, used = np.append(bins, count), np.append(first, opened), np.append(used, 0)
                opened += count
                g = len(bins) - 1
            q = int((res[g] // load).min())
            whole = min(left // q, int(bins[g]))
            parts = []  # (bins, pieces in each)
            if whole:
                parts.append((whole, q))
            if whole < bins[g] and (rest := min(left - whole * q, q - 1)) > 0:
                parts.append((1, rest))
            at = int(first[g])
            for count, k in parts:
                slots.append((length, rank, rank + count * k, at, k, int(used[g])))
                res = np.vstack([res, res[g] - load * k])
                bins, first, used = np.append(bins, count), np.append(first, at), np.append(used, used[g] + length * k)
                rank += count * k
                left -= count * k
                at += count
                bins[g] -= count
            first[g] = at
            keep = (bins > 0) & (res >= 1).all(axis=1)
            res, bins, first, used = res[keep], bins[keep], first[keep], used[keep]
    return pd.DataFrame(slots, columns=["length", "lo", "hi", "seq", "per", "offset"]).astype("int64")


def pack(parts: DataFrame, capacity: int = 1024, ranked_together: int = RANKED_TOGETHER, **options) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (as :func:`pieces` gives them); ``options`` are those of :func:`plan`.

    The pieces of a length are ranked in sub-groups of about ``ranked_together`` at most.
    """
    carried = list(parts.columns)
    # Tokenised once; ranks below need rows that stay as they are, and so do their numbers.
    parts = checkpointed(parts.withColumn("_no", F.monotonically_increasing_id()))
    spark = parts.sparkSession
    groups = max(64, -(-parts.count() // ranked_together))
    keyed = parts.withColumn("_sub", F.pmod(F.xxhash64("_no"), F.lit(groups)))
    counts = checkpointed(keyed.groupBy("length", "_sub").count())
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    slots = plan(histogram, capacity, **options)
    shared = spark.sparkContext.broadcast(tuple(slots.sort_values(["length", "lo"])[c].to_numpy() for c in ("length", "lo", "seq", "per", "offset")))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_sub", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_sub").orderBy("_no"))
    ranked = keyed.withColumn("_rank", inside).join(starts, ["length", "_sub"]).select(*carried, (F.col("_start") + F.col("_rank") - 1).alias("_rank"))

    def place(batches):
        length, lo, seq, per, offset = shared.value
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            begins, ends = np.searchsorted(length, n), np.searchsorted(length, n, side="right")
            at = np.empty(len(n), np.int64)
            for k in np.unique(n).tolist():
                here = n == k
                a, b = begins[here][0], ends[here][0]
                at[here] = a + np.searchsorted(lo[a:b], rank[here], side="right") - 1
            step = rank - lo[at]
            out = {c: batch.column(c) for c in carried}
            out["sequence_id"] = pa.array(seq[at] + step // per[at])
            out["offset"] = pa.array(offset[at] + step % per[at] * n)
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in carried) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
