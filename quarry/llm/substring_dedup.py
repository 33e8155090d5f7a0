"""Substring deduplication with suffix automata of reference shards.

A window of ``window`` words is a repeat if its word sequence also starts earlier in the corpus; words
that a repeat covers are removed. The corpus itself is the reference, so no automaton of all of it
can be broadcast. It is cut into reference shards of bounded size instead: each window goes to the shard
of its minimizer (its smallest hash of ``gram`` consecutive words), which equal windows share. A shard's texts
are streamed in corpus order through a generalised suffix automaton that grows as they pass; the matching
statistic at a word is the length of the longest match with anything earlier, and a window is a repeat
where the statistic reaches its length. Every shard's automaton serves exactly the segments that can match it.

Passes, each over blocks of whole documents (a block is a seeded hash of the row, about ``block_bytes``; a task holds one at a time):

1. the distinct minimizers of each block, a row each; 2. those that occur more than once in the corpus go back to their blocks;
3. blocks send segments (runs of windows with one such minimizer), a row each, to shards; 4. shards answer with a mask of repeated windows for each
segment that has any; 5. blocks remove the words and hash the rest. The rows between passes grow with the text, not with the number of blocks
squared, and the number of tasks follows the blocks.

Hot content: segments that repeat within a block are sent once, equal segments are streamed once in a shard, and a
minimizer with over ``hot`` occurrences is split by the hash of each whole window. A window that many blocks have is merged as a tree: it goes to a
shard for every ``MERGED_BLOCKS`` blocks, each of which keeps its first, and the first of these firsts stays. Words travel as 64-bit hashes
(XXH64, seed 0); two windows are equal if all their word hashes are.

Edge cases: very long texts are whole in their block, which is then larger; null and empty texts have no words and keep the hash of the empty string; texts shorter than a window
stay whole; rows that share a ``doc_id`` are ordered by a hash of their text, equal rows by chance, so that one of
them counts as the first; null ids sort last; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, blocks_for, mix64, tasks_for

ODD = np.uint64(0x9E3779B97F4A7C15)
SPAN = 32  # windows a segment holds at most: the bits of its mask
SHARD_WORDS = 100_000
MERGED_BLOCKS = 4096  # blocks whose copies of a hot window meet in one shard


class Automaton:
    """A generalised suffix automaton over integer words, built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def feed(self, words: list[int]) -> list[int]:
        """Adds a text; gives the matching statistics: for each word the length of the longest match
        that ends there with anything fed before, or with an earlier place of this text."""
        nxt, link, length = self.next, self.link, self.length
        last, out = 0, []
        for c in words:
            if (q := nxt[last].get(c)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                out.append(length[last])
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur
            out.append(length[link[cur]])
        return out

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


class Block:
    """The documents of a block in a fixed order, their words as hashes, and the runs of their windows."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        ids = [NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = table.column("text").to_pylist()
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        tie = [xxhash.xxh64_intdigest(r) >> 1 for r in raw]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], tie[k]))
        self.rows = order
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.ties = np.array([tie[k] for k in order], np.int64)
        self.raw = [raw[k] for k in order]
        h = xxhash.xxh64_intdigest
        counts = np.zeros(len(order), np.int64)
        parts = []
        for k, r in enumerate(self.raw):
            w = r.split()
            counts[k] = len(w)
            parts.append(np.fromiter(map(h, w), np.uint64, len(w)))
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.window = window
        n = len(self.words)
        wins = n - window + 1
        self.win_doc = self.win_at = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.uint64)
        if wins <= 0:
            return
        g = np.zeros(n - gram + 1, np.uint64)
        for j in range(gram):
            g *= ODD
            g += self.words[j : j + len(g)]
        g = self.grams = mix64(g)
        need, have = window - gram + 1, 1
        while have * 2 <= need:
            g = np.minimum(g[: len(g) - have], g[have:])
            have *= 2
        if have < need:
            g = np.minimum(g[: len(g) - (need - have)], g[need - have :])
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(doc[:wins] == doc[window - 1 :])  # windows within one document
        self.win_at, self.win_doc, self.least = at, doc[at], g[at]

    def minimizers(self, gram: int) -> np.ndarray:
        """The hashes of all places that are the least of some window; equal windows at two places have two."""
        if not len(self.least):
            return self.least
        chosen = np.zeros(len(self.grams), bool)
        for d in range(self.window - gram + 1):
            chosen[self.win_at[self.grams[self.win_at + d] == self.least] + d] = True
        return self.grams[chosen]


def _minimizers(window: int, gram: int):
    def run(key, table):
        keys, counts = np.unique(Block(table, window, gram).minimizers(gram), return_counts=True)
        block = np.full(len(keys), key[0].as_py(), np.int32)
        return pa.table({"block": block, "key": keys.view(np.int64), "n": counts.astype(np.int64)})

    return run


#: Routing key, order in the corpus, block-wide row, start in the document, words of a segment.
SEGMENT = np.dtype([("key", "u8"), ("id", "i8"), ("tie", "i8"), ("row", "u4"), ("start", "u4"), ("n", "u4")])
#: A row for each segment that travels: ``mask`` is of windows known to repeat, ``words`` null if no shard has to look.
SEGMENTS = "block int, row long, start long, mask long, key long, single boolean, bucket int, id long, tie long, words binary"
#: The shards' answers; ``pending`` rows are first of a hot window among some blocks, and ``merge`` is that window.
ANSWERS = "block int, row long, start long, mask long, pending boolean, merge long, id long, tie long"


def _segments(window: int, gram: int, buckets: int):
    salts = -(-buckets // MERGED_BLOCKS)

    def run(key, docs, found):
        me = key[0].as_py()
        block = Block(docs, window, gram) if docs.num_rows and found.num_rows else None
        if block is None or not len(block.least):
            return _segment_table(me, np.zeros(0, SEGMENT), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), [])
        keys = found.column("key").to_numpy().view(np.uint64)
        hot = found.column("hot").to_numpy(zero_copy_only=False)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        where = np.minimum(np.searchsorted(keys, block.least), len(keys) - 1)
        hits = np.flatnonzero(keys[where] == block.least)
        is_hot = hot[where[hits]]
        new = np.ones(len(hits), bool)
        new[1:] = (block.least[hits[1:]] != block.least[hits[:-1]]) | (np.diff(block.win_at[hits]) != 1) | (block.win_doc[hits[1:]] != block.win_doc[hits[:-1]])
        new |= is_hot  # a hot minimizer's windows go one by one
        begin = np.flatnonzero(new)
        size = np.diff([*begin, len(hits)])
        # Runs are cut every SPAN windows.
        more = -(-size // SPAN)
        first = np.repeat(begin, more) + SPAN * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        last = np.minimum(first + SPAN, np.repeat(begin + size, more))
        at, doc = block.win_at[hits[first]], block.win_doc[hits[first]]
        single = is_hot[first]
        heads = np.zeros(len(first), SEGMENT)
        heads["key"], heads["n"] = block.least[hits[first]], last - first + window - 1
        heads["id"], heads["tie"], heads["row"], heads["start"] = block.ids[doc], block.ties[doc], doc, at - block.starts[doc]
        masks, buckets_of, words, seen = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), [], set()
        for k, (a, m, alone) in enumerate(zip(at.tolist(), heads["n"].tolist(), single.tolist())):
            raw = block.words[a : a + m].tobytes()
            if raw in seen:
                masks[k] = (1 << (m - window + 1)) - 1
                words.append(None)
                continue
            seen.add(raw)
            words.append(raw)
            if alone:
                heads["key"][k] = xxhash.xxh64_intdigest(raw)
        # What no shard looks at needs no key and no order.
        for c in ("key", "id", "tie"):
            heads[c][masks > 0] = 0
        spread = heads["key"] + np.where(single, np.uint64(me % salts), np.uint64(0)) * ODD
        buckets_of = np.where(masks > 0, me % buckets, (spread % np.uint64(buckets)).astype(np.int64))
        return _segment_table(me, heads, masks, single, buckets_of, words)

    return run


def _segment_table(me: int, heads: np.ndarray, masks: np.ndarray, single: np.ndarray, buckets: np.ndarray, words: list) -> pa.Table:
    return pa.table({
        "block": np.full(len(heads), me, np.int32), "row": heads["row"].astype(np.int64), "start": heads["start"].astype(np.int64), "mask": masks, "key": heads["key"].view(np.int64) if len(heads) else np.zeros(0, np.int64),
        "single": pa.array(single, pa.bool_()), "bucket": buckets.astype(np.int32), "id": heads["id"], "tie": heads["tie"], "words": pa.array(words, pa.binary()),
    })


def shard_masks(heads: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """For each segment, given with the words of all one after another, the mask of its repeated windows."""
    ends = np.cumsum(heads["n"].astype(np.int64))
    begins = ends - heads["n"]
    masks = np.zeros(len(heads), np.uint32)
    order = np.lexsort((heads["start"], heads["row"], heads["tie"], heads["id"], heads["key"]))
    keys = heads["key"][order]
    cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    automaton, fed = Automaton(), 0
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        if fed > SHARD_WORDS:  # equal windows have equal keys, so a shard can end between keys
            automaton, fed = Automaton(), 0
        seen: set[bytes] = set()
        for k in order[a:z].tolist():
            piece = words[begins[k] : ends[k]]
            raw = piece.tobytes()
            if raw in seen:
                masks[k] = (1 << (len(piece) - window + 1)) - 1
                continue
            seen.add(raw)
            stats = automaton.feed(piece.tolist())
            fed += len(stats)
            masks[k] = sum(1 << i for i, m in enumerate(stats[window - 1 :]) if m >= window)
    return masks


def _shards(window: int):
    def run(key, table):
        whole = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row", "start", "mask", "key", "single", "id", "tie")}
        raw = table.column("words").combine_chunks()
        looked = np.flatnonzero(~np.asarray(raw.is_null()))
        mask, pending = whole["mask"].copy(), np.zeros(table.num_rows, bool)
        if len(looked):
            words = [x for x in raw.to_pylist() if x is not None]
            heads = np.zeros(len(looked), SEGMENT)
            for c in ("id", "tie", "row", "start"):
                heads[c] = whole[c][looked]
            heads["key"], heads["n"] = whole["key"][looked].view(np.uint64), [len(x) // 8 for x in words]
            mask[looked] = shard_masks(heads, np.frombuffer(b"".join(words), np.uint64), window)
            pending = whole["single"] & (mask == 0)
            mask[pending] = 1  # repeats, unless it's the first of all
        keep = np.flatnonzero(mask)
        out = {c: whole[c][keep] for c in ("block", "row", "start")} | {"mask": mask[keep], "pending": pa.array(pending[keep], pa.bool_())}
        # Rows that nothing is to be merged with have a number of their own.
        own = (whole["block"].astype(np.int64) << 40) ^ (whole["row"] << 20) ^ whole["start"]
        return pa.table(out | {"merge": np.where(pending, whole["key"], own)[keep], "id": np.where(pending, whole["id"], 0)[keep], "tie": np.where(pending, whole["tie"], 0)[keep]})

    return run


def _rebuild(window: int, keep_text: bool):
    def run(key, docs, found):
        block_ids = docs.column("doc_id").to_pylist()
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in docs.column("text").to_pylist()]
        order = sorted(range(len(raw)), key=lambda k: (NULL_ID if block_ids[k] is None else block_ids[k], xxhash.xxh64_intdigest(raw[k]) >> 1))
        rows, starts, masks = (found.column(c).to_numpy() for c in ("row", "start", "mask"))
        by_row = np.argsort(rows, kind="stable")
        starts, masks = starts[by_row], masks[by_row]
        edges = np.searchsorted(rows[by_row], np.arange(len(order) + 1))
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for row, k in enumerate(order):
            words = raw[k].split()
            n, removed = len(words), 0
            if edges[row] < edges[row + 1]:
                mine = slice(edges[row], edges[row + 1])
                windows = np.zeros(n + 32, bool)
                bits = (masks[mine][:, None] >> np.arange(SPAN)) & 1 > 0
                places = starts[mine][:, None] + np.arange(SPAN)
                windows[places[bits]] = True
                change = np.zeros(n + 65 + window, np.int64)
                at = np.flatnonzero(windows)
                change[at] += 1
                change[at + window] -= 1
                gone = np.cumsum(change)[:n] > 0
                removed = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            n_words.append(n), n_removed.append(removed), digests.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                kept_texts.append(kept.decode("utf-8", "surrogatepass"))
        out = {"doc_id": pa.array([block_ids[k] for k in order], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_texts, pa.string())} if keep_text else {}))

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, hot: int = 2000, block_bytes: int = 8 << 20, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])``, a row per input row."""
    if not 0 < gram <= window:
        raise ValueError("a minimizer's words lie within a window")
    records = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = blocks_for(records, "text", block_bytes)
    tasks = tasks_for(df.sparkSession, n)
    records = records.select(F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(n)).cast("int").alias("block"), "doc_id", "text")
    docs = records.repartition(tasks, "block").groupBy("block")
    minimizers = docs.applyInArrow(_minimizers(window, gram), "block int, key long, n long")
    total = F.sum("n").over(Window.partitionBy("key"))
    repeated = minimizers.repartition(tasks, "key").select("block", "key", total.alias("total")).where("total > 1").select("block", "key", (F.col("total") > hot).alias("hot"))
    segments = docs.cogroup(repeated.repartition(tasks, "block").groupBy("block")).applyInArrow(_segments(window, gram, n), SEGMENTS)
    answers = segments.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_shards(window), ANSWERS)
    place = F.struct("id", "tie", "row", "start")
    answers = answers.repartition(tasks, "pending", "merge").withColumn("least", F.min(place).over(Window.partitionBy("pending", "merge"))).where(~F.col("pending") | (place > F.col("least"))).select("block", "row", "start", "mask")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return docs.cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(_rebuild(window, keep_text), schema)
