"""Merkle manifest of a dataset by Pregel-style RDD supersteps.

Every row is a leaf. The leaves of a class (a language) in the order of their ids make a tree of fan-out ``FAN``, and the classes' roots, in the
order of the classes, make the top tree. A vertex is (tree, level, index); its parent is (tree, level + 1, index // FAN).

Upwards, children message their parents, and a parent that has all its children hashes them and forwards. Downwards, each vertex messages its
children the path it got and, before it, the siblings of each, until every leaf has its path and can be verified by itself. Vertices lie
by their ancestor ``LEVELS`` further up (their home), so that messages within a home stay in its task and a shuffle is needed for
every ``LEVELS``-th superstep only; a home has ``FAN ** LEVELS`` leaves at most, whatever the class's size. A path is sent once to a
home, not to each of its leaves.

The places of the leaves come from one range-partitioned sort: the driver gets seven numbers and labels a partition, as for any
numbering of sorted rows, and hands each partition where its first class continues. No class meets in one task.

Edge cases: nulls are hashed as ``-`` and texts whole; a null id comes first in its class, is never tampered with and is ``-`` in
its leaf; ties in the id are ordered by their leaves, so rows alike in all columns are interchangeable, and each has a leaf and a
proof of its own; the null class is the first; a class of one row has its leaf as its root and no siblings; the proof
without any sibling is the hash of nothing; extra columns are left out; an empty table gives an empty result. A parent that lacks a child raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

FAN = 8
#: Levels that a home holds; FAN ** LEVELS leaves at most.
LEVELS = 3
WIDTH = FAN**LEVELS
#: Leaves that a task holds.
LEAVES_A_TASK = 50_000
#: The name of the tree of the classes' roots; classes are numbered from 0.
TOP = -1
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The hash of all values: ``-`` for null, else the byte count, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns.values()]).cast("binary"), 256)


def leaves(df: DataFrame) -> DataFrame:
    """``(lang, doc_id, leaf, tampered)``; ``tampered`` is the leaf of the lower-cased text where three divides the id's CRC-32, else null."""
    own = {c: F.col(c) for c in COLUMNS}
    changed = own | {"text": F.translate("text", UPPER, LOWER)}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return df.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("leaf"), F.when(struck, leaf_digest(changed)).alias("tampered"))


def _edges(part: int, rows: Iterator) -> Iterator[tuple]:
    """One tuple of a sorted partition: its number, rows, classes, first and last class, and the lengths of the first, last and longest run."""
    n, classes, first, last, first_run, run, longest = 0, 0, None, None, 0, 0, 0
    for lang, *_ in rows:
        if n and lang == last:
            run += 1
        else:
            first_run = first_run or run
            first, last, run, classes = (first if n else lang), lang, 1, classes + 1
        n, longest = n + 1, max(longest, run)
    if n:
        yield part, n, classes, first, last, first_run or run, run, longest


def _starts(edges: list[tuple]) -> tuple[dict[int, tuple], int, int]:
    """Of each partition: the number of its first class, the place in it of the first row, and whether its last class ends there, and all
    with it; then the number of classes and the rows of the largest."""
    at, tree, before, place, most = {}, -1, None, 0, 0
    for k, (part, n, classes, first, last, first_run, last_run, longest) in enumerate(edges):
        goes_on = k > 0 and first == before
        tree, place = (tree, place) if goes_on else (tree + 1, 0)
        end = k + 1 == len(edges)
        at[part] = (tree, place, end or edges[k + 1][3] != last, end)
        most = max(most, longest, place + first_run)
        tree, place = tree + classes - 1, last_run + (place if classes == 1 else 0)
        before = last
    return at, tree + 1, most


def _placed(part: int, rows: Iterator, at: dict[int, tuple]) -> Iterator[tuple]:
    """``((tree, home), (index, digest, last, payload))`` of every leaf; the payload is what the leaf's row needs, and whether its class is the last one."""
    if part not in at:
        return
    tree, place, ends, all_end = at[part]
    rows = iter(rows)
    now = next(rows, None)
    while now is not None:
        after = next(rows, None)
        last = ends if after is None else after[0] != now[0]
        yield (tree, place // WIDTH), (place, now[2], last, (now[1], now[3], last and after is None and all_end))
        if after is not None and last:
            tree, place = tree + 1, 0
        else:
            place += 1
        now = after


def by_home(key: tuple[int, int]) -> int:
    """Homes are dealt by a hash of (tree, number); consecutive homes go to different tasks."""
    return (key[0] * 1_000_003 + key[1] * 7_919) & 0x7FFFFFFF


def _gathered(messages: Iterator[tuple]) -> Iterator[tuple]:
    """``(key, nodes, paths)`` of each home of a task: its nodes in order, checked to be complete from its first on, and the messages from above."""
    nodes, paths = {}, {}
    for key, message in messages:
        (nodes if len(message) == 4 else paths).setdefault(key, []).append(message)
    for key, own in nodes.items():
        own.sort(key=lambda m: m[0])
        if [m[0] for m in own] != list(range(key[1] * WIDTH, key[1] * WIDTH + len(own))) or not (own[-1][2] or len(own) == WIDTH):
            raise RuntimeError(f"a parent of tree {key[0]} lacks a child")
        yield key, own, paths.get(key)


def _grown(key: tuple[int, int], own: list[tuple]) -> tuple[list[list[str]], bool]:
    """The digests of a home, level by level up to its only vertex, and whether this is the root of its tree."""
    whole, levels = key[1] == 0 and own[-1][2], [[m[1] for m in own]]
    while len(levels) <= LEVELS and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([digest("".join(below[at : at + FAN])) for at in range(0, len(below), FAN)])
    return levels, whole


def _climb(band: int, messages: Iterator[tuple]) -> Iterator[tuple]:
    """One message of each home: to its parents' home, or, from the root of a class, to the top tree with the band that it was found in."""
    for key, own, _ in _gathered(messages):
        levels, whole = _grown(key, own)
        tree, top = key[0], levels[-1][0]
        if not whole:
            yield (tree, key[1] // WIDTH), (key[1], top, own[-1][2], own[-1][3])
        elif tree != TOP:
            yield (TOP, tree // WIDTH), (tree, top, own[-1][3][2], band)


def _descend(band: int, messages: Iterator[tuple]) -> Iterator[tuple]:
    """What each home sends its lowest vertices: ``(key, (path, subroot, root))`` to the homes below, or rows of the leaves of classes.

    A path is a tuple of the siblings to the left and right, joined, from the bottom up.
    """
    for key, own, above in _gathered(messages):
        tree = key[0]
        levels, whole = _grown(key, own)
        path, subroot, root = ((), None, levels[-1][0]) if tree == TOP and whole else above[0]
        paths = [path]
        for level in reversed(levels[:-1]):
            below = []
            for i, up in enumerate(paths):
                run = level[i * FAN : (i + 1) * FAN]
                below += [(("".join(run[:j]), "".join(run[j + 1 :])), *up) for j in range(len(run))]
            paths = below
        for (index, own_digest, _, payload), path in zip(own, paths):
            if tree == TOP and band == 0:
                yield (index, 0), (path, own_digest, root, payload)
            elif band:
                yield (tree, index), (path, subroot, root)
            else:
                yield _row(own_digest, payload, path, subroot, root)


def _row(leaf: str, payload: tuple, path: tuple, subroot: str, root: str) -> tuple:
    doc_id, tampered, _ = payload
    proof, folded = hashlib.sha256(), tampered or leaf
    for left, right in path:
        proof.update((left + right).encode())
        folded = digest(left + folded + right)
    return doc_id, leaf, subroot, root, proof.hexdigest(), folded, folded == root


def _bands(n: int) -> int:
    """How many bands of ``LEVELS`` levels a tree of ``n`` leaves has; one at least."""
    bands = 1
    while n > WIDTH:
        n, bands = -(-n // WIDTH), bands + 1
    return bands


def manifest(df: DataFrame) -> DataFrame:
    """``SCHEMA``: every row's leaf, the root of its class and of all, its proof, and whether the leaf, tampered with where it was, still folds to the root."""
    spark = df.sparkSession
    made = checkpointed(leaves(df))  # the texts are read once
    tasks = max(spark.sparkContext.defaultParallelism, -(-made.count() // LEAVES_A_TASK))
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ordered = made.repartitionByRange(tasks, *order).sortWithinPartitions(*order).rdd
    edges = sorted(ordered.mapPartitionsWithIndex(_edges).collect(), key=lambda e: e[0])  # a tuple a partition
    if not edges:
        return spark.createDataFrame([], SCHEMA)
    at, classes, most = _starts(edges)
    start = ordered.mapPartitionsWithIndex(lambda part, rows: _placed(part, rows, at))

    def sent(messages: RDD, band: int) -> RDD:
        return messages.partitionBy(max(1, -(-tasks // WIDTH**band)), by_home)

    def tops(key: tuple[int, int]) -> bool:
        return key[0] == TOP

    # Upwards: the classes, and their roots as the leaves of the top tree.
    inboxes, roots, messages = [], None, start
    for band in range(_bands(most)):
        inboxes.append(sent(messages, band))
        out = inboxes[-1].mapPartitions(lambda m, band=band: _climb(band, m))
        found, messages = out.filter(lambda m: tops(m[0])), out.filter(lambda m: not tops(m[0]))
        roots = found if roots is None else roots.union(found)
    top_inboxes, messages = [], roots
    for band in range(_bands(classes)):
        top_inboxes.append(sent(messages, band))
        messages = top_inboxes[-1].mapPartitions(lambda m, band=band: _climb(band, m))

    # Downwards: the top tree, then the classes; a class's root enters at the band in which it was found.
    paths = None
    for band in reversed(range(len(top_inboxes))):
        both = top_inboxes[band] if paths is None else top_inboxes[band].union(paths.map(_told))
        paths = sent(both, band).mapPartitions(lambda m, band=band: _descend(band, m))
    entries, paths = paths, None
    for band in reversed(range(len(inboxes))):
        enter = entries.filter(lambda m, band=band: m[1][3] == band).map(lambda m: (m[0], m[1][:3]))
        both = inboxes[band].union(enter) if paths is None else inboxes[band].union(enter).union(paths.map(_told))
        paths = sent(both, band).mapPartitions(lambda m, band=band: _descend(band, m))
    return spark.createDataFrame(paths, SCHEMA, verifySchema=False)


def _told(message: tuple) -> tuple:
    """A path for a vertex, as a message to the home whose top vertex it is: homes of a band are numbered as the band's top vertices."""
    return message[0], message[1][:3]
