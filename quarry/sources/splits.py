"""Records that go over line ends or have none, read in splits: quoted fields of delimited text, and the elements of one JSON array.

Spark's text reader cuts a file into splits and each split into pieces at a separator: line ends for delimited text, closing braces for JSON. What
a piece means depends on whether it begins inside a quoted part, and how deep, which a task can't know of its split. So each split is first scanned under both
assumptions; a walk over the splits, one row each, then tells what is so. The second scan gives the records that lie within a split as they are, and the
ends of those that go over its borders as fragments, at most two a split, which meet by a shuffle of their own.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = "file string, start long, chain string, part long, number long, value string"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_OPEN_STRING = re.compile(r'"(?:[^"\\]|\\.)*\Z', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


class QuotedLines:
    """Lines; one that begins or ends inside quotes is part of a longer record. Doubled quotes don't matter to the parity."""

    separator, base = "\n", 0

    def step(self, inside: bool, piece: str) -> tuple[bool, int]:
        return inside ^ (piece.count('"') % 2 == 1), 0


class ArrayElements:
    """Pieces between closing braces; an element of the array ends with a brace one level deep."""

    separator, base = "}", 1

    def step(self, inside: bool, piece: str) -> tuple[bool, int]:
        if inside:
            rest = _REST_OF_STRING.match(piece)
            if rest is None:
                return True, 0
            piece = piece[rest.end() :]
        bare = _STRING.sub("", piece)
        opened = _OPEN_STRING.search(bare)
        bare = bare[: opened.start()] if opened else bare
        depth = bare.count("{") + bare.count("[") - bare.count("]") - (0 if opened else 1)
        return opened is not None, depth


@dataclass(frozen=True)
class Begin:
    """How a split begins: inside quotes or not, how deep, and in which chain of fragments, if a record is open."""

    inside: bool
    depth: int
    chain: str | None


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches):
    """``(file, start, pieces)`` of consecutive rows of one split, batch by batch."""
    for b in batches:
        files, starts, values = (b.column(k).to_pylist() for k in (1, 2, 0))
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and starts[end] == starts[at] and files[end] == files[at]:
                end += 1
            yield files[at], starts[at], values[at:end]
            at = end


def _outcomes(pieces: DataFrame, framing) -> list:
    """Of each split, under both assumptions: whether it ends inside, its change of depth, and the least depth outside quotes after a piece."""

    def run(batches):
        held: dict[tuple, list] = {}
        for file, start, values in _runs(batches):
            # Two states step on: (inside, depth, least depth).
            states = held.setdefault((file, start), [[False, 0, None], [True, 0, None]])
            for s in states:
                inside, depth, low = s
                for v in values:
                    inside, change = framing.step(inside, v)
                    depth += change
                    if not inside and (low is None or depth < low):
                        low = depth
                s[:] = inside, depth, low
        for (file, start), (no, yes) in held.items():
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), **{f"{n}{k}": pa.array([v], t) for n, s in (("no", no), ("yes", yes)) for k, v, t in zip("abc", s, (pa.bool_(), pa.int64(), pa.int64()))}})

    kind = "file string, start long, noa boolean, nob long, noc long, yesa boolean, yesb long, yesc long"
    return pieces.mapInArrow(run, kind).orderBy("file", "start").collect()


def _walked(outcomes: list, base: int) -> tuple[dict[tuple[str, int], Begin], dict[str, tuple[bool, int]]]:
    """How each split begins, and how each file ends."""
    begins, ends, inside, depth, chain, file = {}, {}, False, 0, None, None
    for r in outcomes:
        if r.file != file:
            file, inside, depth, chain = r.file, False, 0, None
        begins[(r.file, r.start)] = Begin(inside, depth, chain)
        after, change, low = (r.yesa, r.yesb, r.yesc) if inside else (r.noa, r.nob, r.noc)
        closes = low is not None and depth + low <= base
        inside, depth = after, depth + change
        # A record is open at the end if it isn't outside at the base; it began here if another closed here, or none was open.
        is_open = inside or depth > base
        chain = None if not is_open else (f"{r.file}#{r.start}" if closes or chain is None else chain)
        ends[r.file] = (inside, depth)
    return begins, ends


def framed(spark: SparkSession, path: str, framing) -> tuple[DataFrame, dict[str, tuple[bool, int]]]:
    """``(file, start, number, value)`` of all records, which are in order by these columns in this order, and how each file ends.

    ``start`` is the split in which a record begins and ``number`` its place there.
    """
    pieces = _pieces(spark, path, framing.separator)
    begins, ends = _walked(_outcomes(pieces, framing), framing.base)
    shared, sep = spark.sparkContext.broadcast(begins), framing.separator  # a row a split

    def run(batches):
        open_: dict[tuple, list] = {}  # of each split: inside, depth, pieces of the open record, number, chain
        for file, start, values in _runs(batches):
            begin = shared.value[(file, start)]
            s = open_.setdefault((file, start), [begin.inside, begin.depth, [], 0, begin.chain])
            out = []
            for v in values:
                s[0], change = framing.step(s[0], v)
                s[1] += change
                s[2].append(v)
                if not s[0] and s[1] <= framing.base:
                    out.append((file, start, s[4], start, s[3], sep.join(s[2])))
                    s[2], s[3], s[4] = [], s[3] + 1, None
            if out:
                yield _batch(out)
        # An open record goes on in the next split; one that goes through the whole split keeps its chain.
        rest = [(file, start, s[4] or f"{file}#{start}", start, s[3], sep.join(s[2])) for (file, start), s in open_.items() if s[2]]
        if rest:
            yield _batch(rest)

    rows = pieces.mapInArrow(run, PIECES)
    alone = rows.where("chain is null").select("file", "start", "number", "value")
    parts = rows.where("chain is not null").groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("part", "number", "value"))).alias("p"))
    joined = parts.select("file", F.col("p")[0]["part"].alias("start"), F.col("p")[0]["number"].alias("number"), F.array_join(F.transform("p", lambda x: x["value"]), sep).alias("value"))
    return alone.unionByName(joined), ends


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """``(file, start, number, fields)`` of delimited text with quoted fields, the header among them; an unclosed quote raises."""
    rows, ends = framed(spark, path, QuotedLines())
    if broken := sorted(f for f, (inside, _) in ends.items() if inside):
        raise ValueError(f"a quoted field isn't closed in {broken[0]}")

    def run(batches):
        csv.field_size_limit(1 << 31)
        for b in batches:
            texts = [v.removesuffix("\r") for v in b.column(3).to_pylist()]
            fields = [next(csv.reader([t], delimiter=separator, strict=True), []) for t in (x.removeprefix("\ufeff") if n == 0 and s == 0 else x for x, s, n in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fields, pa.list_(pa.string()))], ["file", "start", "number", "fields"])

    return rows.mapInArrow(run, "file string, start long, number long, fields array<string>")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, number, value)`` of the objects of one JSON array a file, each as JSON text.

    Raises where a comma is missing, an element isn't an object or the array isn't closed.
    """
    rows, ends = framed(spark, path, ArrayElements())
    # Spark gives no brace after the last piece, which closes the array: counted as one, it leaves the depth at -1.
    if not ends:
        raise ValueError("there is no JSON array")
    if broken := sorted(f for f, (inside, depth) in ends.items() if inside or depth != -1):
        raise ValueError(f"the JSON array isn't whole in {broken[0]}")
    first = (F.col("start") == 0) & (F.col("number") == 0)
    element = F.regexp_extract("value", r"^\s*[\[,]\s*(\{[\s\S]*)$", 1)
    lead = F.when(first, F.col("value").rlike("^\ufeff?\\s*\\[")).otherwise(F.col("value").rlike(r"^\s*,\s*\{"))
    closing = F.col("value").rlike("^(\ufeff?\\s*\\[)?\\s*\\]\\s*$")
    bad = F.raise_error(F.concat(F.lit("a JSON array has a value that isn't an object, or lacks a comma, at "), F.substring("value", 1, 60)))
    value = F.when(lead & (element != ""), F.concat(F.regexp_replace(element, "^\ufeff", ""), F.lit("}"))).otherwise(bad.cast("string"))
    return rows.where(~closing).select("file", "start", "number", value.alias("value"))
