"""Writers: canonical JSON lines, tables committed by rename, manifests, summaries."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from quarry.sources.files import opened


def canonical_json(value) -> str:
    """Sorted keys, no spaces, non-ASCII characters as they are; NaN and infinity raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def identity(prefix: str, spec: dict) -> str:
    """A content-addressed name: the prefix and 16 digits of the specification's digest."""
    return f"{prefix}_{digest(spec)[:16]}"


def _ordered(c, kind):
    """A value with the keys of its structs and maps sorted at any depth; NaN and infinity raise."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[n], kind[n].dataType).alias(n) for n in sorted(kind.names)]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: k.cast("string")))
        value = lambda k: _ordered(F.element_at(c, k.cast(kind.keyType)), kind.valueType)
        return F.when(c.isNotNull(), F.map_from_arrays(entries, F.transform(entries, value)))
    if isinstance(kind, (DoubleType, FloatType)):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("NaN and infinity have no JSON")).cast(kind)).otherwise(c)
    return c


def canonical_lines(df: DataFrame) -> DataFrame:
    """One column ``value`` of JSON with sorted keys at any depth; nulls are kept, NaN and infinity raise."""
    columns = [_ordered(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    canonical_lines(df).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of all files below ``path``; it changes when they do, and no file is read."""
    fs, path_of = _fs(spark, path)
    files, found = fs.listFiles(path_of(path), True), []
    while files.hasNext():
        f = files.next()
        found.append([str(f.getPath()), f.getLen(), f.getModificationTime()])
    return digest(sorted(found))


def commit(spark: SparkSession, path: str, write) -> bool:
    """Calls ``write(staging path)`` and renames the staging folder to ``path``; if another run committed first, its table stays
    and ours is dropped. Returns whether ours is there. Works on any Hadoop file system.

    A file system may move a folder *into* one that another run has committed meanwhile; there the staging folder's name, which readers of
    a table skip for its underscore, tells, and it is removed.
    """
    fs, path_of = _fs(spark, path)
    parent, _, name = path.rstrip("/").rpartition("/")
    staged = f"_{name}.staging-{uuid.uuid4().hex}"
    staging, nested = path_of(f"{parent}/{staged}" if parent else staged), path_of(f"{path.rstrip('/')}/{staged}")
    try:
        write(staging.toString())
        fs.mkdirs(path_of(path).getParent())
        return not fs.exists(path_of(path)) and fs.rename(staging, path_of(path)) and not fs.exists(nested)
    finally:
        for left in (staging, nested):
            if fs.exists(left):
                fs.delete(left, True)


def write_manifest(spark: SparkSession, path: str, value: dict) -> None:
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
    fs, path_of = _fs(spark, path)
    part = path_of(f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(path_of(path), False)
    if not fs.rename(part, path_of(path)):
        raise OSError(f"{path} can't be written")


def read_manifest(spark: SparkSession, path: str) -> dict:
    value = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no object")
    return value


#: Bytes up to which a file is read as one value on an executor.
WHOLE_FILE = 256 << 20


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of every file below ``path``, all by executors.

    Files of up to ``WHOLE_FILE`` bytes are digested as values; larger ones, which no value can hold, are streamed by the task that has their name.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = listed.where(F.col("length") <= WHOLE_FILE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > WHOLE_FILE).select("path", "length", F.col("_metadata.file_path").alias("address")).repartition("path")
    # Spark's file sources pass over files without a byte.
    nothing = spark.createDataFrame([(p, 0, hashlib.sha256().hexdigest()) for p in _empty_files(spark, path)], "path string, length long, sha256 string")
    return small.union(large.mapInArrow(_streamed_digests, "path string, length long, sha256 string")).union(nothing)


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte below ``path``, but those that Spark hides: with a name, or in a folder, that begins with a dot or an underscore."""
    fs, path_of = _fs(spark, path)
    root = fs.makeQualified(path_of(path)).toString().rstrip("/")
    listed, found = fs.listFiles(path_of(path), True), []
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().toString()
        if f.getLen() == 0 and not any(part[0] in "._" for part in name[len(root) :].split("/") if part):
            found.append(name)
    return found


def _streamed_digests(batches):
    for b in batches:
        for name, length, address in zip(*(c.to_pylist() for c in b.columns)):
            h, (system, where) = hashlib.sha256(), opened(address)
            with system.open_input_file(where) as handle:
                while block := handle.read(8 << 20):
                    h.update(block)
            yield pa.RecordBatch.from_pydict({"path": [name], "length": pa.array([length], pa.int64()), "sha256": [h.hexdigest()]})


def inventory(spark: SparkSession, path: str) -> dict:
    """Files by relative path, and one digest of all; a row per file comes to the driver."""
    rows = sorted((r.path.split(path.rstrip("/"), 1)[-1].lstrip("/"), r.length, r.sha256) for r in file_digests(spark, path).collect())
    return {"files": [{"path": p, "bytes": n, "sha256": s} for p, n, s in rows], "sha256": digest(rows)}


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """A summary of one row, with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
