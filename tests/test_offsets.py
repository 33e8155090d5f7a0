"""Point lookups by offset: right lines, in proportion, and what raises."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.sources import writers
from quarry.sources.files import opened
from quarry.sources.offsets import GAP, OffsetStore, line_offsets, sequence_violations

SCHEMA = StructType([StructField("vector_id", LongType()), StructField("text", StringType())])


def _raised(action, words):
    with pytest.raises(Exception) as told:
        action()
    assert words in str(told.value)


@pytest.fixture()
def stored(spark, tmp_path):
    texts = ["", "plain", 'quotes " and \\ and\nline ends\r\n', "éß中\U0001f600", "x" * 20_000] + [f"record {k} " * (k % 90) for k in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    path = str(tmp_path / "chunks of 5% é")
    writers.write_jsonl(rows, path)
    return texts, path, str(tmp_path / "table")


def test_offsets_equal_the_bytes(spark, stored):
    _, path, _ = stored
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows = line_offsets(spark, path).collect()
        assert line_offsets(spark, path).select("file").distinct().count() == 3 and spark.read.text(path).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3005
    for name in {r.file for r in rows}:
        system, where = opened(name)
        with system.open_input_file(where) as handle:
            content = handle.read()
        for r in rows:
            if r.file == name:
                assert content[r.offset : r.offset + r.length].decode() == r.value and content[r.offset + r.length : r.offset + r.length + 1] == b"\n"


def test_records_in_the_order_asked_for(spark, stored):
    texts, path, table = stored
    store = OffsetStore.build(spark, path, table, SCHEMA)
    assert store.count == len(texts)
    asked = [4, 2, 0, 2, 3004, 1, 3]
    rows = store.get_many(spark.createDataFrame(list(enumerate(asked)), "position int, vector_id int")).collect()
    assert [(r.position, r.vector_id, r.text) for r in rows] == [(k, i, texts[i]) for k, i in enumerate(asked)]
    assert store.get_many(spark.createDataFrame([], "position int, vector_id long")).count() == 0


def test_bytes_follow_the_ids(spark, stored):
    _, path, table = stored
    store = OffsetStore.build(spark, path, table, SCHEMA)
    whole = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part"))
    fetched = lambda ids: store.lines(ids).agg(F.sum("fetched"), F.sum("length"), F.count("*")).first()
    few, length, n = fetched(spark.range(0, 3005, 100).withColumnRenamed("id", "vector_id"))
    assert length <= few <= length + n * GAP and few < whole / 8
    every, length, n = fetched(spark.range(3005).withColumnRenamed("id", "vector_id"))
    assert (n, length + n) == (3005, whole) and every <= whole


def test_what_raises(spark, stored, tmp_path):
    _, path, table = stored
    store = OffsetStore.build(spark, path, table, SCHEMA)
    asked = lambda i: spark.createDataFrame([(0, i)], "position int, vector_id long")
    _raised(lambda: store.get_many(asked(3005)).collect(), "no chunk has the id 3005")
    _raised(lambda: store.get_many(asked(None)).collect(), "no chunk has the id null")
    wrong = store.offsets.withColumn("vector_id", 3004 - F.col("vector_id"))
    _raised(lambda: OffsetStore(spark, path, wrong, 3005, SCHEMA).get_many(asked(7)).collect(), "not of chunk 7")
    writers.write_jsonl(spark.createDataFrame([(0, "other")], SCHEMA), path)
    _raised(lambda: OffsetStore.open(spark, path, table, SCHEMA), "have changed")
    for ids, problem in (([0, 2], "gap"), ([0, 1, 1], "repeated"), ([-1, 0], "negative"), ([1], "gap"), ([None, 0], "null")):
        found = sequence_violations(spark.createDataFrame([(i,) for i in ids], "vector_id long")).collect()
        assert [r.problem for r in found] == [problem]
    broken = str(tmp_path / "broken")
    writers.write_jsonl(spark.createDataFrame([(0, "a"), (2, "b")], SCHEMA), broken)
    _raised(lambda: OffsetStore.build(spark, broken, table + "2", SCHEMA), "chunk id 2: gap")
