import zlib
from collections import Counter

from quarry.llm import shard

SCHEMA = "doc_id long, text string, bucket int, slot string"


def rows_of(spark, n=500):
    rows = [(i, f"text {i % 37} " * (i % 11)) for i in range(n)] + [(None, None), (None, ""), (3, "same"), (3, "same")]
    return rows, spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def test_law_of_rows(spark):
    rows, df = rows_of(spark)
    got = shard.assignments(df, shards=24, bucket_bytes=2000).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = shard.assignments(df.repartition(7), shards=24, bucket_bytes=2000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert ids != sorted(ids)


def test_written_shards_round_trip(spark, tmp_path):
    rows, df = rows_of(spark)
    shard.write_shards(df, str(tmp_path / "out"), shards=5, bucket_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)


def test_permutation_is_whole():
    assert sorted(shard.fisher_yates(100, 1, 2).tolist()) == list(range(100))
    assert shard.fisher_yates(100, 1, 2).tolist() != shard.fisher_yates(100, 1, 3).tolist()


def test_empty_and_tiny_tables(spark):
    assert shard.assignments(spark.createDataFrame([], SCHEMA)).count() == 0
    one = shard.assignments(spark.createDataFrame([(4, "a", 1, "x")], SCHEMA)).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_against_a_plain_shuffle(spark):
    """The same permutation by hand: buckets by the hash, sorted, shuffled with their seed, one after another."""
    rows, df = rows_of(spark, 300)
    buckets, seed, shards = 5, 20260731, 7
    hashed = df.selectExpr("doc_id", "text", f"pmod(xxhash64({seed}, doc_id, crc32(cast(text as binary))), {buckets}) as b").collect()
    placed = []
    for b in range(buckets):
        mine = sorted(((r.doc_id is None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8, r.text is None) for r in hashed if r.b == b))
        placed += [mine[k] for k in shard.fisher_yates(len(mine), seed, b)]
    want = [(None if absent else i, size, crc, k * shards // len(placed)) for k, (absent, i, crc, size, _) in enumerate(placed)]
    size = sum(len((t or "").encode()) for _, t in rows)
    got = shard.assignments(df, shards=shards, bucket_bytes=-(-size // buckets)).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.shard) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want


def test_long_texts_and_clashing_names(spark):
    rows = [(1, "long " * 200_000), (2, "long " * 200_000), (3, "s")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).withColumns({c: shard.F.lit("z") for c in ("block", "at", "of", "size", "count")})
    got = shard.assignments(df, shards=3, bucket_bytes=1000).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 1_000_008), (2, 1_000_008), (3, 9)]
