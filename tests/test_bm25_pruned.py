"""Pruned lexical search against the whole one: equal hits, fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, bm25_pruned


def _texts(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    weights = [1 / (k + 1) for k in range(2000)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([5, 20, 80, 300]))) for _ in range(n)]
    texts[7:9], texts[500:560] = ["", None], ["w3 w50 w51 same text"] * 60
    return texts, rng, words, weights


def _queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def _rows(hits):
    return [tuple(r) for r in hits.select("query_id", "rank", "vector_id", "score").orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def indexes(spark):
    texts, rng, words, weights = _texts(3000)
    whole = bm25.build(spark.createDataFrame([(k - 100, t) for k, t in enumerate(texts)], "vector_id long, text string"))
    return whole, bm25_pruned.blocked(whole), [" ".join(rng.choices(words, weights, k=6)) for _ in range(12)]


def test_hits_are_those_of_the_whole_search(spark, indexes, tmp_path):
    whole, blocks, asked = indexes
    queries = _queries(spark, asked + ["w3 w50 w51", "w1 w1 w1 w900", "unknown words", "", None, "w0"])
    for k in (1, 10):
        found = bm25_pruned.search(blocks, queries, k)
        assert _rows(found.hits) == _rows(bm25.search(whole, queries, k))
    blocks.write(str(tmp_path / "b"))
    stored = bm25_pruned.BlockIndex.read(spark, str(tmp_path / "b"), blocks.buckets)
    assert _rows(bm25_pruned.search(stored, queries, 10).hits) == _rows(found.hits)


def test_a_k_beyond_all_documents(spark, indexes):
    whole, blocks, asked = indexes
    queries = _queries(spark, asked[:2] + ["w1999"])
    assert _rows(bm25_pruned.search(blocks, queries, 5000).hits) == _rows(bm25.search(whole, queries, 5000))


def test_less_than_half_of_the_postings_is_scored(spark, indexes):
    whole, blocks, asked = indexes
    work = bm25_pruned.search(blocks, _queries(spark, asked), 3).work
    want = whole.terms.join(_queries(spark, asked).select("query_id", F.explode(F.array_distinct(bm25.terms("query"))).alias("term")), "term").groupBy("query_id").agg(F.sum("df").alias("postings"))
    assert sorted(map(tuple, work.select("query_id", "postings").collect())) == sorted(map(tuple, want.collect()))
    total = work.agg(F.sum("postings").alias("all"), F.sum("scored").alias("scored")).first()
    assert 0 < total.scored < total["all"] / 2


def test_blocks_hold_every_posting_and_heads_the_heaviest(spark, indexes):
    whole, blocks, _ = indexes
    spread = blocks.blocks.select("term", "most", F.explode("postings").alias("p")).select("term", "p.vector_id", "p.weight", (F.col("p.weight") <= F.col("most")).alias("within"))
    assert spread.where("within").select("term", "vector_id", "weight").exceptAll(whole.postings.select("term", "vector_id", "weight")).count() == 0
    assert spread.count() == whole.postings.count()
    heaviest = {r.term: r.w for r in whole.postings.groupBy("term").agg(F.slice(F.sort_array(F.collect_list("weight"), asc=False), 1, bm25_pruned.HEAD).alias("w")).collect()}
    for r in blocks.heads.collect():
        assert [p.weight for p in r.postings] == heaviest[r.term] and r.most == heaviest[r.term][0]


def test_an_empty_index(spark):
    blocks = bm25_pruned.blocked(bm25.build(spark.createDataFrame([], "vector_id long, text string")))
    found = bm25_pruned.search(blocks, _queries(spark, ["w1 w2"]), 3)
    assert found.hits.count() == 0 and found.work.count() == 0
