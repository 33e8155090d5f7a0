"""What a lexical index takes in the shared folder, and rows alike in id and length."""

import os
import random

import pytest

from quarry.operators import bm25, bm25_pruned
from quarry.sources.checkpoints import shared_dir


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture
def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(3000)], k=200)) for _ in range(2000)]


def test_building_keeps_less_than_the_texts(spark, texts, tmp_path):
    folder = shared_dir(spark).removeprefix("file:")
    before = _size(folder)
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "vector_id long, text string"))
    index.write(str(tmp_path / "i"))
    assert 0 < _size(folder) - before + _size(tmp_path / "i") < 2 * sum(map(len, texts))


def test_blocks_keep_less_than_the_texts(spark, texts, tmp_path):
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "vector_id long, text string"))
    folder = shared_dir(spark).removeprefix("file:")
    before = _size(folder)
    bm25_pruned.blocked(index).write(str(tmp_path / "b"))
    assert 0 < _size(folder) - before + _size(tmp_path / "b") < 2 * sum(map(len, texts))


def test_an_index_stored_in_passes_is_whole(spark, texts, tmp_path, monkeypatch):
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "vector_id long, text string"))
    monkeypatch.setattr(bm25, "ROWS_A_FILE", 50_000)
    index.write(str(tmp_path / "i"))
    back = bm25.Bm25Index.read(spark, str(tmp_path / "i"))
    columns = ["term", "vector_id", "tf", "dl"]
    assert back.counts.count() == index.counts.count() > bm25.ROWS_A_FILE
    assert back.counts.select(columns).exceptAll(index.counts.select(columns)).isEmpty()


def test_a_stored_index_leaves_nothing_else_on_disk(spark, tmp_path):
    """Neither what was shuffled for it nor the tables it was made of; the driver's garbage collection isn't waited for."""
    from quarry.plans import catalogue

    rows = [(k, f"word{k % 7} other{k % 5} text", "en", "s", 1) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    files = lambda: sum(f.startswith("shuffle_") for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names)
    held = files()
    index = catalogue.lexical_index(spark, str(tmp_path))
    assert files() <= held
    made = set(os.listdir(folder)) - before
    assert [m for m in made if m.startswith(("bm25-texts", "bm25-terms", "bm25-merged"))] == [] and index.counts.count() == 900


def test_rows_of_a_query_and_a_document_are_not_shuffled(spark, texts, tmp_path):
    bm25.build(spark.createDataFrame(list(enumerate(texts)), "vector_id long, text string")).write(str(tmp_path / "i"))
    asked = spark.createDataFrame([(k, texts[k]) for k in range(5)], "query_id long, query string")
    hits = bm25.search(bm25.Bm25Index.read(spark, str(tmp_path / "i")), asked, 3)
    assert {r.query_id: r.vector_id for r in hits.where("rank = 1").collect()} == {k: k for k in range(5)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(vector_id" in plan and "Exchange hashpartitioning(query_id#" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "query_id" in x and "vector_id" in x]


def test_rows_alike_in_id_and_length_are_one_text(spark):
    rows = [(1, "red red blue"), (1, "red green blue"), (2, "red"), (None, "blue green"), (3, None)]
    index = bm25.build(spark.createDataFrame(rows, "vector_id long, text string"))
    got = {(r.term, r.vector_id): (r.tf, r.dl) for r in index.counts.collect()}
    assert got == {("red", 1): (3, 3), ("blue", 1): (2, 3), ("green", 1): (1, 3), ("red", 2): (1, 1), ("blue", None): (1, 2), ("green", None): (1, 2)}
    assert index.count == 5 and {r.term: (r.df, r.cf) for r in index.terms.collect()} == {"red": (2, 4), "blue": (2, 3), "green": (2, 2)}


def test_texts_of_hits_are_found_without_a_shuffle_of_all(spark, tmp_path):
    """Hits of a known, small size are shipped to the chunks; a left join alone shuffles every text."""
    from quarry.operators import retrieval

    spark.range(2000).selectExpr("id AS vector_id", "repeat(sha2(string(id), 256), 400) AS text").write.parquet(str(tmp_path / "c"))
    hits = bm25.kept(spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1)], "query_id long, vector_id long, rank int"), "hits")
    found = retrieval.with_chunks(hits, spark.read.parquet(str(tmp_path / "c")))
    assert sorted((r.query_id, r.vector_id, len(r.text)) for r in found.collect()) == [(1, 5, 25600), (1, 7, 25600), (2, 5, 25600)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    with pytest.raises(Exception, match="no chunk has the id 9999"):
        retrieval.with_chunks(hits.withColumn("vector_id", hits.vector_id * 0 + 9999), spark.read.parquet(str(tmp_path / "c"))).collect()
