import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import queries as Q


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage's output, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{top}/{k}")
        out.append((docs, docs := spark.read.parquet(f"{top}/{k}")))
    return out


def test_columns_and_decisions(stages):
    for before, after in stages[:-1]:
        assert after.columns == P.COLUMNS and 0 < after.count() <= before.count()
    before, after = stages[1]
    same = before.join(after.select("doc_id", F.col("text").alias("now"), F.col("n_chars").alias("now_chars")), "doc_id")
    assert same.where("length(now) < length(text)").count() > 0
    assert same.where("length(now) > length(text) or now_chars <> length(now)").count() == 0


def test_near_duplicates_leave_one(stages):
    from quarry.llm.minhash_dedup import near_duplicates

    before, after = stages[2]
    roots = {r.component_id for r in near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(roots)


def test_no_leak_is_left(stages, spark, sf):
    from quarry.llm.decontaminate import contaminated

    before, after = stages[3]
    found = {r.doc_id for r in contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - found


def test_packing_covers_all(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    per = after.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("docs"))
    assert per.where(f"tokens > 1024 or docs > {P.MOST_DOCS}").count() == 0


def test_run_gives_the_last_stage(stages, spark, sf):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    import os

    shared = P.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    got = P.run(spark, sf).select(columns)
    # Only the last stage's table stays, under a folder of its own.
    (left,) = [x for x in set(os.listdir(shared)) - before if x.startswith("pipeline-")]
    assert os.listdir(f"{shared}/{left}") == ["4-best_fit_packing"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].select(columns).collect()))


def test_odd_rows_pass_every_stage(spark, sf):
    rows = [(None, None, None, None, None), (None, "a b c d e\nf", "en", None, 1), (1, "", "en", "s", 0), (2, "word " * 20000 + "\n x", "en", "s", 5), (2, "same words here now ok", "fr", "s", 5), (2, "same words here now ok", "fr", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.withColumns({c: docs.source for c in ("spans", "component_id", "items", "sequence_id", "lang_pred", "fp")})
    for name, stage in P.STAGES:
        out = stage(spark, extra, sf)
        if name == "best_fit_packing":
            assert out.groupBy("doc_id", "piece").count().count() >= 5
        else:
            assert out.count() <= 6 and out.columns == P.COLUMNS, name
        if name == "simhash_near_dedup":
            assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "2", "2", "None"]
        assert stage(spark, extra.limit(0), sf).count() == 0, name


@pytest.mark.parametrize("name", [n for n in Q.queries() if n.startswith("op") and not n.startswith("op1_")])
def test_queries_cover_every_document(spark, sf, name):
    out = Q.queries()[name](spark, sf)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(Q.RULES_SQL))
def test_rules_equal_duckdb(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(Q.RULES_SQL[name])
    names = [d[0] for d in cursor.description]
    df = Q.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)
