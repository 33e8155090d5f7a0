"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "vector_id", "score"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_library_without_the_subpackage(tmp_path, left):
    """With the pipeline deleted as well, or left in place."""
    for name in ("quarry", "__spark_entry__.py", *left):
        if not os.path.exists(os.path.join(ROOT, name)):
            continue
        src, dst = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(src, dst) if os.path.isdir(src) else shutil.copy(src, dst)
    shutil.rmtree(tmp_path / "quarry" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    n, oracles, ops, pipeline = said.stdout.split()[-4:]
    assert int(n) > 40 and int(oracles) > 30 and ops == "0" and pipeline == "False", said.stderr


def test_other_import_errors_are_raised(tmp_path):
    for name in ("quarry", "__spark_entry__.py"):
        src, dst = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(src, dst) if os.path.isdir(src) else shutil.copy(src, dst)
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode and "not_there_at_all" in said.stderr


@pytest.mark.parametrize("name", ["q05_token_stats", "q07_fixed_sentence_chunks", "q10_bm25_topk", "q16_open_corpus_scores", "q19_extractive_answer", "q23_reservoir", "q24_run_summary", "q33_nested_flatten", "q49_question_framings", "q55_config_rules", "q69_evaluation_run"])
def test_queries_equal_duckdb(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=repr)
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(names).collect()), key=repr) == want
