import gzip
import json

import numpy as np
import pytest

from quarry.operators import vector_index
from quarry.plans import engine
from quarry.plans.config import Config, QueryPlan
from quarry.sources import readers, writers
from quarry.streaming.append import append_vectors


def test_wikipedia_tsv(spark, tmp_path):
    text = 'id\ttext\ttitle\n1\t"a ""quoted"" text"\tT\n2\tplain\tU\n'
    (tmp_path / "w.tsv").write_text(text)
    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write("﻿" + text)
    for name in ("w.tsv", "w.tsv.gz"):
        got = readers.wikipedia_tsv(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [tuple(r) for r in got] == [("1", 'a "quoted" text', "T"), ("2", "plain", "U")]
    (tmp_path / "long.tsv").write_text('id\ttext\ttitle\n1\t"over\ntwo lines"\tT\n')
    assert [tuple(r) for r in readers.wikipedia_tsv(spark, str(tmp_path / "long.tsv")).collect()] == [("1", "over\ntwo lines", "T")]
    (tmp_path / "bad.tsv").write_text("id\ttext\n1\tx\n")
    with pytest.raises(ValueError):
        readers.wikipedia_tsv(spark, str(tmp_path / "bad.tsv"))


def test_question_framings(spark, tmp_path):
    q = [{"question": "one", "answers": ["a"], "positive_ctxs": [{"title": "t", "text": "x", "passage_id": "3"}], "hard_negative_ctxs": []}, {"question": "two", "answers": ["b"], "positive_ctxs": []}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, q)) + "\n\n")
    (tmp_path / "q.json").write_text(json.dumps(q, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"data": q}))
    for name in ("q.jsonl", "q.json", "d.json"):
        got = readers.questions(spark, str(tmp_path / name)).orderBy("question").collect()
        assert [r.question for r in got if r.question] == ["one", "two"] and got[-2].positive_ctxs[0].passage_id == "3", name


def test_order_violations(spark):
    rows = [(p, p * 2) for p in range(10)] + [(99_999, 500), (100_000, 400), (100_001, 401), (100_002, 401)]
    df = spark.createDataFrame(rows, "position long, id long")
    assert {r.p for r in readers.order_violations(df).collect()} == {100_000, 100_002}


def test_prepared_pages(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "4", "title": "T", "text": "body"}) + "\n")
    assert tuple(readers.prepared_pages(spark, str(tmp_path / "p.jsonl")).first()) == ("dpr_wiki_passage:4", "T", 1, "T\nbody")


def test_commit_manifest_inventory(spark, tmp_path):
    out = str(tmp_path / "t" / "table")
    df = spark.range(5)
    assert writers.commit(spark, out, lambda p: df.write.parquet(p)) and not writers.commit(spark, out, lambda p: spark.range(9).write.parquet(p))
    assert spark.read.parquet(out).count() == 5 and len(list((tmp_path / "t").iterdir())) == 1
    spec = {"b": [1, "é"], "a": None}
    writers.write_manifest(spark, str(tmp_path / "m.json"), spec)
    writers.write_manifest(spark, str(tmp_path / "m.json"), spec)
    assert writers.read_manifest(spark, str(tmp_path / "m.json")) == spec
    assert writers.identity("build", spec) == writers.identity("build", dict(reversed(spec.items()))) and writers.canonical_json(spec) == '{"a":null,"b":[1,"é"]}'
    with pytest.raises(ValueError):
        writers.canonical_json({"x": float("nan")})
    one = writers.inventory(spark, out)
    assert one == writers.inventory(spark, out) and one["files"]


def test_canonical_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None, (2, "x"))], "z int, a string, n struct<y:int,b:string>")
    writers.write_jsonl(df, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"a":null,"n":{"b":"x","y":2},"z":1}']


def test_canonical_lines_at_any_depth(spark):
    df = spark.createDataFrame([([(2, "x")], {"z": (1, "p"), "a": (3, "q")}, 1.5)], "l array<struct<y:int,b:string>>, m map<string,struct<d:int,c:string>>, f double")
    (line,) = [r.value for r in writers.canonical_lines(df).collect()]
    assert line == '{"f":1.5,"l":[{"b":"x","y":2}],"m":{"a":{"c":"q","d":3},"z":{"c":"p","d":1}}}'
    with pytest.raises(Exception, match="NaN"):
        writers.canonical_lines(spark.createDataFrame([([float("nan")],)], "l array<double>")).collect()


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "small").write_bytes(b"abc")
    (tmp_path / "d" / "large").write_bytes(b"x" * 5000)
    monkeypatch.setattr(writers, "WHOLE_FILE", 1000)
    got = {f["path"]: (f["bytes"], f["sha256"]) for f in writers.inventory(spark, str(tmp_path / "d"))["files"]}
    assert got == {"small": (3, hashlib.sha256(b"abc").hexdigest()), "large": (5000, hashlib.sha256(b"x" * 5000).hexdigest())}


@pytest.mark.parametrize("bad", [{"index": "tree"}, {"chunk_overlap": 300}, {"retrieval": "bm25", "search": {"nprobe": 1}}, {"candidate_k": 2}, {"unknown": 1}, {"search": {"nprobe": 4}}, {"context_tokens": 0}, {"chunker": "presegmented"}])
def test_config_is_checked(bad):
    with pytest.raises((ValueError, TypeError)):
        Config.of(bad)


def test_plans():
    p = Config(candidate_k=50).plan()
    assert p.with_top_k(80) == QueryPlan(True, 80, 80) and p.with_top_k(3) == QueryPlan(True, 50, 3) and not p.with_top_k(0).enabled
    with pytest.raises(ValueError):
        QueryPlan(False, 1, 0)


@pytest.fixture
def pages(spark):
    rows = [(f"d{k}", f"s{k}", 1, f"Topic{k} is about thing{k}. It has colour{k % 3}. More text here.") for k in range(12)]
    return spark.createDataFrame(rows, "doc_id string, source string, page int, text string")


@pytest.mark.parametrize("config", [{}, {"retrieval": "bm25"}, {"index": "ivf_flat", "index_build": {"nlist": 3}, "search": {"nprobe": 3}}, {"index": "hnsw"}, {"chunker": "presegmented", "chunk_overlap": 0, "context_tokens": 20}])
def test_engine_answers(spark, pages, config):
    built = engine.build(pages, Config(final_k=2, candidate_k=4, dimension=64, **config))
    q = spark.createDataFrame([(1, "thing7 topic7"), (2, "about topic3 thing3")], "query_id long, question string")
    rows = {r.query_id: r for r in engine.answer(built, q).collect()}
    assert rows[1].results[0].doc_id == "d7" and rows[2].results[0].doc_id == "d3" and len(rows[1].results) == (1 if config.get("retrieval") == "bm25" else 2)
    assert "thing7" in rows[1].answer and rows[1].token_usage.total_tokens > 0


def test_resume(spark, pages, tmp_path):
    built = engine.build(pages, Config(final_k=1, dimension=32))
    q = spark.createDataFrame([(k, f"topic{k} thing{k}") for k in range(4)], "query_id long, question string")
    out = str(tmp_path / "run")
    assert engine.run(built, q, out, rows_per_attempt=3).count() == 3
    assert [r.query_id for r in engine.run(built, q, out).collect()] == [0, 1, 2, 3]
    files = sorted(p.name for p in (tmp_path / "run").iterdir())
    engine.run(built, q, out)
    assert files == sorted(p.name for p in (tmp_path / "run").iterdir())


def test_streamed_vectors(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "index")
    make = lambda ids: spark.createDataFrame([(i, np.eye(4)[i % 4].tolist()) for i in ids], "vector_id long, embedding array<float>")
    make(range(5)).write.parquet(source)
    schema = "vector_id long, embedding array<float>"

    def go():
        append_vectors(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "ck")).awaitTermination()

    go()
    make(range(5, 9)).write.mode("append").parquet(source)
    go()
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vector_id for r in vector_index.flat_search(spark.read.parquet(out), q, 3).orderBy("rank").collect()] == [0, 4, 8]
    make([3]).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="already"):
        go()
