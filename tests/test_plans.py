import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import answering, retrieval, runs
from quarry.plans import engine, prepare, runner
from quarry.plans.config import Config
from quarry.sources import readers, writers


@pytest.fixture
def pages(spark):
    rows = [(f"d{k}", f"s{k}", 1, f"Topic{k} is about thing{k}. It has colour{k % 3}. More text here.") for k in range(12)]
    return spark.createDataFrame(rows, "doc_id string, source string, page int, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "thing7 topic7"), (2, "about topic3 thing3")], "query_id long, question string")


def models():
    """Loaders of an embedder and a generator; made here, they travel to the workers by value."""

    def letters():
        import numpy as np

        def encode(texts):
            x = np.array([[t.count(c) + 0.01 for c in "0123456789abcdefg"] for t in texts])
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        return encode

    def shouting():
        def generate(prompt):
            if "topic3" in prompt:
                raise RuntimeError("no " * 1000)
            return {"answer": "ANSWER", "input_tokens": 5, "output_tokens": 2, "total_tokens": 7}

        return generate

    return letters, shouting


def test_models_are_wired(spark, pages, asked):
    letters, shouting = models()
    c = Config(embedder="model", model_name="letters", dimension=17, generator="model", reranker="cross_encoder", candidate_k=4, final_k=2, save_retrieved_text=False)
    with pytest.raises(ValueError, match="encode"):
        engine.build(pages, c)
    built = engine.build(pages, c, encode=letters)
    scorer = retrieval.model_scorer(lambda: lambda pairs: [float(len(set(q.lower().split()) & set(t.lower().replace(".", "").split()))) for q, t in pairs])
    with pytest.raises(ValueError, match="scorer"):
        engine.answer(built, asked, encode=letters, generate=shouting)
    with pytest.raises(ValueError, match="generate"):
        engine.answer(built, asked, scorer=scorer, encode=letters)
    with pytest.raises(ValueError, match="spaces differ"):
        engine.answer(built, asked, scorer=scorer, encode=letters, generate=shouting, space=c.space() | {"dimension": 3})
    rows = {r.query_id: r for r in engine.answer(built, asked, scorer=scorer, encode=letters, generate=shouting, timed=True).collect()}
    assert rows[1].results[0].doc_id == "d7" and "text" not in rows[1].results[0].asDict() and rows[1].answer == "ANSWER" and rows[1].reported.total_tokens == 7
    assert rows[2].status == "error" and rows[2].error.type == "RuntimeError" and len(rows[2].error.message) == 1000 and rows[2].answer is None
    assert set(rows[1].timings_ms.asDict()) == {"query_embedding_ms", "index_search_ms", "chunk_mapping_ms", "rerank_ms"}


def test_generated_answers_are_checked(spark):
    given = {"blank": " ", "none": None, "negative": {"answer": "x", "input_tokens": -1}, "sum": {"answer": "x", "input_tokens": 1, "output_tokens": 1, "total_tokens": 3}, "fine": "x"}
    df = spark.createDataFrame([(k, k) for k in given], "query_id string, prompt string")
    got = {r.query_id: r for r in answering.model_answers(df, lambda: given.__getitem__).collect()}
    assert {k for k, r in got.items() if r.error is None} == {"fine"} and got["fine"].reported is None


def test_runs_record_errors_and_resume(spark, tmp_path):
    questions = spark.createDataFrame([(k, f"q{k}", f"text {k}") for k in range(1, 10)], "position long, question_id string, question string")
    path, seen = str(tmp_path / "run"), tmp_path / "fixed"
    meta = {f: "x" for f in runs.RESUMED_FIELDS}

    @F.pandas_udf("string")
    def picky(s):
        bad = [t for t in s if t.endswith(("3", "8"))]
        if bad and not seen.exists():
            raise KeyError(f"can't take {bad[0]}")
        return s.str.upper()

    def answer(block):
        return block.select("question_id", "question", picky("question").alias("answer"), F.lit("secret").alias("api_key"))

    summarize = lambda rows: rows.agg(F.count("*").alias("n"))
    rows, about = runner.evaluate(questions, path, meta, answer, summarize, block=4)
    got = rows.collect()
    assert [r.question_id for r in got] == [f"q{k}" for k in range(1, 10)] and "api_key" not in rows.columns
    assert {r.question_id for r in got if r.status == "error"} == {"q3", "q8"} and about["status"] == "completed_with_errors" and about["num_failed_rows"] == 2
    assert {r.error.type for r in got if r.status == "error"} == {"KeyError"}
    with pytest.raises(FileExistsError):
        runner.evaluate(questions, path, meta, answer, summarize)
    with pytest.raises(ValueError, match="build_id"):
        runner.evaluate(questions, path, meta | {"build_id": "y"}, answer, summarize, resume=True)
    seen.touch()
    rows, again = runner.evaluate(questions, path, meta, answer, summarize, resume=True, block=4)
    assert again["status"] == "completed" and again["started_at"] == about["started_at"] and again["run_id"] == about["run_id"] and again["attempt"] == 2
    assert [r.answer for r in rows.collect()] == [f"TEXT {k}" for k in range(1, 10)]
    assert spark.read.json(f"{path}/results").count() == 9 and spark.read.csv(f"{path}/summary", header=True).first().n == "9"
    with pytest.raises(ValueError, match="rows don't belong"):
        runner.evaluate(questions.where("position < 5"), path, meta, answer, summarize, resume=True)
    with pytest.raises(FileNotFoundError):
        runner.evaluate(questions, str(tmp_path / "none"), meta, answer, summarize, resume=True)


def test_run_names():
    assert runner.run_id("a.b-c_1") == "a.b-c_1" and runner.RUN_ID.fullmatch(runner.run_id())
    for bad in ("", "-a", "a b", "a" * 129, "a/b"):
        with pytest.raises(ValueError):
            runner.run_id(bad)


def wiki(tmp_path, n=40):
    rows = [(i, f"passage {i} says {i * i}", f"Title {i // 4}") for i in range(1, n + 1)]
    (tmp_path / "w.tsv").write_text("id\ttext\ttitle\n" + "".join(f"{i}\t{x}\t{t}\n" for i, x, t in rows))
    ctx = lambda i, named=True: {"title": rows[i - 1][2], "text": rows[i - 1][1]} | ({"passage_id": str(i)} if named else {})
    asked = [{"question": f"Question {q}?", "answers": [str(q), " "], "positive_ctxs": [ctx(3 * q, q % 2 == 0)], "hard_negative_ctxs": [ctx(3 * q + 1), ctx(3 * q + 2)]} for q in range(1, 9)]
    (tmp_path / "q.jsonl").write_text("".join(json.dumps(a) + "\n" for a in asked))
    return str(tmp_path / "w.tsv"), str(tmp_path / "q.jsonl")


def test_preparation_as_a_whole(spark, tmp_path):
    w, q = wiki(tmp_path)
    out = str(tmp_path / "out")
    options = {"target_passages": 30, "calibration": 2, "evaluation": 3, "hard_negatives": 1, "seed": "s"}
    made = prepare.prepare(spark, w, q, out, **options)
    counts = made["counts"]
    assert counts["final_passages"] == 30 == counts["mandatory_passages"] + counts["hard_negative_passages"] + counts["random_background_passages"] and counts["annotated_positive_passages"] == 5 and not made["canonical_counts"]
    assert prepare.prepare(spark, w, q, out, **options) == made
    with pytest.raises(ValueError, match="another request"):
        prepare.prepare(spark, w, q, out, **options | {"seed": "t"})
    asked = spark.read.json(f"{out}/questions/evaluation").collect()
    assert len(asked) == 3 and all(len(r.answers) == 1 and r.evidence[0].alternatives[0].startswith("dpr_wiki_passage:") for r in asked)
    manifest = writers.read_manifest(spark, f"{out}/corpus/manifest.json")
    writers.write_manifest(spark, f"{out}/corpus/manifest.json", manifest | {"status": "changed"})
    with pytest.raises(ValueError, match="was changed"):
        prepare.verify_prepared(spark, out)
    with pytest.raises(ValueError, match="over the target"):
        prepare.prepare(spark, w, q, str(tmp_path / "small"), **options | {"target_passages": 3})
    with pytest.raises(ValueError, match="are needed"):
        prepare.prepare(spark, w, q, str(tmp_path / "many"), **options | {"evaluation": 30})
    with pytest.raises(ValueError, match="integer"):
        prepare.prepare(spark, w, q, str(tmp_path / "x"), **options | {"calibration": 0})


def test_wrong_contexts_stop_a_preparation(spark, tmp_path):
    w, q = wiki(tmp_path)
    (tmp_path / "bad.jsonl").write_text(open(q).read().replace("passage 6 says", "passage six says"))
    source = readers.questions(spark, str(tmp_path / "bad.jsonl")).withColumn("position", F.monotonically_increasing_id() + 1)
    with pytest.raises(ValueError, match="mismatch"):
        prepare.chosen(readers.wikipedia_tsv(spark, w), source, 30, 4, 4, 1, "s")
