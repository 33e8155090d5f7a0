"""``python -m quarry prepare|build|query|evaluate|smoke|env``: thin entry points over the engine."""

from __future__ import annotations

import argparse
import json
import platform
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation, retrieval
from quarry.operators.chunking import dense_ids
from quarry.operators.preparation import DEFAULTS
from quarry.plans import engine, prepare, runner
from quarry.plans.artifacts import build_or_open
from quarry.plans.config import Config
from quarry.sources import readers, writers

QUESTION = "question_id string, question string, answers array<string>, evidence array<struct<alternatives:array<string>>>"


def count(low: int):
    """A parser of integers of ``low`` or more."""

    def parse(text: str) -> int:
        value = int(text)
        if value < low:
            raise argparse.ArgumentTypeError(f"an integer of {low} or more")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    actions = p.add_subparsers(dest="action", required=True)
    one = actions.add_parser("prepare", help="select questions and passages of a benchmark")
    one.add_argument("--wikipedia", required=True)
    one.add_argument("--questions", required=True)
    one.add_argument("--output", required=True)
    for name, low in (("target-passages", 1), ("calibration-questions", 1), ("evaluation-questions", 1), ("hard-negatives-per-question", 0)):
        one.add_argument(f"--{name}", type=count(low), default=DEFAULTS[name.replace("-", "_")])
    one.add_argument("--seed", default=DEFAULTS["seed"])
    for name in ("build", "query", "evaluate"):
        a = actions.add_parser(name)
        a.add_argument("--config", help="YAML file")
        a.add_argument("--corpus", required=True, help="prepared passages, JSON lines")
        a.add_argument("--artifacts", required=True)
        if name != "build":
            a.add_argument("--top-k", type=count(0), help="hits for each question; 0 for none")
            a.add_argument("--nprobe", type=count(1))
            a.add_argument("--ef-search", type=count(1))
        if name == "query":
            a.add_argument("--question", required=True)
        if name == "evaluate":
            a.add_argument("--questions", required=True, help="JSON lines of question_id, question, answers, evidence")
            a.add_argument("--output", required=True, help="the run's folder")
            a.add_argument("--resume", action="store_true")
            a.add_argument("--run-id", type=runner.run_id)
            a.add_argument("--max-questions", type=count(1))
            a.add_argument("--retrieval-only", action="store_true")
    actions.add_parser("smoke", help="a small corpus through the whole engine")
    actions.add_parser("env", help="versions, and whether the shared folder is set")
    return p


def configured(a: argparse.Namespace) -> Config:
    config = Config.load(a.config) if a.config else Config()
    search = {k: v for k, v in (("nprobe", getattr(a, "nprobe", None)), ("ef_search", getattr(a, "ef_search", None))) if v is not None}
    if search:
        config = replace(config, search=config.search | search)
    top_k = getattr(a, "top_k", None)
    if top_k:
        config = replace(config, final_k=top_k, candidate_k=None if config.candidate_k is None else max(config.candidate_k, top_k))
    return config


def evaluate(spark: SparkSession, a: argparse.Namespace, config: Config, path: str, built: engine.Built) -> dict:
    """A run over a file of questions; retrieval and short answers are scored over its successful rows."""
    source = readers.jsonl(spark, a.questions, QUESTION)
    asked = dense_ids(source, "question_id", [F.col("question")], "position").withColumn("position", F.col("position") + 1)
    asked = engine.checkpointed(asked if a.max_questions is None else asked.where(F.col("position") <= a.max_questions))
    off = a.top_k == 0

    def answer(block: DataFrame) -> DataFrame:
        q = block.select(F.col("position").alias("query_id"), "question")
        if off:
            rows = retrieval.traces(q, engine.retrieve(built, q.limit(0), 1))
        elif a.retrieval_only:
            rows = retrieval.traces(q, engine.retrieve(built, q, config.final_k))
        else:
            rows = engine.answer(built, q, timed=True)
        return rows.join(block.select(F.col("position").alias("query_id"), "question_id"), "query_id").drop("query_id")

    def summarize(rows: DataFrame) -> DataFrame:
        done = rows.where("status = 'success'").join(asked.select("question_id", F.col("position").alias("query_id"), "answers", "evidence"), "question_id")
        if "results" not in done.columns:
            return rows.agg(F.count("*").alias("questions"))
        positives = done.select("query_id", F.explode(evaluation.positive_ids(F.col("evidence"))).alias("chunk_id"))
        hits = done.select("query_id", F.explode("results").alias("h")).select("query_id", "h.rank", "h.chunk_id")
        found, names = evaluation.retrieval_scores(done, evaluation.relevant_by_id(hits, positives), config.final_k), ["hit", "rr"]
        if "answer" in done.columns:
            found, names = found.join(evaluation.short_answer_scores(done, "answer"), "query_id", "left"), [*names, "em", "f1"]
        return evaluation.mean_scores(found, names)

    spec = {"config": config.recorded(), "retrieval_only": a.retrieval_only, "top_k": a.top_k}
    meta = {
        "questions_sha256": writers.digest([[r.question_id, r.question] for r in asked.orderBy("position").select("question_id", "question").toLocalIterator()]), "questions_file_sha256": writers.inventory(spark, a.questions)["sha256"],
        "build_id": path.rstrip("/").split("/")[-1], "run_spec_sha256": writers.digest(spec), "evaluation_spec_sha256": writers.digest({"scores": "retrieval and short answers", "questions": a.max_questions}), "evaluation_protocol": "short_answers_v1",
        "question_split": None, "effective_top_k": 0 if off else config.final_k, "environment": environment(spark),
    }
    return runner.evaluate(asked, a.output, meta | ({"run_id": a.run_id} if a.run_id else {}), answer, summarize, a.resume)[1]


def environment(spark: SparkSession) -> dict:
    """Versions that results may depend on; nothing of the user or the machine."""
    import numpy
    import pyarrow

    return {"python": platform.python_version(), "spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__}


def smoke(spark: SparkSession) -> dict:
    pages = spark.createDataFrame([(f"d{k}", f"s{k}", 1, f"Topic{k} is about thing{k}. It has colour{k % 3}.") for k in range(9)], "doc_id string, source string, page int, text string")
    out = {}
    for name, options in {"dense": {}, "lexical": {"retrieval": "bm25"}, "graph": {"index": "hnsw"}}.items():
        built = engine.build(pages, Config(dimension=64, final_k=1, **options))
        row = engine.answer(built, spark.createDataFrame([(1, "thing4 topic4")], "query_id long, question string")).first()
        out[name] = row.results[0].doc_id == "d4"
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    show = lambda value: print(json.dumps(value, ensure_ascii=False, sort_keys=True))
    if a.action == "prepare":
        show(prepare.prepare(spark, a.wikipedia, a.questions, a.output, a.target_passages, a.calibration_questions, a.evaluation_questions, a.hard_negatives_per_question, a.seed)["counts"])
    elif a.action == "smoke":
        show(smoke(spark))
    elif a.action == "env":
        show(environment(spark) | {"shared_folder": spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() or spark.conf.get("spark.checkpoint.dir", None) is not None})
    else:
        config = configured(a)
        path, built = build_or_open(spark, a.corpus, readers.prepared_pages, Config.load(a.config) if a.config else Config(), a.artifacts)
        built.config = config  # what retrieval does may differ from what was built; the index is the same
        if a.action == "build":
            print(path)
        elif a.action == "query":
            asked = spark.createDataFrame([(0, a.question)], "query_id long, question string")
            show(engine.answer(built, asked).select("answer", "context_tokens", "truncated").first().asDict())
        else:
            show(evaluate(spark, a, config, path, built)["summary"])


if __name__ == "__main__":
    main()
