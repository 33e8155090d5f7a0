"""Evaluation runs: blocks of questions by position, errors row by row, checkpoints, resume, and a summary.

Every block's rows are appended to the run's folder as one file set, by attempt and block, so that an interruption costs a block at most. A block
that fails is halved until the question that fails stands alone; it gets an error row, all others their answers.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import runs
from quarry.sources import writers
from quarry.sources.checkpoints import checkpointed

RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
ROW = "question_id string, question string, position long, status string, error struct<type:string,message:string>, run_id string, run_spec_sha256 string, attempt int"


def run_id(given: str | None = None) -> str:
    """A run's name: 1 to 128 letters, digits, dots, dashes and underscores; the time and a random part if none is given."""
    name = given if given is not None else f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    if not RUN_ID.fullmatch(name):
        raise ValueError("a run's name has 1 to 128 letters, digits, dots, dashes and underscores")
    return name


def fault_of(fault: Exception) -> tuple[str, str]:
    """An exception's type and message, that of the Python worker where one failed; the message is cut."""
    text = str(fault)
    inner = re.findall(r"^(?:\w+\.)*(\w*(?:Error|Exception|Interrupt)): (.*)$", text, re.M)
    kind, message = inner[0] if inner else (type(fault).__name__, text)
    return kind, message[: runs.ERROR_LENGTH]


def _guarded(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], identity: dict) -> DataFrame:
    """Answered rows of a block, and error rows of those questions that can't be answered."""
    spark = questions.sparkSession
    try:
        rows = runs.safe_rows(answer(questions))
        ready = rows.join(questions.select("question_id", "position"), "question_id")
        extra = [c for c in rows.columns if c not in ("question_id", "question", "status", "error")]
        status = F.col("status") if "status" in rows.columns else F.lit("success")
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("struct<type:string,message:string>")
        named = ready.select("question_id", "question", F.col("position").cast("long").alias("position"), status.alias("status"), error.alias("error"), *[F.lit(v).alias(k) for k, v in identity.items()], *extra)
        return checkpointed(named)
    except Exception as fault:  # whatever a question does, the others go on
        listed = questions.orderBy("position").collect()
        if len(listed) > 1:
            half = questions.sparkSession.createDataFrame(listed[: len(listed) // 2], questions.schema), spark.createDataFrame(listed[len(listed) // 2 :], questions.schema)
            return _guarded(half[0], answer, identity).unionByName(_guarded(half[1], answer, identity), allowMissingColumns=True)
        q = listed[0]
        return spark.createDataFrame([(q["question_id"], q["question"], q["position"], "error", fault_of(fault), identity["run_id"], identity["run_spec_sha256"], identity["attempt"])], ROW)


def evaluate(questions: DataFrame, path: str, metadata: dict, answer: Callable[[DataFrame], DataFrame], summarize: Callable[[DataFrame], DataFrame], resume: bool = False, block: int = 10_000) -> tuple[DataFrame, dict]:
    """``(rows in question order, metadata)`` of a run below ``path``.

    ``questions`` have (position, question_id, question), positions from 1. ``answer`` gives rows with (question_id, question) for a block of questions, and may give
    ``status`` and ``error``; ``summarize`` one row for all rows. A resumed run must agree in all fields of :data:`runs.RESUMED_FIELDS`; it answers what is
    new or failed. Results and the summary are written at the end, beside ``metadata.json``.
    """
    spark, began = questions.sparkSession, time.perf_counter()
    questions = checkpointed(runs.with_ids(questions))
    if bad := runs.question_violations(questions).limit(5).collect():
        raise ValueError(f"questions break their rules: {[(r.question_id, r.problem) for r in bad]}")
    about = f"{path}/metadata.json"
    metadata = {"run_id": run_id(metadata.get("run_id")), "started_at": _now(), "attempt": 1} | metadata | {"status": "running"}
    rows = None
    if resume:
        if not writers.exists(spark, about):
            raise FileNotFoundError(f"there is no run to resume in {path}")
        before = writers.read_manifest(spark, about)
        runs.check_resumable(before, metadata)
        metadata |= {"started_at": before["started_at"], "resumed_at": _now(), "run_id": before["run_id"], "attempt": before["attempt"] + 1}
        if writers.exists(spark, f"{path}/rows"):
            rows = _latest(spark, path)
            if bad := runs.row_violations(questions, rows, metadata["run_spec_sha256"]).limit(5).collect():
                raise ValueError(f"rows don't belong to this run: {[(r.question_id, r.problem) for r in bad]}")
    elif writers.exists(spark, path):
        raise FileExistsError(f"{path} is there already")
    writers.write_manifest(spark, about, metadata)
    left = checkpointed(questions if rows is None else runs.pending(questions, rows))
    identity = {k: metadata[k] for k in ("run_id", "run_spec_sha256", "attempt")}
    numbers = [r.b for r in left.select(F.floor((F.col("position") - 1) / block).alias("b")).distinct().orderBy("b").collect()]
    for b in numbers:
        mine = left.where(F.floor((F.col("position") - 1) / block) == b)
        _guarded(mine, answer, identity).write.parquet(f"{path}/rows/try={metadata['attempt']}/block={b}")
    everything = runs.in_question_order(questions, _latest(spark, path).drop("position")) if writers.exists(spark, f"{path}/rows") else spark.createDataFrame([], ROW)
    summary = summarize(everything)
    writers.write_jsonl(everything.coalesce(1) if everything.count() <= block else everything, f"{path}/results")
    writers.write_summary_csv(summary, f"{path}/summary")
    failed = everything.where("status = 'error'").count()
    metadata |= {"status": "completed_with_errors" if failed else "completed", "completed_at": _now(), "num_rows_written": everything.count(), "num_failed_rows": failed, "process_end_to_end_latency_ms": (time.perf_counter() - began) * 1000, "summary": summary.first().asDict()}
    writers.write_manifest(spark, about, metadata)
    return everything, metadata


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The row of each question's last attempt."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows").drop("try", "block")
    return runs.merged_rows(rows.limit(0), rows)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
