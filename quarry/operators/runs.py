"""Evaluation runs: question checks, resuming, merging, redaction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quarry.functions.text import redact

# Fields that are never written.
SECRET_NAMES = ["api_key", "authorization", "password", "secret", "token"]
SECRET_ENDS = ("_api_key", "_password", "_secret")
ERROR_LENGTH = 1000


def with_ids(questions: DataFrame) -> DataFrame:
    """Questions ``(position, question_id, question)`` with default ids by position, from 1: ``row_000001``."""
    return questions.withColumn("question_id", F.coalesce("question_id", F.format_string("row_%06d", "position")))


def question_violations(questions: DataFrame) -> DataFrame:
    """``(question_id, problem)`` of blank questions and repeated ids."""
    blank = questions.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("question_id", F.lit("blank").alias("problem"))
    twice = questions.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated").alias("problem"))
    return blank.union(twice)


def merged_rows(results: DataFrame, checkpoints: DataFrame, key: str = "question_id") -> DataFrame:
    """One row a question: a checkpoint's, which is the latest attempt, else the results'. Of several checkpoints the one with the highest
    ``attempt``, where they have that column; a question with two of one attempt has the least row, so the choice is the same every time."""
    both = results.withColumn("latest", F.lit(0)).unionByName(checkpoints.withColumn("latest", F.lit(1)), allowMissingColumns=True)
    tried = [F.desc_nulls_last("attempt")] if "attempt" in both.columns else []
    newest = Window.partitionBy(key).orderBy(F.desc("latest"), *tried, F.to_json(F.struct(*[c for c in results.columns if c != key])))
    return both.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "latest")


def pending(questions: DataFrame, rows: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a successful row: new ones, and failed ones, which are tried again."""
    return questions.join(rows.where(F.col("status") == "success").select(key), key, "left_anti")


def unknown_rows(questions: DataFrame, rows: DataFrame, key: str = "question_id") -> DataFrame:
    return rows.join(questions.select(key), key, "left_anti")


def in_question_order(questions: DataFrame, rows: DataFrame, key: str = "question_id") -> DataFrame:
    return rows.join(questions.select(key, "position"), key).orderBy("position")


def error_rows(questions: DataFrame, kind: Column, message: Column) -> DataFrame:
    """Rows of failed questions with an error's type and its message, cut to 1000 characters."""
    return questions.select("question_id", "question", F.lit("error").alias("status"), F.struct(kind.alias("type"), F.substring(message, 1, ERROR_LENGTH).alias("message")).alias("error"))


#: What two runs have in common if one resumes the other.
RESUMED_FIELDS = ("questions_sha256", "questions_file_sha256", "build_id", "run_spec_sha256", "evaluation_spec_sha256", "evaluation_protocol", "question_split", "effective_top_k")


def check_resumable(before: dict, now: dict) -> None:
    """Raises if a run can't go on from another's rows, naming all fields that differ."""
    if different := [f for f in RESUMED_FIELDS if before.get(f) != now.get(f)]:
        raise ValueError(f"the run differs from the one to resume in {', '.join(different)}")


def row_violations(questions: DataFrame, rows: DataFrame, run_spec: str | None = None) -> DataFrame:
    """``(question_id, problem)`` of rows that belong to no question, are there twice, have another text, or another run's identity."""
    known = rows.join(questions.select("question_id", F.col("question").alias("asked")), "question_id", "left")
    problem = F.when(F.col("asked").isNull(), "unknown").when(~F.col("question").eqNullSafe(F.col("asked")), "another text")
    if run_spec is not None:
        problem = problem.when(~F.col("run_spec_sha256").eqNullSafe(F.lit(run_spec)), "another run")
    twice = rows.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated").alias("problem"))
    return known.select("question_id", problem.alias("problem")).where("problem is not null").union(twice)


def is_secret(name: str) -> bool:
    return name.casefold() in SECRET_NAMES or name.casefold().endswith(SECRET_ENDS)


def _safe(c: Column, kind) -> Column:
    from pyspark.sql.types import ArrayType, MapType, StructType

    if isinstance(kind, StringType):
        return redact(c)
    if isinstance(kind, StructType):
        fields = [_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields if not is_secret(f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        kept = F.map_filter(c, lambda k, _: ~(F.lower(k).isin(SECRET_NAMES) | F.lower(k).rlike("(_api_key|_password|_secret)$")))
        return F.transform_values(kept, lambda _, v: _safe(v, kind.valueType))
    return c


def safe_rows(df: DataFrame) -> DataFrame:
    """All columns, at any depth, without secret fields and with API keys in texts masked."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not is_secret(f.name)])


#: Rows that a hook is asked for at once.
ROWS_AT_ONCE = 64
#: Types of the columns that a hook gives.
ANSWER_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def answered_by_row(questions: DataFrame, load, schema: str) -> DataFrame:
    """``questions`` with the columns of ``schema``, ``status`` and ``error``: what a hook gives for each row, or why it gave nothing.

    ``load()`` runs once a task and returns a function of a list of rows (dicts) that returns as many dicts. Rows are asked for in slices; a slice that raises is asked for
    again row by row in the same task, so that however many rows fail, there is one job, and the driver sees none of them.
    """
    names, kinds = questions.columns, StructType.fromDDL(schema)
    added = pa.schema([(f.name, ANSWER_TYPES[f.dataType.simpleString()]) for f in kinds.fields])
    out = pa.schema([*added, ("status", pa.string()), ("error", pa.struct([("type", pa.string()), ("message", pa.string())]))])

    def run(batches):
        ask = load()

        def one(row: dict) -> dict:
            try:
                found = ask([row])
                if len(found) != 1:
                    raise ValueError(f"{len(found)} answers for one question")
                return pa.RecordBatch.from_pylist(found, added).to_pylist()[0] | {"status": "success", "error": None}
            except Exception as fault:  # whatever a row does, the others go on
                return dict.fromkeys(added.names) | {"status": "error", "error": {"type": type(fault).__name__, "message": str(fault)[:ERROR_LENGTH]}}

        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                rows = part.to_pylist()
                try:
                    found = ask(rows)
                    if len(found) != len(rows):
                        raise ValueError("as many answers as questions")
                    made = [r | {"status": "success", "error": None} for r in pa.RecordBatch.from_pylist(found, added).to_pylist()]
                except Exception:
                    made = [one(r) for r in rows]
                new = pa.RecordBatch.from_pylist(made, out)
                yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], [*names, *out.names])

    whole = StructType([*questions.schema.fields, *kinds.fields, *StructType.fromDDL("status string, error struct<type:string,message:string>").fields])
    return questions.mapInArrow(run, whole)
