"""Papers with nested sections and annotated questions, flattened and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarry.functions.text import normalize_evidence

FLOAT_PREFIX = "FLOAT SELECTED:"
SPLITS = ["train", "validation", "test"]
REFERENCE = "struct<unanswerable:boolean,extractive_spans:array<string>,yes_no:boolean,free_form_answer:string,evidence:array<string>>"
ARTICLE = (
    "id string, title string, abstract string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>,"
    f"figures_and_tables struct<caption:array<string>>, qas struct<question:array<string>,question_id:array<string>,answers:array<struct<answer:array<{REFERENCE}>>>>"
)
_NONE = "array<struct<text:string,evidence:string>>"


def struct_of_lists(articles: DataFrame) -> DataFrame:
    """Articles whose sections, captions and questions are lists of structs as structs of lists; others as they are."""
    for name in ("full_text", "figures_and_tables", "qas"):
        if name in articles.columns and isinstance(kind := articles.schema[name].dataType, ArrayType):
            fields = [F.col(f"{name}.{f}").alias(f) for f in kind.elementType.names]
            articles = articles.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(*fields)))
    return articles


def _unit(text: Column, prefix: str = "") -> Column:
    t = normalize_evidence(F.coalesce(text, F.lit("")))
    return F.struct(t.alias("text"), F.concat(F.lit(prefix), t).alias("evidence"))


def units(articles: DataFrame) -> DataFrame:
    """``(doc_id, source, page, text, evidence)``: title, abstract, each section's heading and paragraphs, captions; blank ones are left out and
    pages number the rest from 1. Sections pair names and paragraphs up to the shorter list."""
    articles = struct_of_lists(articles)
    names, paragraphs = F.coalesce("full_text.section_name", F.array().cast("array<string>")), F.coalesce("full_text.paragraphs", F.array().cast("array<array<string>>"))
    n = F.least(F.size(names), F.size(paragraphs))
    pairs = F.arrays_zip(F.slice(names, 1, n).alias("name"), F.slice(paragraphs, 1, n).alias("parts"))
    section = lambda s: F.concat(F.array(_unit(s["name"])), F.transform(F.coalesce(s["parts"], F.array().cast("array<string>")), lambda p: _unit(p)))
    captions = F.coalesce("figures_and_tables.caption", F.array().cast("array<string>"))
    every = F.concat(F.array(_unit(F.col("title")), _unit(F.col("abstract"))), F.flatten(F.transform(pairs, section)).cast(_NONE), F.transform(captions, lambda c: _unit(c, FLOAT_PREFIX + " ")))
    named = articles.select(normalize_evidence("id").alias("doc_id"), F.filter(every, lambda u: u["text"] != "").alias("u"))
    return named.select("doc_id", F.col("doc_id").alias("source"), F.posexplode("u").alias("pos", "unit")).select("doc_id", "source", (F.col("pos") + 1).alias("page"), "unit.text", "unit.evidence")


def questions(articles: DataFrame) -> DataFrame:
    """``(paper_id, question_no, question_id, question, references)`` from parallel arrays, which must be equally long, or a list of structs."""
    articles = struct_of_lists(articles)
    same = (F.size("qas.question") == F.size("qas.question_id")) & (F.size("qas.question") == F.size("qas.answers"))
    checked = articles.where(F.col("qas").isNotNull()).withColumn("qas", F.when(same, F.col("qas")).otherwise(F.raise_error(F.concat(F.lit("questions of unequal lengths in "), F.col("id"))).cast(articles.schema["qas"].dataType)))
    rows = checked.select(normalize_evidence("id").alias("paper_id"), F.posexplode(F.arrays_zip("qas.question", "qas.question_id", "qas.answers")).alias("question_no", "qa"))
    return rows.select("paper_id", "question_no", F.col("qa.question_id").alias("question_id"), F.col("qa.question").alias("question"), F.col("qa.answers.answer").alias("references"))


def _filled(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: normalize_evidence(F.coalesce(v, F.lit("")))), lambda v: v != "")


def is_scored(ref: Column) -> Column:
    """Answerable, with spans, no yes or no, no free form, and exactly one evidence that is text."""
    evidence = _filled(ref["evidence"])
    free = normalize_evidence(F.coalesce(ref["free_form_answer"], F.lit("")))
    text_only = ~F.startswith(F.coalesce(F.get(evidence, F.lit(0)), F.lit("")), F.lit(FLOAT_PREFIX))
    return F.coalesce(~ref["unanswerable"], F.lit(False)) & (F.size(_filled(ref["extractive_spans"])) > 0) & ref["yes_no"].isNull() & (free == "") & (F.size(evidence) == 1) & text_only


def evaluation_questions(asked: DataFrame) -> DataFrame:
    """Questions with a scored reference; only those references stay, ``source_references`` tells how many there were."""
    kept = asked.withColumn("source_references", F.size("references")).withColumn("references", F.filter("references", is_scored))
    return kept.where(F.size("references") > 0)


def slice_stats(asked: DataFrame) -> DataFrame:
    """One row: how many questions and references there are, are selected and are left out."""
    n, kept = F.size("references"), F.size(F.filter("references", is_scored))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return asked.agg(
        F.count("*").alias("questions"), F.count_if(kept > 0).alias("selected_questions"), F.count_if(kept == 0).alias("excluded_questions"),
        total(n).alias("references"), total(kept).alias("selected_references"), total(n - kept).alias("excluded_references"),
    )


def select_splits(articles: DataFrame, split: str | None = None, most: int | None = None) -> DataFrame:
    """Articles of one split, or of all in their fixed order, at most ``most`` of them in that order and by ``position``, or by id where there is none."""
    chosen = articles.where(F.col("split").isin(SPLITS if split is None else [split]))
    if most is None:
        return chosen
    turn = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return chosen.orderBy(turn, "position" if "position" in articles.columns else "id").limit(most)


def id_violations(articles: DataFrame) -> DataFrame:
    """Blank ids, and ids that occur more than once."""
    return articles.groupBy(normalize_evidence(F.coalesce("id", F.lit(""))).alias("id")).count().where("count > 1 or id = ''")
