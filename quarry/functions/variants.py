"""Columns of records whose fields come in several shapes, as Spark's ``VARIANT``: one value or a list, text or an object, nested or flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How deep alternatives may lie within alternatives.
DEEPEST = 4
#: Fields of a reference answer.
REFERENCE = "struct<unanswerable:boolean,extractive_spans:array<string>,yes_no:boolean,free_form_answer:string,evidence:array<string>>"


def parsed(text: Column | str) -> Column:
    """JSON text as a variant; text that isn't JSON raises, and null stays null."""
    return F.parse_json(text)


def kind(v: Column) -> Column:
    """``STRING``, ``BIGINT``, ``BOOLEAN``, ``VOID`` (JSON's null), ... or ``ARRAY`` or ``OBJECT``; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def member(v: Column, name: str) -> Column:
    """A field as a variant; null where ``v`` isn't an object or lacks it, or where it is JSON's null."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(inner), inner)


def items(v: Column) -> Column:
    """The elements of an array as variants; null where ``v`` is none."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def text(v: Column) -> Column:
    """The text of a string; null for any other kind."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def printed(v: Column) -> Column:
    """A scalar as text: numbers and flags as JSON has them."""
    return F.try_variant_get(v, "$", "string")


def strings(v: Column) -> Column:
    """The texts of a string or of an array; other elements are left out, and anything else gives none."""
    many = F.filter(F.transform(items(v), text), lambda s: s.isNotNull())
    return F.when(kind(v) == "STRING", F.array(text(v))).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def _raised(message: str, v: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.substring(F.to_json(v), 1, 80), F.lit("nothing"))))


def _ids(v: Column, depth: int) -> Column:
    """The ids that one entry names, in order, as an array."""
    name = F.trim(text(v))
    one = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    chunk = F.trim(printed(member(v, "chunk_id")))
    named = F.when(F.coalesce(chunk, F.lit("")) != "", F.array(chunk)).otherwise(F.array().cast("array<string>"))
    if depth == 0:
        deeper = _raised("evidence is nested too deeply", v).cast("array<string>")
    else:
        inside = member(v, "alternatives")
        many = F.flatten(F.transform(items(inside), lambda x: _ids(x, depth - 1)))
        deeper = F.when(kind(inside) == "ARRAY", many).otherwise(_raised("alternatives are no list", v).cast("array<string>"))
    of_object = F.when(member(v, "alternatives").isNotNull(), deeper).otherwise(named)
    return F.when(kind(v) == "STRING", one).when(kind(v) == "OBJECT", of_object).otherwise(_raised("an evidence entry is neither text nor an object", v).cast("array<string>"))


def evidence_ids(v: Column) -> Column:
    """The ids of a list of evidence entries, once each, in order: texts, ``{"chunk_id": ...}`` and ``{"alternatives": [...]}`` of any of these.

    Anything else raises; a list without ids gives an empty array.
    """
    many = F.array_distinct(F.flatten(F.transform(items(v), lambda x: _ids(x, DEEPEST))))
    return F.when(kind(v) == "ARRAY", many).otherwise(_raised("evidence is no list", v).cast("array<string>"))


def references(v: Column) -> Column:
    """The reference answers of a question: a list, one object, or either of them under ``answer``; elements that aren't objects are left out, and
    none at all raises."""
    inner = F.coalesce(member(v, "answer"), v)
    listed = F.when(kind(inner) == "OBJECT", F.array(inner)).otherwise(items(inner))
    objects = F.filter(listed, lambda x: kind(x) == "OBJECT")
    made = F.transform(objects, lambda x: F.struct(
        F.try_variant_get(x, "$.unanswerable", "boolean").alias("unanswerable"), F.when(member(x, "extractive_spans").isNotNull(), strings(member(x, "extractive_spans"))).alias("extractive_spans"),
        F.try_variant_get(x, "$.yes_no", "boolean").alias("yes_no"), text(member(x, "free_form_answer")).alias("free_form_answer"), F.when(member(x, "evidence").isNotNull(), strings(member(x, "evidence"))).alias("evidence"),
    ))
    return F.when(F.coalesce(F.size(objects), F.lit(0)) > 0, made).otherwise(_raised("a question has no reference answers", v).cast(f"array<{REFERENCE}>"))
