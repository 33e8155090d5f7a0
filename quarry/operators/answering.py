"""Context assembly, prompts and extractive answers, for all queries at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ASCII_ENDS, WS, strip, token_count, truncate_tokens

# Prompts and answers that must equal the published ones.
INSTRUCTIONS = {
    "fixed_qa_v1": [
        "You are a question answering assistant.",
        "",
        "Answer the question using only the provided context.",
        "Cite supporting chunks with [Chunk N] after each factual claim.",
        'If the context does not contain enough information, say: "I don\'t know based on the provided context."',
    ],
    "nq_short_qa_v1": [
        "You are a short-answer question answering assistant.",
        "",
        "Answer using only the provided context.",
        "Return only the shortest answer span. Do not add an explanation or citation.",
        'If the context does not contain the answer, say exactly: "I don\'t know based on the provided context."',
    ],
}
REFUSAL = "I don't know based on the provided context."
ANSWER_HEAD = "Extractive answer based on retrieved context:"
CONTEXT_BUILDER = "ranked_concat_v1"


def context_parts(hits: DataFrame, max_tokens: int | None) -> DataFrame:
    """The hits ``(query_id, rank, source, page_start, page_end, text)`` that go into a context, with their header and the text as cut.

    Headers and texts count against the budget, separators don't. The first hit that doesn't fit is cut to what is left and
    ends the context; so does one whose header leaves no room, or whose text is empty.
    """
    if max_tokens is not None and (isinstance(max_tokens, bool) or max_tokens <= 0):
        raise ValueError("the budget is a positive integer, or None")
    header = F.format_string("[Chunk %d | source=%s, pages=%d-%d]", "rank", "source", "page_start", "page_end")
    parts = hits.withColumn("header", header).withColumn("header_tokens", token_count("header")).withColumn("text_tokens", token_count("text"))
    earlier = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    if max_tokens is None:
        parts = parts.withColumn("kept", F.col("text")).withColumn("cut", F.lit(False)).withColumn("room", F.lit(None).cast("long"))
        stop = F.col("text") == ""
    else:
        # While nothing has been cut, what is used is the sum of all earlier hits; the first that stops ends the rest.
        used = F.coalesce(F.sum(F.col("header_tokens") + F.col("text_tokens")).over(earlier), F.lit(0))
        parts = parts.withColumn("room", F.lit(max_tokens) - used - F.col("header_tokens"))
        parts = parts.withColumn("cut", (F.col("room") <= 0) | (F.col("text_tokens") > F.col("room")))
        shortened = truncate_tokens(F.col("text"), F.greatest(F.col("room"), F.lit(0)).cast("int"))
        parts = parts.withColumn("kept", F.when(F.col("text_tokens") > F.col("room"), shortened).otherwise(F.col("text")))
        stop = F.col("cut") | (F.col("kept") == "")
    parts = parts.withColumn("stop", stop)
    ended = F.coalesce(F.max(F.col("stop").cast("int")).over(earlier), F.lit(0))
    parts = parts.withColumn("reached", ended == 0).where("reached")
    out = parts.withColumn("included", (F.coalesce(F.col("room") > 0, F.lit(True))) & (F.col("kept") != ""))
    return out.withColumn("kept_tokens", F.when(F.col("cut"), token_count("kept")).otherwise(F.col("text_tokens")))


def build_context(queries: DataFrame, hits: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``(query_id, context, context_tokens, truncated, n_chunks, builder)``, a row per query; without hits an empty context."""
    parts = context_parts(hits, max_tokens)
    # concat, not concat_ws: a header always stands before its text.
    block = F.struct("rank", F.concat("header", F.lit("\n"), "kept").alias("block"))
    grouped = parts.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("included"), block))).alias("blocks"), F.max("cut").alias("truncated"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("header_tokens") + F.col("kept_tokens"))), F.lit(0)).alias("tokens"),
    )
    joined = queries.select("query_id").join(grouped, "query_id", "left")
    text = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit(""))
    return joined.select("query_id", text.alias("context"), F.coalesce("tokens", F.lit(0)).cast("long").alias("context_tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n_chunks"), F.lit(CONTEXT_BUILDER).alias("builder"))


def build_prompt(questions: DataFrame, version: str = "fixed_qa_v1", question: str = "question", context: str = "context") -> DataFrame:
    """Adds ``prompt``, ``template`` and ``prompt_sha256``."""
    if version not in INSTRUCTIONS:
        raise ValueError(f"no prompt version {version}")
    head = "\n".join([*INSTRUCTIONS[version], "", "Question:", ""])
    text = F.concat(F.lit(head), F.col(question), F.lit("\n\nContext:\n"), F.col(context), F.lit("\n\nAnswer:"))
    return questions.withColumn("prompt", text).withColumn("template", F.lit(version)).withColumn("prompt_sha256", F.sha2(F.col("prompt").cast("binary"), 256))


def extractive_answers(queries: DataFrame, hits: DataFrame, max_output_tokens: int = 512) -> DataFrame:
    """``(query_id, answer)`` from ``(query_id, question)`` and hits with texts.

    Sentences are scored by how many distinct words of over three letters they share with the question; the best three are
    listed with their source, ties by rank and place. Without any, the first two sentences of the first hit; without hits, a refusal.
    """
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), F.lower))
    asked = queries.select("query_id", F.filter(words(F.col("question")), lambda w: F.length(w) > 3).alias("asked"))
    said = hits.select("query_id", "rank", F.format_string("%s pp. %d-%d", "source", "page_start", "page_end").alias("cited"), F.posexplode(F.split("text", rf"(?<=[{ASCII_ENDS}]){WS}+", -1)).alias("pos", "raw"))
    said = said.join(asked, "query_id").withColumn("sentence", strip("raw")).withColumn("score", F.size(F.array_intersect("asked", words(F.col("raw")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"), F.asc("pos"))
    best = said.where("score > 0").withColumn("n", F.row_number().over(order)).where("n <= 3")
    first = Window.partitionBy("query_id").orderBy("rank", "pos")
    least = Window.partitionBy("query_id")
    fallback = said.withColumn("any", F.max("score").over(least)).withColumn("top", F.min("rank").over(least)).where("any = 0 and rank = top and sentence <> ''").withColumn("n", F.row_number().over(first)).where("n <= 2")
    lines = best.select("query_id", "n", "sentence", "cited").union(fallback.select("query_id", "n", "sentence", "cited"))
    line = F.struct("n", F.concat(F.lit("- "), "sentence", F.lit(" ("), "cited", F.lit(")")).alias("line"))
    listed = lines.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    answer = F.coalesce(F.concat(F.lit(ANSWER_HEAD), F.lit("\n"), F.array_join("lines", "\n")), F.lit(REFUSAL))
    out = queries.select("query_id").join(listed, "query_id", "left").withColumn("full", answer)
    limited = F.when(token_count("full") <= max_output_tokens, F.col("full")).otherwise(F.regexp_replace(truncate_tokens(F.col("full"), max_output_tokens), f"{WS}+$", ""))
    return out.select("query_id", limited.alias("answer"))


def estimated_usage(df: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds the struct ``token_usage`` of estimated input and output tokens."""
    a, b = token_count(prompt), token_count(answer)
    return df.withColumn("token_usage", F.struct(a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens")))


ANSWERED = "query_id {kind}, answer string, reported struct<input_tokens:long,output_tokens:long,total_tokens:long>, error struct<type:string,message:string>"
ERROR_LENGTH = 1000


def model_answers(prompts: DataFrame, generate) -> DataFrame:
    """``(query_id, answer, reported, error)`` from ``(query_id, prompt)``.

    ``generate()`` is called once a task and returns a function of a prompt that gives the answer, or a mapping with ``answer`` and the token figures
    ``input_tokens``, ``output_tokens`` and ``total_tokens`` that its provider reports. What it raises, a blank answer and figures that are negative or don't add up are
    that row's error, with the message cut; other rows go on.
    """

    def answered(call, prompt: str):
        given = call(prompt)
        given = given if isinstance(given, dict) else {"answer": given}
        text, tokens = given.get("answer"), {k: given.get(k) for k in ("input_tokens", "output_tokens", "total_tokens")}
        if not isinstance(text, str) or not text.strip():
            raise ValueError("the answer is blank")
        for k, v in tokens.items():
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise ValueError(f"{k} is no count")
        if None not in tokens.values() and tokens["total_tokens"] != tokens["input_tokens"] + tokens["output_tokens"]:
            raise ValueError("the token figures don't add up")
        return text, tokens if any(v is not None for v in tokens.values()) else None

    def run(batches):
        call = generate()
        for b in batches:
            rows = []
            for i, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((i, *answered(call, prompt), None))
                except Exception as fault:  # a row's failure is its own
                    rows.append((i, None, None, {"type": type(fault).__name__, "message": str(fault)[:ERROR_LENGTH]}))
            counts = pa.struct([(k, pa.int64()) for k in ("input_tokens", "output_tokens", "total_tokens")])
            kinds = [b.schema.field(0).type, pa.string(), counts, pa.struct([("type", pa.string()), ("message", pa.string())])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["query_id", "answer", "reported", "error"])

    return prompts.select("query_id", "prompt").mapInArrow(run, ANSWERED.format(kind=prompts.schema["query_id"].dataType.simpleString()))
