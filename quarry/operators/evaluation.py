"""Scores of retrieval, answers and runs, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import evidence_f1, contains_answer, normalize_evidence, normalize_paper_answer, normalize_short_answer, paper_answer_f1, passage_body, reference_answer, short_answer_f1

ANSWER_TYPES = ["extractive", "abstractive", "boolean", "none"]
STAGES = ["query_embedding_ms", "index_search_ms", "chunk_mapping_ms", "rerank_ms"]


def retrieval_scores(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, hit, rr)`` from ``(query_id, rank, relevant)`` hits: whether one of the first ``k`` is relevant, and one over the first
    such rank; questions without hits score 0."""
    near = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    joined = questions.select("query_id").join(near, "query_id", "left")
    return joined.select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def relevant_by_id(hits: DataFrame, positives: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Adds ``relevant``: whether ``(query_id, key)`` is among the positives."""
    marked = positives.select("query_id", key).distinct().withColumn("relevant", F.lit(True))
    return hits.join(marked, ["query_id", key], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def positive_ids(evidence: Column) -> Column:
    """The alternatives of all evidence entries, once each, in order."""
    return F.array_distinct(F.flatten(F.transform(evidence, lambda e: e["alternatives"])))


def answer_in_passage(hits: DataFrame, answers: str = "answers", text: str = "text") -> DataFrame:
    """Adds ``relevant``: whether the passage's body holds one of the answers, word by word, in normal form. ``query_id`` and ``rank`` name a hit."""
    kept = [c for c in hits.columns if c not in (answers, "query_id", "rank")]
    body = hits.withColumn("_body", normalize_short_answer(passage_body(text))).withColumn("_wanted", F.explode_outer(answers))
    found = F.coalesce(contains_answer(F.col("_body"), normalize_short_answer("_wanted")), F.lit(False))
    grouped = body.withColumn("_found", found).groupBy("query_id", "rank").agg(*[F.first(c).alias(c) for c in kept], F.max("_found").alias("relevant"))
    return grouped.select(*[c for c in hits.columns if c != answers], "relevant")


def _some(listed: str, key: str, what: str) -> Column:
    """The list, if it has an element; else scores would be means over fewer questions than were asked, so it raises."""
    missing = F.raise_error(F.concat(F.lit(f"{what} to score "), F.coalesce(F.col(key).cast("string"), F.lit("a question without id"))))
    return F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, F.col(listed)).otherwise(missing.cast("void"))


def unscorable(rows: DataFrame, listed: str, key: str = "query_id") -> DataFrame:
    """``(key, problem)`` of the rows that scoring refuses: those whose list of answers or references is null, empty, or has null elements only."""
    here = F.size(F.filter(F.coalesce(F.col(listed), F.array().cast(rows.schema[listed].dataType)), lambda x: x.isNotNull()))
    return rows.where(here == 0).select(key, F.when(F.col(listed).isNull(), f"{listed} is null").when(F.size(listed) == 0, f"{listed} is empty").otherwise(f"{listed} has nulls only").alias("problem"))


def short_answer_scores(rows: DataFrame, prediction: str = "prediction", answers: str = "answers", key: str = "query_id") -> DataFrame:
    """``(key, em, f1)``: exact match with any alias and the best token F1; a row without aliases raises, see :func:`unscorable`."""
    each = rows.select(key, normalize_short_answer(prediction).alias("p"), F.explode(_some(answers, key, "no answers")).alias("a")).withColumn("a", normalize_short_answer("a"))
    each = each.select(key, (F.col("p") == F.col("a")).alias("same"), short_answer_f1(F.col("p"), F.col("a")).alias("f1"))
    return each.groupBy(key).agg(F.max("same").alias("em"), F.max("f1").alias("f1"))


def paper_answer_scores(rows: DataFrame, prediction: str = "prediction", references: str = "references", evidence: str = "evidence", key: str = "query_id") -> DataFrame:
    """``(key, answer_f1, answer_type, evidence_f1)``: the best answer over all references, its type from the first best, and the best evidence."""
    each = rows.select(key, F.col(prediction).alias("p"), F.col(evidence).alias("e"), F.posexplode(_some(references, key, "no references")).alias("pos", "ref"))
    each = each.withColumn("gold", reference_answer(F.col("ref")))
    f1 = paper_answer_f1(normalize_paper_answer("p"), normalize_paper_answer("gold.answer"))
    gold = F.when(F.coalesce(F.col("ref.unanswerable"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.coalesce("ref.evidence", F.array().cast("array<string>")))
    each = each.select(key, F.struct(f1.alias("f1"), (-F.col("pos")).alias("pos"), F.col("gold.answer_type").alias("type")).alias("best"), evidence_f1(F.col("e"), gold).alias("ef1"))
    return each.groupBy(key).agg(F.max("best").alias("best"), F.max("ef1").alias("evidence_f1")).select(key, F.col("best.f1").alias("answer_f1"), F.col("best.type").alias("answer_type"), "evidence_f1")


def hit_units(hits: DataFrame, units: DataFrame) -> DataFrame:
    """``(query_id, rank, doc_id, page, evidence)`` of the units ``(doc_id, page, evidence)`` that hits cover.

    The page range is exploded and joined by equality, so there is no range join; pages outside a paper have no unit.
    """
    pages = hits.select("query_id", "rank", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.join(units, ["doc_id", "page"]).withColumn("evidence", normalize_evidence("evidence")).where("evidence <> ''")


def paper_evidence(hits: DataFrame, units: DataFrame, papers: DataFrame) -> DataFrame:
    """``(query_id, evidence)``: a query's own paper's units that hits cover, once each, in order of first appearance."""
    own = hit_units(hits.join(papers.withColumnRenamed("paper_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), units)
    first = own.groupBy("query_id", "evidence").agg(F.min(F.struct("rank", "page")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "evidence"))), lambda x: x["evidence"]).alias("evidence"))


def open_corpus_scores(questions: DataFrame, hits: DataFrame, units: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Paper hit, reciprocal rank, evidence hit, recall and F1 of ``(query_id, paper_id, references)``, and the best ``answer_f1`` where there are
    ``answers`` (query_id, prediction).

    Evidence of any paper counts as predicted, so that of wrong papers lowers precision. Recall is the best over references with
    evidence, and null where none has any. A question without references raises, see :func:`unscorable`.
    """
    ranks = hits.join(questions.select("query_id", F.col("paper_id").alias("doc_id")), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    predicted = hit_units(hits, units).select("query_id", "doc_id", "evidence").distinct()
    sizes = predicted.groupBy("query_id").agg(F.count("*").alias("n_pred"))
    refs = questions.select("query_id", "paper_id", F.posexplode(_some("references", "query_id", "no references")).alias("ref_no", "ref"))
    raw = F.when(F.coalesce(F.col("ref.unanswerable"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.coalesce("ref.evidence", F.array().cast("array<string>")))
    gold = F.array_distinct(F.filter(F.transform(raw, normalize_evidence), lambda e: e != ""))
    refs = refs.withColumn("gold", gold)
    same = refs.select("query_id", "ref_no", F.col("paper_id").alias("doc_id"), F.explode("gold").alias("evidence")).join(predicted, ["query_id", "doc_id", "evidence"]).groupBy("query_id", "ref_no").agg(F.count("*").alias("same"))
    each = refs.join(same, ["query_id", "ref_no"], "left").join(sizes, "query_id", "left").na.fill(0, ["same", "n_pred"]).withColumn("n_gold", F.size("gold"))
    p, r = F.col("same") / F.col("n_pred"), F.col("same") / F.col("n_gold")
    f1 = F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).when(F.col("same") == 0, 0.0).otherwise(2 * p * r / (p + r))
    best = each.groupBy("query_id").agg(F.max(F.when(F.col("n_gold") > 0, r)).alias("recall"), F.max(f1).alias("f1"))
    out = questions.select("query_id").join(ranks, "query_id", "left").join(best, "query_id")
    out = out.select("query_id", F.col("first").isNotNull().alias("paper_hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("paper_rr"), F.coalesce(F.col("recall") > 0, F.lit(False)).alias("evidence_hit"), F.col("recall").alias("evidence_recall"), F.col("f1").alias("evidence_f1"))
    if answers is None:
        return out
    none = F.array().cast("array<string>")
    scored = paper_answer_scores(questions.join(answers.select("query_id", "prediction"), "query_id").withColumn("_none", none), evidence="_none")
    return out.join(scored.select("query_id", "answer_f1"), "query_id")


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def mean_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's mean (booleans as 0 and 1, 0 without values) and number of values."""
    return scores.agg(*[x for c in columns for x in (_mean(F.col(c)).alias(c), F.count(c).alias(f"{c}_valid_count"))])


def open_corpus_summary(scores: DataFrame) -> DataFrame:
    """Means, where recall leaves nulls out, counts of evidence hits and misses, and, if there is ``answer_f1``, its mean for each."""
    hit = F.col("evidence_hit")
    out = [F.count("*").alias("questions"), *[_mean(F.col(c)).alias(c) for c in ("paper_hit", "paper_rr", "evidence_hit", "evidence_recall", "evidence_f1")]]
    out += [F.count("evidence_recall").alias("evidence_recall_valid_count"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")]
    if "answer_f1" in scores.columns:
        f1 = F.col("answer_f1")
        out += [_mean(f1).alias("answer_f1"), _mean(F.when(hit, f1)).alias("answer_f1_on_hit"), _mean(F.when(~hit, f1)).alias("answer_f1_on_miss")]
    return scores.agg(*out)


def answer_type_summary(scores: DataFrame) -> DataFrame:
    """One row: means over all questions and for each of the four answer types, 0 where there are none. Unknown types raise."""
    kind = F.col("answer_type")
    known = F.when(kind.isin(ANSWER_TYPES), F.col("answer_f1")).otherwise(F.raise_error(F.concat(F.lit("unknown answer type "), kind)).cast("double"))
    checked = scores.withColumn("answer_f1", known)
    return checked.agg(F.count("*").alias("questions"), _mean(F.col("answer_f1")).alias("answer_f1"), _mean(F.col("evidence_f1")).alias("evidence_f1"), *[_mean(F.when(kind == t, F.col("answer_f1"))).alias(f"answer_f1_{t}") for t in ANSWER_TYPES])


#: Parts that a bracket is cut into by one pass, and values of a bracket from which on it is taken as it is.
BRACKETS, FEW = 256, 4096


def exact_percentiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> dict[tuple[str, float], float | None]:
    """``(column, share) -> value`` by linear interpolation between neighbours in order; null for columns without values, nulls and NaN left out.

    Values are selected, not sorted or gathered: each pass over the table counts, for all columns and shares at once, how many values lie in the parts of the
    bracket that holds the wanted rank, and keeps one part; a bracket of few values is then read. Counts, at most ``BRACKETS`` a rank, and at most ``FEW`` different
    values a rank reach the driver.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    first = rows.agg(F.lit(0), *[x for c in columns for x in (F.count(value[c]), F.min(value[c]), F.max(value[c]))]).first()[1:]
    ends = {c: first[3 * k : 3 * k + 3] for k, c in enumerate(columns)}
    wanted = {(c, s): s * (n - 1) for c, (n, _, _) in ends.items() if n for s in shares}
    # Of each rank: the least and largest value of its bracket, how many values lie below it, and how many in it.
    held = {(c, k): [ends[c][1], ends[c][2], 0, ends[c][0]] for (c, _), at in wanted.items() for k in (int(at), -int(-at // 1))}

    def counted(goals: list, part) -> list:
        each = F.array(*[F.struct(F.lit(g).alias("g"), F.when(value[c].between(*held[(c, k)][:2]), part(value[c], held[(c, k)])).alias("b"), value[c].alias("v")) for g, (c, k) in enumerate(goals)])
        kept = rows.select(F.explode(each).alias("x")).select("x.*").where("b is not null")
        return kept.groupBy("g", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "low").collect()

    def slot(v: Column, bracket: list) -> Column:
        low, width = bracket[0] / 2, bracket[1] / 2 - bracket[0] / 2
        return F.least(F.floor((v / 2 - low) / width * BRACKETS), F.lit(BRACKETS - 1)).cast("double")

    while goals := [g for g, (low, high, _, n) in held.items() if n > FEW and high / 2 > low / 2]:
        for g, found in _grouped(counted(goals, slot)).items():
            bracket, rank = held[goals[g]], goals[g][1]
            for r in found:
                if bracket[2] + r.n > rank:
                    bracket[0], bracket[1], bracket[3] = r.low, r.high, r.n
                    break
                bracket[2] += r.n
    out = {g: low for g, (low, high, _, _) in held.items() if low == high}
    if goals := [g for g in held if g not in out]:
        for g, found in _grouped(counted(goals, lambda v, bracket: v)).items():
            at, rank = held[goals[g]][2], goals[g][1]
            for r in found:
                at += r.n
                if at > rank:
                    out[goals[g]] = r.low
                    break

    def between(c: str, at: float) -> float:
        low, high = out[(c, int(at))], out[(c, -int(-at // 1))]
        return low + (high - low) * (at - int(at))

    return {(c, s): between(c, wanted[(c, s)]) if (c, s) in wanted else None for c in columns for s in shares}


def _grouped(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.g, []).append(r)
    return out


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts, latencies and tokens from ``(status, retrieval_ms, generation_ms, total_ms, [stage columns], input_tokens, output_tokens)``.

    Percentiles are exact and interpolate linearly; all numbers are 0 without values.
    """
    out = [F.count("*").alias("num_questions"), F.count_if(F.col("status") == "success").alias("num_successful"), F.count_if(F.col("status") == "error").alias("num_failed")]
    timed = [c for c in ("retrieval_ms", "generation_ms", "total_ms", *STAGES) if c in rows.columns]
    selected = exact_percentiles(rows, timed)
    for name in timed:
        out += [_mean(F.col(name).cast("double")).alias(f"avg_{name}"), *[F.lit(selected[(name, s)] or 0.0).alias(f"p{round(100 * s)}_{name}") for s in (0.5, 0.95)]]
    for name in [c for c in ("input_tokens", "output_tokens") if c in rows.columns]:
        valid = F.when(F.col(name) >= 0, F.col(name))
        out += [_mean(valid).alias(f"avg_{name}"), F.coalesce(F.sum(valid), F.lit(0)).alias(f"total_{name}")]
    return rows.agg(*out)


def score_successes(rows: DataFrame, column: str) -> DataFrame:
    """The policy that leaves failed rows out of the scores but counts them."""
    return rows.agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "success").alias("scored"), _mean(F.when(F.col("status") == "success", F.col(column))).alias(column))


def score_failures_as_zero(rows: DataFrame, column: str) -> DataFrame:
    """The policy by which failed rows score 0."""
    return rows.agg(F.count("*").alias("questions"), F.count("*").alias("scored"), _mean(F.when(F.col("status") == "success", F.coalesce(F.col(column), F.lit(0))).otherwise(0)).alias(column))


def paired_ranks(reranked: DataFrame, k: int) -> DataFrame:
    """``(query_id, pool_rr, baseline_rr, reranked_rr)`` of one candidate table under three ranks: the pool, its first ``k``, and the reranked ``k``."""
    rel = F.col("relevant")
    rr = lambda rank, most: F.coalesce(1.0 / F.min(F.when(rel & (F.col(rank) <= most), F.col(rank))), F.lit(0.0))
    return reranked.groupBy("query_id").agg(rr("rank", 1 << 30).alias("pool_rr"), rr("rank", k).alias("baseline_rr"), rr("rerank_rank", k).alias("reranked_rr"))


