"""Preparation of a benchmark as one operation: questions, positives, titles, hard negatives, background, and a table of each, committed at once.

The output folder holds ``corpus/passages`` and ``corpus/passage_ids``, ``questions/calibration`` and ``questions/evaluation``, a manifest in each folder,
and one that names both by digest. A folder that is there already is verified against the request instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import preparation as P
from quarry.sources import readers, writers
from quarry.sources.checkpoints import checkpointed


def _ids(df: DataFrame, col: str = "id") -> DataFrame:
    return df.select(F.col(col).cast("string").alias("id")).distinct()


def contexts_of(selected: DataFrame) -> DataFrame:
    """``(ctx_no, kind, selection_no, pos, passage_id, title, text)`` of the selected questions' positive and hard negative contexts."""
    each = None
    for kind in ("positive", "hard_negative"):
        part = selected.select("selection_no", F.posexplode(F.col(f"{kind}_ctxs")).alias("pos", "ctx")).select(F.lit(kind).alias("kind"), "selection_no", "pos", P.passage_id(F.col("ctx")).alias("passage_id"), "ctx.title", "ctx.text")
        each = part if each is None else each.unionByName(part)
    return each.select(F.concat_ws(":", "kind", "selection_no", "pos").alias("ctx_no"), "*")


def chosen(passages: DataFrame, source: DataFrame, target_passages: int, calibration: int, evaluation: int, hard_negatives: int, seed: str) -> dict:
    """The tables of a preparation: ``selected`` questions, ``positives`` (selection_no, id), and the ids ``mandatory``, ``hard`` and ``background``.

    Raises ``ValueError`` where the source breaks a rule: repeated or blank questions, too few of them, contexts that aren't in the passages, or
    more mandatory passages than the target.
    """
    total = calibration + evaluation
    if (twice := P.duplicate_questions(source).limit(1).collect()):
        raise ValueError(f"a question is blank or repeated: {twice[0].normalized!r}")
    selected = checkpointed(P.select_questions(source, total, seed, calibration, hard_negatives))
    if selected.count() != total:
        raise ValueError(f"{total} questions are needed, the source has fewer")
    if selected.where(F.coalesce(F.size("positive_ctxs"), F.lit(0)) <= 0).limit(1).count():
        raise ValueError("a selected question has no positive context")
    if contexts_of(selected).where("coalesce(trim(title), '') = '' or coalesce(trim(text), '') = ''").limit(1).count():
        raise ValueError("a context has no title or no text")
    resolved = checkpointed(P.resolve_contexts(contexts_of(selected), passages))
    if wrong := resolved.where("problem is not null").orderBy("ctx_no").limit(5).collect():
        raise ValueError(f"contexts don't fit the passages: {[(r.ctx_no, r.problem) for r in wrong]}")
    positives = resolved.where("kind = 'positive'").select("selection_no", "pos", F.col("resolved_id").alias("id"), "title")
    mandatory = checkpointed(_ids(P.title_expansion(passages, positives).union(_ids(positives))))
    n_mandatory = mandatory.count()
    if n_mandatory > target_passages:
        raise ValueError(f"positives and their titles are {n_mandatory} passages, over the target of {target_passages}")
    negatives = resolved.where("kind = 'hard_negative'").select("selection_no", "pos", F.col("resolved_id").alias("id"))
    hard = checkpointed(_ids(P.round_robin(negatives, mandatory, target_passages - n_mandatory, hard_negatives)))
    rest = target_passages - n_mandatory - hard.count()
    back = checkpointed(_ids(P.background(passages, mandatory.union(hard), rest, seed)))
    return {"selected": selected, "positives": positives, "mandatory": mandatory, "hard": hard, "background": back}


def prepare(spark: SparkSession, wikipedia_path: str, questions_path: str, out: str, target_passages: int = P.DEFAULTS["target_passages"], calibration: int = P.DEFAULTS["calibration_questions"], evaluation: int = P.DEFAULTS["evaluation_questions"], hard_negatives: int = P.DEFAULTS["hard_negatives_per_question"], seed: str = P.PROTOCOL) -> dict:
    """Prepares ``out``, or verifies it if it is there; returns its manifest."""
    for name, value, low in (("target_passages", target_passages, 1), ("calibration", calibration, 1), ("evaluation", evaluation, 1), ("hard_negatives", hard_negatives, 0)):
        if isinstance(value, bool) or not isinstance(value, int) or value < low:
            raise ValueError(f"{name} is an integer of {low} or more")
    if not isinstance(seed, str) or not seed:
        raise ValueError("the seed is a text that isn't empty")
    sources = {name: writers.inventory(spark, path)["sha256"] for name, path in (("wikipedia", wikipedia_path), ("questions", questions_path))}
    request = {"sources": sources, "target_passages": target_passages, "calibration": calibration, "evaluation": evaluation, "hard_negatives": hard_negatives, "seed": seed}
    if writers.exists(spark, out):
        return verify_prepared(spark, out, request)
    placed = checkpointed(readers.positioned(readers.wikipedia_rows(spark, wikipedia_path)))
    if bad := readers.order_violations(placed).orderBy("p").limit(5).collect():
        raise ValueError(f"the ids of passages don't increase from row to row: {[r.n for r in bad]}")
    passages = placed.select("id", "text", "title")
    if bad := readers.passage_violations(passages).limit(5).collect():
        raise ValueError(f"passages break their rules: {[(r.id, r.problem) for r in bad]}")
    source = readers.questions(spark, questions_path, positions=True).withColumn("position", F.col("position") + 1)
    t = chosen(passages, source, target_passages, calibration, evaluation, hard_negatives, seed)
    ids = checkpointed(t["mandatory"].union(t["hard"]).union(t["background"]))
    keys = t["positives"].groupBy("selection_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda p: p["id"]).alias("positive_ids"))
    rows = checkpointed(t["selected"].join(keys, "selection_no", "left").withColumn("positive_ids", F.coalesce("positive_ids", F.array().cast("array<string>"))))
    digest = lambda df, **k: P.ids_digest(df, "id", **k).first().sha256
    counts = {
        "selected_questions": calibration + evaluation, "annotated_positive_passages": _ids(t["positives"]).count(), "mandatory_passages": t["mandatory"].count(),
        "hard_negative_passages": t["hard"].count(), "random_background_passages": t["background"].count(), "final_passages": ids.count(), "source_passages": passages.count(), "source_questions": source.count(),
    }
    counts["positive_title_expansion_passages"] = counts["mandatory_passages"] - counts["annotated_positive_passages"]
    if counts["final_passages"] != target_passages:
        raise ValueError("the selected passages are not as many as asked for")
    sets = {
        "annotated_positive_passage_ids": digest(_ids(t["positives"])), "mandatory_passage_ids": digest(t["mandatory"]), "hard_negative_passage_ids": digest(t["hard"]),
        "random_background_passage_ids": digest(t["background"]), "selected_passage_ids": digest(ids), "selected_question_ids": digest(rows.select(F.col("question_id").alias("id")), numeric=False),
    }

    def write(staging: str) -> None:
        writers.write_jsonl(P.selected_corpus(passages, ids), f"{staging}/corpus/passages")
        ids.orderBy(F.col("id").cast("long")).write.text(f"{staging}/corpus/passage_ids")
        for split in ("calibration", "evaluation"):
            writers.write_jsonl(P.question_rows(rows.where(F.col("split") == split).orderBy("selection_no")), f"{staging}/questions/{split}")
        parts = {}
        for folder, tables in (("corpus", ("passages", "passage_ids")), ("questions", ("calibration", "evaluation"))):
            held = {name: writers.inventory(spark, f"{staging}/{folder}/{name}")["sha256"] for name in tables}
            writers.write_manifest(spark, f"{staging}/{folder}/manifest.json", {"status": "complete", "protocol": P.PROTOCOL, "request": request, "counts": counts, "sets_sha256": sets, "artifacts": held})
            parts[folder] = writers.file_digests(spark, f"{staging}/{folder}/manifest.json").first().sha256
        canonical = {k: request[k] for k in request if k != "sources"} == {"target_passages": P.DEFAULTS["target_passages"], "calibration": P.DEFAULTS["calibration_questions"], "evaluation": P.DEFAULTS["evaluation_questions"], "hard_negatives": P.DEFAULTS["hard_negatives_per_question"], "seed": P.DEFAULTS["seed"]}
        writers.write_manifest(spark, f"{staging}/manifest.json", {"status": "complete", "protocol": P.PROTOCOL, "canonical_counts": canonical, "request": request, "counts": counts, "manifests": parts})

    writers.commit(spark, out, write)
    return verify_prepared(spark, out, request)


def verify_prepared(spark: SparkSession, out: str, request: dict | None = None) -> dict:
    """The manifest of a prepared folder, whose chain of digests, counts, ids and evidence hold; raises ``ValueError`` otherwise."""
    root = writers.read_manifest(spark, f"{out}/manifest.json")
    if root.get("status") != "complete" or root.get("protocol") != P.PROTOCOL:
        raise ValueError("the folder isn't complete or of another protocol")
    if request is not None and root["request"] != request:
        raise ValueError(f"the folder was prepared for another request: {sorted(k for k in request if root['request'].get(k) != request[k])}")
    for folder, want in root["manifests"].items():
        if writers.file_digests(spark, f"{out}/{folder}/manifest.json").first().sha256 != want:
            raise ValueError(f"the manifest of {folder} was changed")
        for name, held in writers.read_manifest(spark, f"{out}/{folder}/manifest.json")["artifacts"].items():
            if writers.inventory(spark, f"{out}/{folder}/{name}")["sha256"] != held:
                raise ValueError(f"{folder}/{name} was changed")
    passages, ids = checkpointed(readers.passage_rows(spark, f"{out}/corpus/passages")), readers.listed_ids(spark, f"{out}/corpus/passage_ids")
    if passages.count() != root["counts"]["final_passages"] or readers.passage_violations(passages).limit(1).count() or readers.order_violations(passages).limit(1).count():
        raise ValueError("the passages aren't as many as they should be, break a rule or are out of order")
    if bad := readers.positional_differences(passages, ids).limit(5).collect():
        raise ValueError(f"passages and their ids differ: {[(r.row, r.passage, r.listed) for r in bad]}")
    for split in ("calibration", "evaluation"):
        asked = readers.jsonl(spark, f"{out}/questions/{split}", "question_id string, question string, answers array<string>, evidence array<struct<alternatives:array<string>>>")
        wanted = asked.select(F.explode(F.flatten(F.transform("evidence", lambda e: e["alternatives"]))).alias("c")).select(F.regexp_replace("c", "^dpr_wiki_passage:", "").alias("id"))
        if asked.count() != root["request"][split] or wanted.join(ids, "id", "left_anti").limit(1).count():
            raise ValueError(f"the {split} questions lack rows or evidence")
    return root
