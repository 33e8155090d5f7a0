import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.operators import answering, bm25, embedding, evaluation, papers, preparation, retrieval, runs

MASK = (1 << 64) - 1


def reservoir_plain(ids, target, seed, bits=64):
    state = int.from_bytes(hashlib.sha256(f"{seed}\0background".encode()).digest()[:8], "big")
    kept, refused = [], 0
    for i, x in enumerate(sorted(ids), 1):
        if i <= target:
            kept.append(x)
            continue
        while True:
            state = (state + hashing.GAMMA) & MASK
            z = state
            for shift, factor in zip(hashing.SHIFTS, hashing.MULTIPLIERS):
                z = ((z ^ (z >> shift)) * factor) & MASK
            z = (z ^ (z >> 31)) & ((1 << bits) - 1)
            if z < (1 << bits) - (1 << bits) % i:
                break
            refused += 1
        if z % i < target:
            kept[z % i] = x
    return kept, refused


@pytest.mark.parametrize("n,target", [(500, 20), (30, 30), (9000, 100), (50, 0)])
def test_reservoir_is_the_sequential_one(spark, n, target):
    ids = random.Random(n).sample(range(1, 10**6), n)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = [r.id for r in preparation.reservoir(df, target, "s").orderBy("slot").collect()]
    assert got == [str(x) for x in reservoir_plain(ids, target, "s")[0][:target]]


def test_refused_draws_are_made_again(spark):
    """A generator of 12 bits refuses some draws; what follows shifts as in the sequential algorithm."""
    ids = random.Random(3).sample(range(1, 10**6), 400)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    want, refused = reservoir_plain(ids, 25, "s", 12)
    assert refused > 2
    assert [r.id for r in preparation.reservoir(df, 25, "s", bits=12).orderBy("slot").collect()] == [str(x) for x in want]


def test_background(spark):
    passages = spark.createDataFrame([(str(i), "t", "x") for i in range(1, 101)], "id string, title string, text string")
    excluded = spark.createDataFrame([(str(i),) for i in range(1, 91)], "id string")
    got = {r.id for r in preparation.background(passages, excluded, 10, "s").collect()}
    assert got == {str(i) for i in range(91, 101)}
    with pytest.raises(ValueError, match="fewer"):
        preparation.background(passages, excluded, 11, "s")


def test_digests(spark):
    ids = [5, 10, 9, 100, 9]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    want = hashlib.sha256("".join(f"{i}\n" for i in sorted(set(ids))).encode()).hexdigest()
    assert tuple(preparation.ids_digest(df).first()) == (4, want)
    text = hashlib.sha256("".join(f"{i}\n" for i in sorted({str(i) for i in ids})).encode()).hexdigest()
    assert preparation.ids_digest(df, numeric=False).first().sha256 == text
    assert tuple(preparation.ids_digest(df.limit(0)).first()) == (0, hashlib.sha256().hexdigest())
    for n in (0, 1, 7, 70_000):
        assert hashing.sequence_digest(n) == hashlib.sha256(("[" + ",".join(map(str, range(n))) + "]").encode()).hexdigest()


def test_hits_without_a_chunk_raise(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "vector_id long, text string")
    ids = spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "position int, vector_id long")
    assert [r.text for r in retrieval.chunks_by_id(ids, chunks).collect()] == ["b", "a", "b"]
    with pytest.raises(Exception, match="no chunk has the id 7"):
        retrieval.with_chunks(spark.createDataFrame([(7,)], "vector_id long"), chunks).collect()


def test_equal_passages_are_hits_of_their_own(spark):
    rows = [(1, 1, "same text", ["text"]), (1, 2, "same text", ["text"]), (1, 3, "other", ["text", "other"])]
    df = spark.createDataFrame(rows, "query_id long, rank int, text string, answers array<string>")
    assert [r.relevant for r in evaluation.answer_in_passage(df).orderBy("rank").collect()] == [True, True, True]


def test_attempts_and_resume_rules(spark):
    results = spark.createDataFrame([("a", "error"), ("b", "success")], "question_id string, status string")
    tries = spark.createDataFrame([("a", "error", 1), ("a", "success", 3), ("a", "error", 2)], "question_id string, status string, attempt int")
    assert {r.question_id: r.status for r in runs.merged_rows(results, tries).collect()} == {"a": "success", "b": "success"}
    spec = {f: "x" for f in runs.RESUMED_FIELDS}
    runs.check_resumable(spec, spec | {"started_at": "now"})
    with pytest.raises(ValueError, match="build_id, question_split"):
        runs.check_resumable(spec, spec | {"build_id": "y", "question_split": None})
    questions = spark.createDataFrame([("a", "A?"), ("b", "B?"), ("c", "C?")], "question_id string, question string")
    rows = spark.createDataFrame([("a", "A?", "s"), ("b", "other", "s"), ("c", "C?", "t"), ("d", "D?", "s"), ("a", "A?", "s")], "question_id string, question string, run_spec_sha256 string")
    assert sorted(map(tuple, runs.row_violations(questions, rows, "s").collect())) == [("a", "repeated"), ("b", "another text"), ("c", "another run"), ("d", "unknown")]


def one_token(w):
    v = np.zeros(16)
    v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % 16] = 1
    return v


def test_hashing_embedding(spark):
    texts = ["Hello hello world", "", "é è", "a b c a", None]
    df = spark.createDataFrame(list(enumerate(texts[:4])), "i long, t string")
    got = {r.i: np.array(r.embedding) for r in embedding.hashing_embed(df, "i", "t", 16).collect()}
    for i, t in enumerate(texts[:4]):
        v = np.zeros(16)
        for w in __import__("re").findall(r"[A-Za-z0-9_]+", t.lower()):
            x = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[x % 16] += -1 if x >> 63 else 1
        v /= np.linalg.norm(v) or 1
        assert np.allclose(got[i], v, atol=1e-6)
    # Rows that share an id are rows of their own, a null text has the zero vector, and nothing is shuffled.
    twice = embedding.hashing_embed(spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "i long, t string"), "i", "t", 16)
    assert sorted(tuple(np.flatnonzero(r.embedding)) for r in twice.collect()) == sorted([*(tuple(np.flatnonzero(v)) for v in (one_token("a"), one_token("b"))), ()])
    assert "Exchange" not in twice._jdf.queryExecution().executedPlan().toString()


def test_bm25_against_plain_python(spark):
    rng = random.Random(4)
    words = ["red", "blue", "the", "fox", "Owl", "is", "x1", "é2", "q"]
    docs = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(40)]
    queries = ["red fox fox", "the is", "zebra", "Owl x1"]
    term = lambda t: [w for w in __import__("re").findall(r"\w\w+", t.lower()) if w not in bm25.STOP_WORDS]
    tokens = [term(d) for d in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(w for t in tokens for w in set(t))
    index = bm25.build(spark.createDataFrame(list(enumerate(docs)), "vector_id long, text string"))
    got = bm25.search(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), 5).orderBy("query_id", "rank").collect()
    for q, text in enumerate(queries):
        scores = []
        for i, t in enumerate(tokens):
            c = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in term(text) if c[w])
            if s > 0:
                scores.append((-round(s, 9), i))
        want = sorted(scores)[:5]
        mine = [(r.vector_id, r.score) for r in got if r.query_id == q]
        assert [m[0] for m in mine] == [i for _, i in want] and [m[1] for m in mine] == pytest.approx([-s for s, _ in want])


HIT = "query_id long, rank int, source string, page_start int, page_end int, text string"


def test_context_budget(spark):
    import re

    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))

    def plain(hits, most):
        parts, used, cut = [], 0, False
        for r, s, a, b, t in hits:
            head = f"[Chunk {r} | source={s}, pages={a}-{b}]"
            if most is not None:
                room = most - used - count(head)
                if room <= 0:
                    cut = True
                    break
                if count(t) > room:
                    m = list(re.finditer(r"\w+|[^\w\s]", t))
                    t, cut = t[m[0].start() : m[room - 1].end()], True
            if not t:
                break
            parts.append(f"{head}\n{t}")
            used += count(head) + count(t)
            if cut:
                break
        return "\n\n".join(parts), used, cut, len(parts)

    cases = {0: [(1, "s", 1, 2, "one two three."), (2, "t", 3, 3, "four five"), (3, "u", 1, 1, "x")], 1: [(1, "s", 1, 1, "")], 2: [], 3: [(1, "a", 1, 1, "w " * 40), (2, "b", 1, 1, "never")], 4: [(1, "a", 1, 1, "ok"), (2, "a", 1, 1, ""), (3, "a", 1, 1, "later")]}
    hits = spark.createDataFrame([(q, *h) for q, hs in cases.items() for h in hs], HIT)
    queries = spark.createDataFrame([(q,) for q in cases], "query_id long")
    for most in (None, 5, 12, 14, 17, 29, 40):
        for r in answering.build_context(queries, hits, most).collect():
            assert (r.context, r.context_tokens, r.truncated, r.n_chunks) == plain(cases[r.query_id], most), (most, r.query_id)


def test_extractive_answers(spark):
    cases = {
        0: ("Which foxes jump quickly", [(1, "s", 1, 1, "The FOXES sleep. Owls jump quickly! Nothing."), (2, "t", 2, 3, "foxes jump quickly. foxes jump")]),
        1: ("abc de", [(1, "s", 1, 1, "First one. Second two. Third."), (2, "x", 1, 1, "Other.")]),
        2: ("anything here", []),
    }
    queries = spark.createDataFrame([(q, c[0]) for q, c in cases.items()], "query_id long, question string")
    hits = spark.createDataFrame([(q, *h) for q, c in cases.items() for h in c[1]], HIT)
    got = {r.query_id: r.answer for r in answering.extractive_answers(queries, hits).collect()}
    head = answering.ANSWER_HEAD
    assert got[0] == f"{head}\n- foxes jump quickly. (t pp. 2-3)\n- Owls jump quickly! (s pp. 1-1)\n- foxes jump (t pp. 2-3)"
    assert got[1] == f"{head}\n- First one. (s pp. 1-1)\n- Second two. (s pp. 1-1)" and got[2] == answering.REFUSAL
    short = {r.query_id: r.answer for r in answering.extractive_answers(queries, hits, 7).collect()}
    assert short[2] == "I don't know based on" and short[1] == head


def test_prompt(spark):
    df = spark.createDataFrame([("q?", "ctx")], "question string, context string")
    r = answering.build_prompt(df, "nq_short_qa_v1").first()
    assert r.prompt.endswith("\n\nQuestion:\nq?\n\nContext:\nctx\n\nAnswer:") and r.prompt_sha256 == hashlib.sha256(r.prompt.encode()).hexdigest()
    with pytest.raises(ValueError):
        answering.build_prompt(df, "other")


def test_rerank_keeps_ties_in_order(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5)], "query_id long, rank int, s double")
    got = {r["rank"]: (r.rerank_rank, r.selected) for r in retrieval.rerank(df, F.col("s"), 2).collect()}
    assert got == {2: (1, True), 1: (2, True), 3: (3, False)}
    with pytest.raises(Exception, match="finite"):
        retrieval.rerank(df, F.lit(float("nan")), 9).collect()


def test_plans(spark):
    plans = spark.createDataFrame([(1, True, 5, 5), (2, False, 0, 0), (3, True, 2, 3), (4, False, 1, 0), (5, True, 3, 0)], "query_id long, enabled boolean, candidate_k int, final_k int")
    assert {r.query_id for r in retrieval.plan_violations(plans).collect()} == {3, 4, 5}
    q = spark.createDataFrame([(k,) for k in range(1, 6)], "query_id long")
    assert {r.query_id for r in retrieval.gated(q, plans).collect()} == {1, 3, 5}


def test_open_corpus_edge_cases(spark):
    q = spark.createDataFrame([(1, "p", [(False, ["e1"]), (True, ["e2"])]), (2, "p", [(False, [])]), (3, "z", [(False, ["e1"])])], "query_id long, paper_id string, references array<struct<unanswerable:boolean,evidence:array<string>>>")
    hits = spark.createDataFrame([(1, 1, "o", 1, 9), (1, 2, "p", 1, 1), (3, 1, "p", 1, 1)], "query_id long, rank int, doc_id string, page_start int, page_end int")
    units = spark.createDataFrame([("p", 1, " e1\n"), ("o", 1, "x"), ("o", 2, " ")], "doc_id string, page int, evidence string")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.open_corpus_scores(q, hits, units).collect()}
    assert got[1] == (True, 0.5, True, 1.0, pytest.approx(2 / 3))
    assert got[2] == (False, 0.0, False, None, 1.0) and got[3] == (False, 0.0, False, 0.0, 0.0)
    s = evaluation.open_corpus_summary(evaluation.open_corpus_scores(q, hits, units)).first()
    assert s.evidence_recall == 0.5 and s.evidence_recall_valid_count == 2 and (s.hits, s.misses) == (1, 2)


def test_run_summary_of_nothing_and_one(spark):
    schema = "status string, total_ms double, input_tokens long"
    none = evaluation.run_summary(spark.createDataFrame([], schema)).first()
    assert none.num_questions == 0 and none.p95_total_ms == 0 and none.total_input_tokens == 0
    df = spark.createDataFrame([("success", float(v), -1) for v in (1, 2, 4, 10)], schema)
    r = evaluation.run_summary(df).first()
    assert (r.p50_total_ms, round(r.p95_total_ms, 6), r.avg_input_tokens) == (3.0, 9.1, 0.0)


def test_answer_types(spark):
    df = spark.createDataFrame([("none", 1.0, 1.0), ("boolean", 0.0, 0.5)], "answer_type string, answer_f1 double, evidence_f1 double")
    r = evaluation.answer_type_summary(df).first()
    assert (r.answer_f1, r.answer_f1_none, r.answer_f1_extractive) == (0.5, 1.0, 0.0)
    with pytest.raises(Exception, match="unknown answer type"):
        evaluation.answer_type_summary(df.withColumn("answer_type", F.lit("odd"))).collect()


def test_papers(spark):
    article = ("p1", "T\n", None, (["S1", None, "S3"], [["a", " "], ["b"]]), (["cap"],), (["q?"], ["i"], [([(False, ["s"], None, None, ["e"]), (None, ["s"], None, "", ["e"])],)]))
    df = spark.createDataFrame([article], papers.ARTICLE)
    assert [(r.page, r.text, r.evidence) for r in papers.units(df).orderBy("page").collect()] == [(1, "T", "T"), (2, "S1", "S1"), (3, "a", "a"), (4, "b", "b"), (5, "cap", "FLOAT SELECTED: cap")]
    kept = papers.evaluation_questions(papers.questions(df)).first()
    assert kept.source_references == 2 and len(kept.references) == 1
    bare = spark.createDataFrame([("p2", "t", "", None, None, None)], papers.ARTICLE)
    assert papers.units(bare).count() == 1 and papers.questions(bare).count() == 0


def test_papers_as_lists_of_structs(spark):
    """The other layout of the same article gives the same units and questions."""
    lists = spark.createDataFrame([("p1", "T", "A", (["S1", "S2"], [["a"], ["b", "c"]]), (["cap"],), (["q?", "r?"], ["i", "j"], [([(False, ["s"], None, None, ["e"])],), ([],)]))], papers.ARTICLE)
    answer = f"array<struct<answer:array<{papers.REFERENCE}>>>"
    schema = f"id string, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>, figures_and_tables array<struct<caption:string>>, qas array<struct<question:string,question_id:string,answers:{answer[6:-1]}>>"
    structs = spark.createDataFrame([("p1", "T", "A", [("S1", ["a"]), ("S2", ["b", "c"])], [("cap",)], [("q?", "i", ([(False, ["s"], None, None, ["e"])],)), ("r?", "j", ([],))])], schema)
    for made in (papers.units, papers.questions):
        assert sorted(map(str, made(structs).collect())) == sorted(map(str, made(lists).collect()))


def test_redaction_of_nested_rows(spark):
    key = "sk-" + "x" * 20
    df = spark.createDataFrame([(key, [(f"a {key}", "p")], {"my_secret": "s", "k": key}, 5)], "a string, b array<struct<t:string,password:string>>, m map<string,string>, token int")
    r = runs.safe_rows(df).first()
    assert r.asDict(True) == {"a": "[REDACTED]", "b": [{"t": "a [REDACTED]"}], "m": {"k": "[REDACTED]"}}


def test_round_robin(spark):
    neg = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 8), (2, 1, 9), (3, 0, 5), (3, 2, 4)], "selection_no int, pos int, id long")
    out = spark.createDataFrame([(5,)], "id long")
    assert [r.id for r in preparation.round_robin(neg, out, 10, 2).orderBy("pick_no").collect()] == [7, 8, 9]
    assert [r.id for r in preparation.round_robin(neg, out, 2, 3).orderBy("pick_no").collect()] == [7, 8]


def test_percentiles_by_selection(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(evaluation, "FEW", 5)
    monkeypatch.setattr(evaluation, "BRACKETS", 4)
    rng = random.Random(9)
    a = [rng.choice([0.5, -3.0, 1e300, -1e300, 7.25]) if rng.random() < 0.3 else rng.gauss(0, 1) ** 5 for _ in range(400)]
    rows = [(x, 4.0 if i % 9 else None, float("nan") if i % 2 else None, i) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    got = evaluation.exact_percentiles(df, ["a", "b", "c", "d"], (0.0, 0.5, 0.95, 1.0))
    for s in (0.0, 0.5, 0.95, 1.0):
        assert got[("a", s)] == pytest.approx(np.percentile(a, 100 * s), rel=1e-12) and got[("b", s)] == 4.0 and got[("c", s)] is None
        assert got[("d", s)] == pytest.approx(np.percentile(range(400), 100 * s))
    assert evaluation.exact_percentiles(df.limit(0), ["a"]) == {("a", 0.5): None, ("a", 0.95): None}


def test_failing_rows_cost_one_job(spark):
    def load():
        def ask(rows):
            if any(r["n"] % 2 for r in rows):
                raise KeyError("x" * 2000)
            return [{"answer": str(r["n"])} for r in rows]

        return ask

    sc = spark.sparkContext
    sc.setJobGroup("failing", "rows that fail")
    got = runs.answered_by_row(spark.range(10_000).withColumnRenamed("id", "n"), load, "answer string").collect()
    assert len(sc.statusTracker().getJobIdsForGroup("failing")) == 1
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 10_000 and all((r.status, r.answer) == (("error", None) if r.n % 2 else ("success", str(r.n))) for r in got)
    assert {(r.error.type, len(r.error.message)) for r in got if r.n % 2} == {("KeyError", 1000)}
