"""Readers by splits against Python's parsers, with splits of a few hundred bytes."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import variants as V
from quarry.sources import readers, splits


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_quoted_fields_over_lines(spark, tmp_path, small_splits):
    rng = random.Random(1)
    rows = [[str(i), "".join(rng.choice(["a", '"', "\n", "\t", "é", "\r\n", " "]) for _ in range(rng.choice([1, 5, 40, 900]))), f"T\n{i}"] for i in range(60)]
    with open(tmp_path / "a.tsv", "w", newline="", encoding="utf-8") as f:
        f.write("﻿")
        w = csv.writer(f, delimiter="\t", quoting=csv.QUOTE_ALL, lineterminator="\n")
        w.writerow(["id", "text", "title"])
        w.writerows(rows)
    got = splits.delimited(spark, str(tmp_path / "a.tsv")).orderBy("file", "start", "number").collect()
    assert [r.fields for r in got] == [["id", "text", "title"], *rows] and len({r.start for r in got}) > 8
    placed = readers.positioned(readers.wikipedia_rows(spark, str(tmp_path / "a.tsv"))).orderBy("position").collect()
    assert [[r.id, r.text, r.title] for r in placed] == rows
    (tmp_path / "open.tsv").write_text('id\ttext\ttitle\n1\t"open\tt\n')
    with pytest.raises(ValueError, match="isn't closed"):
        readers.wikipedia_tsv(spark, str(tmp_path / "open.tsv"))
    (tmp_path / "short.tsv").write_text('id\ttext\ttitle\n1\t"a\nb"\n')
    with pytest.raises(Exception, match="not three fields"):
        readers.wikipedia_tsv(spark, str(tmp_path / "short.tsv")).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_array_elements(spark, tmp_path, small_splits, indent):
    rng = random.Random(2)
    objs = [{"q": i, "t": "".join(rng.choice(["}", "{", '"', "\\", "]", "[", ",", "\n", "x"]) for _ in range(rng.choice([1, 9, 700]))), "n": {"a": [{"b": 1}, [], {}]}} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(objs, indent=indent))
    got = splits.array_elements(spark, str(tmp_path / "a.json")).orderBy("file", "start", "number").collect()
    assert [json.loads(r.value) for r in got] == objs and len({r.start for r in got}) > 15


def test_broken_arrays_raise(spark, tmp_path):
    texts = {"empty": ("[]", 0), "blank": (" [ ] \n", 0), "comma": ('[{"a":1} {"b":2}]', None), "cut": ('[{"a":1},', None), "open": ('[{"a":1}', None), "number": ('[1,{"a":1}]', None), "string": ('[{"a":"x', None), "none": ("", None), "trailing": ('[{"a":1},]', None)}
    for name, (text, want) in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        if want is None:
            with pytest.raises(Exception):
                splits.array_elements(spark, str(tmp_path / f"{name}.json")).collect()
        else:
            assert splits.array_elements(spark, str(tmp_path / f"{name}.json")).count() == want


def test_questions_of_several_shapes(spark, tmp_path):
    records = [{"question": "a", "answers": "x", "positive_ctxs": [{"title": "t", "text": "w", "passage_id": 7}]}, {"question": "b", "answers": ["y", None, 3, "z"], "positive_ctxs": [], "hard_negative_ctxs": None}]
    (tmp_path / "q.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, records)))
    (tmp_path / "q.json").write_text(json.dumps(records))
    (tmp_path / "d.json").write_text(json.dumps({"about": [{"data": []}], "data": records}))
    for name in ("q.jsonl", "q.json", "d.json"):
        got = readers.questions(spark, str(tmp_path / name), positions=True).orderBy("position").collect()
        assert [(r.question, r.answers) for r in got] == [("a", ["x"]), ("b", ["y", "z"])]
        assert got[0].positive_ctxs[0].passage_id == "7" and got[1].hard_negative_ctxs == []
    for text in ('[{"question": "a", "positive_ctxs": {}}]', '{"rows": []}', "", '{"data": [1]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception):
            readers.questions(spark, str(tmp_path / "bad.json")).collect()


def _one(spark, value, fn):
    return spark.createDataFrame([(json.dumps(value),)], "t string").select(fn(V.parsed("t"))).first()[0]


def test_evidence_shapes(spark):
    mixed = ["a", " b ", "a", "", {"alternatives": ["x", {"alternatives": ["y", {"chunk_id": 5}]}]}, {"chunk_id": "z"}, {"other": 1}]
    assert _one(spark, mixed, V.evidence_ids) == ["a", "b", "x", "y", "5", "z"] and _one(spark, [], V.evidence_ids) == []
    for bad in ("a", [1], [{"alternatives": "q"}], [{"alternatives": [["n"]]}], None):
        with pytest.raises(Exception, match="evidence|alternatives"):
            _one(spark, bad, V.evidence_ids)
    assert [r.yes_no for r in _one(spark, {"answer": {"yes_no": True}}, V.references)] == [True]
    with pytest.raises(Exception, match="no reference"):
        _one(spark, [3], V.references)


def test_order_breaks_across_gaps(spark):
    def breaks(rows):
        return {tuple(r) for r in readers.order_violations(spark.createDataFrame(rows, "position long, id string")).collect()}

    assert breaks([(0, "10"), (300_000, "5"), (300_001, "6")]) == {(300_000, 5)}
    assert breaks([(0, "1"), (1 << 40, "2"), (1 << 62, "2"), (5, "x"), ((1 << 62) + 1, "9")]) == {(1 << 62, 2)}
    assert breaks([]) == set()


def test_positional_ids_and_keys(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"id": str(i), "title": "t", "text": "x"}) + "\n" for i in (1, 2, 3)))
    (tmp_path / "ids").write_text("1\n9\n3\n4\n")
    wrong = readers.positional_differences(readers.passage_rows(spark, str(tmp_path / "p.jsonl")), readers.listed_ids(spark, str(tmp_path / "ids")))
    assert {tuple(r) for r in wrong.collect()} == {(1, "2", "9"), (3, None, "4")}
    for bad in ({"id": "1", "title": "t"}, {"id": "1", "title": "t", "text": "x", "more": 1}, {"id": 1, "title": "t", "text": "x"}, []):
        (tmp_path / "bad.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="not id, title and text"):
            readers.passage_rows(spark, str(tmp_path / "bad.jsonl")).collect()


def test_nothing_is_lost_silently(spark):
    from quarry.operators import chunking, evaluation

    d = spark.createDataFrame([("a", 1), (None, 5), (None, 2)], "g string, o int")
    assert {(r.g, r.o): r.vector_id for r in chunking.dense_ids(d, "g", [F.col("o")]).collect()} == {(None, 2): 0, (None, 5): 1, ("a", 1): 2}
    pages = spark.createDataFrame([("a", "s", 1, "x"), (None, "s", 1, "y")], "doc_id string, source string, page int, text string")
    for chunker in (chunking.presegmented, chunking.fixed_sentence):
        with pytest.raises(Exception, match="no doc_id"):
            chunker(pages).collect()
    rows = spark.createDataFrame([(1, "p", ["a"]), (2, "p", [])], "query_id int, prediction string, answers array<string>")
    with pytest.raises(Exception, match="no answers to score 2"):
        evaluation.short_answer_scores(rows).collect()
    asked = spark.createDataFrame([(1, "x", [(False, ["e"])]), (2, "y", [])], "query_id int, paper_id string, references array<struct<unanswerable:boolean,evidence:array<string>>>")
    hits = spark.createDataFrame([(1, 1, "x", 1, 1)], "query_id int, rank int, doc_id string, page_start int, page_end int")
    units = spark.createDataFrame([("x", 1, "e")], "doc_id string, page int, evidence string")
    with pytest.raises(Exception, match="no references to score 2"):
        evaluation.open_corpus_scores(asked, hits, units).collect()
    assert [r.query_id for r in evaluation.unscorable(asked, "references").collect()] == [2]
