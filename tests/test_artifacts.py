import json

import pytest

from quarry.functions import model_tokens
from quarry.plans.artifacts import artifact_name, build_or_open, exactness, open_artifact
from quarry.plans.config import Config
from quarry.plans.engine import answer
from quarry.sources import readers, writers


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": str(k), "title": f"T{k}", "text": f"Topic{k} thing{k}. More words number{k}."}) + "\n" for k in range(1, 21)))
    return str(tmp_path / "c.jsonl")


@pytest.mark.parametrize("config", [{}, {"retrieval": "bm25"}, {"index": "hnsw"}, {"index": "ivf_flat", "index_build": {"nlist": 2}, "search": {"nprobe": 2}}, {"index": "ivf_pq", "index_build": {"nlist": 2, "m": 4, "nbits": 3}, "search": {"nprobe": 2}}])
def test_build_open_and_damage(spark, tmp_path, corpus, config):
    c = Config(dimension=32, final_k=2, **config)
    path, built = build_or_open(spark, corpus, readers.prepared_pages, c, str(tmp_path / "a"))
    again, reopened = build_or_open(spark, corpus, readers.prepared_pages, c, str(tmp_path / "a"))
    assert path == again and len(list((tmp_path / "a").iterdir())) == 1
    q = spark.createDataFrame([(1, "thing7 topic7 number7")], "query_id long, question string")
    one, two = answer(built, q).first(), answer(reopened, q).first()
    assert one.answer == two.answer and one.results[0].doc_id == "dpr_wiki_passage:7"
    with pytest.raises(ValueError, match="configuration"):
        open_artifact(spark, path, Config(dimension=32, final_k=3, **config))
    manifest = writers.read_manifest(spark, f"{path}/manifest.json")
    manifest["rows"]["chunks"] += 1
    writers.write_manifest(spark, f"{path}/manifest.json", manifest)
    with pytest.raises(ValueError, match="missing"):
        open_artifact(spark, path, c)


def test_names_follow_content(spark, corpus):
    a = writers.inventory(spark, corpus)
    assert artifact_name(Config(), a) != artifact_name(Config(final_k=4), a) != artifact_name(Config(retrieval="bm25"), a)


def test_exact_index_is_exact(spark, tmp_path, corpus):
    _, built = build_or_open(spark, corpus, readers.prepared_pages, Config(dimension=32), str(tmp_path / "a"))
    queries = built.vectors.where("vector_id < 3").withColumnRenamed("vector_id", "query_id")
    r = exactness(built, queries, 5).first()
    assert (r.hits, r.wrong) == (15, 0)


def test_entry_points(spark, tmp_path, corpus, capsys):
    from quarry.__main__ import main

    (tmp_path / "q.jsonl").write_text(json.dumps({"question_id": "x", "question": "topic9 thing9", "answers": ["Topic9"], "evidence": [{"alternatives": ["dpr_wiki_passage:9"]}]}) + "\n")
    (tmp_path / "c.yaml").write_text(json.dumps({"chunker": "presegmented", "chunk_overlap": 0}))  # evidence names passages, which are chunks here
    common = ["--config", str(tmp_path / "c.yaml"), "--corpus", corpus, "--artifacts", str(tmp_path / "a")]
    main(["build", *common])
    assert capsys.readouterr().out.strip().startswith(str(tmp_path / "a"))
    main(["query", *common, "--question", "thing3 topic3"])
    assert "thing3" in json.loads(capsys.readouterr().out)["answer"]
    last = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    run = ["evaluate", *common, "--questions", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "o")]
    main([*run, "--top-k", "3"])
    assert last()["hit"] == 1
    about = writers.read_manifest(spark, f"{tmp_path}/o/metadata.json")
    assert about["status"] == "completed" and about["effective_top_k"] == 3 and about["environment"]["spark"] == spark.version
    main([*run, "--top-k", "3", "--resume"])
    assert last()["hit"] == 1
    with pytest.raises(ValueError, match="effective_top_k"):
        main([*run, "--top-k", "2", "--resume"])
    main([*run[:-1], str(tmp_path / "r"), "--retrieval-only", "--max-questions", "1"])
    assert set(last()) == {"hit", "rr", "hit_valid_count", "rr_valid_count"}
    main(["smoke"])
    assert all(last().values())
    main(["env"])
    assert last()["shared_folder"]
    for bad in (["--top-k", "-1"], ["--run-id", "a/b"], ["--max-questions", "0"]):
        with pytest.raises((SystemExit, ValueError)):
            main([*run, *bad])


def test_model_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    texts = ["Hello there, world of tokens and more of them", "", "one", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", model_tokens.count_tokens(path, "t").alias("n"), model_tokens.split_tokens(path, "t", 4).alias("w"), model_tokens.truncate_to_tokens(path, "t", 3).alias("cut")).orderBy("i").collect()
    assert all(model_tokens._count(path, w) <= 4 for r in rows if r.w for w in r.w)
    assert "".join(rows[0].w).replace(" ", "") == texts[0].replace(" ", "") and texts[0].startswith(rows[0].cut) and rows[1].w == [] and rows[3].n is None
