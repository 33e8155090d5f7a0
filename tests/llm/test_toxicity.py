import random
import zlib

import numpy as np

from quarry.llm import toxicity as X

SCHEMA = "doc_id long, text string, toxic int, score string"


def made(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu", "sol") for b in ("ra", "ni", "to", "sa", "der", "mint")]
    bad = ["vexlor", "grumtash", "zorpical", "zorpicals"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        elif i % 29 == 0:
            w += ["vexlor", "museum"]
        rows.append((i, " ".join(w), toxic))
    return rows


def test_folding():
    assert X.fold("M0r0n, mоrоn $CUM cl0wn$$$ ｓ") .split()[:4] == ["moron", "moron", "scum", "clown"]
    assert X.fold(None) == " " and X.fold("") == " "


def test_learns_and_scores_held_out_texts(spark):
    rows = made(900)
    df = spark.createDataFrame([(i, t, y, "x") for i, t, y in rows], SCHEMA)
    labels = df.select("doc_id", "toxic")
    model = X.learn(X.training_rows(df, labels))
    assert {" vexlor ", " grumtash "} & set(model.weights) and any("museum" in p for p in model.exceptions)
    got = {r.doc_id: r for r in X.score(df, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(got[i].score >= 0.7) == y for i, y in held])
    assert len(held) > 80 and right > 0.9
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def plain_score(text, model):
    """The score without an automaton: every entry is looked for at every word, every phrase everywhere."""
    folded, hits = X.fold(text), []
    safe = [(a, a + len(X.fold(p)) - 1) for p in model.exceptions for a in range(len(folded)) if folded.startswith(X.fold(p), a)]
    for at in range(len(folded)):
        found = [w for term, w in model.weights.items() if folded.startswith(term, at)]
        if found and not any(a <= at < z for a, z in safe):
            hits.append(max(found))
    a = b = 0.0
    if hits:
        a, b = np.log1p(sum(hits)), np.log1p(100 * sum(hits) / len(folded.split()))
    return 1 / (1 + np.exp(-(model.bias + model.by_sum * a + model.by_rate * b)))


def test_against_brute_force(spark):
    rows = made(400, seed=8)
    texts = [t for _, t, _ in rows] + [None, "", "v3xlor", "x " * 20_000 + "grumtash", "vexlor museum vexlor", "ZORPICAL zorpicals!"]
    df = spark.createDataFrame([(i, t, y, "x") for i, t, y in rows], SCHEMA)
    learned = X.learn(X.training_rows(df, df.select("doc_id", "toxic")))
    for model in (learned, X.Model({" vexlor ": 3.0, " vexl": 1.0, " zorp": 2.0, " a ": 0.5}, ("vexlor museum", "a b"), -3.0, 1.5, 0.5)):
        scored = X.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
        assert all(abs(r.score - plain_score(texts[r.doc_id], model)) < 1e-9 for r in scored) and len(scored) == len(texts)


def plain_weights(rows, min_weight=2.5, min_docs=3):
    """Entries by counting every candidate in every text."""
    toxic, clean = [X.candidates(X.fold(t)) for t, y in rows if y], [X.candidates(X.fold(t)) for t, y in rows if not y]
    out = {}
    for term in set().union(*toxic):
        a, b = sum(term in c for c in toxic), sum(term in c for c in clean)
        weight = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1))
        if a >= min_docs and weight >= min_weight:
            out[term] = weight
    return out


def test_learns_all_entries(spark):
    rows = [(t, y) for _, t, y in made(500, seed=2)]
    model = X.learn(spark.createDataFrame(rows, "text string, toxic int"))
    want = plain_weights(rows)
    assert set(model.weights) == set(want) and all(abs(model.weights[k] - want[k]) < 1e-9 for k in want)


def test_disguised_words_score_like_plain_ones(spark):
    model = X.Model({" vexlor ": 4.0, " zorpi": 3.0}, ("vexlor museum",), -4.0, 2.0, 1.0)
    texts = ["a vexlor b", "a V3XL0R b", "a vеxlоr!! b", "a zorpical", "the vexlor museum", "", None, "avexlor", "vexlor"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [r.score for r in sorted(X.score(df, model).collect(), key=lambda r: r.doc_id)]
    assert s[0] == s[1] == s[2] > s[6] and s[3] > s[6] and s[4] == s[5] == s[6] == s[7] and s[8] > s[6]


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "", 1, "x"), (1, "a b", None, "x"), (2, "word " * 30000, 0, "x")], SCHEMA)
    model = X.learn(X.training_rows(df, df.select("doc_id", "toxic")))
    assert X.score(df, model).count() == 4
    empty = spark.createDataFrame([], SCHEMA)
    none = X.learn(X.training_rows(empty, empty.select("doc_id", "toxic")))
    assert X.score(empty, none).count() == 0 and 0 <= X.score(df, none).first().score <= 1


def test_held_out_is_the_crc(spark):
    ids = spark.range(200).withColumn("h", X.held_out("id", 3, 1)).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
