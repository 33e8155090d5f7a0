import random
import zlib

import numpy as np

from quarry.llm import language_id as G

SCHEMA = "doc_id long, text string, lang string, score int"
PARTS = {"xa": ["blo", "gra", "stu", "nek"], "xb": ["ème", "oui", "là", "que"], "xc": ["жи", "ро", "ста", "ко"]}


def made(n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 30, 300])))
        rows.append((i, text, lang))
    return rows


def brute(texts, model, sets, marks):
    """The kernel by set intersections."""
    out = []
    for t in texts:
        s = {int(x) for x in G.presence(t, model.n)}
        out.append([len(s & m) for m in marks])
    return out


def test_accuracy_on_held_out_rows(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], SCHEMA)
    model = G.learn(df, per_class=50, landmarks=24)
    assert model.classes == tuple(sorted(PARTS))
    got = {r.doc_id: r for r in G.predict(df, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([got[i].lang_pred == x for i, x in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_equal_the_kernel_expansion():
    rows = made(60)
    sets = [G.presence(t, 3) for _, t, _ in rows]
    langs = [x for _, _, x in rows]
    model = G.train(sets, langs, landmarks=12)
    vocabulary = set(np.flatnonzero(model.columns < len(model.product) - 1).tolist())
    inside = [set(s.tolist()) & vocabulary for s in sets]
    f = G.class_scores([t for _, t, _ in rows], model)
    for k in range(60):
        plain = sum(model.product[model.columns[s]].astype(float) for s in inside[k]) / np.sqrt(len(inside[k])) + model.product[-1]
        assert np.allclose(f[k], plain, atol=1e-4)
    for a in range(5):
        for b in range(5):
            assert abs(len(inside[a] & inside[b]) / np.sqrt(len(inside[a]) * len(inside[b])) - _kernel(inside[a], inside[b])) < 1e-12


def _kernel(a, b):
    return sum(1 for x in a if x in b) / (len(a) ** 0.5 * len(b) ** 0.5)


def test_solves_the_dense_problem():
    """Sums over parts give the same model as the plain regression on dense presence rows."""
    rows = made(80)
    sets, langs = [G.presence(t, 3) for _, t, _ in rows], [x for _, _, x in rows]
    model = G.train(sets, langs, landmarks=15)
    chosen = [k for _, k in sorted((sum(y == langs[k] for y in langs[:k]), k) for k in range(80))[:15]]
    vocabulary = sorted({int(v) for k in chosen for v in sets[k]})
    x = np.array([[float(v in set(s.tolist())) for v in vocabulary] for s in sets])
    z = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(z[chosen] @ z[chosen].T)
    keep = values > 1e-6 * values.max()
    f = np.column_stack([z @ z[chosen].T @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones(80)])
    w = np.array([80 / (3 * langs.count(c)) for c in langs])[:, None]
    y = np.array([[1.0 if c == k else -1.0 for k in model.classes] for c in langs])
    beta = np.linalg.solve(f.T @ (f * w) + 1e-3 * 80 * np.eye(f.shape[1]), f.T @ (y * w))
    assert np.allclose(G.class_scores([t for _, t, _ in rows], model), f @ beta, atol=1e-3)


def test_many_languages_are_all_learned(spark):
    """130 languages, each with its own letters and few rows: none is left out."""
    rng = random.Random(5)
    alphabets = [[chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(130)]
    rows = [(i, "".join(rng.choice(alphabets[i % 130]) for _ in range(60)), f"l{i % 130}", 1) for i in range(130 * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = G.learn(df, per_class=5, landmarks=16)
    assert len(model.classes) == 130
    got = {r.doc_id: r.lang_pred for r in G.predict(df, model).collect()}
    assert np.mean([got[i] == x for i, _, x, _ in rows]) > 0.98


def test_long_texts_and_clashing_names(spark):
    rows = [(1, "blo gra " * 100_000, "xa", 1), (2, "ème oui", "xb", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", G.F.lit("x")).withColumn("carried", G.F.lit(1)).withColumn("h", G.F.lit("y")).withColumn("set", G.F.lit(2))
    got = {r.doc_id: r for r in G.predict(df, G.learn(df), carry=["lang_pred", "h"]).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {1: "xa", 2: "xb"} and got[1].carried.h == "y"


def test_ngrams_are_those_of_the_text():
    assert G.symbols("A1b").tolist() == G.symbols(" a ?! B ").tolist()
    s = G.symbols("abc abd")
    want = {tuple(s[i : i + n].tolist()) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    assert len(G.presence("abc abd", 3)) == len(want)


def test_odd_inputs(spark):
    rows = [(None, None, None, 1), (1, "", "xa", 1), (2, "123 ...", "xa", 1), (3, "blogra", "xa", 1), (3, "blogra", "xa", 1), (4, "𝒳 𐍈", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = G.predict(df, G.learn(df), carry=["lang", "score"]).collect()
    assert len(got) == 6 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (None, 1, 2))
    assert {r.lang_pred for r in got if r.doc_id == 3} == {"xa"} and all(r.carried.score == 1 for r in got)
    empty = df.limit(0)
    assert G.learn(empty) is None and G.predict(empty, None).count() == 0
    assert {r.lang_pred for r in G.predict(df, None).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    """Superscripts, fractions and Roman numerals are of the categories No and Nl: no letters."""
    rows = made(60) + [(900, "½ ² 12 Ⅷ ①", None), (901, "_ 3", None), (902, "ª", None)]
    df = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in G.predict(df, G.learn(df, per_class=20, landmarks=6)).collect()}
    assert got[900] == got[901] == "und" and got[902] != "und"
