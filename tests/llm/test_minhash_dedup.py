import random

import corpus_pipeline as P
from quarry.llm import minhash_dedup as M
from quarry.llm import simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = set(M.shingles(a).tolist()), set(M.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """The smallest id of each row's group over all pairs."""
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if jaccard(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.choice([6, 30, 120, 400]))]
        rows += [(100 * g + k, edited(rng, base, min(len(base), rng.choice([0, 1, 1, 2, 3, len(base) // 40, len(base) // 20])))) for k in range(6)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two  WORDS"), (9005, "x " * 30_000)]
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 20
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()} == want


def test_neighbour_rounds_lose_nothing(spark, monkeypatch):
    """A group that has no all-pairs shortcut at first gives the same components."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, base, rng.choice([2, 4, 6]))) for k in range(60)]
    monkeypatch.setattr(M, "PAIRS_A_MEMBER", 0)
    monkeypatch.setattr(M, "NEIGHBOUR_ROUNDS", 2)
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()} == brute(rows)


def test_stage_drops_edited_copies(spark, sf):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    copy = edited(rng, base, 5)
    assert jaccard(" ".join(base), copy) >= 0.8
    far = simhash_dedup.simhash(" ".join(base)) ^ simhash_dedup.simhash(copy)
    assert far.bit_count() > 2
    rows = [(1, " ".join(base), "en", "s", 1), (2, copy, "en", "s", 1), (3, "another text of a few words", "en", "s", 1)]
    got = P.dedup_near(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
