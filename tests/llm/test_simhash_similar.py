import random

import numpy as np
from test_minhash_dedup import SCHEMA, brute, edited

import corpus_pipeline as P
from quarry.llm import simhash_similar as S


def groups(rng):
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.choice([6, 30, 120, 400]))]
        rows += [(100 * g + k, edited(rng, base, min(len(base), rng.choice([0, 1, 1, 2, 3, len(base) // 40, len(base) // 20])))) for k in range(6)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two  WORDS"), (9005, "x " * 30_000)]


def test_the_stage_is_simhash_and_equals_brute_force(spark, sf, monkeypatch):
    """The pipeline's stage takes its candidates from SimHash; its rows are those of all pairs compared."""
    made = []
    held = S.bucketed
    monkeypatch.setattr(S, "bucketed", lambda marked: made.append(marked.columns) or held(marked))
    rows = groups(random.Random(3))
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA).repartition(3)
    got = P.dedup_near(spark, df, sf)
    assert made and sorted(r.doc_id for r in got.collect()) == sorted(set(brute(rows).values()))


def test_neighbour_rounds_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, base, rng.choice([2, 4, 6]))) for k in range(60)]
    monkeypatch.setattr(S, "PAIRS_A_MEMBER", 0)
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == brute(rows)


def test_missed_pairs_are_as_rare_as_stated():
    """Of pairs at a similarity of 0.8, nearly all have a near block and near fingerprints; sizes from a few shingles on."""
    rng, missed = np.random.default_rng(6), 0
    for _ in range(1000):
        n = int(rng.choice([8, 40, 200]))
        x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        a, b = x[: n + n // 8], np.concatenate([x[:n], x[n + n // 8 :]])  # n shared of n + n / 4
        far = [int(v).bit_count() for v in S.blocks(a) ^ S.blocks(b)]
        missed += min(far) > 2 or sum(far) > S.MOST_BITS
    assert missed <= 5


def test_sets_with_company_are_looked_up():
    rng = np.random.default_rng(7)
    for n in [1, 2, 3, 4, 5, 9, 10, 37, 200]:
        for m in {n, max(1, n - n // 5), n + n // 5}:
            shared = next((o for o in range(min(n, m) + 1) if o >= 0.8 * (n + m - o)), None)
            if shared is None:
                continue
            x = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:shared], x[n:]]))
            (p, need), (q, need_b) = S.looked_up(n, 0.8), S.looked_up(m, 0.8)
            assert len(np.intersect1d(a[:p], b[:q])) >= max(need, need_b)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (1, ""), (7, "A b c d e f"), (7, "other words")]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], SCHEMA)
    extra = df.withColumns({c: df.text for c in ("tie", "least", "need", "blocks", "root")})
    assert sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(extra).collect()), key=str) == sorted([(None, 7), (None, 1), (1, 1), (7, 7), (7, 7)], key=str)
    assert S.near_duplicates(extra.limit(0)).count() == 0


def test_rows_of_buckets_are_joined_for_pairs_only(spark, monkeypatch):
    """A text may have 600 rows in buckets; no join has them as its result, so it is that of pairs at most."""
    rng, plans = random.Random(5), []
    base = [f"w{k}" for k in range(200)]
    df = spark.createDataFrame([(k, edited(rng, base, 3), None, None, None) for k in range(40)], SCHEMA)
    held = S.checkpointed
    monkeypatch.setattr(S, "checkpointed", lambda made: plans.append((made.columns, made._jdf.queryExecution().optimizedPlan().toString())) or held(made))
    S.near_duplicates(df).collect()
    joined = [(c, p) for c, p in plans if "key" in c and "Join" in p]
    assert joined == [] and any(c == ["a", "b"] and "Join Inner" in p for c, p in plans)
