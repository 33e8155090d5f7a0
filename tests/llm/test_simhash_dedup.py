import random

import pytest
import xxhash

from quarry.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fp int, component_id string"


def plain_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    words = [w for w in (text or "").encode().translate(S.LOWER).split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fp = [plain_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted([(i, fp[k] - (1 << 64) if fp[k] >> 63 else fp[k], least.get(find(k))) for k, (i, _) in enumerate(rows)], key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("Aa b C d é fg".split(" ")) + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 5, 200, 700]))) for _ in range(40)]
    for _ in range(60):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x"
        texts.append("\t".join(w).upper() if rng.random() < 0.5 else " ".join(w))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, None), (5, ""), (3, " \n"), (None, texts[3]), (None, "alone here now"), (990, texts[10])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = sorted([tuple(r)[:3] for r in S.near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_ball_covers_radius():
    assert len(S.ball(1)) == 65 and len(set(S.ball(1))) == 65


@pytest.mark.parametrize("most", [1, 500_000])
def test_components_of_a_long_chain(spark, monkeypatch, most):
    """With forests of an edge each, and of all edges of a task."""
    from quarry.llm import common
    from quarry.llm.common import components

    monkeypatch.setattr(common, "EDGES_AT_ONCE", most)
    rng = random.Random(most)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)]
    plain = {n: n for p in pairs for n in p}
    for _ in plain:
        for a, b in pairs:
            plain[a] = plain[b] = min(plain[a], plain[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {n: r for n, r in plain.items() if n != r}
    assert components(df.limit(0)).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_root_and_long_texts(spark):
    """Very many copies, one very long text, and columns named like the operator's own."""
    rows = [(i, "the same text here again") for i in range(3000)] + [(9000, "w1 w2 w3 w4 " * 50_000), (9001, "w1 w2 w3 w4 " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).withColumns({c: S.F.lit("z") for c in ("root", "node", "tie", "least_id", "u", "v")})
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert got == {i: 0 for i in range(3000)} | {9000: 9000, 9001: 9000}
