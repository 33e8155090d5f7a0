import hashlib
import random

import numpy as np
import pytest

from quarry.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, bucket string, block int"


def brute(rows, window):
    order = sorted(range(len(rows)), key=lambda k: (S.NULL_ID if rows[k][0] is None else rows[k][0], S.xxhash.xxh64_intdigest((rows[k][1] or "").encode()) >> 1))
    seen, out = set(), []
    for k in order:
        i, t = rows[k]
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n, vocabulary):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 19, 20, 21, 60, 300]))) for _ in range(n)]
    passage = " ".join(word() for _ in range(70))
    for _ in range(n):
        k = rng.randrange(4)
        base = rng.choice(texts).split()
        if k == 0:
            texts.append("\n".join(base))
        elif k == 1 and base:
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        elif k == 2:
            at = rng.randrange(len(base) + 1)
            texts.append(" ".join([*base[:at], passage, *base[at:]]))
        else:
            texts.append("a b " * rng.choice([5, 12, 40]) + "é x \t a")
    return texts


@pytest.mark.parametrize("hot,merged", [(2000, 4096), (3, 4096), (3, 2)])
def test_against_brute_force(spark, monkeypatch, hot, merged):
    monkeypatch.setattr(S, "MERGED_BLOCKS", merged)
    rng = random.Random(hot)
    rows = [(i, t) for i, t in enumerate(corpus(rng, 60, 500))]
    rng.shuffle(rows)
    rows += [(None, rows[3][1]), (None, None), (rows[5][0], rows[5][1]), (rows[6][0], "other " * 30), (10**6, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in S.remove_repeats(df, hot=hot, block_bytes=4000).collect()]
    assert sorted(got, key=str) == brute(rows, 20)


def test_rows_between_passes_grow_with_the_text(spark):
    """More blocks give no more rows: each distinct minimizer of a block is one row, whatever the buckets."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(80)]
    table = lambda part: S.pa.table({"doc_id": S.pa.array([r[0] for r in part], S.pa.int64()), "text": [r[1] for r in part]})
    run = S._minimizers(20, 8)
    counts = [sum(run([S.pa.scalar(k)], table(rows[k::n])).num_rows for k in range(n)) for n in (1, 8, 80)]
    assert max(counts) == min(counts)


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, "x " + long), (3, " ".join(long.split()[500:540]))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).withColumns({c: S.F.lit("z") for c in ("key", "mask", "words", "least", "row")})
    assert sorted(map(tuple, S.remove_repeats(df).collect())) == brute(rows, 20)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(200):
        automaton, fed = S.Automaton(), []
        for _ in range(4):
            text = [rng.randrange(3) for _ in range(rng.randrange(25))]
            stats = automaton.feed(text)
            for i in range(len(text)):
                best = 0
                for m in range(1, i + 2):
                    want = text[i + 1 - m : i + 1]
                    places = [x[a : a + m] for x in [*fed, text[:i]] for a in range(len(x) - m + 1)]
                    if want in places:
                        best = m
                assert stats[i] == best
            fed.append(text)


def test_masks_in_corpus_order():
    words = np.arange(1, 26, dtype=np.uint64)
    heads = np.zeros(2, S.SEGMENT)
    heads["key"], heads["id"], heads["n"] = 7, [9, 4], 25
    assert S.shard_masks(heads, np.concatenate([words, words]), 20).tolist() == [0b111111, 0]
