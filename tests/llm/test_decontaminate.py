import random
import re
from collections import Counter

from quarry.llm import decontaminate as D

SCHEMA = "doc_id long, text string, items string, similarity int"


def tokens(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def shingles(w, n=5):
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def brute(rows, items):
    out = []
    for i, t in rows:
        w, found = tokens(t), {}
        for item, it in items:
            iw = tokens(it)
            if not iw or not w:
                continue
            want = shingles(iw)
            for s in range(max(1, len(w) - len(iw) + 1)):
                have = shingles(w[s : s + len(iw)])
                sim = sum((have & want).values()) / sum((have | want).values())
                if sim >= 0.8:
                    found[item] = max(sim, found.get(item, 0))
        out.append((i, bool(found), len(found), sorted(found), max(found.values(), default=None)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("the of and é ß".split(" ")) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 8, 30, 30, 31, 60, 200])]
    items += [(50, None), (51, ""), (52, items[3][1]), (None, "lone item text of some seven words"), (60, "again and again " * 12), (61, "x " * 60)]
    rows = [(0, None), (1, ""), (2, "..."), (None, "x " + items[4][1] + " y"), (3, "short one"), (4, items[0][1])]
    for k in range(60):
        w = [word() for _ in range(rng.choice([2, 40, 300]))]
        if k % 3:
            p = (rng.choice(items[:9])[1] or "q").split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                p[rng.randrange(len(p))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        t = " ".join(w)
        rows.append((10 + k, t.upper() if k % 7 == 0 else t.replace(" ", ",\n", 9)))
    rows += [rows[20], (rows[20][0], "the same id")]
    # An item's halves the other way round, its parts in any order, a shingle over and over, and items beside each other.
    a, b = items[7][1].split()[:100], items[7][1].split()[100:]
    rows += [(80, " ".join(["x", *b, *a, "y"])), (81, " ".join([*a[50:], *a[:50], *b])), (82, " ".join(["x"] * 40 + items[3][1].split() + ["x"] * 400))]
    rows += [(83, " ".join([items[3][1], items[4][1], items[3][1]])), (84, " ".join(items[3][1].split()[:27] + ["x"] * 30 + items[3][1].split()[-3:]))]
    long = [word() for _ in range(6000)]
    rows.append((85, " ".join(long[:2000] + b + a + long[2000:])))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    named = [x for x in items if x[0] is not None]
    got = [tuple(r) for r in D.contaminated(df, bench.where("item_id is not null")).collect()]
    want = brute(rows, named)
    assert [r[:4] for r in sorted(got, key=str)] == [r[:4] for r in want]
    assert all(a[4] is None and b[4] is None or abs(a[4] - b[4]) < 1e-12 for a, b in zip(sorted(got, key=str), want))
    kept = D.clean(df, bench.where("item_id is not null"))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in want if not r[1])
    assert kept.columns == df.columns
    D.contaminated(df, bench).count()


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(df, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f", "", 1)], SCHEMA)
    assert [r.contaminated for r in D.contaminated(one, bench).collect()] == [False]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    plan = D.contaminated(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_find_the_radius():
    assert all(sum(cut) == D.BITS for cut in [D.CUTS])
    assert D.MOST_RADIUS // (D.HASHES * len(D.CUTS)) == D.BLOCK_RADIUS


def test_fingerprint(spark):
    """Bits are those of a plain majority, and the distance follows the similarity."""
    rng = random.Random(3)
    sets = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 9, 60)] + [[]]
    sets += [sets[3][:54] + [rng.randrange(1 << 63) for _ in range(6)]]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, features array<long>")
    rows = {r.k: r for r in D.fingerprinted(df).collect()}
    hashes = spark.createDataFrame([(k, j, x) for k, s in enumerate(sets) for x in s for j in range(D.HASHES)], "k int, j int, x long").selectExpr("k", "j", "xxhash64(j, x) as h").collect()
    for k, s in enumerate(sets):
        for j in range(D.HASHES):
            mine = [r.h % (1 << 64) for r in hashes if (r.k, r.j) == (k, j)]
            assert rows[k][f"fp{j}"] == sum(1 << b for b in range(D.BITS) if 2 * sum(h >> b & 1 for h in mine) > len(s))
    apart = sum((rows[3][f"fp{j}"] ^ rows[5][f"fp{j}"]).bit_count() for j in range(D.HASHES))
    assert 20 < apart < 74


def test_an_item_in_another_order_is_found(spark):
    """Two halves of 50 words, exchanged: a window of the item's size still has a similarity of 0.92."""
    first, second = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    df = spark.createDataFrame([(1, " ".join(["x", "y", *second, *first, "z"])), (2, " ".join(first))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(first + second))], "item_id long, text string")
    got = {r.doc_id: r for r in D.contaminated(df, bench).collect()}
    assert got[1].items == [7] and abs(got[1].best_similarity - 92 / 100) < 1e-9 and not got[2].contaminated
