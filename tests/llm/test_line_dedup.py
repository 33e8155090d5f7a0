import random

import pytest

from quarry.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, spans int"


def brute(rows, t, tie):
    order = sorted(set(range(len(rows))), key=lambda k: (L.NULL_ID if rows[k][0] is None else rows[k][0], tie[rows[k][1]]))
    first, out = {}, []
    for k in order:
        i, text = rows[k]
        lines = [] if text is None else text.split("\n")
        key = (L.NULL_ID if i is None else i, tie[text])
        for a in range(len(lines) - t + 1):
            w = tuple(lines[a : a + t])
            first[w] = min(first.get(w, (key, a)), (key, a))
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        key = (L.NULL_ID if i is None else i, tie[text])
        gone = set()
        for a in range(len(lines) - t + 1):
            if first[tuple(lines[a : a + t])] < (key, a):
                gone |= set(range(a, a + t))
        out.append((i, None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_against_brute_force(spark, t):
    from pyspark.sql import functions as F

    rng = random.Random(t)
    line = lambda: rng.choice(["", "a", "b", "é", *[f"line {k}" for k in range(40)]])
    rows = [(i, "\n".join(line() for _ in range(rng.choice([1, 2, 3, 5, 9, 40])))) for i in range(60)]
    rows += [(100 + i, rng.choice(rows)[1] + rng.choice(["", "\nmore", "\na\nb"])) for i in range(40)]
    rows += [(None, None), (None, rows[0][1]), (5, rows[7][1]), rows[9], (300, ""), (301, "a\n" * 30), (302, "\n")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, x, "en", 1) for i, x in rows], SCHEMA).repartition(3)
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = L.remove_runs(df, run_lines=t, carry=["lang", "spans"]).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows, t, tie)
    assert all(r.carried == ("en", 1) for r in got)


def test_empty_table(spark):
    assert L.remove_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.remove_runs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_lines_without_repeated_neighbours(spark):
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"a\n{long}\nb"), (2, long), (3, f"c\n{long}\nd\n{long}\nb\nx\nb\nx"), (4, short), (5, short), (6, "x\ny"), (7, f"b\nx\n{long}\nz"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_removed) for r in L.remove_runs(df, long_words=50).collect()}
    # long, b is a run of two lines of the first text; b, x of the third.
    assert got == {1: (rows[0][1], 0), 2: ("", 1), 3: ("c\nd\nx", 5), 4: (short, 0), 5: (short, 0), 6: ("x\ny", 0), 7: ("z", 3), 8: (None, 0), 9: ("", 0)}
    kept = {r.doc_id: r.n_removed for r in L.remove_runs(df).collect()}
    assert kept[2] == 0


@pytest.mark.parametrize("t", [2, 3])
def test_long_lines_against_brute_force(spark, t):
    """Lines of one and of four words; all long ones are runs of their own."""
    rng = random.Random(t)
    line = lambda: rng.choice([f"l{k}" for k in range(6)] + [f"w{k} x y z" for k in range(12)])
    rows = [(i, "\n".join(line() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))) for i in range(60)]
    rows = list({x: (i, x) for i, x in reversed(rows)}.values())
    first, want = set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for n in {t, 1}:
                w = tuple(lines[a : a + n])
                if len(w) == n and (n > 1 or len(w[0].split()) >= 4):
                    gone |= set(range(a, a + n)) if w in first else set()
                    first.add(w)
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.text, r.n_removed) for r in L.remove_runs(df, run_lines=t, long_words=4).collect()} == want
