import hashlib
import random
import zlib

from quarry.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (i, source, lang, n, text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in g]) for x, g in groups.items()}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(groups[x]):
            path = way(trees[x], at) + way(top, k)
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            d = leaf(r, struck)
            for a, z in path:
                d = sha("".join(a) + d + "".join(z))
            proof = sha("".join("".join(a) + "".join(z) for a, z in path))
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", leaf int, root string")
    return sorted([tuple(r) for r in M.manifest(df).collect()], key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    # One class holds most rows (two bands), others one, seven, eight and nine; more classes than a home of the top tree has.
    rows = [(i, rng.choice(["Ab", "", None, "ÄÖ z", "x" * 9]), "en", rng.choice([None, "s"]), rng.choice([None, i])) for i in range(700)]
    for k, n in enumerate([1, 7, 8, 9, 64, 65]):
        rows += [(10_000 * (k + 1) + i, f"Text {i}", [None, "", "Z", "é", "zz", "😀"][k], "src", 3) for i in range(n)]
    rows += [(90_000 + i, "T", f"l{i:04d}", None, 1) for i in range(520)]
    rows += [(None, "N", "en", None, None), (None, "N", "en", None, None), (5, "again", "en", "s", 5), (6, "Q" * 100_000, None, None, None)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(not r[6] for r in got) and len({r[3] for r in got}) == 1


def test_one_class_and_one_row(spark):
    for n in (1, 2, 8, 9, 512, 513):
        rows = [(i, "Aa", "en", "s", 2) for i in range(n)]
        assert run(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.manifest(df).collect() == [] and M.manifest(df).columns == [c.split()[0] for c in M.SCHEMA.split(", ")]


def test_places_across_partitions():
    parts = [[("a",)] * 3, [], [("a",)] * 2, [("a",), ("b",), ("c",)], [("c",)], [("d",)]]
    edges = [e for p, rows in enumerate(parts) for e in M._edges(p, iter(rows))]
    at, classes, most = M._starts(edges)
    assert classes == 4 and most == 6
    placed = [x for p, rows in enumerate(parts) for x in M._placed(p, iter([(*r, 0, "l", None) for r in rows]), at)]
    assert [(k[0], m[0], m[2], m[3][2]) for k, m in placed] == [
        *[(0, i, i == 5, False) for i in range(6)], (1, 0, True, False), (2, 0, False, False), (2, 1, True, False), (3, 0, True, True),
    ]


def test_lost_child_raises():
    import pytest

    with pytest.raises(RuntimeError):
        list(M._gathered(iter([((0, 0), (0, "d", False, None)), ((0, 0), (2, "d", True, None))])))
