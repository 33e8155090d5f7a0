import numpy as np

from quarry.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, u int"


def run(spark, rows):
    got = E.near_duplicates(spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def brute(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        a = np.array(v, np.float32).astype(float) if ok else None
        unit.append(a / np.abs(a).max() if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted([(i, n[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)], key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "PART_ROWS", 64)  # the hot group is cut into parts
    monkeypatch.setattr(E, "LIST_ROWS", 40)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=13).tolist(), int(rng.integers(3))) for i in range(150)]
    centre = rng.normal(size=13)
    rows += [(1000 + k, (centre + rng.normal(size=13) * 0.17).tolist(), 1) for k in range(250)]  # on the border of 0.98
    rows += [(2000 + k, rows[k % 7][1], rows[k % 7][2]) for k in range(60)]
    rows += [(3000 + k, (3.0 * np.array(rows[k][1]) + rng.normal(size=13) * 0.2).tolist(), rows[k][2]) for k in range(80)]
    rows += [(None, rows[4][1], rows[4][2]), (5, rows[9][1], rows[9][2]), (None, [9.0] + [0.0] * 12, 2), (4000, rows[4][1], 77), (4001, rows[4][1], None)]
    rows += [(4002, None, 1), (4003, [0.0] * 13, 1), (4004, [], 1), (4005, [1.0, None] * 6 + [1.0], 1), (4006, [float("nan")] * 13, 1), (4007, [float("inf")] * 13, 1), (4008, [1.0, 2.0], 1), (4009, [1.0, 2.01], 1), (4010, [1e38] * 13, 2), (4011, [1e-30] * 13, 2)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 4000


def test_edge_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (None, [1.0], None)]) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)
    assert run(spark, [(3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1)]) == sorted([(3, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True)], key=str)


def test_planes_between_lists_lose_no_pair():
    rng = np.random.default_rng(7)
    c = rng.normal(size=(20, 6))
    x = E.unit(rng.normal(size=(4000, 6)))
    y = E.unit(x + rng.normal(size=x.shape) * 0.08)
    apart = np.sqrt(2 - 2 * 0.98)
    (hx, px), (hy, py) = E.probes(x, c, apart), E.probes(y, c, apart)
    near = (x * y).sum(axis=1) >= 0.98
    assert near.sum() > 1000 and (hx[near] != hy[near]).sum() > 50
    assert all(hx[k] == hy[k] or hy[k] in px[k] or hx[k] in py[k] for k in np.flatnonzero(near))


def test_codes_bound_products():
    rng = np.random.default_rng(8)
    x = E.unit(rng.normal(size=(300, 10)) + 2)
    centroid, books = x.mean(axis=0), rng.normal(size=(8, 5, 2)) * 0.1
    rest = E._padded(x - centroid).reshape(300, 8, 2)
    code = np.stack([E.clustering.nearest(rest[:, j], books[j])[0] for j in range(8)], axis=1)
    left = np.sqrt(((rest - np.stack([books[j][code[:, j]] for j in range(8)], axis=1)) ** 2).sum(axis=(1, 2)))
    got = {(int(a), int(b)) for i, k in E.linked_pairs(x, x, code, left, centroid, books, 0.95, True) for a, b in zip(i, k)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 0.95} and got
