import re

import numpy as np
import pytest

from quarry.operators import vector_index as V


def corpus(spark, n=600, d=16, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dup:
        x[5] = x[6] = x[7]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vector_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, n, 50)] + [(9999, x[6].tolist())], "query_id long, embedding array<float>")
    return x, df, q


def plain(x, q, k):
    s = np.round(x.astype(float) @ x[q].astype(float), 9)
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vector_id)
    return out


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_flat_is_exact_with_ties(spark, k):
    x, df, q = corpus(spark)
    got = hits(V.flat_search(df, q, k))
    for i in range(0, 600, 50):
        assert got[i] == plain(x, i, min(k, 600))
    assert got[9999][:3] == [5, 6, 7][: min(k, 3)]


def test_full_probe_equals_flat(spark):
    x, df, q = corpus(spark)
    index = V.train_ivf(df, nlist=8, train_size=500)
    table = V.build_ivf(df, index)
    assert hits(V.ivf_search(table, index, q, 10, nprobe=8)) == hits(V.flat_search(df, q, 10))
    few = V.recall(V.ivf_search(table, index, q, 10, nprobe=2), V.flat_search(df, q, 10)).first()
    most = V.recall(V.ivf_search(table, index, q, 10, nprobe=7), V.flat_search(df, q, 10)).first()
    assert few.mean_recall < most.mean_recall and most.mean_recall >= 0.9
    limited = hits(V.ivf_search(table, index, q, 600, nprobe=8, max_codes=1))
    assert all(len(v) < 600 for v in limited.values())


def test_pq_and_graph_recall(spark):
    x, df, q = corpus(spark)
    exact = V.flat_search(df, q, 10)
    index = V.train_ivf(df, nlist=4, m=8, nbits=6, train_size=600)
    table = V.build_ivf(df, index)
    assert table.columns == ["vector_id", "cell", "codes"]
    assert V.recall(V.ivf_search(table, index, q, 30, nprobe=4), exact).first().mean_recall >= 0.9
    assert V.recall(V.hnsw_search(df, q, 10, m=16, ef_construction=100), exact).first().mean_recall >= 0.9


def test_codes_by_tables_and_rescoring(spark):
    x, df, q = corpus(spark)
    exact = V.flat_search(df, q, 10)
    index = V.train_ivf(df, nlist=4, m=8, nbits=6, train_size=600)
    codes = index.encode(x[:50].astype(float), np.zeros(50, int))
    few, many = x[100:105].astype(float), x[100:140].astype(float)
    plain = index.decode(codes, np.zeros(50, int))
    assert np.allclose(index.scores(codes, 0, few), plain @ few.T) and np.allclose(index.scores(codes, 0, many), plain @ many.T)
    found = V.rescored(V.ivf_search(V.build_ivf(df, index), index, q, 30, nprobe=4), df, q, 10)
    assert V.recall(found, exact).first().mean_recall >= 0.9
    scores = {(r.query_id, r.vector_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.vector_id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.vector_id) in scores)


def test_probes_prune_files(spark, tmp_path):
    """An index written by cell is read only in the cells that are probed."""
    x, df, q = corpus(spark)
    index = V.train_ivf(df, nlist=8, train_size=500)
    V.build_ivf(df, index).write.partitionBy("cell").parquet(str(tmp_path / "ivf"))
    stored = spark.read.parquet(str(tmp_path / "ivf"))
    one = q.where("query_id = 50")
    found = V.ivf_search(stored, index, one, 10, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert hits(found) == hits(V.ivf_search(V.build_ivf(df, index), index, one, 10, nprobe=2))


def test_stored_graphs(spark, tmp_path):
    x, df, q = corpus(spark)
    V.build_graphs(df, m=8, ef_construction=60, shard=100).write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.count() >= 6
    exact = V.flat_search(df, q, 10)
    assert V.recall(V.graph_search(stored, q, 10, 40), exact).first().mean_recall >= 0.9
    tiny = V.build_graphs(df.where("vector_id < 3"), m=2, ef_construction=2)
    assert hits(V.graph_search(tiny, q.where("query_id = 0"), 5))[0] == hits(V.flat_search(df.where("vector_id < 3"), q.where("query_id = 0"), 5))[0]
    assert V.graph_search(V.build_graphs(df.limit(0)), q, 5).count() == 0


def test_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "BLOCKS_A_PLAN", 3)
    x, df, q = corpus(spark)
    got = hits(V.flat_search(df, q, 4))
    assert len(got) == 13 and all(got[i] == plain(x, i, 4) for i in range(0, 600, 50))


@pytest.mark.parametrize("kind,build,search", [("x", {}, {}), ("flat_ip", {}, {"nprobe": 1}), ("ivf_flat", {"nlist": 4}, {"nprobe": 5}), ("ivf_pq", {"nbits": 17}, {}), ("hnsw", {"m": 0}, {}), ("ivf_pq", {"m": 7}, {}), ("hnsw", {}, {"ef_search": True})])
def test_parameters_are_checked(kind, build, search):
    with pytest.raises(ValueError):
        V.check_params(kind, build, search, 16)


def test_training_needs_rows(spark):
    _, df, _ = corpus(spark, 20, dup=False)
    with pytest.raises(ValueError):
        V.train_ivf(df, nlist=21)
    with pytest.raises(ValueError):
        V.train_ivf(df, nlist=2, m=4, nbits=8)


def test_id_violations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "vector_id long")
    b = spark.createDataFrame([(2,), (3,)], "vector_id long")
    assert {r.vector_id for r in V.id_violations(a, b).collect()} == {1, 2}


def clustered(spark, n=1200, centres=12, dim=16):
    rng = np.random.default_rng(11)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] * 2 + rng.normal(size=(n, dim)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vector_id long, embedding array<float>")


def test_routed_graphs_visit_few_shards(spark):
    df = clustered(spark)
    q = df.where("vector_id % 40 = 0").withColumnRenamed("vector_id", "query_id")
    router = V.train_router(df, 16, train_size=600)
    graphs = V.build_routed(df, router, m=8, ef_construction=60, shard=64).cache()
    assert graphs.count() > 16 and graphs.select("cell").distinct().count() <= 16
    found = V.routed_search(graphs, router, q, 10, 40, visits=4)
    assert found.groupBy("query_id", "vector_id").count().where("count > 1").count() == 0
    assert V.recall(found, V.flat_search(df, q, 10)).first().mean_recall >= 0.9
    seen = V.visited_shards(router, q, 4).groupBy("query_id").count().collect()
    assert len(seen) == 30 and {r["count"] for r in seen} == {4}


def test_few_cells_of_clusters_have_what_is_near(spark):
    df = clustered(spark)
    q = df.where("vector_id % 40 = 0").withColumnRenamed("vector_id", "query_id")
    index = V.train_ivf(df, nlist=16, train_size=800)
    assert V.recall(V.ivf_search(V.build_ivf(df, index), index, q, 10, nprobe=3), V.flat_search(df, q, 10)).first().mean_recall >= 0.95


def test_training_sample_is_numpys_draw(spark):
    df = spark.range(10, 2010).selectExpr("id * 3 as vector_id", "array(1f, 2f) as embedding").repartition(7)
    got = sorted(r.vector_id for r in V.training_sample(df, 300, 42).collect())
    drawn = np.sort(np.random.default_rng(42).choice(2000, size=300, replace=False))
    assert got == [int(30 + 3 * p) for p in drawn]
    assert V.training_sample(df, 5000, 1).count() == 2000


def test_wrong_lengths_raise_by_id(spark):
    bad = spark.createDataFrame([(1, [1.0, 0.0, 5.0]), (2, [7.0])], "vector_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="vector 1 is not one of 2"):
        V.flat_search(bad, q, 1).collect()
    null = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vector_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="vector 2 is not one of 2"):
        V.flat_search(null, q, 1).collect()


def test_kmeans_on_executors(spark):
    """Well-parted clusters are found, however the rows are dealt; the seeding leaves none out."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 5)) * 20
    x = centres[np.arange(800) % 8] + rng.normal(size=(800, 5)) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vector_id long, embedding array<double>")
    for parts in (1, 5):
        c = V.clustering.fit(df.repartition(parts), 8, 10, 3)[0]
        assert max(np.linalg.norm(c - m, axis=1).min() for m in centres) < 0.1
    two = V.clustering.fit(df, 4, 3, view=lambda m: m[:, :4].reshape(len(m), 2, 2))
    assert two.shape == (2, 4, 2) and np.isfinite(two).all()


def test_visits_are_the_hits_of_a_search_for_all(spark):
    x, df, q = corpus(spark)
    index = V.train_ivf(df, nlist=8, train_size=500)
    table = V.build_ivf(df, index)
    for nprobe, most in ((8, 601), (8, 1), (3, 0), (5, 150)):
        found = V.ivf_search(table, index, q, 10_000, nprobe=nprobe, max_codes=most).groupBy("query_id").count()
        assert sorted(map(tuple, V.ivf_visits(table, index, q, nprobe, most).collect())) == sorted(map(tuple, found.collect()))
