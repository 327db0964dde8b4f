"""Planted inputs and the properties that operators must keep on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cluster as K
from loomgraph.operators import corpus as O
from loomgraph.operators import graph as G
from loomgraph.operators import metrics as M
from loomgraph.operators import tensor as N
from loomgraph.operators import vectors as V


@pytest.fixture(scope="module")
def planted(spark):
    """Twelve chunks of four concepts, and one relation between the first and the last."""
    names = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"c{i}", names[(i + k) % 4], 1 + (i + k) % 3) for i in range(12) for k in range(1 + i % 2)]
    cc = spark.createDataFrame(rows, "chunk_id string, concept string, tf long")
    lens = spark.createDataFrame([(f"c{i}", 10 + i) for i in range(12)], "chunk_id string, dl long")
    n = O.totals(lens)
    idf = O.idf_of(cc, n)
    return cc, idf, O.weights(cc, idf, lens, n), spark.createDataFrame([("alpha", "delta", 0.9)], "a string, b string, prob double")


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_matrix_is_graph(spark, planted):
    cc, idf, m, rel = planted
    seed = spark.createDataFrame([(0, "c0", 1), (0, "c4", 2)], "qid int, id string, rk int")
    own = G.seed_concepts(seed, cc)
    flat = scores(G.propagate(own, m, seed))
    q = {r["concept"]: 1.0 for r in own.collect()}
    dense: dict = {}
    for r in m.collect():
        dense[r["chunk_id"]] = dense.get(r["chunk_id"], 0) + q.get(r["concept"], 0) * r["w"]
    want = {k: v for k, v in dense.items() if v > 0 and k not in ("c0", "c4")}
    assert flat.keys() == want.keys() and all(abs(flat[k] - want[k]) < 1e-9 for k in want)
    for hops in (1, 2):
        assert scores(G.propagate(G.relation_weights(own, G.both_ways(rel), 0.0, hops), m, seed)) == pytest.approx(flat)
    wide = scores(G.propagate(G.relation_weights(own, G.both_ways(rel), 0.7), m, seed))
    assert set(wide) > set(flat) or sum(wide.values()) > sum(flat.values())


def test_reversed_scores_disagree(spark):
    a = spark.createDataFrame([(0, f"c{i}", float(i)) for i in range(1, 20)], "qid int, id string, score double")
    b = a.withColumn("score", 20 - F.col("score"))
    assert M.kendall(a, a).first()["tau"] == pytest.approx(1)
    assert M.kendall(a, b).first()["tau"] == pytest.approx(-1)
    assert M.kendall(a, b.withColumn("score", F.lit(1.0))).first()["tau"] is None
    ra, rb = (x.withColumn("rk", F.expr("row_number() over (partition by qid order by score desc)")) for x in (a, b))
    assert M.overlap(ra, rb, 5).first()["overlap"] < 1


def test_auc_mirrors(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (0.2, 1)], "s double, y int")
    x = M.auc(rows, "s", "y").first()["auc"]
    y = M.auc(rows.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert x + y == pytest.approx(1)


@pytest.fixture(scope="module")
def two_groups(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(2, 64))
    rows = [(i, i // 10, (centre[i // 10] + 0.3 * rng.normal(size=64)).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def test_planted_clusters(spark, two_groups):
    pairs = V.similar_pairs(two_groups, -1.0).join(two_groups.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(two_groups.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    assert M.auc(pairs.withColumn("y", (F.col("la") == F.col("lb")).cast("int")), "score", "y").first()["auc"] >= 0.9
    found = K.labelled(two_groups, K.density_labels).join(two_groups.select(F.col("vec_id").alias("id"), "label"), "id")
    assert K.agreement(found.select(F.col("cluster").alias("x"), F.col("label").alias("y"))).first()["ari"] >= 0.5
    assert M.shuffle_test(two_groups, 40).first()["p_value"] < 0.05


def test_dispersion_is_pairwise(two_groups):
    u = np.array([r["embedding"] for r in two_groups.collect()])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T)[np.triu_indices(len(u), 1)]
    assert V.dispersion(two_groups).first()["dispersion"] == pytest.approx((1 - s).mean())


def test_page_rank_keeps_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    reset = spark.createDataFrame([(0, "a", 3.0), (0, "c", 1.0)], "qid int, node string, s double")
    p = {r["node"]: r["p"] for r in G.page_rank(edges, reset, 0.5, 40).collect()}
    assert sum(p.values()) == pytest.approx(1)
    t = np.array([[0, 1 / 3, 1], [1, 0, 0], [0, 2 / 3, 0]])
    s = np.array([0.75, 0, 0.25])
    want = np.linalg.solve(np.eye(3) - 0.5 * t, 0.5 * s)
    assert [p[k] for k in "abc"] == pytest.approx(want.tolist(), abs=1e-9)


def test_components_are_stable(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (7, 7)], "a int, b int")
    once = {r["node"]: r["root"] for r in G.components(edges).collect()}
    assert {once[i] for i in range(31)} == {0} and once[102] == once[100] == 100
    again = G.components(spark.createDataFrame(list(once.items()), "a int, b int"))
    assert {r["node"]: r["root"] for r in again.collect()} == {k: v for k, v in once.items()}


def test_interleave_ends_without_repeats(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "qid int, id string, rk int")
    b = spark.createDataFrame([(0, "y", 1), (0, "x", 2), (0, "z", 3)], "qid int, id string, rk int")
    assert [r["id"] for r in N.interleave(a, b).orderBy("rk").collect()] == ["x", "y", "z"]


def test_factors_recover_a_tensor():
    rng = np.random.default_rng(0)
    f = [rng.random((n, 2)) for n in (8, 3, 8)]
    x = np.einsum("ir,jr,kr->ijk", *f)
    at = np.argwhere(np.ones(x.shape, bool))
    _, error = N.cp_factors((at, x.ravel()), x.shape, 2, ridge=1e-6, sweeps=400)
    assert error < 1e-3 * (x**2).sum()


def test_procrustes_recovers_a_rotation(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    df = spark.createDataFrame([(x.tolist(), (x @ q).tolist()) for x in a], "a array<double>, b array<double>")
    assert np.allclose(N.procrustes_of(df, "a", "b"), q)
    assert np.allclose(N.procrustes(a, a @ q), q)


def test_whitening_decorrelates():
    x = np.random.default_rng(2).normal(size=(200, 6)) @ np.random.default_rng(3).normal(size=(6, 6))
    assert np.allclose(np.cov(K.whitened(x, ridge=1e-9).T), np.eye(6), atol=0.01)


def test_knn_blocks_agree(two_groups):
    one, many = (V.knn(two_groups, two_groups, 3, block=b).orderBy("qid", "rk").collect() for b in (1000, 7))
    assert one == many


def test_fallbacks(spark):
    from loomgraph.operators import readout as D

    s = "chunk_id string, word string, score double"
    strict = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 1.0)], s)
    relaxed = spark.createDataFrame([("a", "z", 9.0), ("b", "x", 1.0), ("b", "w", 0.1)], s)
    single = spark.createDataFrame([("b", "v", 1.0), ("c", "u", 1.0)], s)
    got = {(r["chunk_id"], r["word"]): r["tier"] for r in D.with_fallbacks(strict, relaxed, single).collect()}
    assert got == {("a", "x"): 0, ("a", "y"): 0, ("b", "x"): 0, ("b", "w"): 1, ("c", "u"): 2}


def test_readout_pieces(spark):
    from loomgraph.operators import readout as D

    tree = spark.createDataFrame([("0", None), ("1", "0"), ("2", "0"), ("3", "1")], "node string, parent string")
    assert D.tree_report(tree).first().asDict() == {"nodes": 4, "depth": 2, "leaves": 2}
    assert D.outline('class A(B):\n    """Doc."""\n    def f(self, x=1): pass\n') == "class A(B): Doc.\n  function f(self, x=1)"
    v = spark.createDataFrame([([1.0, 1.0], [0.0, 1.0], [1.0, 0.0])], "b array<double>, d array<double>, t array<double>")
    assert D.best_shift(v, "b", "d", "t").first()["alpha"] == pytest.approx(1.0)
    assert D.prefix_offsets(v, "d", "t").first()["offset"] == pytest.approx(1.0)
    m = spark.createDataFrame([("c", [1.0, 3.0]), ("c", [3.0, 5.0])], "concept string, vector array<double>")
    assert D.mean_vectors(m).first()["vector"] == [2.0, 4.0]
    spans = spark.createDataFrame([("1", "a b"), ("1", "nasa"), ("1", "dog"), ("1", "zog")], "chunk_id string, span string")
    caps = spark.createDataFrame([("nasa", True, 0), ("dog", False, 1), ("zog", False, 1)], "span string, caps boolean, inner_caps int")
    words = spark.createDataFrame([("dog",)], "word string")
    assert {r["span"] for r in D.single_entities(spans, caps, words).collect()} == {"a b", "nasa", "zog"}
