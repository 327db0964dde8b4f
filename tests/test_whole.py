"""Queries that once took a part of their tables take all."""

import numpy as np

from tests_common import DATA
from loomgraph.operators import tensor
from loomgraph.plans import registry


def test_cluster_pairs_take_every_vector(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    rows = registry.QUERIES["rel_03_cluster_pairs"](spark, DATA).collect()
    member = [r for r in rows if r["layer"] == "member"]
    first = {r["a"] for r in member}
    assert len(member) == len(ids) and {r["b"] for r in member} == ids and all((x, x) in {(r["a"], r["b"]) for r in member} for x in first)
    assert {(r["a"], r["b"]) for r in rows if r["layer"] == "inter"} == {(x, y) for x in first for y in first if x < y} and len(first) == 6


def test_ridge_takes_every_concept(spark):
    rng = np.random.default_rng(1)
    m = np.where(rng.random((700, 300)) < 0.01, rng.random((700, 300)) * 9, 0)
    cells = spark.createDataFrame([(f"c{i}", f"k{j}", float(m[i, j])) for i, j in np.argwhere(m > 0).tolist()], "concept string, chunk_id string, w double")
    used = [i for i in range(700) if m[i].any()]
    seeds = [(q, f"c{i}", float(q + 1)) for q in range(3) for i in used[q::150]]
    got = tensor.ridge_weights(spark.createDataFrame(seeds, "qid long, concept string, weight double"), cells, 1.0).collect()
    want = np.linalg.solve(m @ m.T + np.eye(700), np.stack([sum(w * np.eye(700)[int(c[1:])] for k, c, w in seeds if k == q) for q in range(3)]).T)
    x = np.zeros((700, 3))
    for r in got:
        x[int(r["concept"][1:]), r["qid"]] = r["weight"]
    assert len(used) > 600 and np.abs(x - want).max() < 1e-8


def _chain(spark, n):
    """Relations of a ring of n nodes, 1 and 2 steps apart."""
    return spark.createDataFrame([(f"n{i:03}", "near" if s == 1 else "far", f"n{(i + d) % n:03}", 1.0 / s) for i in range(n) for s in (1, 2) for d in (s, -s)], "a string, bucket string, b string, v double")


def dense_factors(x, rank, ridge, sweeps):
    rng = np.random.default_rng(0)
    f = [rng.standard_normal((n, rank)) * 0.1 for n in x.shape]
    for _ in range(sweeps):
        for m, spec in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
            a, b = (f[k] for k in range(3) if k != m)
            f[m] = np.linalg.solve((a.T @ a) * (b.T @ b) + ridge * np.eye(rank), np.einsum(spec, x, a, b).T).T
            if m < 2:
                f[m] = f[m] / np.linalg.norm(f[m], axis=0)
    return f, float(((np.einsum("ir,jr,kr->ijk", *f) - x) ** 2).sum())


def test_factors_are_those_of_the_dense_tensor(spark):
    (at, v), names, buckets = tensor.sparse(_chain(spark, 70))
    x = np.zeros((70, 2, 70))
    x[tuple(at.T)] = v
    f, error = tensor.cp_factors((at, v), x.shape, 4, 0.1, sweeps=20, tol=0)
    g, want = dense_factors(x, 4, 0.1, 20)
    assert len(names) == 70 and abs(error - want) < 1e-8 and max(np.abs(a - b).max() for a, b in zip(f, g)) < 1e-6


def test_completion_takes_every_node(spark):
    coo = _chain(spark, 70)
    got = tensor.completion(coo, rank=6, ridge=0.1).collect()
    (at, v), names, buckets = tensor.sparse(coo)
    y = np.einsum("ir,jr,kr->ijk", *tensor.cp_factors((at, v), (70, 2, 70), 6, 0.1)[0]).max(1)
    y[at[:, 0], at[:, 2]] = 0
    np.fill_diagonal(y, 0)
    best = sorted(y[y > 0].tolist(), reverse=True)[: int(len(at) * 0.2)]
    assert np.allclose(sorted((r["prob"] for r in got), reverse=True), np.array(best) / best[0]) and len({x for r in got for x in (r["a"], r["b"])} & set(names[60:])) > 0


def test_empty_cells():
    at = np.array([[i, j, k] for i in range(9) for j in range(2) for k in range(9) if (i + j + k) % 3 == 0])
    for full, n in ((at, 40), (at, 500), (at[:3], 10)):
        got = tensor.empty_cells(full, (9, 2, 9), n, np.random.default_rng(0))
        assert len({*map(tuple, got)}) == len(got) == min(n, 162 - len(full)) and not {*map(tuple, got)} & {*map(tuple, full)}


def test_whole_graph_queries(spark):
    got = {n: registry.QUERIES[n](spark, DATA).collect() for n in ("ret_09_page_rank", "rel_02_pairs", "rel_04_pair_context", "con_05_layer_overlap")}
    assert len({r["qid"] for r in got["ret_09_page_rank"]}) == 40
    assert sorted((r["a"], r["b"]) for r in got["rel_04_pair_context"]) == sorted((r["a"], r["b"]) for r in got["rel_02_pairs"])
    assert len({r["first"] for r in got["con_05_layer_overlap"]}) > 100 and all(r["both"] + r["only_first"] + r["only_second"] > 0 for r in got["con_05_layer_overlap"])
