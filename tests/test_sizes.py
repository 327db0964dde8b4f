"""Operators that meet their rows in blocks: any size of block gives the result of all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cluster as K
from loomgraph.operators import concepts as C
from loomgraph.operators import corpus as O
from loomgraph.operators import graph as G
from loomgraph.operators import metrics as M
from loomgraph.operators import ranking as R
from loomgraph.operators import spans as S
from loomgraph.operators import tensor as N
from loomgraph.operators import vectors as V
from loomgraph.session import stored


@pytest.fixture(scope="module")
def crowd(spark):
    """Three labels, in each two dense groups, noise, a copied vector; one label of a single row."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 16))
    x = [(int(i // 2), centre[i] + 0.2 * rng.normal(size=16)) for i in range(6) for _ in range(30)] + [(k % 3, rng.normal(size=16)) for k in range(40)]
    x += [x[0], x[0], (9, rng.normal(size=16))]
    rows = [(int(k), label, v.tolist()) for k, (label, v) in zip(rng.permutation(len(x)), x)]
    return sorted(rows), spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def _of(rows, label=None):
    return np.array([r[2] for r in rows if label is None or r[1] == label])


def test_density_clusters_in_blocks(crowd):
    rows, df = crowd
    want = K.density_labels(_of(rows))
    for block, tile in ((1000, 1000), (50, 16), (7, 3)):
        got = {r["id"]: r["cluster"] for r in K.density_clusters(df, block=block, tile=tile).collect()}
        assert [got[r[0]] for r in rows] == want.tolist() and len(got) == len(rows) and want.max() > 2
    got = {r["id"]: r["cluster"] for r in K.density_clusters(df, "label", min_samples=3, block=20, tile=8).collect()}
    for label in (0, 1, 2, 9):
        assert [got[r[0]] for r in rows if r[1] == label] == K.density_labels(_of(rows, label), min_samples=3).tolist()


def test_density_clusters_beyond_a_task(spark):
    """More rows than a task takes at once."""
    n = K.MOST + 500
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 4)) * 9
    x = np.round(centre[np.arange(n) % 4] + rng.normal(size=(n, 4)) * 0.01, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert K.density_clusters(df).count() == n
    assert {r["id"]: r["cluster"] for r in K.greedy_clusters(df, 0.9).collect()} == {i: i % 4 for i in range(n)}


def test_greedy_clusters_in_order(crowd):
    rows, df = crowd
    got = {r["id"]: r["cluster"] for r in K.greedy_clusters(df.repartition(5), 0.6).collect()}
    sums, counts, want = [], [], []
    for v in _of(rows):
        c = [s @ v / np.linalg.norm(s) / np.linalg.norm(v) for s in sums]
        best = int(np.argmax(c)) if c and max(c) > 0.6 else len(sums)
        if best == len(sums):
            sums.append(np.zeros(16))
            counts.append(0)
        sums[best], counts[best] = sums[best] + v, counts[best] + 1
        want.append(best)
    assert [got[r[0]] for r in rows] == want and 3 < max(want) < 100


def test_transforms_in_parts(crowd):
    rows, df = crowd
    for f, whole in ((lambda: K.residual_vectors(df, "label"), K.residuals), (lambda: K.whitened_vectors(df, "label", most=9, block=11), lambda x: K.whitened(x, most=9))):
        got = {r["id"]: r["vector"] for r in f().collect()}
        for label in (0, 1, 2, 9):
            own = [r for r in rows if r[1] == label]
            assert np.allclose([got[r[0]] for r in own], whole(_of(own)), atol=1e-7)


def test_tree_in_blocks(crowd):
    rows, df = crowd
    level, want = {"0": rows}, []
    for k in range(3):
        nxt = {}
        for node, own in level.items():
            x = _of(own) - (_of(own).mean(0) if k else 0)
            for r, v, c in zip(own, x, K.density_labels(x) if len(own) >= 5 else [-1] * len(own)):
                if c >= 0:
                    nxt.setdefault(f"{node}.{c}", []).append((r[0], r[1], v))
                    want.append((f"{node}.{c}", node, k, r[0]))
        level = nxt
    assert sorted(tuple(r) for r in K.concept_tree(df, block=40, tile=16).collect()) == sorted(want) and {w[2] for w in want} == {0, 1, 2}


@pytest.fixture(scope="module")
def space(spark):
    """More products of queries (ids divisible by 3) and rows than a tile has, many of them ties."""
    rng = np.random.default_rng(3)
    n = 2100
    v = rng.integers(-2, 3, (n, 6)).astype(float)
    v[:4] = 0
    label = np.arange(n) % 5
    df = spark.createDataFrame([(i, int(label[i]), v[i].tolist()) for i in rng.permutation(n).tolist()], "vec_id long, label int, embedding array<double>").repartition(3)
    u = K.unit(v)
    return df, df.filter("vec_id % 3 = 0"), np.round(u @ u.T, 6), label


def _best(s, k):
    """(column, score) of the k largest of a row, ties by column, without NaN."""
    return [(int(j), float(s[j])) for j in np.lexsort((np.arange(len(s)), -s)) if s[j] > -np.inf][:k]


def test_search_holds_few_candidates():
    rng = np.random.default_rng(1)
    s = np.round(rng.random((40, 300_000)), 3)
    found, most = V.Best(40, 5), 0
    for k in range(0, s.shape[1], 5000):
        found.add(s[:, k : k + 5000], np.arange(k, k + 5000))
        most = max(most, found.some)
    i, x, ids = found.cut()
    assert all(list(zip(ids[i == q].tolist(), x[i == q].tolist())) == _best(s[q], 5) for q in range(40))
    assert most <= 2 * 40 * 5 + V.TILE // 4


def test_searches_in_tiles(space):
    df, q, s, label = space
    assert q.count() * df.count() > V.TILE
    for k, block in ((7, 4096), (1, 64)):
        got = {}
        for r in V.knn(q, df, k, block=block).orderBy("qid", "rk").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["score"]))
        assert got == {i: _best(s[i], k) for i in range(0, len(s), 3)}
    rows = V.scores(q, df).collect()
    assert len(rows) == 700 * 2100 and all(s[r["qid"], r["id"]] == r["score"] for r in rows)
    m = {r["qid"]: r for r in V.score_moments(q, df).collect()}
    by = {(r["qid"], r["label"]): r["mean"] for r in V.score_moments(q, df, "label").collect()}
    for i in range(0, len(s), 3):
        assert abs(m[i]["mean"] - s[i].mean()) < 1e-9 and abs(m[i]["deviation"] - s[i].std()) < 1e-9
        assert all(abs(by[i, c] - s[i][label == c].mean()) < 1e-9 for c in range(5))
    fit, like = label[::3, None] == label[None, :], s[::3] >= 0.5
    want = {"TP": (fit & like).sum(), "HSS": (~fit & like).sum(), "LHS": (fit & ~like).sum(), "TN": (~fit & ~like).sum()}
    assert {r["cell"]: r["n"] for r in R.cells(q, df, 0.5).collect()} == want


def test_weighed_searches(spark, space):
    df, q, s, label = space
    w = np.array([[(i * 7 + c * 3) % 11 / 10 - 0.3 for c in range(5)] for i in range(len(s))])
    cs = spark.createDataFrame([(i, c, float(w[i, c])) for i in range(0, len(s), 3) for c in range(4)], "qid long, cluster int, score double")
    got = {}
    for r in R.cluster_records(cs, q, df, 9).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    for i in range(0, len(s), 3):
        p = w[i, label] * s[i]
        p = np.where((label < 4) & (p >= 0), np.round(np.sqrt(np.abs(p)), 6), -np.inf)
        assert got[i] == _best(p, 9)
    near = spark.createDataFrame([(i, c, float(c == i % 5)) for i in range(0, len(s), 3) for c in range(5)], "qid long, cluster int, score double")
    edges = spark.createDataFrame([(c, (c + d) % 5) for c in range(5) for d in (1, 2)], "src int, dst int")
    got = {}
    for r in R.dig(q, df, near, edges, 20, 30).orderBy("qid", "rk").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    for i in range(0, len(s), 3):
        first = [j for j, _ in _best(s[i], 20)]
        p = np.where(np.isin(label, [(i + 1) % 5, (i + 2) % 5]), np.round(0.8 * s[i], 6), -np.inf)
        p[first] = s[i][first]
        assert [j for j, _ in got[i]] == [j for j, _ in _best(p, 30)] and np.allclose([x for _, x in got[i]], [x for _, x in _best(p, 30)], atol=1e-9)


def test_distances_within_labels(space):
    df, _, s, label = space
    pairs = np.array([s[i, j] for c in range(5) for k, i in enumerate(np.flatnonzero(label == c)) for j in np.flatnonzero(label == c)[k + 1 :]])
    want = np.bincount(np.minimum(np.floor((1 - pairs) / 2 * 20), 19).astype(int), minlength=20)
    for block in (None, 100):
        assert {r["bin"]: r["n"] for r in V.distances_within(df, block=block).collect()} == {b: n for b, n in enumerate(want.tolist()) if n}


def test_ideal_gain_of_counted_grades(spark):
    """Queries with fewer and more relevant rows than ranks, grades with ties."""
    rng = np.random.default_rng(2)
    grades = {q: rng.integers(1, 4, n).tolist() for q, n in enumerate((1, 3, 10, 25))}
    qrels = spark.createDataFrame([(q, i, g) for q, gs in grades.items() for i, g in enumerate(gs)] + [(0, 99, 0)], "qid long, id long, grade long")
    results = spark.createDataFrame([(q, i, i + 1) for q in grades for i in range(0, 12)], "qid long, id long, rk int")
    gain = lambda gs: sum(g / np.log2(i + 2) for i, g in enumerate(gs[:10]))
    got = {r["qid"]: r for r in M.rank_metrics(results, qrels).collect()}
    for q, gs in grades.items():
        assert got[q]["ndcg"] == pytest.approx(gain(gs) / gain(sorted(gs, reverse=True))) and got[q]["recall"] == pytest.approx(min(len(gs), 10) / len(gs))


def test_entity_tokens_without_short_verb_forms(spark):
    words = ["ring", "running", "owed", "need", "fed", "stone"]
    tokens = spark.createDataFrame([("c", w, 2) for w in words], "chunk_id string, word string, tf long")
    assert {r["word"] for r in C.entity_tokens(tokens).collect()} == {"need", "stone"}


@pytest.fixture(scope="module")
def net(spark):
    """Chunks of up to five of 60 words, the first ones common, some of one stem or form; relations of words on a chunk; 70 questions."""
    rng = np.random.default_rng(4)
    base = [f"{a}{b}" for a in ("stone", "water", "light", "green", "cloud", "ridge") for b in ("", "s", "y", "ies", "ing", "ings", "es", "ed", "er", "ers")]
    rows = []
    for k in range(300):
        for w in dict.fromkeys((rng.random(5) ** 2 * len(base)).astype(int).tolist()):
            rows.append((f"c{k}", base[w], int(rng.integers(1, 5))))
    cc = spark.createDataFrame(rows, "chunk_id string, concept string, tf long")
    rel = stored(G.relations(cc), "test-relations")
    own = spark.createDataFrame([(q, base[w]) for q in range(70) for w in {*rng.integers(30, 60, 2).tolist()}], "qid long, concept string")
    m = cc.select("concept", "chunk_id", (F.col("tf") * 1.37).alias("w"))
    seed = spark.createDataFrame([(q, f"c{(q * 7 + d) % 300}", d) for q in range(70) for d in range(3)], "qid long, id string, rk int")
    return cc, rel, own, m, seed


def test_relations_of_many_questions_at_once(net):
    cc, rel, own, m, seed = net
    near = G.both_ways(rel, "a", "b", "prob").filter("prob > 0.2")
    for weight, hops in ((0.7, 1), (0.1, 2)):
        want = R.top(G.propagate(G.relation_weights(own, near, weight, hops), m, seed).withColumn("score", F.round("score", 6)), 12)
        got = G.relation_best(own, near, m, seed, weight, hops, 12)
        key = lambda r: (r["qid"], r["rk"], r["id"], round(r["score"], 6))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_pairs_without_all_chunks_of_a_concept(net, spark):
    cc, rel, *_ = net
    chunks = cc.select("chunk_id").distinct().withColumn("text", F.expr("repeat('x', 3 + cast(substring(chunk_id, 2) as int) % 17)"))
    of, size = {}, {r["chunk_id"]: len(r["text"]) for r in chunks.collect()}
    for r in cc.collect():
        of.setdefault(r["concept"], set()).add(r["chunk_id"])
    words = sorted(of)
    pairs = [(a, b) for a in words[:25] for b in words[::-1][:25]] + [("none", words[0])]
    got = {(r["a"], r["b"]): (r["strategy"], r["context"]) for r in G.pair_context(spark.createDataFrame(pairs, "a string, b string"), cc, chunks).collect()}
    first = lambda c: min(c, key=lambda x: (size[x], x))
    for a, b in pairs:
        both = of.get(a, set()) & of[b]
        assert got[a, b] == (("common", first(both)) if both else ("joined", f"{first(of[a])}+{first(of[b])}") if a in of else ("missing", None))
    assert {s for s, _ in got.values()} == {"common", "joined", "missing"}


def test_disambiguation_looks_up_the_fewer(net):
    _, rel, *_ = net
    near = stored(G.both_ways(rel, "a", "b", "prob").filter("pmod(hash(src, dst), 16) = 0"), "test-near")
    words = near.groupBy("src").agg(F.collect_set("dst").alias("w"))
    rows = rel.join(words.select(F.col("src").alias("a"), F.col("w").alias("x")), "a").join(words.select(F.col("src").alias("b"), F.col("w").alias("y")), "b")
    want = sorted(map(tuple, rows.select("a", "b", G.disambiguate(F.col("x"), F.col("y"))).collect()))
    assert sorted(map(tuple, G.disambiguated(rel, near).collect())) == want and len({v for *_, v in want}) == 3


def test_role_words_of_concepts(net):
    from loomgraph.operators import readout as D

    cc, rel, *_ = net
    near = G.both_ways(rel, "a", "b", "prob")
    corpus = cc.select(F.col("concept").alias("word")).filter("word <> 'waters'")
    r = cc.join(near, F.col("concept") == F.col("src")).select("chunk_id", "concept", F.col("dst").alias("token"), "prob")
    for n in (1, 3, 5):
        want = sorted(map(tuple, D.role_words(r, cc.select("chunk_id", "concept"), corpus, n).collect()))
        assert sorted(map(tuple, D.concept_role_words(near, cc.select("chunk_id", "concept"), corpus, n).collect())) == want and len(want) > 500


def test_tau_of_many_rows():
    rng = np.random.default_rng(6)
    for n, top in ((2, 5), (9, 3), (200, 4), (300, 1000)):
        x, y = rng.integers(0, top, n), rng.integers(0, top, n) / 7
        dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
        want = (dx * dy).sum() / np.sqrt(float((dx != 0).sum()) * (dy != 0).sum()) if dx.any() and dy.any() else None
        assert M.tau_b(x, y) == (want if want is None else pytest.approx(want))
        assert M.falling_pairs(x) == sum(int(x[i] > x[j]) for i in range(n) for j in range(i + 1, n))
    # All pairs of these would take half an hour.
    assert M.tau_b(np.arange(1_000_000), np.arange(1_000_000)[::-1] // 2) == pytest.approx(-1, abs=1e-6)
    assert M.tau_b(np.ones(5), np.arange(5)) is None and M.tau_b(np.ones(1), np.ones(1)) is None


def test_ranks_of_many_questions_and_nodes(spark):
    """More questions than a task walks for at once, more nodes than a block names, edges to and from a hub."""
    n, steps = 5000, 4
    rng = np.random.default_rng(8)
    e = [(i, (i + d) % n, float(d)) for i in range(n) for d in (1, 3)] + [(i, 0, 0.5) for i in range(1, n, 3)] + [(0, i, 1.0) for i in range(5, 900)]
    reset = [(q, int(i), float(q % 3 + 1)) for q in range(40) for i in rng.integers(0, n, 3)]
    name = lambda i: f"n{i}"
    got = {(r["qid"], r["node"]): r["p"] for r in G.page_rank(spark.createDataFrame([(name(i), name(j), w) for i, j, w in e], "src string, dst string, w double"), spark.createDataFrame([(q, name(i), s) for q, i, s in reset], "qid long, node string, s double"), 0.5, steps).collect()}
    src, dst, w = (np.array(x) for x in zip(*e))
    share = w / np.bincount(src, w, n)[src]
    s = np.zeros((n, 40))
    for q, i, x in reset:
        s[i, q] += x
    s /= s.sum(0)
    p = s
    for _ in range(steps):
        new = 0.5 * s
        np.add.at(new, dst, 0.5 * p[src] * share[:, None])
        p = new
    assert len(got) == (p > 0).sum() and all(abs(got[q, name(i)] - p[i, q]) < 1e-12 for i, q in np.argwhere(p > 0).tolist())


def test_ridge_questions_are_tasks_of_their_own(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 1.0)], "concept string, chunk_id string, w double")
    own = spark.createDataFrame([(q, c) for q in range(30) for c in "ab"], "qid long, concept string")
    got = N.ridge_weights(own, cells, 1.0)
    assert len({r["qid"] for r in got.collect()}) == 30 and got.rdd.getNumPartitions() >= 30


def test_multiwords(spark):
    text = "the deep river flows. deep river, old mill; deep river flows on and old mill turns"
    chunks = spark.createDataFrame([(k, text if k else "river deep") for k in range(4)], "chunk_id long, text string")
    tokens = spark.createDataFrame([(k, w) for k in range(4) for w in ("river", "turns")], "chunk_id long, word string")
    grams = O.ngrams(chunks, 1, stop=()).union(O.ngrams(chunks, 2, stop=()))
    got = {}
    for r in S.multiwords(chunks, tokens, grams).collect():
        got.setdefault(r["chunk_id"], set()).add(r["span"])
    assert got == {0: {"river"}} | {k: {"deep river", "the deep river flows", "deep river flows on and", "on and old mill turns"} for k in (1, 2, 3)}


def test_cells_of_a_tensor_stay_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cells = {(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2)) if a != b}
    coo = spark.createDataFrame([(f"n{a:02}", "near" if (a + b) % 2 else "far", f"n{b:02}", 1.0 + a % 3) for a, b in sorted(cells)], "a string, bucket string, b string, v double")
    (at, v), names, buckets = N.sparse(coo)
    y = np.einsum("ir,jr,kr->ijk", *N.cp_factors((at, v), (len(names), 2, len(names)), 5, 0.1)[0]).max(1)
    y[at[:, 0], at[:, 2]] = 0
    np.fill_diagonal(y, 0)
    want = np.sort(y[y > 0])[::-1][: int(len(at) * 0.2)]
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(type(coo), name, lambda self: pytest.fail("cells are brought to the driver"))
    got = N.completion(coo, rank=5, ridge=0.1).collect()
    assert np.allclose(sorted((r["prob"] for r in got), reverse=True), want / want[0])
    assert not {(r["a"], r["b"]) for r in got} & {(f"n{a:02}", f"n{b:02}") for a, b in cells}
    grid = spark.createDataFrame([(2, 0.1, 0), (3, 1.0, 1)], "rank int, ridge double, seed int")
    assert [0 <= r["auc"] <= 1 for r in N.holdout_grid(coo, grid).collect()] == [True, True]
