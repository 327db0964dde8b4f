"""Queries of clusters, trees, tensors and ordered scans; most are checked by tests of their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import cluster as K
from loomgraph.operators import corpus as O
from loomgraph.operators import graph as G
from loomgraph.operators import ranking as R
from loomgraph.operators import spans as S
from loomgraph.operators import tensor as N
from loomgraph.operators import vectors as V
from loomgraph.sinks import cache

from .base import RELATIONS, query, table
from .graph_queries import Graph, merged, rounded
from .vector_queries import Space


@query("src_06_chapters")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.chapters(docs, "doc_id").select("doc_id", "chapter", "title", F.length("body").alias("n"))


@query("str_03_symbols")
def _(spark, d):
    return S.symbols(table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")))


@query("ent_01_cap_spans")
def _(spark, d):
    return S.cap_spans(O.chunks(table(spark, d, "documents"))).groupBy("surface").agg(F.count("*").alias("n"))


@query("ent_04_multiwords")
def _(spark, d):
    g = Graph(spark, d)
    grams = O.ngrams(g.chunks, 1, stop=()).union(O.ngrams(g.chunks, 2, stop=()))
    return S.multiwords(g.chunks, g.cc.select("chunk_id", F.col("concept").alias("word")), grams)


@query("rel_03_cluster_pairs")
def _(spark, d):
    return K.kmeans_pairs(Space(spark, d).v)


@query("clu_01_density_clusters")
def _(spark, d):
    return K.density_clusters(Space(spark, d).v)


@query("clu_03_greedy_clusters")
def _(spark, d):
    return K.greedy_clusters(Space(spark, d).v, 0.3)


@query("clu_04_residuals", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id AS id, label, d, e[d] AS x FROM (SELECT *, unnest(range(1, len(e) + 1)) AS d FROM v)) SELECT id, round(sqrt(sum(r * r)), 5) AS length FROM (SELECT id, x - avg(x) OVER (PARTITION BY label, d) AS r FROM x) GROUP BY 1")
def _(spark, d):
    t = K.residual_vectors(Space(spark, d).v, "label")
    return t.select("id", F.round(V.norm(F.col("vector")), 5).alias("length"))


@query("clu_04_whitened")
def _(spark, d):
    return K.whitened_vectors(Space(spark, d).v, "label").select("label", "id", F.round(V.norm(F.col("vector")), 5).alias("length"))


@query("clu_06_concept_tree")
def _(spark, d):
    return K.concept_tree(Space(spark, d).v)


@query("clu_09_communities")
def _(spark, d):
    return K.communities(Graph(spark, d).adjacent, 6)


@query("clu_09_agreement", "WITH p AS (SELECT label AS x, vec_id % 7 AS y FROM embeddings), c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2), a AS (SELECT sum(n) AS n FROM c GROUP BY x), b AS (SELECT sum(n) AS n FROM c GROUP BY y), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM a) AS i, (SELECT sum(n * (n - 1) / 2) FROM b) AS j, (SELECT sum(n * ln(n)) FROM c) AS hij, (SELECT sum(n * ln(n)) FROM a) AS hi, (SELECT sum(n * ln(n)) FROM b) AS hj, (SELECT sum(n) FROM c)::DOUBLE AS t) SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ln(t) + (hij - hi - hj) / t) / (2 * ln(t) - hi / t - hj / t), 6) AS nmi FROM s")
def _(spark, d):
    return rounded(K.agreement(Space(spark, d).v.select(F.col("label").alias("x"), (F.col("vec_id") % 7).alias("y"))), "ari", "nmi")


@query("clu_11_communities_agreement")
def _(spark, d):
    g = Graph(spark, d)
    com = K.communities(g.adjacent, 6).withColumnRenamed("label", "x")
    parts = G.components(g.relations.select("a", "b")).withColumnRenamed("root", "y")
    return rounded(K.agreement(com.join(parts, "node").select("x", "y")), "ari", "nmi")


def _coo(spark, d):
    bucket = F.when(F.col("prob") >= 0.5, "strong").when(F.col("prob") >= 0.1, "middle").otherwise("weak")
    return G.tensor(Graph(spark, d).relations, bucket)


@query("lin_02_holdout_grid")
def _(spark, d):
    grid = spark.createDataFrame([(r, l, s) for r in (4, 8) for l in (0.1, 1.0) for s in (0,)], "rank int, ridge double, seed int")
    return N.holdout_grid(_coo(spark, d), grid)


@query("lin_03_completion")
def _(spark, d):
    return N.completion(_coo(spark, d))


@query("lin_05_procrustes")
def _(spark, d):
    v = Space(spark, d).v.select(F.col("embedding").cast("array<double>").alias("a"), F.transform("embedding", lambda x, i: x.cast("double") * F.when(i % 2 == 0, -1).otherwise(1)).alias("b"))
    m = N.procrustes_of(v, "a", "b")
    return spark.createDataFrame([(i, float(round(abs(m[i, i]), 6))) for i in range(len(m))], "dim int, diagonal double")


@query("ret_03_ridge_arm")
def _(spark, d):
    g = Graph(spark, d)
    q = N.ridge_weights(g.own, g.m, 1.0)
    return R.top(rounded(G.propagate(q, g.m, g.seeds), "score").filter("score > 0"), 10)


@query("ret_03_similarity_arm", "WITH " + RELATIONS + ", sim AS (SELECT src, dst, prob / sum(prob) OVER (PARTITION BY src) AS w FROM adj), wq AS (SELECT qid, concept, sum(w) AS w FROM (SELECT qid, concept, 1.0 AS w FROM seed_concepts UNION ALL SELECT c.qid, s.dst, 0.5 * s.w FROM seed_concepts c JOIN sim s ON s.src = c.concept) GROUP BY 1, 2) SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rk FROM (SELECT wq.qid, m.chunk_id AS id, sum(wq.w * m.w) AS s FROM wq JOIN m USING (concept) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = wq.qid AND s.chunk_id = m.chunk_id) GROUP BY 1, 2)) WHERE rk <= 10")
def _(spark, d):
    g = Graph(spark, d)
    sim = V.similarity_rows(g.relations.select("a", "b", F.col("prob").alias("score")))
    near = g.own.join(sim, F.col("concept") == F.col("i")).select("qid", F.col("j").alias("concept"), (F.col("w") * 0.5).alias("weight"))
    q = g.own.select("qid", "concept", F.lit(1.0).alias("weight")).union(near).groupBy("qid", "concept").agg(F.sum("weight").alias("weight"))
    return R.top(rounded(G.propagate(q, g.m, g.seeds), "score"), 10)


@query("ret_08_interleave")
def _(spark, d):
    g = Graph(spark, d)
    return N.interleave(merged(g).select("qid", "id", "rk"), g.dense.select("qid", "id", "rk"))


@query("ret_14_whitened_cascade")
def _(spark, d):
    s = Space(spark, d)
    dense = V.knn(s.q, s.v, 100)
    dims = V.variance_ranks(s.v).filter("rk <= 8").select("dim")
    q = V.by_dimension(s.q.withColumnRenamed("vec_id", "qid"), "qid").join(dims, "dim")
    c = V.by_dimension(s.v.withColumnRenamed("vec_id", "id"), "id").join(dims, "dim").withColumnRenamed("x", "y")
    fused = dense.select("qid", "id", F.col("score").alias("dense")).join(q, "qid").join(c, ["id", "dim"]).groupBy("qid", "id", "dense").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return R.top(R.top(rounded(fused, "score"), 20).select("qid", "id", F.col("dense").alias("score")), 10)


@query("snk_01_embedding_cache")
def _(spark, d):
    from loomgraph.plugins import hashed_words

    texts = table(spark, d, "benchmark").select(F.col("text"))
    return cache.embedded(texts, hashed_words(32), "hashed-words/32").select("key", F.size("vector").alias("dims"))


@query("udf_01_embedding_standin")
def _(spark, d):
    from loomgraph.plugins import hashed_words

    b = table(spark, d, "benchmark")
    e = b.select("item_id", hashed_words(32).column("text").alias("embedding"))
    return V.knn(e, e, 3, "item_id", "embedding", "item_id", "embedding")
