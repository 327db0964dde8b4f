"""Queries of vector joins, aggregates over vectors and rankings. Queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import ranking as R
from loomgraph.operators import vectors as V

from .base import VECTORS, query, table

COS = VECTORS + """,
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
cos AS (SELECT q.vec_id AS qid, c.vec_id AS id, c.label, round(coalesce(list_cosine_similarity(q.e, c.e), 0), 6) AS s FROM q, v c),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM cos),
cdim AS (SELECT label, d, avg(e[d]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS d FROM v) GROUP BY 1, 2),
cent AS (SELECT label, list(x ORDER BY d) AS c FROM cdim GROUP BY 1),
qc AS (SELECT q.vec_id AS qid, cent.label, round(list_cosine_similarity(q.e, cent.c), 6) AS s FROM q, cent),
cpair AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS s FROM cent a, cent b WHERE a.label < b.label),
cedge AS (SELECT a AS src, b AS dst FROM cpair WHERE s >= 0 UNION ALL SELECT b, a FROM cpair WHERE s >= 0)"""
TOP10 = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)"


class Space:
    """The vector table with its centroids; each part lazy."""

    def __init__(self, spark, d):
        self.v = table(spark, d, "embeddings").filter(F.col("embedding").isNotNull())
        self.q = self.v.filter("vec_id % 50 = 0")
        self.members = self.v.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))

    def all_scores(self):
        """Scores of every row for the stated queries."""
        return V.scores(self.q, self.v)

    def cent(self):
        return V.centroids(self.v)

    def qc(self):
        return V.scores(self.q, self.cent(), c_id="label", c_vec="centroid").select("qid", F.col("id").alias("cluster"), "score")

    def edges(self, least=0.0):
        p = V.similar_pairs(self.cent(), least, "label", "centroid")
        return p.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(p.select("b", "a"))


@query("aux_01_cosine", "WITH " + COS + " SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)), 6) AS cos FROM v")
def _(spark, d):
    s = Space(spark, d)
    first = s.v.filter("vec_id = 0").select(F.col("embedding").alias("e0"))
    from loomgraph.operators.corpus import one_row

    return one_row(s.v, first).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.cosine(F.col("embedding"), F.col("e0")), 6).alias("cos"))


@query("jon_02_similar_pairs", "WITH " + VECTORS + " SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.3")
def _(spark, d):
    return V.similar_pairs(Space(spark, d).v, 0.3)


@query("jon_03_knn", "WITH " + COS + " SELECT qid, id, s AS score, rk FROM dense WHERE rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    return V.knn(s.q, s.v, 10)


@query("jon_05_soft_keywords", "WITH " + COS + """, best AS (SELECT qid, arg_max(id, {'s': s, 'i': -id}) AS id, max(s) AS s FROM cos WHERE id % 50 <> 0 GROUP BY qid HAVING max(s) >= 0.2),
hit AS (SELECT qid // 100 AS q, id % 20 AS doc, sum((1 + qid % 3) * s * (1 + id % 5)) AS num FROM best GROUP BY 1, 2),
qw AS (SELECT qid // 100 AS q, sum(1 + qid % 3) AS w FROM (SELECT DISTINCT qid FROM cos) GROUP BY 1), dw AS (SELECT vec_id % 20 AS doc, sum(1 + vec_id % 5) AS w FROM v WHERE vec_id % 50 <> 0 GROUP BY 1)
SELECT q, doc, round(num / sqrt(qw.w * dw.w), 6) AS score FROM hit JOIN qw USING (q) JOIN dw USING (doc)""")
def _(spark, d):
    s = Space(spark, d)
    own = s.q.select(F.col("vec_id").alias("kw"), F.floor(F.col("vec_id") / 100).alias("q"), (1 + F.col("vec_id") % 3).alias("w"))
    corpus = s.v.filter("vec_id % 50 <> 0")
    theirs = corpus.select(F.col("vec_id").alias("kw"), (F.col("vec_id") % 20).alias("doc"), (1 + F.col("vec_id") % 5).alias("w"))
    best = V.knn(s.q, corpus, 1, least=0.2)
    from loomgraph.operators.lexical import soft_keywords

    return soft_keywords(own, theirs, best).select("q", "doc", F.round("score", 6).alias("score"))


@query("agg_07_centroids", "WITH " + COS + " SELECT label, (d - 1)::BIGINT AS dim, round(x, 6) AS x FROM cdim WHERE label >= 0")
def _(spark, d):
    c = V.centroids(Space(spark, d).v)
    return V.by_dimension(c, "label", vec_col="centroid").select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("agg_08_dispersion", "WITH " + VECTORS + " SELECT a.label, round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) AS dispersion FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def _(spark, d):
    return V.dispersion(Space(spark, d).v, "label").filter("n > 1").select("label", F.round("dispersion", 6).alias("dispersion"))


@query("agg_09_distance_histogram", "WITH " + VECTORS + " SELECT least(floor((1 - round(list_cosine_similarity(a.e, b.e), 6)) / 2 * 20), 19)::BIGINT AS bin, count(*) AS n FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label = b.label GROUP BY 1")
def _(spark, d):
    return V.distances_within(Space(spark, d).v, "label", 20)


@query("agg_10_separation", "WITH " + VECTORS + ", p AS (SELECT a.label = b.label AS same, 1 - list_cosine_similarity(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id < b.vec_id), s AS (SELECT avg(dist) FILTER (WHERE same) AS w, avg(dist) FILTER (WHERE NOT same) AS b FROM p) SELECT round(w, 6) AS within, round(b, 6) AS between, round((b - w) / greatest(b, w), 6) AS proxy FROM s")
def _(spark, d):
    s = V.separation(Space(spark, d).v)
    return s.select(*[F.round(c, 6).alias(c) for c in ("within", "between", "proxy")])


@query("agg_11_variance_dims", "WITH " + VECTORS + ", x AS (SELECT d, round(var_pop(e[d]), 6) AS variance FROM (SELECT e, unnest(range(1, len(e) + 1)) AS d FROM v) GROUP BY 1) SELECT (d - 1)::BIGINT AS dim, variance, row_number() OVER (ORDER BY variance DESC, d) AS rk FROM x")
def _(spark, d):
    return V.variance_ranks(Space(spark, d).v).select(F.col("dim").cast("long").alias("dim"), "variance", "rk")


@query("agg_12_transforms", "WITH " + COS + ", st AS (SELECT qid, avg(s) AS m, stddev_pop(s) AS sd FROM cos GROUP BY 1) SELECT qid, id, round(CASE WHEN s > 0 THEN s * s * s ELSE 0 END, 6) AS p3, round(1 / (1 + exp(-20 * (s - 0.3))), 6) AS sig, round(CASE WHEN sd > 0 THEN (s - m) / sd ELSE 0 END, 5) AS z FROM cos JOIN st USING (qid)")
def _(spark, d):
    s = Space(spark, d)
    stats = F.broadcast(V.score_moments(s.q, s.v))
    z = F.when(F.col("deviation") > 0, (F.col("score") - F.col("mean")) / F.col("deviation")).otherwise(F.lit(0.0))
    return s.all_scores().join(stats, "qid").withColumn("zz", z).select("qid", "id", F.round(V.power(F.col("score"), 3), 6).alias("p3"), F.round(V.sigmoid(F.col("score"), 0.3), 6).alias("sig"), F.round("zz", 5).alias("z"))


@query("agg_13_similarity_rows", "WITH " + COS + ", p AS (SELECT a AS i, b AS j, s FROM cpair WHERE s > 0 UNION ALL SELECT b, a, s FROM cpair WHERE s > 0) SELECT i, j, round(s / sum(s) OVER (PARTITION BY i), 6) AS w FROM p")
def _(spark, d):
    p = V.similar_pairs(Space(spark, d).cent(), 0.0, "label", "centroid")
    return V.similarity_rows(p).select("i", "j", F.round("w", 6).alias("w"))


@query("ret_11_concern_fusion", "WITH " + COS + ", ctx AS (SELECT qid, max(s * (0.6 + 0.2 * (label % 3))) AS c FROM dense WHERE rk BETWEEN 2 AND 6 GROUP BY 1) SELECT d.qid, d.id, round(CASE WHEN x.c >= 0.3 THEN x.c + 0.6 * d.s ELSE 0.6 * d.s END, 6) AS score FROM dense d JOIN ctx x USING (qid) WHERE d.rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    k = V.knn(s.q, s.v, 10)
    ctx = k.filter("rk between 2 and 6").join(s.members, "id").groupBy("qid").agg(F.max(F.col("score") * (0.6 + 0.2 * (F.col("cluster") % 3))).alias("c"))
    return k.join(ctx, "qid").select("qid", "id", F.round(R.fuse_concern(F.col("c"), F.col("score")), 6).alias("score"))


@query("ret_12_cluster_graph", "WITH " + COS + """, nb AS (SELECT qc.qid, e.dst AS label, max(0.5 * qc.s) AS s FROM qc JOIN cedge e ON e.src = qc.label GROUP BY 1, 2),
cs AS (SELECT qc.qid, qc.label, greatest(qc.s, coalesce(nb.s, qc.s)) AS s FROM qc LEFT JOIN nb USING (qid, label)),
r AS (SELECT c.qid, c.id, round(CASE WHEN cs.s * c.s >= 0 THEN sqrt(cs.s * c.s) END, 6) AS score FROM cos c JOIN cs USING (qid, label))
SELECT * FROM (SELECT qid, id, score, """ + TOP10 + " AS rk FROM r WHERE score IS NOT NULL) WHERE rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    cs = R.spread(s.qc(), s.edges())
    return R.cluster_records(cs, s.q, s.v, 10)


@query("ret_13_concept_tree_dig", "WITH " + COS + """, near AS (SELECT qid, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS r FROM qc) WHERE r = 1),
more AS (SELECT c.qid, c.id, 0.8 * c.s AS score FROM near n JOIN cedge e ON e.src = n.label JOIN cos c ON c.qid = n.qid AND c.label = e.dst),
u AS (SELECT qid, id, s AS score FROM dense WHERE rk <= 20 UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.rk <= 20 AND d.qid = m.qid AND d.id = m.id))
SELECT * FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM u) WHERE rk <= 30""")
def _(spark, d):
    s = Space(spark, d)
    return R.dig(s.q, s.v, s.qc(), s.edges(), 20, 30)


@query("ret_15_residual", "WITH " + COS + """, near AS (SELECT qid, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS r FROM qc) WHERE r = 1),
res AS (SELECT n.qid, c.vec_id AS id, round(coalesce(list_cosine_similarity(list_transform(list_zip(q.e, t.c), lambda x: x[1] - x[2]), list_transform(list_zip(c.e, t.c), lambda x: x[1] - x[2])), 0), 6) AS s FROM near n JOIN q ON q.vec_id = n.qid JOIN cent t ON t.label = n.label JOIN v c ON c.label = n.label)
SELECT c.qid, c.id, round(coalesce(r.s, 0.5 * c.s), 7) AS score FROM cos c LEFT JOIN res r ON r.qid = c.qid AND r.id = c.id""")
def _(spark, d):
    s = Space(spark, d)
    near = R.top(s.qc(), 1, tie="cluster").select("qid", "cluster")
    cent = s.cent().select(F.col("label").alias("cluster"), "centroid")
    return R.residual_scores(s.q, s.v, cent, near).select("qid", "id", F.round("score", 7).alias("score"))


@query("ret_16_cluster_boost", "WITH " + COS + """, near AS (SELECT qid, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS r FROM qc) WHERE r <= 4),
b AS (SELECT d.qid, d.id, round(d.s * CASE WHEN n.label IS NOT NULL THEN 1.3 ELSE 1 END, 7) AS score FROM dense d LEFT JOIN near n ON n.qid = d.qid AND n.label = d.label WHERE d.rk <= 100)
SELECT * FROM (SELECT qid, id, score, """ + TOP10 + " AS rk FROM b) WHERE rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    near = R.top(s.qc(), 4, tie="cluster")
    b = R.boost(V.knn(s.q, s.v, 100).drop("rk"), s.members, near).select("qid", "id", F.round("score", 7).alias("score"))
    return R.top(b, 10)


@query("ret_19_agent_steps", "WITH " + COS + ", rel AS (SELECT d.qid, d.rk FROM dense d JOIN v ON v.vec_id = d.qid AND v.label = d.label WHERE d.id <> d.qid) SELECT q.vec_id AS qid, min(rel.rk) AS steps FROM q LEFT JOIN rel ON rel.qid = q.vec_id AND rel.rk <= 100 GROUP BY 1")
def _(spark, d):
    s = Space(spark, d)
    k = V.knn(s.q, s.v, 100)
    rel = k.join(s.q.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid").join(s.members, "id").filter("own = cluster and qid <> id")
    return R.steps_to_hit(k, rel)


@query("ret_21_analogy", "WITH " + COS + """, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), t AS (SELECT vec_id AS qid, vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c FROM q),
aim AS (SELECT t.*, list_transform(list_zip(ub.e, ua.e, uc.e), lambda x: x[1] - x[2] + x[3]) AS e FROM t JOIN u ua ON ua.vec_id = a JOIN u ub ON ub.vec_id = b JOIN u uc ON uc.vec_id = c),
s AS (SELECT qid, v.vec_id AS id, round(list_cosine_similarity(aim.e, v.e), 6) AS score FROM aim, v WHERE v.vec_id NOT IN (a, b, c))
SELECT * FROM (SELECT qid, id, score, """ + TOP10 + " AS rk FROM s) WHERE rk <= 5")
def _(spark, d):
    s = Space(spark, d)
    t = s.q.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    return R.analogy(s.v, t, 5)


@query("ret_24_dual_query", "WITH " + COS + """, q2 AS (SELECT vec_id - 1 AS qid, e FROM v WHERE vec_id % 50 = 1), b AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM (SELECT q2.qid, c.vec_id AS id, round(list_cosine_similarity(q2.e, c.e), 6) AS s FROM q2, v c)),
u AS (SELECT qid, id, round(CASE WHEN a.s IS NULL THEN b.s * 0.95 WHEN b.s IS NULL THEN a.s ELSE greatest(a.s, b.s) END, 6) AS score FROM (SELECT * FROM dense WHERE rk <= 50) a FULL JOIN (SELECT * FROM b WHERE rk <= 50) b USING (qid, id))
SELECT * FROM (SELECT qid, id, score, """ + TOP10 + " AS rk FROM u) WHERE rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    other = s.v.filter("vec_id % 50 = 1").select((F.col("vec_id") - 1).alias("qid"), "embedding")
    rows = R.max_merge(V.knn(s.q, s.v, 50), V.knn(other, s.v, 50, q_id="qid")).select("qid", "id", (F.round(F.col("score") * 1e6) / 1e6).alias("score"))
    return R.top(rows, 10)


@query("ret_25_fused_cluster", "WITH " + COS + """, f AS (SELECT qid, label, avg(s) AS s FROM cos GROUP BY 1, 2), nb AS (SELECT f.qid, e.dst AS label, max(0.5 * f.s) AS s FROM f JOIN cedge e ON e.src = f.label GROUP BY 1, 2),
cs AS (SELECT f.qid, f.label, greatest(f.s, coalesce(nb.s, f.s)) AS s FROM f LEFT JOIN nb USING (qid, label)), r AS (SELECT c.qid, c.id, round(CASE WHEN cs.s * c.s >= 0 THEN sqrt(cs.s * c.s) END, 6) AS score FROM cos c JOIN cs USING (qid, label))
SELECT * FROM (SELECT qid, id, score, """ + TOP10 + " AS rk FROM r WHERE score IS NOT NULL) WHERE rk <= 10")
def _(spark, d):
    s = Space(spark, d)
    mean = V.score_moments(s.q, s.v, "label").select("qid", F.col("label").alias("cluster"), F.col("mean").alias("score"))
    return R.cluster_records(R.spread(mean, s.edges()), s.q, s.v, 10)


@query("clu_02_component_activation", "WITH " + VECTORS + ", l AS (SELECT vec_id, d, e[d] AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS d FROM v)), t AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY round(var_pop(x), 6) DESC, d) AS rk FROM l GROUP BY d) WHERE rk <= 8) SELECT (d - 1)::BIGINT AS dim, vec_id AS id FROM (SELECT l.*, row_number() OVER (PARTITION BY d ORDER BY x DESC, vec_id) AS rk FROM l JOIN t USING (d)) WHERE rk <= (SELECT floor(count(*) * 0.2) FROM v)")
def _(spark, d):
    return V.component_activation(Space(spark, d).v, 8).select(F.col("dim").cast("long").alias("dim"), "id")


@query("clu_08_density_theta", "WITH " + COS + ", p AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rk FROM cpair) SELECT min(s) AS theta FROM p WHERE rk <= (SELECT floor(6.5 * count(*) / 2) FROM cent)")
def _(spark, d):
    s = Space(spark, d)
    c = s.cent()
    return V.density_theta(V.similar_pairs(c, -2.0, "label", "centroid"), c.count())


@query("clu_10_reverse_lookup", "WITH " + COS + " SELECT * FROM (SELECT label AS qid, vec_id AS id, s AS score, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rk FROM (SELECT cent.label, v.vec_id, round(list_cosine_similarity(cent.c, v.e), 6) AS s FROM cent, v)) WHERE rk <= 5")
def _(spark, d):
    s = Space(spark, d)
    return V.knn(s.cent(), s.v, 5, q_id="label", q_vec="centroid")


@query("met_09_cells", "WITH " + COS + " SELECT CASE WHEN d.s >= 0.3 AND v.label = d.label THEN 'TP' WHEN d.s >= 0.3 THEN 'HSS' WHEN v.label = d.label THEN 'LHS' ELSE 'TN' END AS cell, count(*) AS n FROM cos d JOIN v ON v.vec_id = d.qid GROUP BY 1")
def _(spark, d):
    s = Space(spark, d)
    return R.cells(s.q, s.v, 0.3)
