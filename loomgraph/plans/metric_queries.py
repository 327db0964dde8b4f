"""Queries of rank metrics, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import corpus as O
from loomgraph.operators import metrics as M
from loomgraph.operators import ranking as R
from loomgraph.operators import vectors as V

from .base import RELATIONS, TOKENS, query, table
from .graph_queries import MERGED, Graph, merged, rounded
from .text_queries import STEM
from .vector_queries import COS, Space

EVAL = COS + """, qrels AS (SELECT a.vec_id AS qid, b.vec_id AS id, 1 + b.vec_id % 3 AS grade FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
res AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM cos WHERE qid <> id),
hit AS (SELECT r.*, g.grade, row_number() OVER (PARTITION BY r.qid ORDER BY r.rk) AS seen FROM res r JOIN qrels g USING (qid, id) WHERE rk <= 10),
got AS (SELECT qid, sum(grade / log2(rk + 1)) AS dcg, count(*) AS n, sum(seen / rk) AS ap, min(rk) AS f FROM hit GROUP BY 1),
ideal AS (SELECT qid, sum(grade / log2(i + 1)) FILTER (WHERE i <= 10) AS idcg, count(*) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS i FROM qrels) GROUP BY 1),
per AS (SELECT i.qid, coalesce(dcg, 0) / idcg AS ndcg, coalesce(n, 0) / 10 AS p, coalesce(n, 0) / rel AS recall, coalesce(ap, 0) / least(rel, 10) AS ap, coalesce(1 / f, 0) AS rr FROM ideal i LEFT JOIN got USING (qid))"""


def _eval(spark, d):
    s = Space(spark, d)
    q = s.q.select(F.col("vec_id").alias("qid"), "label")
    qrels = s.v.select(F.col("vec_id").alias("id"), "label").join(F.broadcast(q), "label").filter("qid <> id").select("qid", "id", (1 + F.col("id") % 3).alias("grade"))
    res = R.top(V.knn(s.q, s.v, 11).filter("qid <> id").drop("rk"), 10).select("qid", "id", "rk")
    return s, res, qrels


@query("met_01_ndcg", "WITH " + EVAL + " SELECT qid, round(ndcg, 6) AS ndcg, round(p, 6) AS p FROM per")
def _(spark, d):
    _, res, qrels = _eval(spark, d)
    return rounded(M.rank_metrics(res, qrels), "ndcg", "p").select("qid", "ndcg", "p")


@query("met_02_suite", "WITH " + EVAL + " SELECT coalesce('s' || (qid % 4), '_all') AS stratum, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS ap, round(avg(rr), 6) AS rr FROM per GROUP BY GROUPING SETS (('s' || (qid % 4)), ())")
def _(spark, d):
    _, res, qrels = _eval(spark, d)
    rows = M.rank_metrics(res, qrels).withColumn("stratum", F.concat(F.lit("s"), F.col("qid") % 4))
    return rounded(M.by_stratum(rows, "stratum", "ndcg", "recall", "ap", "rr"), "ndcg", "recall", "ap", "rr")


@query("met_03_overlap", "WITH " + RELATIONS + MERGED + ", a AS (SELECT qid, list(id) AS l FROM merged GROUP BY 1), b AS (SELECT qid, list(chunk_id) AS l FROM dense WHERE rk <= 10 GROUP BY 1) SELECT qid, round(len(list_intersect(a.l, b.l)) / least(10, len(a.l), len(b.l)), 6) AS overlap FROM a JOIN b USING (qid)")
def _(spark, d):
    g = Graph(spark, d)
    return rounded(M.overlap(merged(g), g.dense.filter("rk <= 10")), "overlap")


@query("met_04_kendall", "WITH " + RELATIONS + """, x AS (SELECT qid, chunk_id AS id, round(score, 6) AS a FROM flat), y AS (SELECT qid, chunk_id AS id, score AS b FROM dense WHERE rk <= 100), u AS (SELECT qid, id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM x FULL JOIN y USING (qid, id)),
p AS (SELECT l.qid, sign(l.a - r.a) AS sa, sign(l.b - r.b) AS sb FROM u l JOIN u r ON l.qid = r.qid AND l.id < r.id)
SELECT qid, round(sum(sa * sb) / sqrt(sum(abs(sa))::DOUBLE * sum(abs(sb))), 6) AS tau FROM p GROUP BY 1""")
def _(spark, d):
    g = Graph(spark, d)
    return rounded(M.kendall(rounded(g.flat, "score"), g.dense.select("qid", "id", "score")), "tau")


@query("met_05_evidence_recall", "WITH " + RELATIONS + MERGED + r""", ctx AS (SELECT DISTINCT m.qid, t.word FROM merged m JOIN tokens t ON t.chunk_id = m.id), st AS (SELECT qid, i, trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT qid, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id AS qid, string_split(replace(text, '.', ';'), ';') AS x FROM benchmark))),
sw AS (SELECT DISTINCT qid, i, w FROM (SELECT qid, i, unnest(regexp_extract_all(lower(s), '[a-z]+')) AS w FROM st WHERE s <> '') WHERE length(w) >= 4 AND w NOT IN """ + "('that','this','with','from','have','been','were','they','them','their','there','which','what','when','where','than','then','also','more','most','some','such','only','into','about','these','those','other','between','through','during','after','before','because','while','being','does','done','each')" + """),
sc AS (SELECT st.qid, st.i, CASE WHEN count(sw.w) > 0 THEN count(c.word) / count(sw.w) ELSE 0 END AS r FROM st LEFT JOIN sw USING (qid, i) LEFT JOIN ctx c ON c.qid = st.qid AND c.word = sw.w WHERE st.s <> '' GROUP BY 1, 2)
SELECT qid, round(avg(r), 6) AS recall FROM sc GROUP BY 1""")
def _(spark, d):
    g = Graph(spark, d)
    e = g.questions.select("qid", F.explode(T.statements(F.replace(F.col("text"), F.lit("."), F.lit(";")))).alias("statement"))
    ctx = merged(g).join(g.chunks.select(F.col("chunk_id").alias("id"), "text"), "id")
    return rounded(M.evidence_recall(e, ctx), "recall")


@query("met_06_auc", "WITH s AS (SELECT d.source, length(d.text) AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT a.source, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY 1) SELECT q.source, round(p.auc, 6) AS auc FROM (SELECT DISTINCT source FROM s) q LEFT JOIN p USING (source)")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")).join(table(spark, d, "labels"), "doc_id")
    return rounded(M.auc(s, "n", "quality", "source"), "auc")


@query("met_07_sign_flips", "WITH " + EVAL + ", df AS (SELECT qid, ndcg - recall AS d FROM per), f AS (SELECT k, avg(d * CASE WHEN substr(md5(qid || ':' || k), 1, 1) < '8' THEN 1.0 ELSE -1.0 END) AS m FROM df, (SELECT unnest(range(1, 1001)) AS k) GROUP BY 1), b AS (SELECT avg(d) AS delta, count(*) AS n FROM df) SELECT round(delta, 6) AS delta, CASE WHEN n < 5 OR abs(delta) < 1e-8 THEN 1.0 ELSE (SELECT count(*) FROM f WHERE abs(round(m, 9)) >= abs(round(delta, 9))) / 1000 END AS p_value, n FROM b")
def _(spark, d):
    _, res, qrels = _eval(spark, d)
    return rounded(M.sign_flips(M.rank_metrics(res, qrels).select("qid", (F.col("ndcg") - F.col("recall")).alias("diff"))), "delta")


@query("met_08_shuffle_test")
def _(spark, d):
    return M.shuffle_test(Space(spark, d).v, 20)


@query("met_10_tail_stats", "WITH " + RELATIONS + """, p AS (SELECT qid, round(score, 6) AS s FROM flat WHERE round(score, 6) > 0), t AS (SELECT qid, count(*) AS n_unique, round(avg((c > 1)::INT), 6) AS tie_share, max(c) AS longest_tie FROM (SELECT qid, s, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT qid, count(*) AS n_positive, round(-sum(x * ln(x)), 5) AS entropy, round(max(s) / quantile_cont(s, 0.5), 5) AS over_median FROM (SELECT qid, s, s / sum(s) OVER (PARTITION BY qid) AS x FROM p) GROUP BY 1) SELECT * FROM t JOIN e USING (qid)""")
def _(spark, d):
    return rounded(rounded(M.tail_stats(Graph(spark, d).flat), "entropy", "over_median", digits=5), "tie_share")


@query("met_11_verdicts", "SELECT source, n, CASE WHEN share >= 0.88 AND n >= 10 THEN 'grounded' WHEN n >= 10 THEN 'weak' ELSE 'none' END AS verdict, round(share * 61.0 * 100 / 64.0, 6) AS retention FROM (SELECT d.source, count(*) AS n, avg(l.quality) AS share FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("share"))
    p = F.when(F.col("n") >= 10, 0.01).otherwise(1.0)
    return s.select("source", "n", M.verdict(F.col("share"), p, 0.88).alias("verdict"), F.round(M.retention(F.col("share"), F.lit(61.0), F.lit(64.0)), 6).alias("retention"))


@query("met_12_by_level", "WITH " + RELATIONS + MERGED + ", h AS (SELECT m.qid, count(*) FILTER (WHERE d.qid IS NOT NULL) / 10 AS hit FROM merged m LEFT JOIN dense d ON d.qid = m.qid AND d.chunk_id = m.id AND d.rk <= 10 GROUP BY 1) SELECT coalesce('L' || (qid % 4 + 1), '_all') AS level, count(*) AS n, round(avg(hit), 6) AS hit FROM h GROUP BY GROUPING SETS (('L' || (qid % 4 + 1)), ())")
def _(spark, d):
    g = Graph(spark, d)
    top = g.dense.filter("rk <= 10").select("qid", "id", F.lit(1).alias("in"))
    h = merged(g).join(top, ["qid", "id"], "left").groupBy("qid").agg((F.count("in") / 10).alias("hit"))
    return rounded(M.by_stratum(h.withColumn("level", F.concat(F.lit("L"), F.col("qid") % 4 + 1)), "level", "hit"), "hit")


@query("met_13_morphological_pairs", "WITH " + TOKENS + f", w AS (SELECT DISTINCT word, {STEM.format(w='word')} AS st FROM tokens) SELECT a.word AS a, b.word AS b FROM w a JOIN w b ON a.st = b.st AND a.word < b.word")
def _(spark, d):
    return M.morphological_pairs(O.token_counts(O.chunks(table(spark, d, "documents"))).select("word").distinct())


@query("met_14_separation", "WITH " + RELATIONS + ", r1 AS (SELECT qid, chunk_id AS id, rk FROM dense WHERE rk <= 100), r2 AS (SELECT qid, chunk_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rk FROM flat), c AS (SELECT r1.qid, r1.id, CASE WHEN d.score >= 40 THEN 'TP' WHEN d.score >= 20 THEN 'HSS' ELSE 'TN' END AS cell FROM r1 JOIN dense d ON d.qid = r1.qid AND d.chunk_id = r1.id), z AS (SELECT cell, count(*) AS n, avg(r1.rk) AS a, avg(r2.rk) AS b FROM c JOIN r1 USING (qid, id) JOIN r2 USING (qid, id) GROUP BY 1) SELECT cell, n, round(a, 6) AS rank_first, round(b, 6) AS rank_second, CASE WHEN n < 5 THEN 'too_few' WHEN b < a THEN 'up' WHEN b > a THEN 'down' ELSE 'same' END AS verdict FROM z")
def _(spark, d):
    g = Graph(spark, d)
    first = g.dense.select("qid", "id", "rk", "score")
    second = R.top(rounded(g.flat, "score"), 1_000_000)
    cells = first.select("qid", "id", F.when(F.col("score") >= 40, "TP").when(F.col("score") >= 20, "HSS").otherwise("TN").alias("cell"))
    return rounded(M.separation_report(first, second, cells), "rank_first", "rank_second")


@query("met_15_leaderboard", "WITH " + EVAL + " SELECT round(avg(ndcg), 6) AS base, round(61.0 / (100 * avg(ndcg)), 6) AS factor, round(avg(recall) * 61.0 / avg(ndcg), 6) AS converted FROM per")
def _(spark, d):
    _, res, qrels = _eval(spark, d)
    a = M.rank_metrics(res, qrels).agg(F.avg("ndcg").alias("base"), F.avg("recall").alias("r"))
    f = M.leaderboard_factor(F.col("base"))
    return a.select(F.round("base", 6).alias("base"), F.round(f, 6).alias("factor"), F.round(F.col("r") * f * 100, 6).alias("converted"))


@query("met_16_ratio_persistence", "WITH r AS (SELECT l_linenumber AS depth, avg(l_discount) AS ratio FROM lineitem GROUP BY 1) SELECT depth, round(ratio, 6) AS ratio, round(ratio / lag(ratio) OVER (ORDER BY depth), 6) AS over_last FROM r")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("depth"), F.col("l_discount").alias("ratio"))
    return rounded(M.ratio_persistence(rows), "ratio", "over_last")
