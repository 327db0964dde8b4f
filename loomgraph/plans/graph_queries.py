"""Queries of the concept graph: weights, relations, propagation, paths, entities and knowledge graphs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import concepts as C
from loomgraph.operators import corpus as O
from loomgraph.operators import entities as E
from loomgraph.operators import graph as G
from loomgraph.operators import lexical as L
from loomgraph.operators import ranking as R
from loomgraph.operators import vectors as V
from loomgraph.session import once, stored

from .base import CHUNKS, CONCEPTS, RELATIONS, SEEDS, STOP_SQL, TOKENS, query, table
from .text_queries import POS, STEM


class Index(O.Corpus):
    """The concept graph of the documents, with the benchmark's texts as questions."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        super().__init__(table(spark, d, "documents"))
        self.questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def dense(self):
        return stored(R.top(G.lexical_scores(self.questions, self.tokens, self.n), 100), "dense")

    @cached_property
    def seeds(self):
        return self.dense.filter("rk <= 5").select("qid", "id", "rk")

    @cached_property
    def own(self):
        return stored(G.seed_concepts(self.seeds, self.cc), "seed_concepts")

    @cached_property
    def relations(self):
        return stored(G.relations(self.cc), "relations")

    @cached_property
    def adjacent(self):
        return G.both_ways(self.relations, "a", "b", "prob")

    @cached_property
    def flat(self):
        return stored(G.propagate(self.own, self.m, self.seeds), "flat")


def Graph(spark, d) -> Index:
    """The index of the tables at d, whose tables are written when a query first needs them and then shared."""
    return once(spark, "graph", d, lambda: Index(spark, d))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("agg_01_idf", "WITH " + CONCEPTS + " SELECT concept, df, round(idf, 6) AS idf FROM idf")
def _(spark, d):
    return rounded(Graph(spark, d).idf, "idf")


@query("agg_02_tf_lengths", "WITH " + TOKENS + " SELECT chunk_id, dl::BIGINT AS dl, sum(tf)::BIGINT AS tokens FROM lens JOIN tokens USING (chunk_id) GROUP BY 1, 2")
def _(spark, d):
    g = Graph(spark, d)
    return g.tokens.groupBy("chunk_id").agg(F.sum("tf").alias("tokens")).join(g.lens, "chunk_id").select("chunk_id", "dl", "tokens")


@query("agg_03_bm25", "WITH " + CONCEPTS + " SELECT concept, chunk_id, round(w / idf, 6) AS tf_weight FROM m")
def _(spark, d):
    return Graph(spark, d).m.select("concept", "chunk_id", F.round(F.col("w") / F.col("idf"), 6).alias("tf_weight"))


@query("agg_04_matrix", "WITH " + CONCEPTS + " SELECT concept, chunk_id, round(w, 6) AS w FROM m")
def _(spark, d):
    return rounded(Graph(spark, d).m.select("concept", "chunk_id", "w"), "w")


@query("agg_05_grounding_matrix", "WITH " + CONCEPTS + """, cov AS (SELECT count(DISTINCT chunk_id) AS n FROM cc), g AS (SELECT cc.concept, cc.chunk_id, ln((cov.n - i.df + 0.5) / (i.df + 0.5) + 1) * cc.tf * 2.5 / (cc.tf + 1.5 * (0.25 + 0.75 * l.dl / greatest(n.avgdl, 1))) AS w FROM cc JOIN idf i USING (concept) JOIN lens l USING (chunk_id), n_chunks n, cov)
SELECT concept, chunk_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY concept)), 6) AS w FROM g""")
def _(spark, d):
    g = Graph(spark, d)
    return rounded(E.grounding_matrix(g.cc, g.lens, g.n), "w")


@query("agg_06_graph_stats", "WITH " + RELATIONS + """, deg AS (SELECT src, count(*) AS d FROM adj GROUP BY 1)
SELECT (SELECT count(DISTINCT chunk_id) FROM cc) AS chunks, (SELECT count(DISTINCT concept) FROM cc) AS concepts, (SELECT count(*) FROM cc) AS memberships, (SELECT count(*) FROM relations) AS edges,
 (SELECT round(avg(prob), 6) FROM relations) AS weight_mean, (SELECT round(stddev_pop(prob), 6) FROM relations) AS weight_std, (SELECT max(d) FROM deg) AS degree_max, (SELECT round(avg(d), 6) FROM deg) AS degree_mean, (SELECT round(count(*)::DOUBLE / count(DISTINCT chunk_id), 6) FROM cc) AS concepts_per_chunk""")
def _(spark, d):
    g = Graph(spark, d)
    return rounded(G.graph_stats(g.cc, g.relations), "weight_mean", "weight_std", "degree_mean", "concepts_per_chunk")


@query("jon_01_membership", "WITH " + RELATIONS + " SELECT a, b, count(*) AS n FROM (SELECT x.concept AS a, y.concept AS b FROM cc x JOIN cc y ON x.chunk_id = y.chunk_id AND x.concept < y.concept) GROUP BY 1, 2")
def _(spark, d):
    return G.pair_counts(Graph(spark, d).cc, 1).select("a", "b", "n")


@query("jon_04_weighted_jaccard", "WITH " + TOKENS + f""", q AS (SELECT item_id AS qid, w AS kw, count(*) AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4 AND w NOT IN {STOP_SQL} GROUP BY 1, 2),
low AS (SELECT qid, chunk_id AS id, sum(least(q.w, t.tf)) AS low FROM q JOIN tokens t ON t.word = q.kw GROUP BY 1, 2), sq AS (SELECT qid, sum(w) AS s FROM q GROUP BY 1), sd AS (SELECT chunk_id AS id, sum(tf) AS s FROM tokens GROUP BY 1)
SELECT qid, id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM (SELECT qid, id, round(low / (sq.s + sd.s - low), 6) AS score FROM low JOIN sq USING (qid) JOIN sd USING (id))) WHERE rk <= 5""")
def _(spark, d):
    g = Graph(spark, d)
    q = O.token_counts(g.questions, "qid").select("qid", F.col("word").alias("kw"), F.col("tf").alias("w"))
    return L.weighted_jaccard(q, g.tokens.select(F.col("chunk_id").alias("id"), F.col("word").alias("kw"), F.col("tf").alias("w")), 5)


@query("jon_06_file_hop", "WITH " + SEEDS + """, r AS (SELECT qid, chunk_id AS id, score FROM dense WHERE rk <= 20), f AS (SELECT DISTINCT r.qid, c.doc_id FROM r JOIN chunks c ON c.chunk_id = r.id), nb AS (SELECT DISTINCT qid, d FROM (SELECT qid, unnest([doc_id - 1, doc_id + 1]) AS d FROM f)),
more AS (SELECT nb.qid, c.chunk_id AS id, 0.5 * s.score AS score FROM nb JOIN chunks c ON c.doc_id = nb.d JOIN dense s ON s.qid = nb.qid AND s.chunk_id = c.chunk_id)
SELECT qid, id, round(score, 7) AS score FROM r UNION ALL SELECT qid, id, round(score, 7) FROM more m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.qid = m.qid AND r.id = m.id)""")
def _(spark, d):
    g = Graph(spark, d)
    scores = G.lexical_scores(g.questions, g.tokens, g.n)
    file_of = g.chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("file"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("src"))
    adjacent = docs.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst"))
    return rounded(L.hop(g.dense.filter("rk <= 20").select("qid", "id", "score"), file_of, adjacent, scores), "score", digits=7)


ENT = "WITH " + CONCEPTS + """, e AS (SELECT DISTINCT c.chunk_id, lower(w) AS name FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS w FROM chunks) c), f AS (SELECT name, count(*) AS f FROM e GROUP BY 1), few AS (SELECT chunk_id, name FROM (SELECT e.*, row_number() OVER (PARTITION BY chunk_id ORDER BY f DESC, name) AS rk FROM e JOIN f USING (name)) WHERE rk <= 15)"""


def _names(g):
    w = F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    return g.chunks.select("chunk_id", w.alias("w")).select("chunk_id", F.lower("w").alias("name")).distinct()


@query("jon_07_entity_edges", ENT + ", p AS (SELECT x.name AS a, y.name AS b, count(*) AS n FROM few x JOIN few y ON x.chunk_id = y.chunk_id AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 20000) SELECT a, b, n, round(n::DOUBLE / max(n) OVER (), 6) AS prob FROM p")
def _(spark, d):
    return rounded(G.entity_edges(_names(Graph(spark, d))), "prob")


@query("jon_07_entity_concept_edges", ENT + ", p AS (SELECT e.name AS a, cc.concept AS b, count(*) AS n FROM e JOIN cc USING (chunk_id) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, n, round(n::DOUBLE / max(n) OVER (), 6) AS prob FROM p")
def _(spark, d):
    g = Graph(spark, d)
    return rounded(G.cross_edges(_names(g), g.cc), "prob")


@query("ent_02_term_spans", "WITH " + CHUNKS + f""", s AS (SELECT chunk_id, i, regexp_extract_all(x, '[A-Za-z]+') AS w FROM (SELECT chunk_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM (SELECT chunk_id, regexp_split_to_array(text, '[.!?;:\\n]+') AS p FROM chunks))),
g AS (SELECT list_transform(w[j : j + n - 1], lambda x: lower(x)) AS l, w[j : j + n - 1] AS raw FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS j FROM s, (VALUES (2), (3)) t(n) WHERE len(w) >= n)),
k AS (SELECT array_to_string(l, ' ') AS term, len(list_filter(raw, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 AS cap FROM g WHERE len(list_filter(l, lambda x: length(x) < 3 OR x IN {STOP_SQL})) = 0)
SELECT term, count(*) AS freq, bool_or(cap) AS cap FROM k GROUP BY 1 HAVING count(*) >= 2 OR bool_or(cap)""")
def _(spark, d):
    return E.term_spans(Graph(spark, d).chunks)


@query("ent_03_entity_table", ENT.replace("SELECT DISTINCT c.chunk_id, lower(w) AS name", "SELECT c.chunk_id, lower(w) AS name, w AS surface") + f", s AS (SELECT name, {STEM.format(w='name')} AS st, count(*) AS frequency, count(DISTINCT chunk_id) AS n_chunks FROM e GROUP BY 1, 2), dis AS (SELECT name, arg_max(surface, {{'n': n, 's': surface}}) AS display FROM (SELECT name, surface, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) SELECT s.name, dis.display, s.frequency, s.n_chunks FROM s JOIN dis USING (name) WHERE s.st NOT IN (SELECT {STEM.format(w='concept')} FROM idf)")
def _(spark, d):
    g = Graph(spark, d)
    spans = g.chunks.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("surface"))
    return E.entity_table(spans, g.idf.select("concept"))


@query("ent_06_recovery", ENT + ", q AS (SELECT DISTINCT item_id, lower(w) AS target FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS w FROM benchmark)), n AS (SELECT DISTINCT name FROM e) SELECT item_id, target, EXISTS (SELECT 1 FROM n WHERE n.name = q.target) AS recovered FROM q")
def _(spark, d):
    g = Graph(spark, d)
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("w")).select("item_id", F.lower("w").alias("target")).distinct()
    return E.recovered(q, _names(g).select("name").distinct())


@query("ent_08_components", "WITH RECURSIVE " + RELATIONS + ", strong AS (SELECT src, dst FROM adj WHERE prob > 0.12), r AS (SELECT 0 AS k, src AS node, src AS root FROM (SELECT DISTINCT src FROM strong) UNION ALL SELECT k + 1, node, least(root, m) FROM (SELECT r.k, r.node, r.root, min(x.root) AS m FROM r JOIN strong s ON s.src = r.node JOIN r x ON x.node = s.dst AND x.k = r.k GROUP BY 1, 2, 3) WHERE k < 25) SELECT node, root FROM r WHERE k = 25")
def _(spark, d):
    return G.components(Graph(spark, d).relations.filter("prob > 0.12").select("a", "b"))


@query("ent_09_stem_merge", ENT + f" SELECT {STEM.format(w='e.name')} AS stem, arg_max(e.name, {{'f': f.f, 'n': e.name}}) AS display, count(DISTINCT e.chunk_id) AS n_chunks FROM e JOIN f USING (name) GROUP BY 1")
def _(spark, d):
    return E.stem_merge(_names(Graph(spark, d)))


# Readouts come as a table; words of chunks by rank of frequency stand in for a model's layers.
READOUT = TOKENS + ", ro AS (SELECT chunk_id, layer, word AS token, 1.0 / (1 + abs(layer - 6 - length(word) % 9)) AS prob FROM (SELECT chunk_id, word, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, word) AS rk FROM tokens) t, (SELECT unnest(range(4, 20)) AS layer) WHERE rk <= 8 AND abs(layer - 6 - length(word) % 9) <= 3)"


def _readout(g):
    from pyspark.sql import Window

    few = g.tokens.withColumn("rk", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("tf"), "word"))).filter("rk <= 8")
    rows = few.select("chunk_id", F.col("word").alias("token"), F.explode(F.sequence(F.lit(4), F.lit(19))).alias("layer")).withColumn("off", F.abs(F.col("layer") - 6 - F.length("token") % 9))
    return rows.filter("off <= 3").select("chunk_id", F.col("layer").cast("long").alias("layer"), "token", (F.lit(1.0) / (1 + F.col("off"))).alias("prob"))


PROFILES = READOUT + ", bw AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)), prof AS (SELECT chunk_id, token AS word, sum(layer * prob) / sum(prob) AS com, min(layer) AS first, max(layer) AS last, count(DISTINCT layer) AS n_layers, sum(prob) AS total, token IN (SELECT w FROM bw) AS in_corpus FROM ro GROUP BY 1, 2 HAVING count(DISTINCT layer) >= 3 AND max(layer) >= 10)"


def _profiles(g, d):
    words = table(g.spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    return G.depth_profiles(_readout(g), words)


@query("con_03_depth_profiles", "WITH " + PROFILES + " SELECT chunk_id, word, round(com, 6) AS com, first, last, n_layers, last - first AS span, in_corpus FROM prof")
def _(spark, d):
    p = _profiles(Graph(spark, d), d)
    return p.select("chunk_id", "word", F.round("com", 6).alias("com"), "first", "last", "n_layers", "span", "in_corpus")


@query("con_04_gap_split", "WITH " + PROFILES + """, e AS (SELECT *, in_corpus OR count(*) FILTER (WHERE in_corpus) OVER (PARTITION BY chunk_id) < 2 AS used FROM (SELECT chunk_id, word, round(com, 6) AS com, in_corpus FROM prof)),
o AS (SELECT *, coalesce(round(com - lag(com) OVER w, 9), 0) AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY chunk_id, used) AS n FROM e WINDOW w AS (PARTITION BY chunk_id, used ORDER BY com, word)),
c AS (SELECT chunk_id, used, max(gap) AS g, arg_max(com, {'g': gap, 'i': -i}) AS at, max(com) FILTER (WHERE i = n // 2 + 1) AS mid FROM o GROUP BY 1, 2)
SELECT o.chunk_id, o.word, CASE WHEN NOT o.used THEN 'noise' WHEN o.n <= 1 THEN 'meta' WHEN o.com < CASE WHEN c.g >= 2 THEN c.at ELSE c.mid END THEN 'meta' ELSE 'sub' END AS role FROM o JOIN c USING (chunk_id, used)""")
def _(spark, d):
    p = _profiles(Graph(spark, d), d).withColumn("com", F.round("com", 6))
    return G.gap_split(p).select("chunk_id", "word", "role")


@query("con_05_onset", "WITH " + READOUT + " SELECT chunk_id, min(layer) FILTER (WHERE n >= 2) AS onset FROM (SELECT chunk_id, layer, count(DISTINCT token) AS n FROM ro GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return G.onset(_readout(Graph(spark, d)))


@query("con_05_layer_overlap", "WITH " + READOUT + ", p AS (SELECT x.chunk_id AS first, y.chunk_id AS second FROM chunks x JOIN chunks y ON x.doc_id = y.doc_id AND y.ord = x.ord + 1), r AS (SELECT DISTINCT chunk_id, layer, token FROM ro), a AS (SELECT p.first, p.second, r.layer, r.token FROM p JOIN r ON r.chunk_id = p.first), b AS (SELECT p.first, p.second, r.layer, r.token FROM p JOIN r ON r.chunk_id = p.second) SELECT first, second, layer, (count(*) FILTER (WHERE x AND y))::INT AS both, (count(*) FILTER (WHERE x AND NOT y))::INT AS only_first, (count(*) FILTER (WHERE y AND NOT x))::INT AS only_second FROM (SELECT coalesce(a.first, b.first) AS first, coalesce(a.second, b.second) AS second, coalesce(a.layer, b.layer) AS layer, a.token IS NOT NULL AS x, b.token IS NOT NULL AS y FROM a FULL JOIN b ON a.first = b.first AND a.second = b.second AND a.layer = b.layer AND a.token = b.token) GROUP BY 1, 2, 3")
def _(spark, d):
    """Every chunk with the next of its document."""
    g = Graph(spark, d)
    c = g.chunks.select("doc_id", "chunk_id", F.col("ord").alias("k"))
    pairs = c.select("doc_id", F.col("chunk_id").alias("first"), (F.col("k") + 1).alias("k")).join(c.withColumnRenamed("chunk_id", "second"), ["doc_id", "k"]).select("first", "second")
    return G.compare_layers_of(_readout(g), pairs)


@query("con_08_quality", "WITH " + CONCEPTS + f", bw AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)), p AS (SELECT chunk_id, {POS.format(w='concept')} AS pos, concept IN (SELECT w FROM bw) AS hit, length(concept) <= 6 AS short FROM cc) SELECT chunk_id, count(*) AS n, round(avg(hit::INT), 6) AS hit, round(avg((short AND NOT hit)::INT), 6) AS fragment, round(avg((pos IN ('VBG', 'VBD'))::INT), 6) AS verb, round(avg((pos = 'JJ')::INT), 6) AS adjective, round(count(*) FILTER (WHERE hit AND pos IN ('NN', 'NNS', 'UNK')) / greatest(count(*) FILTER (WHERE hit), 1), 6) AS noun FROM p GROUP BY 1")
def _(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    return rounded(C.quality(Graph(spark, d).cc, words, "chunk_id"), "hit", "fragment", "verb", "adjective", "noun")


@query("rel_02_pairs", "WITH " + RELATIONS + " SELECT a, b, n, context, round(prob, 6) AS prob FROM relations")
def _(spark, d):
    return rounded(Graph(spark, d).relations, "prob")


@query("rel_04_pair_context", "WITH " + RELATIONS + """, p AS (SELECT a, b FROM relations), s AS (SELECT cc.*, length(c.text) AS size FROM cc JOIN chunks c USING (chunk_id)),
com AS (SELECT p.a, p.b, arg_min(x.chunk_id, {'s': x.size, 'c': x.chunk_id}) AS bo FROM p JOIN s x ON x.concept = p.a JOIN s y ON y.concept = p.b AND y.chunk_id = x.chunk_id GROUP BY 1, 2), one AS (SELECT concept, arg_min(chunk_id, {'s': size, 'c': chunk_id}) AS own FROM s GROUP BY 1)
SELECT p.a, p.b, CASE WHEN com.bo IS NOT NULL THEN 'common' ELSE 'joined' END AS strategy, coalesce(com.bo, x.own || '+' || y.own) AS context FROM p LEFT JOIN com USING (a, b) LEFT JOIN one x ON x.concept = p.a LEFT JOIN one y ON y.concept = p.b""")
def _(spark, d):
    """All pairs of the relations."""
    g = Graph(spark, d)
    return G.pair_context(g.relations.select("a", "b"), g.cc, g.chunks)


@query("rel_05_top_pairs", "WITH " + RELATIONS + " SELECT a, b, n FROM relations ORDER BY n DESC, a, b LIMIT 50")
def _(spark, d):
    return Graph(spark, d).relations.orderBy(F.desc("n"), "a", "b").limit(50).select("a", "b", "n")


BUCKET_SQL = "CASE st " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.BUCKETS.items()) + " ELSE 'other' END"


@query("rel_07_buckets", "WITH " + CHUNKS + f", w AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM conversations) UNION SELECT unnest([{', '.join(repr(k) for k in G.BUCKETS)}]) ) SELECT word, {BUCKET_SQL} AS bucket FROM (SELECT word, {STEM.format(w='word')} AS st FROM w)")
def _(spark, d):
    """Every word of the documents and conversations, and the rules' own words."""
    words = [table(spark, d, t).select(F.explode(T.words("text")).alias("word")) for t in ("documents", "conversations")]
    own = spark.createDataFrame([(w,) for w in G.BUCKETS], "word string")
    return words[0].union(words[1]).distinct().union(own).distinct().select("word", G.relation_bucket(F.col("word")).alias("bucket"))


@query("rel_09_disambiguation", "WITH " + RELATIONS + f", l AS (SELECT concept, list(DISTINCT {STEM.format(w='o.dst')}) AS w FROM idf JOIN adj o ON o.src = concept GROUP BY 1) SELECT r.a, r.b, CASE WHEN len(list_intersect(x.w, y.w)) >= 2 THEN 'same' WHEN len(list_intersect(x.w, y.w)) = 1 THEN 'near' ELSE 'diff' END AS verdict FROM relations r JOIN l x ON x.concept = r.a JOIN l y ON y.concept = r.b")
def _(spark, d):
    g = Graph(spark, d)
    return G.disambiguated(g.relations, g.adjacent)


@query("rel_10_trace", "WITH t AS (SELECT user_id AS run, extract('hour' FROM ts) AS step, event_type AS word, value AS prob FROM events) SELECT run, word, count(DISTINCT step) AS n_steps, round(max(prob), 6) AS best, arg_min(step, {'p': -prob, 's': step}) AS best_step FROM t GROUP BY 1, 2 HAVING count(DISTINCT step) >= 2 AND max(prob) >= 0.05")
def _(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("run"), F.hour("ts").cast("long").alias("step"), F.col("event_type").alias("word"), F.col("value").alias("prob"))
    return rounded(G.trace(t), "best")


@query("ret_01_flat", "WITH " + RELATIONS + " SELECT qid, id, score, rk FROM (SELECT qid, chunk_id AS id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rk FROM flat) WHERE rk <= 30")
def _(spark, d):
    return R.top(rounded(Graph(spark, d).flat, "score"), 30)


def _relation_sql(weight, hops):
    two = ", h2 AS (SELECT DISTINCT h1.qid, a.dst AS concept FROM h1 JOIN adj a ON a.src = h1.concept WHERE NOT EXISTS (SELECT 1 FROM seed_concepts s WHERE s.qid = h1.qid AND s.concept = a.dst) AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.qid = h1.qid AND x.concept = a.dst))" if hops == 2 else ""
    return f""", h1 AS (SELECT DISTINCT s.qid, a.dst AS concept FROM seed_concepts s JOIN adj a ON a.src = s.concept WHERE NOT EXISTS (SELECT 1 FROM seed_concepts t WHERE t.qid = s.qid AND t.concept = a.dst)){two},
wq AS (SELECT qid, concept, 1.0 AS w FROM seed_concepts UNION ALL SELECT qid, concept, {weight} FROM h1{f" UNION ALL SELECT qid, concept, {weight} * {weight} FROM h2" if hops == 2 else ""}),
rp AS (SELECT wq.qid, m.chunk_id AS id, sum(wq.w * m.w) AS score FROM wq JOIN m USING (concept) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = wq.qid AND s.chunk_id = m.chunk_id) GROUP BY 1, 2)"""


@query("ret_01_relation_propagate", "WITH " + RELATIONS + _relation_sql(0.7, 1) + " SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM rp) WHERE rk <= 30")
def _(spark, d):
    g = Graph(spark, d)
    return G.relation_best(g.own, g.adjacent, g.m, g.seeds, 0.7, 1, 30).drop("rk")


@query("ret_02_relation_two_hops", "WITH " + RELATIONS + _relation_sql(0.1, 2) + " SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rk FROM rp) WHERE rk <= 30")
def _(spark, d):
    g = Graph(spark, d)
    return G.relation_best(g.own, g.adjacent, g.m, g.seeds, 0.1, 2, 30).drop("rk")


@query("ret_04_matrix_retrieve", "WITH " + RELATIONS + """, qv AS (SELECT s.qid, s.concept, i.idf AS w FROM seed_concepts s JOIN idf i USING (concept)), wq AS (SELECT qid, concept, sum(w) AS w FROM (SELECT * FROM qv UNION ALL SELECT qv.qid, p.dst, 0.5 * 0.7 * p.n * qv.w FROM qv JOIN (SELECT a AS src, b AS dst, n FROM relations UNION ALL SELECT b, a, n FROM relations) p ON p.src = qv.concept) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 5) DESC, id) AS rk FROM (SELECT wq.qid, m.chunk_id AS id, sum(wq.w * m.w) AS score FROM wq JOIN m USING (concept) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = wq.qid AND s.chunk_id = m.chunk_id) GROUP BY 1, 2)) WHERE rk <= 10""")
def _(spark, d):
    g = Graph(spark, d)
    q = g.own.join(g.idf, "concept").select("qid", "concept", F.col("idf").alias("weight"))
    near = q.join(G.both_ways(g.relations, "a", "b", "n"), F.col("concept") == F.col("src")).select("qid", F.col("dst").alias("concept"), F.col("n") * 0.5 * 0.7 * F.col("weight"))
    every = q.union(near).groupBy("qid", "concept").agg(F.sum("weight").alias("weight"))
    return R.top(rounded(G.propagate(every, g.m, g.seeds), "score", digits=5), 10)


@query("ret_05_hierarchical", "WITH " + RELATIONS + " SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rk FROM (SELECT c.qid, m.chunk_id AS id, sum(m.w * CASE WHEN i.df >= 6 THEN 1.0 ELSE 1.5 END) AS s FROM seed_concepts c JOIN m USING (concept) JOIN idf i USING (concept) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = c.qid AND s.chunk_id = m.chunk_id) GROUP BY 1, 2)) WHERE rk <= 10")
def _(spark, d):
    g = Graph(spark, d)
    kinds = g.own.join(g.idf.select("concept", "df"), "concept")
    meta = G.propagate(kinds.filter("df >= 6").select("qid", "concept"), g.m, g.seeds)
    sub = G.propagate(kinds.filter("df < 6").select("qid", "concept"), g.m, g.seeds)
    both = meta.union(sub.withColumn("score", F.col("score") * 1.5)).groupBy("qid", "id").agg(F.sum("score").alias("score"))
    return R.top(rounded(both, "score"), 10)


MERGED = """, fl AS (SELECT qid, chunk_id AS id, round(score, 6) AS score FROM flat), tiers AS (SELECT qid, chunk_id AS id, 0 AS tier, rk::DOUBLE AS o FROM seeds UNION ALL SELECT qid, id, 1, -score FROM fl UNION ALL SELECT qid, chunk_id, 2, rk::DOUBLE FROM dense WHERE rk <= 100),
firsts AS (SELECT qid, id, min({'tier': tier, 'o': o}) AS t FROM tiers GROUP BY 1, 2), merged AS (SELECT qid, id, rk FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY t.tier, t.o, id) AS rk FROM firsts) WHERE rk <= 10)"""


def merged(g):
    return G.merge_ranking(g.seeds, rounded(g.flat, "score"), g.dense)


@query("ret_06_merge_backfill", "WITH " + RELATIONS + MERGED + " SELECT qid, id, rk FROM merged")
def _(spark, d):
    return merged(Graph(spark, d))


@query("ret_07_dual_level", "WITH " + RELATIONS + """, eh AS (SELECT qid, concept AS name, s AS score FROM (SELECT q.qid, i.concept, round(i.idf / 10, 6) AS s, row_number() OVER (PARTITION BY q.qid ORDER BY round(i.idf / 10, 6) DESC, i.concept) AS rk FROM q_tokens q JOIN idf i ON i.concept = q.word) WHERE rk <= 20),
rh AS (SELECT qid, a, b, s FROM (SELECT e.qid, r.a, r.b, round(e.score * r.prob, 6) AS s, row_number() OVER (PARTITION BY e.qid ORDER BY round(e.score * r.prob, 6) DESC, r.a, r.b) AS rk FROM eh e JOIN relations r ON r.a = e.name) WHERE rk <= 20),
b AS (SELECT qid, name, max(s) AS s FROM (SELECT qid, name, score AS s FROM eh UNION ALL SELECT qid, a, s FROM rh UNION ALL SELECT qid, b, s FROM rh) GROUP BY 1, 2), ev AS (SELECT qid, name, max(s) AS s FROM (SELECT * FROM b UNION ALL SELECT b.qid, j.dst, 0.5 * b.s FROM b JOIN adj j ON j.src = b.name) GROUP BY 1, 2)
SELECT qid, cc.chunk_id AS id, round(max(s), 7) AS score FROM ev JOIN cc ON cc.concept = ev.name GROUP BY 1, 2""")
def _(spark, d):
    g = Graph(spark, d)
    words = g.questions.select("qid", F.explode(T.content_tokens("text")).alias("concept"))
    hits = words.join(g.idf, "concept").select("qid", F.col("concept").alias("name"), F.round(F.col("idf") / 10, 6).alias("score"))
    hits = R.top(hits, 20, tie="name").drop("rk")
    rel = hits.join(g.relations, F.col("name") == F.col("a")).select("qid", "a", "b", F.round(F.col("score") * F.col("prob"), 6).alias("score"))
    from pyspark.sql import Window

    rel = rel.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "a", "b"))).filter("rk <= 20").drop("rk")
    return rounded(G.dual_level(hits, rel, g.adjacent, g.cc.select(F.col("concept").alias("name"), "chunk_id")), "score", digits=7)


PPR = RELATIONS + """, pe AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, greatest(prob, 1e-3) AS w FROM adj UNION ALL SELECT concept, chunk_id, 1.0 FROM cc UNION ALL SELECT chunk_id, concept, 1.0 FROM cc) GROUP BY 1, 2), po AS (SELECT src, sum(w) AS o FROM pe GROUP BY 1), pt AS (SELECT src, dst, w / o AS t FROM pe JOIN po USING (src)),
ps AS (SELECT qid, concept AS node, 1.0 / count(*) OVER (PARTITION BY qid) AS s FROM seed_concepts),
pr AS (SELECT 0 AS k, qid, node, s AS p FROM ps UNION ALL SELECT k + 1, qid, node, sum(p) FROM (SELECT r.k, r.qid, t.dst AS node, 0.5 * r.p * t.t AS p FROM pr r JOIN pt t ON t.src = r.node WHERE r.k < 10 UNION ALL SELECT g.k, s.qid, s.node, 0.5 * s.s FROM ps s, (SELECT DISTINCT k FROM pr WHERE k < 10) g) GROUP BY 1, 2, 3)"""


def _page_rank(g, own):
    contains = G.both_ways(g.cc, "concept", "chunk_id").withColumn("w", F.lit(1.0))
    edges = g.adjacent.select("src", "dst", F.greatest("prob", F.lit(1e-3)).alias("w")).union(contains)
    reset = own.select("qid", F.col("concept").alias("node"), F.lit(1.0).alias("s"))
    p = G.page_rank(edges, reset, 0.5, 10)
    return p.filter("node like '%::chunk_%'").select("qid", F.col("node").alias("id"), F.round("p", 8).alias("p"))


@query("ret_09_page_rank", "WITH RECURSIVE " + PPR + " SELECT qid, node AS id, round(p, 8) AS p FROM pr WHERE k = 10 AND node LIKE '%::chunk_%'")
def _(spark, d):
    """Every question."""
    g = Graph(spark, d)
    return _page_rank(g, g.own)


@query("ret_09_passage_seeds", "WITH " + SEEDS + ", f AS (SELECT qid, chunk_id AS id, score FROM dense WHERE rk <= 100) SELECT qid, id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) * 0.05 ELSE 0 END, 6) AS s FROM f WINDOW w AS (PARTITION BY qid)")
def _(spark, d):
    return rounded(G.min_max(Graph(spark, d).dense.select("qid", "id", "score"), 0.05), "s")


@query("ret_09_phrase_seeds", "WITH " + RELATIONS + ", fact AS (SELECT qid, a, b, s FROM (SELECT c.qid, r.a, r.b, round(r.prob, 6) AS s, row_number() OVER (PARTITION BY c.qid ORDER BY round(r.prob, 6) DESC, r.a, r.b) AS rk FROM seed_concepts c JOIN relations r ON r.a = c.concept) WHERE rk <= 5), mean AS (SELECT qid, node, round(avg(s / i.df), 9) AS s FROM (SELECT qid, a AS node, s FROM fact UNION ALL SELECT qid, b, s FROM fact) JOIN idf i ON i.concept = node GROUP BY 1, 2) SELECT qid, node, s FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY s DESC) AS rk FROM mean) WHERE rk <= 5")
def _(spark, d):
    from pyspark.sql import Window

    g = Graph(spark, d)
    f = g.own.join(g.relations, F.col("concept") == F.col("a")).select("qid", "a", "b", F.round("prob", 6).alias("score"))
    f = f.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "a", "b"))).filter("rk <= 5").drop("rk")
    return G.phrase_seeds(f, g.idf.select(F.col("concept").alias("node"), "df"), digits=9)


@query("ret_17_concept_query", "WITH " + RELATIONS + """, hit AS (SELECT q.qid, i.concept, i.idf AS w FROM q_tokens q JOIN idf i ON i.concept = q.word), u AS (SELECT qid, concept, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM hit), s AS (SELECT qid, m.chunk_id AS id, round(sum(u.w * m.w), 6) AS score FROM u JOIN m USING (concept) GROUP BY 1, 2),
b AS (SELECT s.qid, s.id, s.score, coalesce(d.score, 0) AS dense FROM s LEFT JOIN dense d ON d.qid = s.qid AND d.chunk_id = s.id AND d.rk <= 100) SELECT qid, id, round((dense - avg(dense) OVER w) / CASE WHEN stddev_pop(dense) OVER w > 0 THEN stddev_pop(dense) OVER w ELSE 1 END + 0.5 * (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 0 THEN stddev_pop(score) OVER w ELSE 1 END, 5) AS score FROM b WINDOW w AS (PARTITION BY qid)""")
def _(spark, d):
    g = Graph(spark, d)
    words = g.questions.select("qid", F.explode(T.content_tokens("text")).alias("concept"))
    q = E.unit_weights(words.join(g.idf, "concept").select("qid", "concept", F.col("idf").alias("weight")))
    none = g.seeds.filter("false")
    s = rounded(G.propagate(q, g.m, none), "score")
    both = s.join(g.dense.select("qid", "id", F.col("score").alias("dense")), ["qid", "id"], "left").fillna(0.0, ["dense"])
    z = V.z_scores(V.z_scores(both, "qid", "dense", "zd"), "qid", "score", "zs")
    return z.select("qid", "id", F.round(F.col("zd") + 0.5 * F.col("zs"), 5).alias("score"))


@query("ret_20_geometric_attributes", "WITH " + RELATIONS + f", p AS (SELECT a.src AS c, a.dst AS w, round(a.prob * (SELECT max(n) FROM relations), 6) AS f FROM adj a WHERE {STEM.format(w='a.src')} <> {STEM.format(w='a.dst')}) SELECT c, w, score, rk FROM (SELECT c, w, round(f * i.idf, 5) AS score, row_number() OVER (PARTITION BY c ORDER BY round(f * i.idf, 5) DESC, w) AS rk FROM p JOIN idf i ON i.concept = p.w) WHERE rk <= 5")
def _(spark, d):
    g = Graph(spark, d)
    co = G.both_ways(g.relations, "a", "b", "n").filter(T.stem("src") != T.stem("dst"))
    rows = co.join(g.idf, F.col("dst") == F.col("concept")).select(F.col("src").alias("c"), F.col("dst").alias("w"), F.round(F.col("n") * F.col("idf"), 5).alias("score"))
    return R.top(rows, 5, "c", "score", "w")


@query("ret_22_two_hop_paths", "WITH " + RELATIONS + ", s AS (SELECT * FROM adj WHERE prob >= 0.15) SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM s x JOIN s y ON x.dst = y.src WHERE x.src < y.dst")
def _(spark, d):
    return G.two_hop(Graph(spark, d).adjacent.filter("prob >= 0.15"))


@query("ret_22_strongest_paths", "WITH " + RELATIONS + ", t AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY prob DESC, dst) AS rk FROM adj) WHERE rk <= 2) SELECT min(dst) AS a, src AS b, max(dst) AS c FROM t GROUP BY src HAVING count(*) = 2")
def _(spark, d):
    return G.strongest_path(Graph(spark, d).adjacent)


@query("ret_23_squared_weights", "WITH " + RELATIONS + ", s AS (SELECT src, dst, max(prob) AS w FROM adj WHERE prob >= 0.1 GROUP BY 1, 2) SELECT x.src AS a, y.dst AS c, round(sum(x.w * y.w), 6) AS w FROM s x JOIN s y ON x.dst = y.src WHERE x.src < y.dst GROUP BY 1, 2")
def _(spark, d):
    return rounded(G.squared(Graph(spark, d).adjacent.filter("prob >= 0.1")), "w")


@query("ret_26_other_seed_space", "WITH " + RELATIONS + ", sj AS (SELECT qid, chunk_id, rk FROM (SELECT q.qid, t.chunk_id, row_number() OVER (PARTITION BY q.qid ORDER BY count(*) DESC, t.chunk_id) AS rk FROM q_tokens q JOIN tokens t USING (word) GROUP BY 1, 2) WHERE rk <= 5), sc AS (SELECT DISTINCT sj.qid, cc.concept FROM sj JOIN cc USING (chunk_id)) SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rk FROM (SELECT sc.qid, m.chunk_id AS id, sum(m.w) AS s FROM sc JOIN m USING (concept) WHERE NOT EXISTS (SELECT 1 FROM sj WHERE sj.qid = sc.qid AND sj.chunk_id = m.chunk_id) GROUP BY 1, 2)) WHERE rk <= 10")
def _(spark, d):
    g = Graph(spark, d)
    words = g.questions.select("qid", F.explode(T.content_tokens("text")).alias("word"))
    other = words.join(g.tokens, "word").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.count("*").alias("score"))
    seed = G.seeds(other)
    return R.top(rounded(G.propagate(G.seed_concepts(seed, g.cc), g.m, seed), "score"), 10)


@query("lin_01_tensor", "WITH " + RELATIONS + ", t AS (SELECT src AS a, CASE WHEN prob >= 0.5 THEN 'strong' WHEN prob >= 0.1 THEN 'middle' ELSE 'weak' END AS bucket, dst AS b, prob FROM adj) SELECT a, bucket, b, round(max(prob), 6) AS v FROM t GROUP BY 1, 2, 3")
def _(spark, d):
    bucket = F.when(F.col("prob") >= 0.5, "strong").when(F.col("prob") >= 0.1, "middle").otherwise("weak")
    return rounded(G.tensor(Graph(spark, d).relations, bucket), "v")


@query("kg_01_code_graph", "WITH s AS (SELECT DISTINCT 'f' || p_size AS file, p_name AS symbol FROM part), u AS (SELECT DISTINCT 'f' || (p_size + 1) AS file, p_name AS word FROM part), o AS (SELECT symbol, max(file) AS owner FROM s GROUP BY 1) SELECT file AS source, 'DEFINES' AS relation, file || '::' || symbol AS target FROM s UNION ALL SELECT DISTINCT u.file, 'REFERENCES', owner || '::' || symbol FROM u JOIN o ON o.symbol = u.word WHERE u.file <> owner")
def _(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.concat(F.lit("f"), "p_size").alias("file"), F.col("p_name").alias("symbol")).distinct()
    u = p.select(F.concat(F.lit("f"), F.col("p_size") + 1).alias("file"), F.col("p_name").alias("word")).distinct()
    return G.code_graph(None, s, u)


KG = "r AS (SELECT DISTINCT 'u' || (user_id % 20) AS name, extract('hour' FROM ts) AS chapter FROM events), o AS (SELECT r.* FROM r JOIN (SELECT name FROM r GROUP BY 1 HAVING count(*) >= 2) USING (name)), kg AS (SELECT name AS source, 'APPEARS_IN' AS relation, chapter::VARCHAR AS target, NULL::BIGINT AS weight FROM o UNION ALL SELECT x.name, 'INTERACTS_WITH', y.name, count(*) FROM o x JOIN o y ON x.chapter = y.chapter AND x.name < y.name GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


def _kg(spark, d):
    r = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("name"), F.hour("ts").alias("chapter"))
    return G.appearance_graph(r)


@query("kg_02_appearances", f"WITH {KG} SELECT * FROM kg")
def _(spark, d):
    return _kg(spark, d)


@query("kg_03_citations", "SELECT doc_id AS source, 'DISCUSSED_IN' AS relation, unnest(list_distinct(regexp_extract_all(lower(text), 'version (\\d)', 1))) AS target FROM documents WHERE regexp_matches(lower(text), 'version \\d')")
def _(spark, d):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"version (\d)"), F.lit(1)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.lit("DISCUSSED_IN").alias("relation"), F.explode(found).alias("target"))


@query("kg_04_questions", f"WITH {KG} SELECT source, relation, 'What does ' || source || ' ' || lower(replace(relation, '_', ' ')) || '?' AS question, string_agg(DISTINCT target, ',' ORDER BY target) AS answers FROM kg GROUP BY 1, 2 HAVING count(DISTINCT target) BETWEEN 1 AND 30")
def _(spark, d):
    return G.graph_questions(_kg(spark, d), 1, 30).withColumn("answers", F.array_join("answers", ","))


@query("kg_05_grep_truth", "SELECT DISTINCT w AS word, doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{3,}')) AS w FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{3,}"), F.lit(0))).alias("word"), "doc_id").distinct()
