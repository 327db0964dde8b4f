"""Queries of the steps around a model: caches of its results, upserts, reranking, fact filters, fallbacks, kept entities, judges.

The models are the stand-ins of plugins.py, whose results SQL can compute as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import plugins as P
from loomgraph.functions import text as T
from loomgraph.operators import concepts as C
from loomgraph.operators import readout as D
from loomgraph.session import scratch_path, stored
from loomgraph.sinks import cache

from .base import RELATIONS, SEEDS, STOP_SQL, TOKENS, query, table
from .graph_queries import PROFILES, Graph, _profiles, _readout, rounded

WORDS_OF = "SELECT DISTINCT {id}, w FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {table})"


@query("snk_02_keyword_cache", rf"""WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM benchmark),
c AS (SELECT text, w AS kw, count(*) AS c FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM t) WHERE length(w) >= 4 AND w NOT IN {STOP_SQL} GROUP BY 1, 2),
r AS (SELECT text, kw, c, max(c) OVER (PARTITION BY text) AS m, row_number() OVER (PARTITION BY text ORDER BY c DESC, kw) AS rk FROM c)
SELECT b.item_id, r.kw, round(r.c::DOUBLE / r.m, 6) AS w FROM benchmark b JOIN r ON coalesce(b.text, '') = r.text WHERE rk <= 8""")
def _(spark, d):
    got = cache.keyworded(table(spark, d, "benchmark").select("item_id", "text"), P.counted_keywords(8), "counted/8", "document")
    return rounded(got.select("item_id", F.inline("keywords")), "w")


@query("snk_03_upsert", "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN -length(coalesce(text, '')) ELSE length(coalesce(text, '')) END::INT AS n FROM documents")
def _(spark, d):
    """All languages are written, then English ones anew with other values."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    path = scratch_path(spark, "upsert")
    cache.upsert(rows, path, "lang")
    cache.upsert(rows.filter("lang = 'en'").withColumn("n", -F.col("n")), path, "lang")
    return spark.read.schema("doc_id long, n int, lang string").parquet(path)


@query("ret_18_rerank", "WITH " + SEEDS + f""", qw AS ({WORDS_OF.format(id='item_id', table='benchmark')}), tw AS ({WORDS_OF.format(id='chunk_id', table='chunks')}), qn AS (SELECT item_id, count(*) AS n FROM qw GROUP BY 1),
s AS (SELECT d.qid, d.chunk_id AS id, count(t.w)::DOUBLE / max(qn.n) AS score FROM dense d JOIN qw ON qw.item_id = d.qid JOIN qn ON qn.item_id = d.qid LEFT JOIN tw t ON t.chunk_id = d.chunk_id AND t.w = qw.w WHERE d.rk <= 20 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM s)
SELECT qid, id, round(score, 6) AS score, rk FROM k WHERE rk <= 10""")
def _(spark, d):
    g = Graph(spark, d)
    chunks = g.chunks.select(F.col("chunk_id").alias("id"), "text")
    pairs = g.dense.filter("rk <= 20").select("qid", "id").join(g.questions.select("qid", F.col("text").alias("question")), "qid").join(chunks, "id")
    return rounded(P.reranked(pairs, P.shared_words()), "score")


@query("ret_10_fact_filter", "WITH " + RELATIONS + f""", qw AS ({WORDS_OF.format(id='item_id', table='benchmark')})
SELECT c.qid, r.a, r.b FROM seed_concepts c JOIN relations r ON r.a = c.concept
WHERE EXISTS (SELECT 1 FROM qw WHERE qw.item_id = c.qid AND qw.w IN (r.a, r.b)) OR NOT EXISTS (SELECT 1 FROM qw WHERE qw.item_id = c.qid)""")
def _(spark, d):
    g = Graph(spark, d)
    facts = g.own.join(g.relations, F.col("concept") == F.col("a")).select("qid", "a", "b").join(g.questions, "qid")
    prompt = F.concat_ws("\x1f", F.coalesce("text", F.lit("")), F.concat_ws(" ", "a", "b"))
    return P.kept_facts(facts.withColumn("prompt", prompt), P.word_recogniser()).select("qid", "a", "b")


@query("con_06_fallbacks", "WITH " + PROFILES + """, t AS (SELECT chunk_id, word, round(com, 6) AS score, 0 AS tier FROM prof WHERE in_corpus UNION ALL SELECT chunk_id, word, round(com, 6), 1 FROM prof UNION ALL SELECT chunk_id, token, round(prob, 6), 2 FROM ro WHERE layer = 10),
u AS (SELECT chunk_id, coalesce(min(tier) FILTER (WHERE c >= 2), 2) AS until FROM (SELECT chunk_id, tier, count(DISTINCT word) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT t.*, row_number() OVER (PARTITION BY chunk_id, word ORDER BY tier, score DESC) AS one FROM t JOIN u USING (chunk_id) WHERE tier <= until),
k AS (SELECT chunk_id, word, tier, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, score DESC, word) AS rk FROM o WHERE one = 1)
SELECT chunk_id, word, tier, rk FROM k WHERE rk <= 8""")
def _(spark, d):
    """Strict words are profiles that the questions have too, relaxed ones all profiles, single ones layer 10's."""
    g = Graph(spark, d)
    p = stored(_profiles(g, d).withColumn("score", F.round("com", 6)), "profiles")
    single = _readout(g).filter("layer = 10").select("chunk_id", F.col("token").alias("word"), F.round("prob", 6).alias("score"))
    return D.with_fallbacks(p.filter("in_corpus"), p, single)


_INNER = "[a-z,;] ([A-Z][a-z]+)"
_CAPS = "[A-Z]{4,}"


@query("ent_05_kept_entities", "WITH " + TOKENS + rf""", c AS (SELECT word, sum(tf) AS total FROM tokens GROUP BY 1),
e AS (SELECT chunk_id, word FROM (SELECT t.chunk_id, t.word, row_number() OVER (PARTITION BY t.chunk_id ORDER BY t.tf DESC, t.word) AS rk FROM tokens t JOIN c USING (word) WHERE t.tf >= 2 OR c.total >= 20) WHERE rk <= 16 AND NOT (word LIKE '%ing' OR (word LIKE '%ed' AND word NOT LIKE '%eed'))),
i AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_INNER}', 1)) AS w FROM chunks) GROUP BY 1), a AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '{_CAPS}')) AS w FROM chunks)), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT e.chunk_id, e.word AS span FROM e LEFT JOIN i USING (word) WHERE e.word IN (SELECT word FROM a) OR coalesce(i.n, 0) >= 2 OR (coalesce(i.n, 0) >= 1 AND e.word NOT IN (SELECT w FROM b))""")
def _(spark, d):
    """Words that the questions have stand for a dictionary's."""
    g = Graph(spark, d)
    inner = g.chunks.select(F.explode(F.regexp_extract_all("text", F.lit(_INNER), F.lit(1))).alias("w")).select(F.lower("w").alias("span"), F.lit(1).alias("inner"), F.lit(False).alias("caps"))
    caps = g.chunks.select(F.explode(F.regexp_extract_all("text", F.lit(_CAPS), F.lit(0))).alias("w")).select(F.lower("w").alias("span"), F.lit(0).alias("inner"), F.lit(True).alias("caps"))
    surfaces = inner.union(caps).groupBy("span").agg(F.max("caps").alias("caps"), F.sum("inner").alias("inner_caps"))
    known = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word"))
    return D.single_entities(C.entity_tokens(g.tokens).select("chunk_id", F.col("word").alias("span")), surfaces, known)


@query("udf_03_judge", """WITH x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Yes, part of it' WHEN 1 THEN ' no: UNRELATED' WHEN 2 THEN 'is-a' END AS reply FROM benchmark)
SELECT item_id, CASE WHEN upper(trim(reply)) LIKE 'YES%' THEN true WHEN upper(trim(reply)) LIKE 'NO%' THEN false END AS verdict,
CASE item_id % 4 WHEN 0 THEN 'part_of' WHEN 1 THEN 'unrelated' WHEN 2 THEN 'is_a' END AS label FROM x""")
def _(spark, d):
    """Replies that a judge might give, as text."""
    k = F.col("item_id") % 4
    said = F.when(k == 0, "Yes, part of it").when(k == 1, " no: UNRELATED").when(k == 2, "is-a")
    rows = table(spark, d, "benchmark").select("item_id").withColumn("prompt", said)
    return P.judged(rows, P.echo()).select("item_id", "verdict", P.relation_label(F.col("reply")).alias("label"))


@query("udf_04_keywords", "WITH " + TOKENS + ", r AS (SELECT chunk_id, word AS kw, tf, max(tf) OVER (PARTITION BY chunk_id) AS m, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, word) AS rk FROM tokens) SELECT chunk_id, kw, round(tf::DOUBLE / m, 6) AS w FROM r WHERE rk <= 8")
def _(spark, d):
    return rounded(P.keywords_standin(Graph(spark, d).tokens.select("chunk_id", "word", "tf")), "w")


@query("lin_06_prefix_offsets", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.label, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.e, lambda x: x * x)) * list_sum(list_transform(b.e, lambda x: x * x))) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND b.label = a.label) SELECT label, round(avg(1 - c), 5) AS \"offset\" FROM p GROUP BY 1")
def _(spark, d):
    """The next vector of a label stands for that of the text with a prefix."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("e").alias("f")), ["vec_id", "label"])
    return rounded(D.prefix_offsets(pairs, "e", "f", "label"), "offset", digits=5)
