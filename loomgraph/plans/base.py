"""The register of queries and the SQL pieces that their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with equivalent SQL where there is any."""

    def take(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return take


#: Tables of texts, whose rows are worth spreading over all cores.
TEXTS = frozenset(["documents", "pages", "conversations"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


#: Common table expressions of the checks, each needing those before it.
CHUNKS = r"""
chunk_windows AS (SELECT doc_id, i, trim(substring(text, CAST(i * 1100 + 1 AS BIGINT), 1200), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1099) // 1100)) AS i FROM documents WHERE length(text) > 0)),
chunks AS (SELECT doc_id || '::chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, text
  FROM chunk_windows WHERE length(text) > 50)"""
STOP_SQL = "('that','this','with','from','have','been','were','they','them','their','there','which','what','when','where','than','then','also','more','most','some','such','only','into','about','these','those','other','between','through','during','after','before','because','while','being','does','done','each')"
TOKENS = CHUNKS + rf""",
tokens AS (SELECT chunk_id, w AS word, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM chunks) WHERE length(w) >= 4 AND w NOT IN {STOP_SQL} GROUP BY 1, 2),
lens AS (SELECT chunk_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS dl FROM chunks),
n_chunks AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""
CONCEPTS = TOKENS + """,
word_df AS (SELECT word, count(*) AS df FROM tokens GROUP BY 1),
concept_rank AS (SELECT t.chunk_id, t.word AS concept, t.tf, row_number() OVER (PARTITION BY t.chunk_id ORDER BY round(t.tf * (ln((n.n + 1.0) / (d.df + 1.0)) + 1), 6) DESC, t.word) AS rk
  FROM tokens t JOIN word_df d USING (word), n_chunks n WHERE d.df >= 2),
cc AS (SELECT chunk_id, concept, tf FROM concept_rank WHERE rk <= 5),
idf AS (SELECT concept, count(*) AS df, ln((max(n.n) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM cc, n_chunks n GROUP BY concept),
m AS (SELECT cc.concept, cc.chunk_id, cc.tf, idf.idf, idf.idf * cc.tf * 2.2 / (cc.tf + 1.2 * (0.25 + 0.75 * l.dl / greatest(n.avgdl, 1))) AS w FROM cc JOIN idf USING (concept) JOIN lens l USING (chunk_id), n_chunks n)"""
SEEDS = CONCEPTS + rf""",
q_tokens AS (SELECT DISTINCT item_id AS qid, w AS word FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4 AND w NOT IN {STOP_SQL}),
lexical AS (SELECT q.qid, t.chunk_id, sum(round(ln((n.n + 1.0) / (d.df + 1.0)) + 1, 6)) AS score FROM q_tokens q JOIN tokens t USING (word) JOIN word_df d USING (word), n_chunks n GROUP BY 1, 2),
dense AS (SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rk FROM lexical),
seeds AS (SELECT qid, chunk_id, rk FROM dense WHERE rk <= 5)"""
RELATIONS = SEEDS + """,
pair_n AS (SELECT a.concept AS a, b.concept AS b, count(*) AS n, min(a.chunk_id) AS context FROM cc a JOIN cc b ON a.chunk_id = b.chunk_id AND a.concept < b.concept GROUP BY 1, 2),
relations AS (SELECT a, b, n, context, n::DOUBLE / max(n) OVER () AS prob FROM pair_n WHERE n >= 2),
adj AS (SELECT a AS src, b AS dst, prob FROM relations UNION ALL SELECT b, a, prob FROM relations),
seed_concepts AS (SELECT DISTINCT s.qid, cc.concept FROM seeds s JOIN cc USING (chunk_id)),
flat AS (SELECT c.qid, m.chunk_id, sum(m.w) AS score FROM seed_concepts c JOIN m USING (concept) LEFT JOIN seeds s ON s.qid = c.qid AND s.chunk_id = m.chunk_id WHERE s.qid IS NULL GROUP BY 1, 2)"""
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
