"""Queries of sources, string scalars and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import concepts as C
from loomgraph.operators import corpus as O

from .base import CHUNKS, CONCEPTS, STOP_SQL, TOKENS, query, table


def _docs(spark, d):
    return table(spark, d, "documents")


WORDS = TOKENS + ", vocab AS (SELECT word, sum(tf)::BIGINT AS tf, count(*) AS df FROM tokens GROUP BY 1)"
STEM = "CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 4 AND {w} LIKE '%es' THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
ROLE_SQL = "(" + ", ".join(f"'{w}'" for w in T.ROLE_STOP) + ")"
POS = r"""CASE WHEN length({w}) < 3 THEN 'SHORT' WHEN {w} LIKE '%ing' AND length({w}) > 4 THEN 'VBG' WHEN {w} LIKE '%ed' AND length({w}) > 3 AND {w} NOT LIKE '%eed' THEN 'VBD'
 WHEN regexp_matches({w}, '(tion|ment|ness|ity|sion|osis|oma|ism|ist|logy|pathy|emia|uria|graphy|plasia|rrhea|cy|ce|cracy|hood|ship|dom)$') THEN 'NN'
 WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is|os|xs)$') THEN 'NNS' WHEN regexp_matches({w}, '..+.(ful|less|ous|ive|able|ible|ical|ish|like|most|ward)$') THEN 'JJ'
 WHEN regexp_matches({w}, '(al|ic|id|an|ar|en|or)$') AND length({w}) > 5 THEN 'JJ' ELSE 'UNK' END"""


def _vocab(spark, d):
    return O.token_counts(O.chunks(_docs(spark, d))).groupBy("word").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("src_01_corpus_questions", "SELECT item_id AS qid, 'L' || (item_id % 4 + 1) AS level, text FROM (SELECT *, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS rk FROM benchmark) WHERE rk <= 5")
def _(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("L"), F.col("item_id") % 4 + 1).alias("level"), "text")
    return C.first_of_each(q, "level", "qid", 5)


@query("src_02_fine_records", "SELECT doc_id, coalesce(nullif(text, ''), source) AS body, length(coalesce(nullif(text, ''), source))::BIGINT AS n FROM documents WHERE length(coalesce(nullif(text, ''), source)) >= 20")
def _(spark, d):
    body = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("source"))
    return _docs(spark, d).select("doc_id", body.alias("body"), F.length(body).cast("long").alias("n")).filter("n >= 20")


@query("src_03_last_wins", "SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2")
def _(spark, d):
    return C.last_wins(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text")


@query("src_04_file_fan_out", "SELECT p.page_id, split_part(split_part(p.url, '://', 2), '/', 1) AS host, h.n FROM pages p JOIN (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1) h ON split_part(split_part(p.url, '://', 2), '/', 1) = h.host")
def _(spark, d):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    p = table(spark, d, "pages").select("page_id", host.alias("host"))
    return p.join(p.groupBy("host").agg(F.count("*").alias("n")), "host").select("page_id", "host", "n")


@query("src_05_record_cards", "SELECT p_brand || ': ' || string_agg(p_name, ' | ' ORDER BY p_partkey) AS card FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rk FROM part) WHERE rk <= 3 GROUP BY p_brand")
def _(spark, d):
    return C.cards(table(spark, d, "part"), "p_brand", "p_partkey", "p_name", 3)


@query("src_07_all_corpora", "SELECT 'documents' AS domain, doc_id::VARCHAR AS id, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', page_id::VARCHAR, length(html) FROM pages UNION ALL SELECT 'benchmark', item_id::VARCHAR, length(text) FROM benchmark UNION ALL SELECT 'conversations', conv_id || ':' || turn, length(text) FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    parts = {"documents": (_docs(spark, d), "doc_id", "text"), "pages": (table(spark, d, "pages"), "page_id", "html"), "benchmark": (table(spark, d, "benchmark"), "item_id", "text"), "conversations": (c, "id", "text")}
    return C.all_corpora(parts).select("domain", "id", F.length("text").cast("long").alias("n"))


@query("src_08_capped_records", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 10")
def _(spark, d):
    return C.first_of_each(_docs(spark, d).select("source", "doc_id"), "source", "doc_id", 10)


@query("src_09_semi_join_index", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"))


@query("str_01_chunks", "WITH " + CHUNKS + " SELECT chunk_id, doc_id, ord, text FROM chunks")
def _(spark, d):
    return O.chunks(_docs(spark, d))


@query("str_02_paragraphs")
def _(spark, d):
    return O.paragraphs(_docs(spark, d))


@query("str_05_corpus_words", "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents)")
def _(spark, d):
    return _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()


@query("str_06_term_frequency", "SELECT w AS word, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY 1")
def _(spark, d):
    return _docs(spark, d).select(F.explode(T.words("text", 5)).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))


@query("str_07_content_tokens", f"SELECT item_id, count(DISTINCT w) AS n, string_agg(DISTINCT w, ' ' ORDER BY w) AS tokens FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4 AND w NOT IN {STOP_SQL} GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "benchmark").withColumn("t", T.content_tokens("text")).filter(F.size("t") > 0)
    return t.select("item_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


_GRAM = f"""
, w AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 2 AND x NOT IN {STOP_SQL}) AS w FROM chunks)
"""


@query("str_08_ngrams", "WITH " + CHUNKS + _GRAM + "SELECT gram, n, count(*) AS count FROM (SELECT array_to_string(w[i : i + n - 1], ' ') AS gram, n FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(n) WHERE len(w) >= n)) GROUP BY 1, 2")
def _(spark, d):
    c = O.chunks(_docs(spark, d))
    return O.ngrams(c, 1).union(O.ngrams(c, 2)).union(O.ngrams(c, 3))


@query("str_09_stem", "WITH " + WORDS + f" SELECT word, {STEM.format(w='word')} AS stem FROM vocab")
def _(spark, d):
    return _vocab(spark, d).select("word", T.stem("word").alias("stem"))


_DED = "CASE WHEN length({w}) > 6 AND {w} LIKE '%ed' THEN left({w}, length({w}) - 2) ELSE {w} END"


@query("str_10_dedupe_stem", "WITH " + WORDS + f", s AS (SELECT word, {STEM.format(w='word')} AS s FROM vocab), i AS (SELECT word, CASE WHEN length(s) > 6 AND s LIKE '%ing' THEN left(s, length(s) - 3) ELSE s END AS s FROM s) SELECT word, {_DED.format(w='s')} AS stem FROM i")
def _(spark, d):
    return _vocab(spark, d).select("word", T.dedupe_stem("word").alias("stem"))


@query("str_11_normal_name", f"SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(trim(lower(p_name)), '\\s+'), lambda x: {STEM.format(w='x')}), ' ') AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normal_name("p_name").alias("name"))


@query("str_12_ascii", r"SELECT doc_id, NOT regexp_matches(text, '[^\x00-\x7F]') AS plain FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", (~F.col("text").rlike(r"[^\x00-\x7F]")).alias("plain"))


@query("str_13_word_class", "WITH " + WORDS + f" SELECT word, {POS.format(w='word')} AS pos FROM vocab")
def _(spark, d):
    return _vocab(spark, d).select("word", T.word_class("word").alias("pos"))


@query("str_14_fragments", "WITH " + WORDS + ", b AS (SELECT DISTINCT left(w, 6) AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)) SELECT b.w AS word, length(b.w) <= 6 AND v.word IS NULL AS fragment FROM b LEFT JOIN vocab v ON v.word = b.w")
def _(spark, d):
    b = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("w")).select(F.substring("w", 1, 6).alias("word")).distinct()
    known = _vocab(spark, d).select("word", F.lit(True).alias("known"))
    return b.join(known, "word", "left").select("word", T.is_fragment("word", F.coalesce("known", F.lit(False))).alias("fragment"))


@query("str_15_prefix_completion", "WITH " + WORDS + ", p AS (SELECT DISTINCT left(word, 4) AS prefix FROM vocab WHERE length(word) >= 5) SELECT prefix, arg_max(word, {'tf': tf, 'len': -length(word), 'word': word}) AS word FROM p JOIN (SELECT * FROM vocab WHERE length(word) >= 5) v ON left(v.word, 4) = prefix AND length(v.word) <= 19 GROUP BY prefix")
def _(spark, d):
    v = _vocab(spark, d).filter(F.length("word") >= 5)
    return C.complete(v.select(F.substring("word", 1, 4).alias("prefix")).distinct(), v.select("word", "tf"))


@query("str_17_statements", r"SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS ord, s AS statement FROM (SELECT item_id, i, trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, string_split(replace(text, '.', ';'), ';') AS x FROM benchmark))) WHERE s <> ''")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(T.statements(F.replace(F.col("text"), F.lit("."), F.lit(";")))).alias("ord", "statement")).select("item_id", F.col("ord").cast("long").alias("ord"), "statement")


@query("str_18_chapters")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.chapters("text").alias("chapters"))


_THEMES = {"article": ["the ", "der ", "la ", "le "], "license": ["license", "apache", "copyright"], "money": ["$", "price"]}


@query("str_19_themes", "SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(lower(text), 'the |der |la |le ') THEN 'article' END, CASE WHEN regexp_matches(lower(text), 'license|apache|copyright') THEN 'license' END, CASE WHEN regexp_matches(lower(text), '[$]|price') THEN 'money' END) AS themes FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.themes("text", _THEMES), " ").alias("themes"))


@query("str_20_prefix", f"SELECT item_id, 'about ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:5], ', ') AS prefix FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.prefix_of(T.words("text"), 5, "about ").alias("prefix"))


@query("str_21_surface", "SELECT DISTINCT item_id, w AS word, substring(text, strpos(lower(text), w), length(w)) AS surface, w IN (SELECT lower(x) FROM (SELECT unnest(regexp_extract_all(text, '[A-Z]{2,}')) AS x FROM benchmark)) AS has_caps FROM (SELECT item_id, text, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)")
def _(spark, d):
    b = table(spark, d, "benchmark")
    w = b.select("item_id", "text", F.explode(T.words("text")).alias("word")).distinct()
    caps = b.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), F.lit(0))).alias("x")).select(F.lower("x").alias("word"), F.lit(True).alias("c")).distinct()
    return w.join(caps, "word", "left").select("item_id", "word", T.surface("word", "text").alias("surface"), F.coalesce("c", F.lit(False)).alias("has_caps"))


@query("str_22_json_labels", "SELECT event_id, k AS key, v::DOUBLE AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events WHERE json_valid(props)), LATERAL (SELECT try_cast(json_extract_string(props, '$.' || k) AS DOUBLE) AS v) WHERE v BETWEEN 0 AND 1")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(T.label_weights("props")).alias("key", "value"))


@query("str_22_span_weights", "WITH t AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + 7 AS e, l_discount AS lp FROM lineitem), q AS (SELECT DISTINCT k, 15 AS s, 33 AS e FROM t) SELECT q.k AS key, round(least(1.0, greatest(0.0, exp(avg(-t.lp)))), 6) AS weight FROM q JOIN t ON t.k = q.k AND t.s < q.e AND q.s < t.e GROUP BY q.k")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 7).alias("end"), (-F.col("l_discount")).alias("logprob"))
    spans = t.select("key").distinct().withColumns({"start": F.lit(15), "end": F.lit(33)})
    return C.span_weights(spans, t).select("key", F.round("weight", 6).alias("weight"))


# Filters over the concept table.


def _cc(spark, d):
    return O.Corpus(_docs(spark, d))


@query("flt_01_df_range", "WITH " + CONCEPTS + " SELECT concept, df FROM idf WHERE df >= 2 AND df <= (SELECT floor(0.3 * n) FROM n_chunks)")
def _(spark, d):
    c = _cc(spark, d)
    return C.df_range(c.cc, c.n).groupBy("concept").agg(F.count("*").alias("df"))


KNEE = CONCEPTS + """,
curve AS (SELECT df::DOUBLE / n.n AS ratio, row_number() OVER (ORDER BY df DESC, concept) - 1 AS x, count(*) OVER () AS c FROM idf, n_chunks n),
ends AS (SELECT max(ratio) AS y0, min(ratio) AS y1, max(c) AS c FROM curve),
knee AS (SELECT CASE WHEN max(e.c) < 10 OR max(e.y0 - e.y1) < 1e-8 THEN 0.3 ELSE greatest(0.2, least(0.6, arg_max(k.ratio, {'d': round(abs((e.c - 1) * (k.ratio - e.y0) - k.x * (e.y1 - e.y0)) / sqrt((e.c - 1.0) * (e.c - 1) + (e.y1 - e.y0) * (e.y1 - e.y0)), 9), 'x': -k.x}))) END AS knee FROM curve k, ends e)"""


@query("flt_02_df_knee", "WITH " + KNEE + " SELECT round(knee, 6) AS knee FROM knee")
def _(spark, d):
    c = _cc(spark, d)
    return C.df_knee(c.idf, c.n).select(F.round("knee", 6).alias("knee"))


ADAPT = KNEE + ", kept AS (SELECT i.concept, i.df, CASE WHEN i.df > floor(n.n * k.knee) THEN CASE WHEN i.concept IN (SELECT word FROM word_df) THEN 'keep' ELSE 'artefact' END WHEN i.df < 2 THEN 'rare' ELSE 'keep' END AS verdict FROM idf i, n_chunks n, knee k)"


@query("flt_03_adaptive", "WITH " + ADAPT + " SELECT concept, df, verdict FROM kept")
def _(spark, d):
    c = _cc(spark, d)
    return C.adaptive(c.idf, c.n, c.tokens.select("word").distinct())


@query("flt_04_optimize", "WITH " + ADAPT + """, tfreq AS (SELECT word, sum(tf) AS tf FROM tokens WHERE length(word) >= 5 GROUP BY 1),
done AS (SELECT k.concept, coalesce(CASE WHEN length(k.concept) <= 5 THEN arg_max(t.word, {'tf': t.tf, 'len': -length(t.word), 'w': t.word}) FILTER (WHERE t.word IS NOT NULL) END, k.concept) AS completed FROM kept k LEFT JOIN tfreq t ON length(k.concept) <= 5 AND left(t.word, 3) = left(k.concept, 3) AND starts_with(t.word, k.concept) AND length(t.word) <= length(k.concept) + 15 WHERE k.verdict = 'keep' GROUP BY k.concept)
SELECT d.completed AS concept, count(DISTINCT cc.chunk_id) AS df, round(ln((max(n.n) + 1.0) / (count(DISTINCT cc.chunk_id) + 1.0)) + 1, 6) AS idf FROM done d JOIN cc USING (concept), n_chunks n GROUP BY 1""")
def _(spark, d):
    c = _cc(spark, d)
    return C.optimized(c.cc, c.idf, c.n, c.tokens).select("concept", "df", F.round("idf", 6).alias("idf"))


@query("flt_05_triple_filter", "WITH " + CONCEPTS + f" SELECT concept, df, CASE WHEN df < 2 THEN 'df' WHEN regexp_matches(concept, '[^\\x00-\\x7F]') THEN 'non_ascii' WHEN concept IN {STOP_SQL} THEN 'stop' WHEN {POS.format(w='concept')} IN ('VBG', 'VBD') THEN 'verb' ELSE 'ok' END AS reason FROM idf")
def _(spark, d):
    return C.triple_filter(_cc(spark, d).idf)


@query("flt_06_keep_rules", "WITH " + CONCEPTS + f""", r AS (SELECT concept, {STEM.format(w='concept')} AS st, {POS.format(w='concept')} AS pos FROM idf)
SELECT concept, pos NOT IN ('VBG', 'VBD') AS concept_ok, pos NOT IN ('VBG', 'VBD') AND st NOT IN ('type', 'part', 'form', 'way') AS role_ok FROM r""")
def _(spark, d):
    i = _cc(spark, d).idf
    stop = ("type", "part", "form", "way")
    return i.select("concept", C.concept_ok(F.col("concept")).alias("concept_ok"), C.role_ok(F.col("concept"), role_stop=stop).alias("role_ok"))


@query("flt_07_attributes", "WITH " + CONCEPTS + f""", st AS (SELECT chunk_id, concept, tf, {STEM.format(w='concept')} AS s FROM cc), lead AS (SELECT chunk_id, arg_max(s, {{'tf': tf, 'c': concept}}) AS s FROM st GROUP BY 1),
i AS (SELECT st.chunk_id, st.concept, st.tf, CASE WHEN length(st.s) > 6 AND st.s LIKE '%ing' THEN left(st.s, length(st.s) - 3) ELSE st.s END AS k FROM st JOIN lead USING (chunk_id) WHERE st.s <> lead.s AND st.concept NOT IN {ROLE_SQL} AND st.s NOT IN {ROLE_SQL}),
k AS (SELECT chunk_id, concept, tf, {_DED.format(w='k')} AS k FROM i),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, k ORDER BY tf DESC, concept) AS one FROM k)
SELECT chunk_id, concept, rk FROM (SELECT chunk_id, concept, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, concept) AS rk FROM f WHERE one = 1) WHERE rk <= 3""")
def _(spark, d):
    cc = _cc(spark, d).cc
    lead = cc.groupBy("chunk_id").agg(F.max_by("concept", F.struct("tf", "concept")).alias("own"))
    ranked = cc.join(lead, "chunk_id").select("chunk_id", "own", F.col("concept").alias("word"), F.col("tf").alias("score"))
    return C.attributes(ranked, "chunk_id", n=3).select("chunk_id", F.col("word").alias("concept"), "rk")


@query("flt_08_entity_tokens", "WITH " + TOKENS + ", c AS (SELECT word, sum(tf) AS total FROM tokens GROUP BY 1) SELECT chunk_id, word, rk FROM (SELECT t.chunk_id, t.word, row_number() OVER (PARTITION BY t.chunk_id ORDER BY t.tf DESC, t.word) AS rk FROM tokens t JOIN c USING (word) WHERE t.tf >= 2 OR c.total >= 20) WHERE rk <= 16 AND NOT (word LIKE '%ing' OR (word LIKE '%ed' AND word NOT LIKE '%eed'))")
def _(spark, d):
    t = O.token_counts(O.chunks(_docs(spark, d)))
    return C.entity_tokens(t)


@query("flt_10_quality_gate", "WITH " + CONCEPTS + f""", p AS (SELECT cc.chunk_id, {POS.format(w='concept')} AS pos, concept IN (SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)) AS hit, length(concept) <= 6 AS short FROM cc),
g AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE hit) / count(*) AS hit, count(*) FILTER (WHERE short AND NOT hit) / count(*) AS frag, count(*) FILTER (WHERE pos IN ('VBG', 'VBD')) / count(*) AS verb FROM p GROUP BY 1)
SELECT chunk_id, CASE WHEN n < 3 THEN 'too_few_effective' WHEN hit < 0.4 THEN 'low_corpus_hit' WHEN frag > 0.3 THEN 'high_fragment' WHEN verb > 0.4 THEN 'high_verb' ELSE 'expanded' END AS verdict FROM g""")
def _(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()
    q = C.quality(_cc(spark, d).cc, words, "chunk_id")
    return q.select("chunk_id", C.gate(q).alias("verdict"))
