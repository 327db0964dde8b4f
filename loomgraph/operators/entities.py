"""Entities from text: term spans, capitalized spans, entity tables and merging; query weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

from .corpus import bm25, one_row


def grounding_matrix(cc: DataFrame, lens: DataFrame, n: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(concept, chunk_id, w): ln((N - df + .5) / (df + .5) + 1) x BM25, rows of unit length; N is the chunks covered."""
    covered = cc.agg(F.countDistinct("chunk_id").alias("covered"))
    df = cc.groupBy("concept").agg(F.count("*").alias("df"))
    rows = one_row(one_row(cc.join(df, "concept").join(lens, "chunk_id"), n), covered)
    idf = F.log((F.col("covered") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    rows = rows.withColumn("w", idf * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    return rows.select("concept", "chunk_id", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("concept")))).alias("w"))


def term_spans(chunks: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 2, stop: tuple[str, ...] = T.STOP) -> DataFrame:
    """(term, freq, cap): runs of 2 or 3 words within a sentence, all of three letters at least and no stop words,
    that are frequent or occur with a capital."""
    words = F.regexp_extract_all("s", F.lit("[A-Za-z]+"), F.lit(0))
    rows = chunks.select(F.explode(F.split("text", r"[.!?;:\n]+")).alias("s")).select(words.alias("w"))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))
        return F.when(F.size("w") >= n, every).otherwise(F.expr("cast(array() as array<array<string>>)"))

    cut = F.flatten(F.array(*[runs(n) for n in sizes]))
    grams = rows.select(F.explode(cut).alias("g"))
    bad = F.exists("g", lambda x: (F.length(x) < 3) | F.lower(x).isin(*stop))
    grams = grams.filter(~bad).select(F.lower(F.array_join("g", " ")).alias("term"), F.exists("g", lambda x: x.rlike("^[A-Z]")).alias("cap"))
    return grams.groupBy("term").agg(F.count("*").alias("freq"), F.bool_or("cap").alias("cap")).filter((F.col("freq") >= least) | F.col("cap"))


def entity_table(spans: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, display, frequency, n_chunks) of spans (chunk_id, surface): names without those whose stem is a concept's."""
    s = spans.withColumn("name", F.lower("surface"))
    surfaces = s.groupBy("name", "surface").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("surface", F.struct("n", "surface")).alias("display"), F.sum("n").alias("frequency"))
    chunks = s.select("name", "chunk_id").distinct().groupBy("name").agg(F.count("*").alias("n_chunks"))
    known = concepts.select(T.stem("concept").alias("stem")).distinct()
    return surfaces.join(chunks, "name").withColumn("stem", T.normal_name("name")).join(known, "stem", "left_anti").select("name", "display", "frequency", "n_chunks")


def recovered(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(item_id, target, recovered): whether a target is among the names."""
    hit = names.select(F.col("name").alias("target"), F.lit(True).alias("hit")).distinct()
    return targets.join(hit, "target", "left").select("item_id", "target", F.coalesce("hit", F.lit(False)).alias("recovered"))


def stem_merge(members: DataFrame) -> DataFrame:
    """(stem, display, n_chunks): entities (chunk_id, name) of one stem as one, under the most frequent one's name."""
    freq = members.groupBy("name").agg(F.count("*").alias("f"))
    rows = members.join(freq, "name").withColumn("stem", T.stem("name"))
    return rows.groupBy("stem").agg(F.max_by("name", F.struct("f", "name")).alias("display"), F.countDistinct("chunk_id").alias("n_chunks"))


def unit_weights(q: DataFrame) -> DataFrame:
    """(qid, concept, weight) scaled to unit length for each qid."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("qid")))
    return q.withColumn("weight", F.col("weight") / length)
