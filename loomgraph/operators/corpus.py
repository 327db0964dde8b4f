"""Corpus operators: chunks, token and n-gram statistics, fine records, concepts as a table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import stored


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1200, overlap: int = 100, least: int = 50) -> DataFrame:
    """(chunk_id, doc_id, ord, text): windows of more than `least` characters; ord counts those kept."""
    kept = F.filter(T.windows(text_col, size, overlap), lambda w: F.length(w) > least)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("ord", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk_"), F.col("ord")).alias("chunk_id"), "doc_id", F.col("ord").cast("long").alias("ord"), "text")


def token_counts(rows: DataFrame, key: str = "chunk_id", text_col: str = "text", least: int = 4, stop: tuple[str, ...] = T.STOP) -> DataFrame:
    """(key, word, tf) of content words. Texts are dealt out by key, not their words, so all words of a key come together."""
    found = rows.select(key, text_col).repartition(F.col(key)).select(key, F.explode(T.words(text_col, least)).alias("word"))
    return found.filter(~F.col("word").isin(*stop)).groupBy(key, "word").agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, key: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(key, dl): white-space separated words."""
    return rows.select(key, F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("dl"))


def totals(lens: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1


def bm25(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))


def one_row(df: DataFrame, small: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.crossJoin(F.broadcast(small.limit(1)))


def top_concepts(tokens: DataFrame, n: DataFrame, k: int = 5, least_df: int = 2) -> DataFrame:
    """(chunk_id, concept, tf): each chunk's k words of the highest tf x idf. A stand-in for a model's readout."""
    df = tokens.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    scored = one_row(tokens.join(df, "word"), n).withColumn("score", F.round(F.col("tf") * smooth_idf(F.col("n"), F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "word"))
    return scored.withColumn("rk", rank).filter(F.col("rk") <= k).select("chunk_id", F.col("word").alias("concept"), "tf")


class Corpus:
    """The derived tables of a document table. Chunks are read from the documents; those that need a pass over all texts or a shuffle
    are written once to the scratch folder when they are first asked for, and what builds on them reads them there."""

    def __init__(self, docs: DataFrame):
        self.chunks = chunks(docs)

    @cached_property
    def tokens(self) -> DataFrame:
        return stored(token_counts(self.chunks), "tokens")

    @cached_property
    def lens(self) -> DataFrame:
        return stored(lengths(self.chunks), "lengths")

    @cached_property
    def n(self) -> DataFrame:
        return stored(totals(self.lens), "totals")

    @cached_property
    def cc(self) -> DataFrame:
        return stored(top_concepts(self.tokens, self.n), "chunk_concepts")

    @cached_property
    def idf(self) -> DataFrame:
        return stored(idf_of(self.cc, self.n), "idf")

    @cached_property
    def m(self) -> DataFrame:
        return stored(weights(self.cc, self.idf, self.lens, self.n), "weights")


def idf_of(cc: DataFrame, n: DataFrame) -> DataFrame:
    """(concept, df, idf) over chunk_concepts."""
    return one_row(cc.groupBy("concept").agg(F.countDistinct("chunk_id").alias("df")), n).select("concept", "df", smooth_idf(F.col("n"), F.col("df")).alias("idf"))


def weights(cc: DataFrame, idf: DataFrame, lens: DataFrame, n: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(concept, chunk_id, tf, idf, w): the concept-chunk matrix on its memberships only; w = idf x BM25."""
    rows = one_row(cc.join(idf, "concept").join(lens, "chunk_id"), n)
    return rows.select("concept", "chunk_id", "tf", "idf", (F.col("idf") * bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("w"))


def ngrams(rows: DataFrame, n: int, key: str = "chunk_id", text_col: str = "text", least: int = 2, stop: tuple[str, ...] = T.STOP) -> DataFrame:
    """(gram, n_grams, count) of runs of n content words that follow each other once stop words are out."""
    w = F.filter(T.words(text_col, least), lambda x: ~x.isin(*stop))
    rows = rows.select(key, w.alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("count")).select("gram", F.lit(n).alias("n"), "count")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 500) -> DataFrame:
    """(doc_id, ord, text): sentences packed greedily into paragraphs of up to `most` characters, never empty ones.

    Packing is a fold over a text's sentences: it stays in one row, as a higher-order aggregate.
    """
    t = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(T.BLANK))
    sentences = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda s: F.btrim(s, F.lit(T.BLANK))), lambda s: s != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, s: Column) -> Column:
        full = (F.length(a["cur"]) + F.length(s) + 1 > most) & (a["cur"] != "")
        done = F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full | (a["cur"] == ""), s).otherwise(F.concat(a["cur"], F.lit(" "), s)).alias("cur"))

    packed = F.aggregate(sentences, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    whole = F.when(F.size(packed) > 0, packed).otherwise(F.array(F.coalesce(F.col(text_col), F.lit("")).substr(1, most)))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(whole).alias("ord", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")
