"""Read-through caches of model results and upserts of result tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plugins import Model
from loomgraph.session import scratch

SCHEMA = "key string, space string, vector array<float>"
KEYWORDS = "key string, space string, keywords array<struct<kw: string, w: double>>"


def cache_key(text: Column, space: str) -> Column:
    """SHA-256 of text and the namespace of model and settings."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.lit(space)), 256)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _through(texts: DataFrame, model: Model, space: str, path: str | None, text_col: str, schema: str, value: str) -> DataFrame:
    """texts with key and the model's value: hits come from the cache at path, distinct misses go to the model once and are appended."""
    spark = texts.sparkSession
    path = path or f"{scratch(spark)}/loomgraph-cache/{hashlib.sha256(space.encode()).hexdigest()[:16]}"
    keyed = texts.withColumn("key", cache_key(F.col(text_col), space))
    have = _rows(spark, path, schema).select("key")
    misses = keyed.select("key", F.col(text_col).alias("text")).dropDuplicates(["key"]).join(have, "key", "left_anti")
    misses.select("key", F.lit(space).alias("space"), model.column("text").alias(value)).write.mode("append").parquet(path)
    got = _rows(spark, path, schema).filter(F.col("space") == space).dropDuplicates(["key"]).select("key", value)
    return keyed.join(got, "key", "left")


def embedded(texts: DataFrame, model: Model, space: str, path: str | None = None, text_col: str = "text") -> DataFrame:
    """texts with key and vector, read through a cache of vectors."""
    return _through(texts, model, space, path, text_col, SCHEMA, "vector")


def keyworded(texts: DataFrame, model: Model, space: str, mode: str, path: str | None = None, text_col: str = "text") -> DataFrame:
    """texts with key and keywords (kw, w), read through a cache whose keys hold text, model (space) and mode."""
    return _through(texts, model, f"{space}|{mode}", path, text_col, KEYWORDS, "keywords")


def upsert(rows: DataFrame, path: str, part: str) -> None:
    """Writes rows over the partitions (by `part`) that they have; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
