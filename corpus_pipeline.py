"""The corpus pipeline: five stages, each written and reread as the next one's documents.

Quality, near duplicates, benchmark passages, secrets, mixture. Stages take (spark, docs, sf_dir) and work on all
rows of docs; all but the last return the columns of documents. Any of them handles nulls, empty tables and
repeated rows as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, neardup, quality, secrets
from loomgraph.llm.common import scratch_path, table
from loomgraph.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold; odd rows, empty tables and clashing columns as in quality.keep_good()."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the smallest id;
    odd rows, empty tables and clashing columns as in neardup.deduplicate()."""
    ship(spark)
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim match of 13 words or more with a benchmark item, however long they are, and that shorter items
    don't hit in a twentieth of their words; odd rows, empty tables and clashing columns as in decontam.decontaminate()."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by its kind; n_chars follows the text. Null texts stay null; the
    rest as in secrets.redact()."""
    ship(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as systematic sampling takes it, its copies numbered from 0 in `copy`;
    odd rows, empty tables and clashing columns as in mixing.emit()."""
    return mixing.emit(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]
#: SQL can't express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
