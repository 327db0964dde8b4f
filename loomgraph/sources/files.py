"""File sources: benchmark corpora and questions, retrieval sets, multi-hop sets, code and mixed folders, books, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import corpus as O
from loomgraph.operators.concepts import first_of_each, last_wins

CORPUS = "corpus_name string, context string"
QUESTION = "id string, question string, answer string, question_type string, source string, evidence array<string>"
#: Question types and their levels.
LEVELS = {"Fact Retrieval": "L1", "Complex Reasoning": "L2", "Contextual Summarize": "L3", "Creative Generation": "L4"}


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, doc_id, ord, text): one book or a list of books, in windows."""
    books = spark.read.schema(CORPUS).json(path, multiLine=True)
    return O.chunks(books, "corpus_name", "context")


def questions_json(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(qid, question, answer, level, evidence): of each level the first most // levels in the file's order.

    Evidence may be a string or an array of strings there; it is an array here.
    """
    raw = spark.read.json(path, multiLine=True)
    kind = dict(raw.dtypes).get("evidence", "string")
    evidence = F.col("evidence") if kind.startswith("array") else F.array(F.col("evidence")) if "evidence" in raw.columns else F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    rows = raw.withColumn("__at", F.monotonically_increasing_id()).select(F.col("id").cast("string").alias("qid"), "question", "answer", F.coalesce(F.try_element_at(table, F.col("question_type")), F.col("question_type")).alias("level"), evidence.alias("evidence"), "__at")
    if most is not None:
        levels = max(1, rows.select("level").distinct().count())
        rows = first_of_each(rows, "level", "__at", most // levels)
    return rows.drop("__at")


def retrieval_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels): corpus.jsonl and queries.jsonl by _id, qrels/test.tsv with a header."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("id"), "title", "text")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")
    qrels = spark.read.csv(f"{folder}/qrels/test.tsv", sep="\t", header=True, schema="qid string, id string, grade int")
    return corpus, queries, qrels


def fine_records(corpus: DataFrame, name: str, least: int = 20) -> DataFrame:
    """(id, text) of paragraphs `name:doc:pN`; a document without text has its title; short ones are left out."""
    body = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("title"))
    docs = corpus.select("id", body.alias("body")).filter(F.length("body") >= least)
    return O.paragraphs(docs, "id", "body").select(F.concat(F.lit(f"{name}:"), "doc_id", F.lit(":p"), F.col("ord").cast("string")).alias("id"), "text")


def multi_hop_paragraphs(spark: SparkSession, path: str, hops: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of lines with paragraphs (title, paragraph_text, is_supporting); a title's last text stands."""
    raw = spark.read.schema("id string, question string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>").json(path)
    raw = raw.withColumn("__at", F.monotonically_increasing_id())
    flat = raw.select("id", "__at", F.posexplode("paragraphs").alias("i", "p"))
    corpus = last_wins(flat.select(F.col("p.title").alias("id"), F.col("p.paragraph_text").alias("text"), F.struct("__at", "i").alias("at")), ["id"], "at", "text")
    qrels = flat.filter("p.is_supporting").select(F.col("id").alias("qid"), F.col("p.title").alias("id"), F.lit(1).alias("grade")).distinct()
    n = qrels.groupBy("qid").agg(F.concat(F.count("*").cast("string"), F.lit("_hop")).alias("stratum"))
    return corpus, raw.select(F.col("id").alias("qid"), F.col("question").alias("text")).join(n, "qid", "left"), qrels


def multi_hop_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of lines with context (title, sentences) and supporting_facts (title); stratum is the type."""
    raw = spark.read.schema("id string, question string, type string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>").json(path)
    raw = raw.withColumn("__at", F.monotonically_increasing_id())
    flat = raw.select("id", "__at", F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("i", "p"))
    body = F.array_join("p.sentences", "")
    corpus = last_wins(flat.select(F.col("p.title").alias("id"), body.alias("text"), F.struct("__at", "i").alias("at")), ["id"], "at", "text")
    qrels = raw.select(F.col("id").alias("qid"), F.explode("supporting_facts.title").alias("id")).distinct().withColumn("grade", F.lit(1))
    return corpus, raw.select(F.col("id").alias("qid"), F.col("question").alias("text"), F.col("type").alias("stratum")), qrels


def code_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("ts",), skip: tuple[str, ...] = ("node_modules",), most_files: int | None = None, most_chars: int | None = None) -> DataFrame:
    """(path, text) of source files, whole, in the order of their paths."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(suffixes) + "}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for s in skip:
        rows = rows.filter(~F.col("path").contains(f"/{s}/"))
    if most_chars is not None:
        rows = rows.withColumn("text", F.substring("text", 1, most_chars))
    return rows.orderBy("path").limit(most_files) if most_files is not None else rows


def fan_out(truth: DataFrame, symbols: DataFrame) -> DataFrame:
    """(qid, id): a file's relevance (qid, path) goes to all of its symbols (path, name)."""
    return truth.join(symbols, "path").select("qid", F.concat_ws("::", "path", "name").alias("id")).distinct()


def csv_card(spark: SparkSession, path: str, rows: int = 3) -> DataFrame:
    """One (id, text): a CSV file's name, header and first rows."""
    df = spark.read.csv(path, header=True)
    lines = [" | ".join("" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
    return spark.createDataFrame([(path, "\n".join([path.rsplit("/", 1)[-1], " | ".join(df.columns), *lines]))], "id string, text string")


def sqlite_cards(spark: SparkSession, path: str, rows: int = 3) -> DataFrame:
    """(id, text) for each table of a local SQLite file: its columns with types and first rows."""
    import sqlite3

    out = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
            quoted = '"' + name.replace('"', '""') + '"'
            columns = ", ".join(f"{c[1]}({c[2]})" for c in db.execute(f"PRAGMA table_info({quoted})"))
            lines = [" | ".join(map(str, r)) for r in db.execute(f"SELECT * FROM {quoted} LIMIT {int(rows)}")]
            out.append((f"{path}:{name}", "\n".join([name, columns, *lines])))
    return spark.createDataFrame(out, "id string, text string")


def mixed_folder(spark: SparkSession, folder: str, most_chars: int = 2000) -> DataFrame:
    """(id, text) of .md and .py files, each up to most_chars characters."""
    return code_files(spark, folder, ("md", "py"), most_chars=most_chars).withColumnRenamed("path", "id")


def books(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of .txt files, for spans.chapters()."""
    return code_files(spark, folder, ("txt",))


class MissingIndex(FileNotFoundError):
    """A part of an index is not where it should be."""


def index(spark: SparkSession, folder: str, chunks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an index (chunk_concepts, concept_vectors, relations) and the chunks that it covers."""
    out = {}
    for name in ("chunk_concepts", "concept_vectors", "relations"):
        path = f"{folder}/{name}.parquet"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise MissingIndex(f"{path} is not there; build the index first")
        out[name] = spark.read.parquet(path)
    if chunks is not None:
        out["chunks"] = chunks.join(out["chunk_concepts"].select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out


def evenly(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even steps of the order."""
    total = rows.count()
    if total <= n:
        return rows
    at = rows.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    want = rows.sparkSession.range(n).select(F.floor(F.col("id") * (total / n)).alias("__i"))
    return at.join(want, "__i", "left_semi").drop("__i")
