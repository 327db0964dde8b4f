"""File sources, caches and ordered spans on small inputs."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph import plugins
from loomgraph.functions import text as T
from loomgraph.operators import lexical as L
from loomgraph.operators import spans as S
from loomgraph.sinks import cache
from loomgraph.sources import files


def test_corpus_and_questions(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"corpus_name": "b", "context": "x" * 1300}, {"corpus_name": "c", "context": "short"}]))
    assert [r["chunk_id"] for r in files.corpus_json(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == ["b::chunk_0", "b::chunk_1"]
    q = [{"id": str(i), "question": "q", "answer": "a", "question_type": t, "source": "s", "evidence": "x; y;"} for i, t in enumerate(["Fact Retrieval", "Fact Retrieval", "Complex Reasoning"])]
    (tmp_path / "q.json").write_text(json.dumps(q))
    rows = files.questions_json(spark, str(tmp_path / "q.json"), 2).withColumn("s", T.statement_list("evidence")).orderBy("qid").collect()
    assert [(r["qid"], r["level"], r["s"]) for r in rows] == [("0", "L1", ["x", "y"]), ("2", "L2", ["x", "y"])]


def test_retrieval_set(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "1", "title": "A title that is long enough", "text": ""}, {"_id": "2", "title": "t", "text": "Tiny."}]))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "?"}))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t2\n")
    corpus, queries, qrels = files.retrieval_set(spark, str(tmp_path))
    assert files.fine_records(corpus, "ds").collect()[0]["id"] == "ds:1:p0"
    assert queries.count() == 1 and qrels.first()["grade"] == 2


def test_multi_hop(spark, tmp_path):
    rows = [{"id": "1", "question": "q", "paragraphs": [{"title": "t", "paragraph_text": "old", "is_supporting": True}, {"title": "t", "paragraph_text": "new", "is_supporting": False}, {"title": "u", "paragraph_text": "u", "is_supporting": True}]}]
    (tmp_path / "m.jsonl").write_text(json.dumps(rows[0]))
    corpus, queries, qrels = files.multi_hop_paragraphs(spark, str(tmp_path / "m.jsonl"))
    assert {r["id"]: r["text"] for r in corpus.collect()} == {"t": "new", "u": "u"}
    assert queries.first()["stratum"] == "2_hop" and qrels.count() == 2
    (tmp_path / "h.jsonl").write_text(json.dumps({"id": "1", "question": "q", "type": "bridge", "context": {"title": ["a", "b"], "sentences": [["x", "y"], ["z"]]}, "supporting_facts": {"title": ["a", "a"]}}))
    corpus, queries, qrels = files.multi_hop_context(spark, str(tmp_path / "h.jsonl"))
    assert {r["id"]: r["text"] for r in corpus.collect()} == {"a": "xy", "b": "z"} and qrels.count() == 1


def test_code_and_mixed(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("export function alpha(x) { return x + 1 + 2 + 3 }\nclass Beta { body: string; more: string }\n")
    (tmp_path / "src/node_modules/b.ts").write_text("function no() {}")
    (tmp_path / "src/t.csv").write_text("x,y\n1,2\n3,4\n")
    found = files.code_files(spark, str(tmp_path / "src"))
    assert found.count() == 1
    s = S.symbols(found).orderBy("name")
    assert [(r["name"], r["kind"]) for r in s.collect()] == [("Beta", "class"), ("alpha", "function")]
    truth = found.select(F.lit("q").alias("qid"), "path")
    assert files.fan_out(truth, s).count() == 2
    assert "1 | 2" in files.csv_card(spark, str(tmp_path / "src/t.csv")).first()["text"]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.execute("INSERT INTO t VALUES (1, 'x')")
    assert files.sqlite_cards(spark, str(tmp_path / "d.db")).first()["text"] == "t\na(INTEGER), b(TEXT)\n1 | x"


def test_index_errors(spark, tmp_path):
    with pytest.raises(files.MissingIndex):
        files.index(spark, str(tmp_path))


def test_chapters(spark):
    body = "word " * 20
    books = [
        (1, "Front\n" + "".join(f"Chapter {i}: Title {i}.\n{body}\n" for i in (1, 2, 3)) + "CHAPTER 4\nshort\n"),
        (2, "\n".join(f"CHAPTER {r}\n\n{body}" for r in ("I", "IV", "IX"))),
        (3, "\n".join(f"第{n}章 名{n}\n{'字' * 60}" for n in ("一千零一", "二", "3"))),
        (4, "\n".join(f"{n}. Heading {n}\n{body}" for n in (1, 2, 3, 4))),
        (5, "Chapter 1\nx\nChapter 2\ny\nChapter 3\nz\n\n" + "p" * 150),  # too short for chapters
        (6, "\n\n".join(["p" * 150] * 30)), (7, None), (8, ""),
    ]
    got = {}
    for r in S.chapters(spark.createDataFrame(books, "id long, text string"), "id").collect():
        got.setdefault(r["id"], []).append((r["chapter"], r["title"], r["body"]))
    assert [t for _, t, _ in got[1]] == ["Title 1", "Title 2", "Title 3"] and all(b.startswith("Chapter") for _, _, b in got[1])
    assert len(got[2]) == 3 and got[2][1][1].startswith("word") and [t for _, t, _ in got[3]] == ["名一千零一", "名二", "名3"]
    assert [t for _, t, _ in got[4]] == [f"Heading {n}" for n in (1, 2, 3, 4)]
    assert len(got[5]) == 1 and got[5][0][2] == "p" * 150
    assert [(t, len(b)) for _, t, b in got[6]] == [("段 1", 14 * 152 - 2), ("段 2", 14 * 152 - 2), ("段 3", 2 * 152 - 2)]
    assert not {7, 8} & set(got)


def test_citations(spark):
    df = spark.createDataFrame([("See Chapter 12, ch. three and chapter sixty; 第三十四回, 第5章, 第十回.",)], "t string")
    assert df.select(T.chapters("t").alias("c")).first()["c"] == [3, 5, 10, 12, 34, 60]


def test_names(spark):
    """Every name is a run of capitalized words of a sentence with single connectors between, and no longer run holds it."""
    texts = [
        "Then Sherlock Holmes's friend met King of the Hill and Anna de la Cruz. I’ll go. The IV Legion; NASA, Ox and UN.",
        "Chapter One Two Three Four Five Six. Gutenberg. Monday. don’t Don’t it’s Vincent van Gogh’s.", None, "", "\n\n",
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    got = {}
    for r in S.cap_spans(df).collect():
        got.setdefault(r["chunk_id"], []).append(r["surface"])
    assert sorted(got["0"]) == sorted(["Then Sherlock Holmes", "King", "Hill and Anna", "Cruz", "IV Legion", "NASA Ox and UN"])
    assert sorted(got["1"]) == sorted(["Chapter One Two Three", "Four Five Six", "Vincent van Gogh"]) and set(got) == {"0", "1"}


def test_cap_spans(spark):
    text = "The quick man met Anna of Green Gables. Then the man saw Anna's house. the then the then. We saw McKay."
    got = {r["surface"] for r in S.cap_spans(spark.createDataFrame([("c", text)], "chunk_id string, text string")).collect()}
    assert "Anna of Green Gables" in got and "McKay" in got and "Then" not in got and "The" not in got


def test_weighted_jaccard(spark):
    q = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5)], "qid string, kw string, w double")
    d = spark.createDataFrame([("1", "a", 0.5), ("1", "c", 0.5), ("2", "z", 1.0)], "id string, kw string, w double")
    rows = L.weighted_jaccard(q, d, 5).collect()
    assert [(r["id"], r["score"]) for r in rows] == [("1", 0.25)]


def test_cache_reads_through(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([("a cat",), ("a cat",), (None,)], "text string")
    first = cache.embedded(texts, plugins.hashed_words(8), "m", path)
    assert first.count() == 3 and first.filter("vector is null").count() == 0
    before = spark.read.parquet(path).count()
    cache.embedded(texts, plugins.hashed_words(8), "m", path).count()
    assert spark.read.parquet(path).count() == before == 2


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "out")
    cache.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "v int, probe string"), path, "probe")
    cache.upsert(spark.createDataFrame([(3, "b")], "v int, probe string"), path, "probe")
    assert {(r["v"], r["probe"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_plugins(spark):
    df = spark.createDataFrame([("YES it is", "UNRELATED"), ("No", "is_a")], "prompt string, reply2 string")
    yes = plugins.Model(lambda: lambda t: t, "string", __import__("pyarrow").string())
    assert [r["verdict"] for r in plugins.judged(df, yes).collect()] == [True, False]
    assert [r[0] for r in df.select(plugins.relation_label(F.col("reply2"))).collect()] == ["unrelated", "is_a"]
