"""Interfaces of steps that need a model, and offline stand-ins.

A stand-in is deterministic and says so in its name; it is no substitute for the model's quality. Model results reach the
operators as tables or columns, so a plug-in is anything that maps a text column to a result column.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


@dataclass
class Model:
    """A batch function list[str] -> list, made anew once for each worker by `make`, with its result type."""

    make: Callable[[], Callable[[list[str]], list]]
    kind: str
    arrow: pa.DataType
    batch: int = 12

    def column(self, *texts: str | Column) -> Column:
        make, arrow, size = self.make, self.arrow, self.batch

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = make()
            for column in columns:
                given = [t or "" for t in column.to_pylist()]
                yield pa.array([x for at in range(0, len(given), size) for x in f(given[at : at + size])], arrow)

        return arrow_udf(run, self.kind)(*texts)


def hashed_words(dims: int = 64) -> Model:
    """Stand-in embedder: the sum of a fixed normal vector for each word, seeded by its hash, scaled to length 1."""

    def make():
        known: dict[str, np.ndarray] = {}

        def vector(w: str) -> np.ndarray:
            if w not in known:
                seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                known[w] = np.random.default_rng(seed).standard_normal(dims)
            return known[w]

        def run(texts: list[str]) -> list:
            out = []
            for t in texts:
                v = sum((vector(w) for w in re.findall(r"[a-z]{2,}", t.lower())), np.zeros(dims))
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            return out

        return run

    return Model(make, "array<float>", pa.list_(pa.float32()))


def answers_standin() -> Model:
    """Stand-in for answer generation: the first sentence of the context."""
    return Model(lambda: lambda texts: [re.split(r"(?<=[.!?])\s", t.strip())[0] for t in texts], "string", pa.string())


def keywords_standin(tokens: DataFrame, n: int = 8) -> DataFrame:
    """(key, kw, w) of token counts (key, word, tf): a stand-in for weighted keywords, by frequency within the text."""
    key = tokens.columns[0]
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tf"), "word"))
    top = tokens.withColumn("rk", rank).filter(F.col("rk") <= n)
    return top.select(key, F.col("word").alias("kw"), (F.col("tf") / F.max("tf").over(Window.partitionBy(key))).alias("w"))


def echo() -> Model:
    """Stand-in judge that replies what it is asked."""
    return Model(lambda: list, "string", pa.string())


def counted_keywords(n: int = 8) -> Model:
    """Stand-in keyword model: a text's n most frequent content words, weighted by their share of the most frequent one's count."""
    from loomgraph.functions.text import STOP

    def run(texts: list[str]) -> list:
        out = []
        for t in texts:
            counts = Counter(w for w in re.findall(r"[a-z]+", t.lower()) if len(w) >= 4 and w not in STOP)
            best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]
            out.append([{"kw": w, "w": c / best[0][1]} for w, c in best])
        return out

    return Model(lambda: run, "array<struct<kw: string, w: double>>", pa.list_(pa.struct([("kw", pa.string()), ("w", pa.float64())])))


def shared_words() -> Model:
    """Stand-in cross-encoder over question and text, parted by U+001F: the share of the question's distinct words that the text has."""

    def run(pairs: list[str]) -> list:
        out = []
        for p in pairs:
            question, _, text = p.lower().partition("\x1f")
            asked = set(re.findall(r"[a-z]+", question))
            out.append(len(asked & set(re.findall(r"[a-z]+", text))) / max(len(asked), 1))
        return out

    return Model(lambda: run, "double", pa.float64())


def word_recogniser() -> Model:
    """Stand-in recogniser over question and fact, parted by U+001F: YES if the question has a word of the fact, NO if not, no reply (null)
    to an empty question."""

    def run(pairs: list[str]) -> list:
        out = []
        for p in pairs:
            question, _, fact = p.lower().partition("\x1f")
            asked = set(re.findall(r"[a-z]+", question))
            out.append(("YES" if asked & set(re.findall(r"[a-z]+", fact)) else "NO") if asked else None)
        return out

    return Model(lambda: run, "string", pa.string())


def judged(rows: DataFrame, model: Model | None = None, prompt: str = "prompt") -> DataFrame:
    """rows with reply and verdict (YES: true, NO: false, else null) of a judge; without a model both are null."""
    reply = model.column(prompt) if model else F.lit(None).cast("string")
    text = F.upper(F.btrim(F.col("reply")))
    return rows.withColumn("reply", reply).withColumn("verdict", F.when(text.startswith("YES"), True).when(text.startswith("NO"), False))


def relation_label(reply: Column) -> Column:
    """is_a, part_of, unrelated or related; the longer label is tried first."""
    r = F.lower(F.coalesce(reply, F.lit("")))
    return F.when(r.contains("unrelated"), "unrelated").when(r.rlike(r"is[_\s-]?a\b"), "is_a").when(r.rlike(r"part[_\s-]?of"), "part_of").when(r.contains("related"), "related")


def answer_prompt(question: Column, context: Column, most: int = 6000) -> Column:
    return F.concat(F.lit("Context:\n"), F.substring(context, 1, most), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def reranked(pairs: DataFrame, score: Model | None = None, k: int = 10) -> DataFrame:
    """(qid, id, score, rk) of candidates (qid, id, question, text[, score]) by a cross-encoder, or as scored without one."""
    from loomgraph.operators.ranking import top

    s = pairs.withColumn("score", score.column(F.concat_ws("\x1f", "question", "text")).cast("double")) if score else pairs
    return top(s.select("qid", "id", "score"), k)


def kept_facts(facts: DataFrame, recognise: Model | None = None, prompt: str = "prompt") -> DataFrame:
    """Facts that a recogniser says YES to; without one, or where it fails (null), all."""
    if recognise is None:
        return facts
    return judged(facts, recognise, prompt).filter(F.coalesce("verdict", F.lit(True))).drop("reply", "verdict")
