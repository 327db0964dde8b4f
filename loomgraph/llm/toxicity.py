"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the n-grams of characters it has at all. For each n-gram r is naive Bayes's log-count ratio: the log of
the ratio of its smoothed count in toxic texts to the sum of all n-grams' smoothed counts there, and the same in the other texts.
The classifier is logistic on presence times r. Counts are taken where the texts are, over all n-grams of the labelled rows; an n-gram
takes part if its shares of the two classes' texts differ by LEAST_GAIN standard deviations (there is no limit to how many
do). Only these and the bounded sample's rows over them reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import blocks, bounded, col, held_out, spread, stored, texts

SIZES = (3, 4, 5, 6)
#: Labelled rows at most that training reads.
MOST_ROWS = 12_000
#: Standard deviations by which the shares of an n-gram in the two classes differ at least, to take part.
LEAST_GAIN = 4.0
#: Weight of the toxic side in the loss.
TOXIC_SHARE = 0.4
THRESHOLD = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = {c: " " for c in (9, 10, 11, 12, 13, 0xA0)}


def plain(text: bytes) -> str:
    """Lower case, white space as spaces, one at either end."""
    return f" {text.decode().lower().translate(_SPACE)} "


def gram_hashes(chars: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """For each size, a hash of the n-gram that starts at each character."""
    h = chars
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * _BASE + chars[n - 1 :] if len(h) > 1 else np.zeros(0, np.uint64)
        if n in sizes:
            g = (h + np.uint64(n)) * _MIX
            yield g ^ (g >> np.uint64(32))


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (gram, toxic texts, other texts), added up within blocks of texts of a bounded size."""
    for batch in batches:
        at = 0
        for part in blocks(batch.column(1)):
            label = np.asarray(batch.column(0).slice(at, len(part)).to_pylist(), np.int64)
            at += len(part)
            own = [np.unique(np.concatenate(list(gram_hashes(_chars(plain(t)))))) for t in texts(part)]
            toxic = np.concatenate([np.zeros(0, np.uint64), *(g for g, y in zip(own, label) if y)])
            other = np.concatenate([np.zeros(0, np.uint64), *(g for g, y in zip(own, label) if not y)])
            own = None
            p, n = np.unique(toxic, return_counts=True)
            q, m = np.unique(other, return_counts=True)
            g = np.union1d(p, q)
            np_, nq = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
            np_[np.searchsorted(g, p)], nq[np.searchsorted(g, q)] = n, m
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np_), pa.array(nq)], names=["gram", "p", "q"])


@dataclass
class Grams:
    """Chosen n-grams, sorted by hash, with their log-count ratios."""

    hashes: np.ndarray
    ratios: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def present(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) pairs of a few texts, by text."""
        parts = [plain(t) for t in texts(arr)]
        doc = np.repeat(np.arange(len(parts)), [len(t) for t in parts])
        found = []
        for g in gram_hashes(_chars("".join(parts))):
            at = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
            ok = self.hashes[place] == g[at]
            at, place = at[ok], place[ok]
            n = len(doc) - len(g)
            whole = doc[at] == doc[at + n]  # not over the end of a text
            found.append(doc[at[whole]] * len(self.hashes) + place[whole])
        key = np.unique(np.concatenate(found)) if len(self.hashes) else np.zeros(0, np.int64)
        return key // max(len(self.hashes), 1), key % max(len(self.hashes), 1)


@dataclass
class Model:
    grams: Grams
    weight: np.ndarray  # by gram, its ratio included
    bias: float

    def score(self, arr: pa.Array) -> np.ndarray:
        doc, gram = self.grams.present(arr)
        z = self.bias + np.bincount(doc, weights=self.weight[gram], minlength=len(arr))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(doc: np.ndarray, gram: np.ndarray, label: np.ndarray, ratios: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio; of the loss, TOXIC_SHARE is the toxic texts' together."""
    n, k = len(label), len(ratios)
    value = ratios[gram]
    share = np.where(label == 1, TOXIC_SHARE / max((label == 1).sum(), 1), (1 - TOXIC_SHARE) / max((label == 0).sum(), 1))
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(doc, weights=value * w[gram], minlength=n)
        e = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - label) * share
        g = np.append(np.bincount(gram, weights=value * e[doc], minlength=k) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def ratios(counts: DataFrame, toxic: int, other: int, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, their log-count ratios) of those (gram, p toxic texts, q other texts) that tell the classes apart, by n-gram;
    toxic, other: labelled texts. The sums are over all n-grams and come with the same pass."""
    sums = Observation()
    pooled = (F.col("p") + F.col("q") + 1) / F.lit(toxic + other + 2.0)
    gain = F.abs((F.col("p") + 0.5) / F.lit(toxic + 1.0) - (F.col("q") + 0.5) / F.lit(other + 1.0)) / F.sqrt(pooled * (1 - pooled) * F.lit(1.0 / toxic + 1.0 / other))
    rows = counts.observe(sums, F.sum(F.col("p") + 1).alias("p"), F.sum(F.col("q") + 1).alias("q")).filter(gain >= least_gain).select("gram", "p", "q").collect()
    gram = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    p, q = (np.array([r[c] for r in rows], np.float64) for c in "pq")
    r = np.log((p + 1) / (sums.get["p"] or 1)) - np.log((q + 1) / (sums.get["q"] or 1))
    order = np.argsort(gram)
    return gram[order], r[order]


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, least_gain: float = LEAST_GAIN) -> Model | None:
    """The model from at most `most_rows` labelled rows outside the held-out fold; None if a class is missing. Where labels of one id
    differ, each counts; null labels and ids do not."""
    fold = ~held_out(F.col("doc_id"))
    ids = bounded(labels.filter(fold & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct(), most_rows)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("toxic").cast("long"), "text"), "labelled")
    rows = spread(rows)
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    counts = rows.mapInArrow(_counts, "gram long, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    grams = Grams(*ratios(counts, totals[1], totals[0], least_gain))
    held = docs.sparkSession.sparkContext.broadcast(grams)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1)):
                doc, gram = held.value.present(part)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(gram.astype(np.int32)))], names=["toxic", "grams"])
                at += len(part)

    got = rows.mapInArrow(present, "toxic long, grams array<int>").toArrow()
    lists = got.column("grams").combine_chunks()
    label = got.column("toxic").to_numpy()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(label)), size)
    w, b = fit(doc, lists.flatten().to_numpy(), label, grams.ratios)
    return Model(grams, w * grams.ratios, b)


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, from 0 to 1, of each whole text (null: empty); 0 without a model."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array(np.concatenate([np.zeros(0), *(held.value.score(b) for b in blocks(batch))]))

    return docs.withColumn(out, arrow_udf(scored, "double")(col(text_col)))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document. Repeated rows each have a row, ids may be null (held out), null and empty texts have a score like any
    other, texts of any length are read whole, a score at the threshold is predicted 1, an empty table gives an empty result,
    other columns are ignored, whatever their names."""
    rows = with_score(spread(docs.select("doc_id", "text")), learn(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
