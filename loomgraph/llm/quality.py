"""A quality classifier by positive-unlabelled learning.

Trusted positives are texts that `labels.quality` marks 1; the unlabelled side is all web text outside the held-out fold, whose
labels are not read. The share of good text in it (the class prior) is estimated by the best-bin rule: among thresholds of a
first classifier of positives against unlabelled text, the least ratio of the unlabelled and positive shares above it, each
taken at its confidence bound. The classifier then minimises the non-negative unbiased risk
    prior E_p[l(f)] + max(0, E_u[l(-f)] - prior E_p[l(-f)]),
so it never gains by driving the estimated risk of negatives below zero. Features are of the whole text: how its classes
of characters follow each other, and how its words and lines repeat.

The prior's shares are counted over all unlabelled texts. The risk of the unlabelled side is taken over a draw of them, by which
gradient steps are affordable; Newton steps of the output layer on all of them were tried and gave a worse classifier, since the
exact minimum at a prior a little too high moves all margins of bad text up to the bound of the risk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import blocks, bounded, col, every, free, held_out, spread, utf8
from .decontam import words_of

#: Rows at most that gradient steps take: trusted positives, unlabelled texts. The prior counts all of these.
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
THRESHOLD = 0.3

_CLASS_OF = np.zeros(256, np.uint8)
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"'\"()-", b"|<>[]{}\\/_=", b"#$%&*+@^~`"]
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i + 1
_CLASS_OF[0x80:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES * N_CLASSES + 6


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document."""
    mixed = key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    m, d = mixed[order], doc[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])]) if len(m) else np.zeros(0, bool)
    return np.bincount(d[new], minlength=n)


def _line_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the document of each line that is not empty."""
    n = len(data)
    at = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], at + 1]))
    starts = starts[starts < n]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = np.arange(n, dtype=np.uint64) - np.repeat(starts, np.diff(np.concatenate([starts, [n]]))).astype(np.uint64)
    term = (data.astype(np.uint64) + np.uint64(1)) * ((step * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB))
    term ^= term >> np.uint64(31)
    term[data == 10] = 0
    h = np.add.reduceat(term, starts)
    keep = h != 0
    return h[keep], np.searchsorted(offsets, starts[keep], side="right") - 1


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each of the concatenated UTF-8 texts; zeros for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    size = np.diff(offsets)
    square = N_CLASSES * N_CLASSES
    if len(data):
        doc = np.repeat(np.arange(n), size)
        c = _CLASS_OF[data].astype(np.int64)
        same = doc[1:] == doc[:-1]
        code = (doc[:-1] * square + c[:-1] * N_CLASSES + c[1:])[same]
        out[:, :square] = np.log1p(1000.0 * np.bincount(code, minlength=n * square).reshape(n, square) / np.maximum(size, 1)[:, None])
    h, wd, words = words_of(offsets, data)
    some = np.maximum(words, 1)
    again = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
    out[:, square] = np.bincount(wd[1:][again], minlength=n) / some
    out[:, square + 1] = _distinct(h, wd, n) / some
    out[:, square + 2] = np.log(np.maximum(_distinct(h, wd, n), 1)) / np.log(some + 1)
    lh, ld = _line_hashes(offsets, data)
    lines = np.bincount(ld, minlength=n)
    out[:, square + 3] = 1.0 - _distinct(lh, ld, n) / np.maximum(lines, 1) * (lines > 0)
    out[:, square + 4] = np.log1p(words) / 10
    out[:, square + 5] = size / some / 10
    return out


def _feature_column(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in column:
        x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(features(*utf8(b)) for b in blocks(batch))])
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(standard(x, self.mean, self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def moments(positive: np.ndarray, unlabelled: np.ndarray, columns: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature over both sides; some columns at a time, so no copy of all of them is made."""
    mean, scale = np.zeros(positive.shape[1]), np.zeros(positive.shape[1])
    for at in range(0, len(mean), columns):
        part = slice(at, at + columns)
        both = np.concatenate([positive[:, part], unlabelled[:, part]]).astype(np.float64)
        mean[part], scale[part] = both.mean(0), np.maximum(both.std(0), 1e-3)
    return mean, scale


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """x by mean and scale, within 8 of 0, in one array of doubles."""
    z = np.subtract(x, mean, dtype=np.float64)
    z /= scale
    return np.clip(z, -8, 8, out=z)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Minimises the non-negative risk at `prior`; with prior None, the plain risk of positives against unlabelled."""
    mean, scale = moments(positive, unlabelled)
    x, u = (standard(a, mean, scale) for a in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        hx, hu = np.tanh(x @ theta[0] + theta[1]), np.tanh(u @ theta[0] + theta[1])
        fx, fu = hx @ theta[2] + theta[3], hu @ theta[2] + theta[3]
        if prior is None:
            gx, gu = (_sigmoid(fx) - 1) / (2 * len(x)), _sigmoid(fu) / (2 * len(u))
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fx).mean()
            if negative >= 0:
                gx, gu = prior * (_sigmoid(fx) - 1) / len(x) - prior * _sigmoid(fx) / len(x), _sigmoid(fu) / len(u)
            else:  # step back up from a risk below zero
                gx, gu = prior * _sigmoid(fx) / len(x), -_sigmoid(fu) / len(u)
        dx, du = np.outer(gx, theta[2]) * (1 - hx * hx), np.outer(gu, theta[2]) * (1 - hu * hu)
        grads = [x.T @ dx + u.T @ du + decay * theta[0], dx.sum(0) + du.sum(0), hx.T @ gx + hu.T @ gu + decay * theta[2], gx.sum() + gu.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3]), 0.5 if prior is None else prior)


def best_bin_cuts(positive: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(positive, np.linspace(0.0, 0.95, 96)))


def best_bin(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int, delta: float = 0.1) -> float:
    """The class prior from the shares of n_p held-back positives and of n_u unlabelled texts at or above each cut."""
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from scores of held-back positives and unlabelled texts."""
    cuts = best_bin_cuts(positive)
    above = lambda x: np.array([(x >= c).mean() for c in cuts])
    return best_bin(above(positive), len(positive), above(unlabelled), len(unlabelled))


def first_fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, np.ndarray]:
    """A plain classifier of one half of the rows, and its margins of the other half of the positives."""
    first = fit(positive[::2], unlabelled[::2], None, steps=200)
    return first, first.margin(positive[1::2] if len(positive) > 1 else positive)


def with_margin(docs: DataFrame, model: Model, of, out: str, text_col: str = "text") -> DataFrame:
    """docs with `out`: of(model, features) of each whole text (null: empty), a double."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def read(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array(np.concatenate([np.zeros(0), *(of(held.value, features(*utf8(b)).astype(np.float64)) for b in blocks(batch))]))

    return docs.withColumn(out, arrow_udf(read, "double")(col(text_col)))


def whole_prior(docs: DataFrame, first: Model, held: np.ndarray) -> float:
    """The class prior from the margins `held` of held-back positives and those of all texts of docs, counted in one pass."""
    cuts = best_bin_cuts(held)
    rows = with_margin(docs.select("text"), first, Model.margin, "m")
    n, *above = rows.select("m").agg(F.count("*"), *[F.count_if(F.col("m") >= float(c)) for c in cuts]).first()
    return best_bin(np.array([(held >= c).mean() for c in cuts]), len(held), np.array(above) / n, n)


def learn(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """The model from rows outside the held-out fold; None if there is nothing to learn from.

    Ids come first (id columns only are read and the bounded sets of ids broadcast), then the texts of these rows are
    read for their features, then all texts outside the fold for the prior. Where labels for one id differ, each counts; so
    does each of repeated rows.
    """
    fold = ~held_out(F.col("doc_id"))
    good = bounded(labels.filter(fold & (F.col("quality") == 1)).select("doc_id").distinct(), most_positive)
    web = bounded(docs.select("doc_id").filter(fold & F.col("doc_id").isNotNull()).distinct(), most_unlabelled, seed=1)
    ids = good.withColumn("u", F.lit(0)).unionByName(web.withColumn("u", F.lit(1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("u", arrow_udf(_feature_column, "array<float>")("text").alias("x"), F.xxhash64("doc_id").alias("h"))
    got = rows.toArrow()
    if not got.num_rows:
        return None
    order = pc.sort_indices(got.select(["h", "u"]), [("h", "ascending"), ("u", "ascending")]).to_numpy()
    side = got.column("u").to_numpy()[order]
    if not (side == 0).any() or not (side == 1).any():
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    del got
    positive, unlabelled = x[order[side == 0]], x[order[side == 1]]
    del x
    first, held = first_fit(positive, unlabelled)
    prior = whole_prior(spread(docs.filter(fold & F.col("doc_id").isNotNull()).select("text")), first, held)
    return fit(positive, unlabelled, prior)


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, from 0 to 1, of each whole text (null: empty); 0.5 without a model."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    return with_margin(docs, model, Model.score, out, text_col)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document. Repeated rows each have a row, ids may be null (held out), null and empty texts have a score like any
    other, texts of any length are read whole, a score at the threshold is predicted 1, an empty table gives an empty result,
    other columns are ignored, whatever their names."""
    rows = with_score(spread(docs.select("doc_id", "text")), learn(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; a score at it stays.

    Null and empty texts have a score like any other. Without a model (no labels, no documents) all have 0.5. Equal texts have
    equal scores, so of repeated rows all stay or all go. An empty table stays empty; columns stay, whatever their names.
    """
    out = free(docs, "score")
    return with_score(docs, learn(docs, labels), out=out).filter(F.col(out) >= threshold).select(*every(docs))
