"""Rank metrics, agreement, separation tests and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

from .corpus import one_row


def _log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def rank_metrics(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, p, recall, ap, rr) of results (qid, id, rk) against (qid, id, grade); every query of qrels has a row.

    The k results of a query are broadcast and qrels are counted by grade, so these, which may be many a query, are read and not shuffled.
    """
    good = qrels.filter("grade > 0")
    hits = good.join(F.broadcast(results.filter(F.col("rk") <= k)), ["qid", "id"])
    seen = F.row_number().over(Window.partitionBy("qid").orderBy("rk"))
    hits = hits.withColumn("seen", seen)
    got = hits.groupBy("qid").agg(
        F.sum(F.col("grade") / _log2(F.col("rk") + 1)).alias("dcg"), F.count("*").alias("n"), F.sum(F.col("seen") / F.col("rk")).alias("ap"), F.min("rk").alias("first")
    )
    # Rows of one grade take the ranks after those of all better ones; below[i] is the sum of the first i ranks' discounts.
    below = F.lit(np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, k + 2)))]).tolist())
    upto = F.sum("c").over(Window.partitionBy("qid").orderBy(F.desc("grade")))
    at = lambda n: F.element_at(below, (F.least(n, F.lit(k)) + 1).cast("int"))
    grades = good.groupBy("qid", "grade").agg(F.count("*").alias("c")).withColumn("upto", upto)
    ideal = grades.groupBy("qid").agg(F.sum(F.col("grade") * (at(F.col("upto")) - at(F.col("upto") - F.col("c")))).alias("idcg"), F.sum("c").alias("relevant"))
    rows = ideal.join(got, "qid", "left").fillna(0, ["dcg", "n", "ap"])
    rr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return rows.select("qid", (F.col("dcg") / F.col("idcg")).alias("ndcg"), (F.col("n") / k).alias("p"), (F.col("n") / F.col("relevant")).alias("recall"), (F.col("ap") / F.least("relevant", F.lit(k))).alias("ap"), rr.alias("rr"))


def by_stratum(rows: DataFrame, stratum: str, *values: str) -> DataFrame:
    """Means of values for each stratum and for all ('_all'), nulls left out."""
    got = rows.rollup(stratum).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values], F.grouping(stratum).alias("g"))
    return got.withColumn(stratum, F.when(F.col("g") == 1, F.lit("_all")).otherwise(F.col(stratum).cast("string"))).drop("g")


def overlap(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """(qid, overlap): rows that two rankings' tops share, over the shorter one's length or k."""
    a, b = (r.filter(F.col("rk") <= k).groupBy("qid").agg(F.collect_set("id").alias(n)) for r, n in ((first, "a"), (second, "b")))
    n = F.least(F.lit(k), F.size("a"), F.size("b"))
    return a.join(b, "qid").select("qid", (F.size(F.array_intersect("a", "b")) / n).alias("overlap"))


def _tied(x: np.ndarray) -> int:
    """Pairs of equal values of a sorted array."""
    c = np.diff(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))) if len(x) else np.zeros(0, np.int64)
    return int((c * (c - 1) // 2).sum())


def falling_pairs(y: np.ndarray) -> int:
    """How many pairs i < j have y[i] > y[j], for whole numbers from 0: bit by bit from the highest, those that first differ in it."""
    total = 0
    for b in range(int(y.max()).bit_length() - 1, -1, -1) if len(y) else ():
        # Rows are in the order of their higher bits, and in the given one where these are equal.
        one, high = (y >> b) & 1, y >> (b + 1)
        ones = np.cumsum(one)
        start = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        before = np.repeat((ones - one)[start], np.diff(np.append(start, len(y))))
        total += int((ones - before)[one == 0].sum())
        y = y[np.argsort(y >> b, kind="stable")]
    return total


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b in n log n steps; None where there are fewer than two rows or a side is constant."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = np.unique(x[order], return_inverse=True)[1], np.unique(y[order], return_inverse=True)[1]
    pairs, tx, ty = n * (n - 1) // 2, _tied(x), _tied(np.sort(y))
    # With x rising and y rising within equal x, only pairs that disagree fall.
    s = pairs - tx - ty + _tied(x * (int(y.max(initial=0)) + 1) + y) - 2 * falling_pairs(y)
    return s / float(np.sqrt(float(pairs - tx) * float(pairs - ty))) if n > 1 and pairs > tx and pairs > ty else None


def _tau(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"qid": pdf["qid"].iloc[:1], "tau": [tau_b(pdf["a"].to_numpy(), pdf["b"].to_numpy())]})


def kendall(first: DataFrame, second: DataFrame) -> DataFrame:
    """(qid, tau): tau-b of two score tables (qid, id, score) over the union of their rows, missing ones as 0; null where
    there are fewer than two or a side is constant. A query's scores are one task's rows, 16 bytes each, and are sorted."""
    a, b = first.select("qid", "id", F.col("score").alias("a")), second.select("qid", "id", F.col("score").alias("b"))
    both = a.join(b, ["qid", "id"], "full").fillna(0.0, ["a", "b"]).select("qid", "a", "b")
    return both.groupBy("qid").applyInPandas(_tau, f"qid {dict(first.dtypes)['qid']}, tau double")


def evidence_recall(evidence: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, recall): the mean over statements (qid, statement) of the share of content words in the context (qid, text)."""
    e = evidence.select("qid", "statement", T.content_tokens("statement").alias("t"))
    c = context.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(T.content_tokens("text")))).alias("c"))
    rows = e.join(c, "qid", "left")
    share = F.when(F.size("t") > 0, F.coalesce(F.size(F.array_intersect("t", "c")), F.lit(0)) / F.size("t")).otherwise(F.lit(0.0))
    return rows.groupBy("qid").agg(F.avg(share).alias("recall"))


def auc(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """(keys, auc): P(score of a positive > of a negative), ties half. Only counts by distinct score are ordered."""
    steps = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("wins", F.col("p") * (below + F.col("q") / 2))
    total = F.sum("p") * F.sum("q")
    return steps.groupBy(*keys).agg(F.when(total > 0, F.sum("wins") / total).alias("auc"))


def sign_flips(diffs: DataFrame, n: int = 1000) -> DataFrame:
    """One row (delta, p_value, n): a two-sided paired permutation test of (qid, diff) with n sign flips.

    Signs come from a hash of query and flip; each query's flips are a row's array, added up by flip. p is 1 under five queries.
    """
    flips = diffs.select("diff", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "qid")
    sign = F.when(F.substring(F.md5(F.concat_ws(":", F.col("qid").cast("string"), F.col("k").cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    means = flips.groupBy("k").agg(F.avg(F.col("diff") * sign).alias("m"))
    base = diffs.agg(F.avg("diff").alias("delta"), F.count("*").alias("n"))
    hits = one_row(means, base).agg(F.count_if(F.abs(F.round("m", 9)) >= F.abs(F.round("delta", 9))).alias("hits"))
    p = F.when((F.col("n") < 5) | (F.abs("delta") < 1e-8), 1.0).otherwise(F.col("hits") / n)
    return one_row(base, hits).select("delta", p.alias("p_value"), "n")


def tail_stats(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, n_positive, n_unique, tie_share, longest_tie, entropy, over_median) of scores (qid, id, score)."""
    pos = scores.filter("score > 0").withColumn("s", F.round("score", digits))
    ties = pos.groupBy("qid", "s").agg(F.count("*").alias("c"))
    t = ties.groupBy("qid").agg(F.count("*").alias("n_unique"), F.avg((F.col("c") > 1).cast("int")).alias("tie_share"), F.max("c").alias("longest_tie"))
    total = pos.withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy("qid")))
    e = total.groupBy("qid").agg(F.count("*").alias("n_positive"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), (F.max("s") / F.percentile("s", F.lit(0.5))).alias("over_median"))
    return t.join(e, "qid")


def verdict(auc_: Column, p: Column, strong: float = 0.6, level: float = 0.05) -> Column:
    return F.when((auc_ >= strong) & (p < level), "grounded").when(p < level, "weak").otherwise("none")


def retention(acc: Column, factor: Column, board: Column) -> Column:
    return acc * factor * 100 / board


def leaderboard_factor(base: Column, board: float = 61.0) -> Column:
    return F.when(base > 0, board / (100 * base))


def morphological_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: words of one stem."""
    w = words.select("word", T.stem("word").alias("stem"))
    return w.select(F.col("word").alias("a"), "stem").join(w.select(F.col("word").alias("b"), "stem"), "stem").filter("a < b").select("a", "b")


def separation_report(first: DataFrame, second: DataFrame, cells: DataFrame, least: int = 5) -> DataFrame:
    """(cell, n, rank_first, rank_second, verdict): mean ranks of the cells (qid, id, cell) under two rankings (qid, id, rk)."""
    a, b = first.select("qid", "id", F.col("rk").alias("ra")), second.select("qid", "id", F.col("rk").alias("rb"))
    rows = cells.join(a, ["qid", "id"]).join(b, ["qid", "id"]).groupBy("cell").agg(F.count("*").alias("n"), F.avg("ra").alias("rank_first"), F.avg("rb").alias("rank_second"))
    v = F.when(F.col("n") < least, "too_few").when(F.col("rank_second") < F.col("rank_first"), "up").when(F.col("rank_second") > F.col("rank_first"), "down").otherwise("same")
    return rows.withColumn("verdict", v)


def shuffle_test(vectors: DataFrame, n: int = 100, id_col: str = "vec_id", label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """One row (ratio, p_value): mean dispersion within labels over that of all rows, against n reassignments of the labels
    that keep their sizes (each a ranking of the rows by hash)."""
    from .vectors import dispersion

    v = vectors.filter(F.col(label) >= 0).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec_col).alias("embedding"))
    whole = dispersion(v).select(F.col("dispersion").alias("whole"))
    own = dispersion(v, "label").agg(F.avg("dispersion").alias("own"))
    order = Window.partitionBy("k").orderBy(F.xxhash64("id", "k"))
    slots = v.select("label", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("label", F.monotonically_increasing_id())))
    dealt = v.select("id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("i", F.row_number().over(order))
    mixed = dispersion(dealt.join(slots, ["k", "i"]), "k", "label").groupBy("k").agg(F.avg("dispersion").alias("d"))
    hits = one_row(mixed, own).agg(F.count_if(F.col("d") <= F.col("own")).alias("hits"))
    return one_row(one_row(own, whole), hits).select((F.col("own") / F.col("whole")).alias("ratio"), ((F.col("hits") + 1) / (n + 1)).alias("p_value"))


def ratio_persistence(depths: DataFrame) -> DataFrame:
    """(depth, ratio, over_last): mean ratio of each depth and its share of the one before."""
    r = depths.groupBy("depth").agg(F.avg("ratio").alias("ratio"))
    return r.withColumn("over_last", F.col("ratio") / F.lag("ratio").over(Window.orderBy("depth")))
