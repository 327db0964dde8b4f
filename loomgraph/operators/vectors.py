"""Vector operators: cosine, nearest neighbours, similar pairs, centroids, dispersion, variance and score transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import TILE as SIDE
from .blocks import in_parts, matrix, meeting, spans
from .blocks import unit as units_of
from .corpus import one_row

#: Vectors of the broadcast side of a blocked search at a time, and products of a task at a time (8 bytes each).
BLOCK, TILE = 4096, 1 << 20
#: Decimals to which similarities are rounded before they are ranked, so that ties break by id everywhere.
DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(F.lit(0.0)))


class Block(NamedTuple):
    """Queries of a blocked search: their ids, unit vectors and further columns."""

    ids: pa.Array
    units: np.ndarray
    cols: dict[str, list]


class Tile(NamedTuple):
    """Cosines of a block with some rows (queries x rows), and these rows (id, v, further columns)."""

    s: np.ndarray
    rows: pa.RecordBatch


def _vector_blocks(vectors: DataFrame, id_col: str, vec_col: str, block: int, keep: tuple[str, ...] = ()) -> Iterator[tuple[list, np.ndarray, dict]]:
    """(ids, unit vectors, further columns) of at most `block` rows at a time; only one block is on the driver."""
    rows = []

    def taken() -> tuple[list, np.ndarray, dict]:
        return [r[0] for r in rows], units_of(np.asarray([r[1] for r in rows], np.float64)), {c: [r[2 + k] for r in rows] for k, c in enumerate(keep)}

    for r in vectors.select(id_col, vec_col, *keep).filter(F.col(vec_col).isNotNull()).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield taken()
            rows = []
    if rows:
        yield taken()


def searched(queries: DataFrame, corpus: DataFrame, f: Callable[[Block, Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str, q_id: str = "vec_id", q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding", q_keep: tuple[str, ...] = (), c_keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """What f(queries, tiles) gives of the cosines of all queries with all rows.

    Queries are broadcast in blocks of a fixed size. A task meets its rows with a block in tiles of a fixed number of products, of
    which it holds one at a time, with what f keeps.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(c_id).alias("id"), F.col(c_vec).alias("v"), *c_keep).filter(F.col("v").isNotNull())
    id_type = to_arrow_type(queries.schema[q_id].dataType)
    parts = []
    for ids, units, cols in _vector_blocks(queries, q_id, q_vec, block, q_keep):
        held = spark.sparkContext.broadcast((pa.array(ids, id_type), units, cols))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = Block(*held.value)
            step = max(1, TILE // len(own.units))
            tiles = (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step))
            yield from f(own, (Tile(np.round(own.units @ units_of(matrix(b.column("v"))).T, DIGITS), b) for b in tiles))

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


class Best:
    """The k best (query, id, score) of tiles, ties by id; candidates are cut to k a query whenever there are many."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.low, self.held, self.some = np.full(n, -np.inf), [], 0

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        low = self.low
        if s.shape[1] > self.k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(s, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((s >= low[:, None]) & (s > -np.inf))
        if len(i):
            self.held.append((i, s[i, j], ids[j]))
            self.some += len(i)
            if self.some > 2 * self.n * self.k + TILE // 4:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        i, s, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -s, i))
        i = i[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        order, i, last = order[rank < self.k], i[rank < self.k], rank[rank < self.k] == self.k - 1
        self.held, self.some = [(i, s[order], ids[order])], len(i)
        self.low[i[last]] = s[order][last]
        return self.held[0]


def knn(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "vec_id", q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding", least: float | None = None, block: int = BLOCK, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, weights: str = "weights", cluster: str = "cluster") -> DataFrame:
    """(qid, id, score, rk): each query's k most similar rows by cosine, ties by id; of at least `least` if that is given.

    With weigh, the best k by weigh(cosines, weights): a query's `weights` are a map of weights by cluster, a row has the weight of its
    `cluster`, NaN where there is none; rows whose result is NaN are left out.

    A partition keeps its best k a query and sends those on, and a window merges the partitions'.
    """
    schema = f"qid {dict(queries.dtypes)[q_id]}, id {dict(corpus.dtypes)[c_id]}, score double"

    def best(own: Block, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        found, kind = Best(len(own.units), k), None
        table = weight_table(own.cols[weights]) if weigh else None
        for s, rows in tiles:
            kind = rows.column("id").type
            if weigh:
                w = weigh(s, table[0][:, [table[1].get(c, -1) for c in rows.column(cluster).to_pylist()]])
                s = np.where(np.isnan(w), -np.inf, np.round(w, DIGITS))
            if least is not None:
                s = np.where(s >= least, s, -np.inf)
            found.add(s, np.asarray(rows.column("id").to_pylist()))
        if (got := found.cut()) is not None:
            i, s, ids = got
            yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), pa.array(ids.tolist(), kind), pa.array(s)], names=["qid", "id", "score"])

    found = searched(queries, corpus, best, schema, q_id, q_vec, c_id, c_vec, (weights,) if weigh else (), (cluster,) if weigh else (), block)
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rk") <= k)


def weight_table(maps: list[dict | None]) -> tuple[np.ndarray, dict]:
    """Weights of queries by cluster, a last column of NaN for any other cluster; the columns of the clusters."""
    place: dict = {}
    for m in maps:
        for c in m or ():
            place.setdefault(c, len(place))
    table = np.full((len(maps), len(place) + 1), np.nan)
    for i, m in enumerate(maps):
        for c, w in (m or {}).items():
            table[i, place[c]] = w
    return table, place


def _emitted(own: Block, s: np.ndarray, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(qid, id, score) of a tile, some queries at a time."""
    for r in spans(len(s), max(1, (TILE >> 3) // max(len(ids), 1))):
        i, j = np.repeat(np.arange(r.start, r.stop), len(ids)), np.tile(np.arange(len(ids)), r.stop - r.start)
        yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[r].ravel())], names=names)


def scores(queries: DataFrame, corpus: DataFrame, q_id: str = "vec_id", q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(qid, id, score): the cosine of every query with every row. They leave a task as they are made; nothing is shuffled."""
    every = lambda own, tiles: (b for s, rows in tiles for b in _emitted(own, s, rows.column("id"), ["qid", "id", "score"]))
    return searched(queries, corpus, every, f"qid {dict(queries.dtypes)[q_id]}, id {dict(corpus.dtypes)[c_id]}, score double", q_id, q_vec, c_id, c_vec, block=block)


def score_moments(queries: DataFrame, corpus: DataFrame, by: str | None = None, q_id: str = "vec_id", q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(qid[, by], mean, deviation) of scores(), the deviation of the population. A task sends on one row a query [and value of by]."""
    kinds = f"qid {dict(queries.dtypes)[q_id]}, " + (f"{by} {dict(corpus.dtypes)[by]}, " if by else "")

    def moments(own: Block, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for s, rows in tiles:
            kind = rows.column(by).type if by else None
            names = rows.column(by).to_pylist() if by else [None] * rows.num_rows
            at: dict = {}
            for j, c in enumerate(names):
                at.setdefault(c, []).append(j)
            for c, cols in at.items():
                x = s[:, cols] if len(at) > 1 else s
                n, mean = x.shape[1], x.mean(1)
                m2 = ((x - mean[:, None]) ** 2).sum(1)
                if c in sums:
                    n0, mean0, m20 = sums[c]
                    d, n1 = mean - mean0, n + n0
                    n, mean, m2 = n1, mean0 + d * n / n1, m20 + m2 + d * d * n0 * n / n1
                sums[c] = n, mean, m2
        for c, (n, mean, m2) in sums.items():
            own_ = [pa.array([c] * len(mean), kind)] if by else []
            yield pa.RecordBatch.from_arrays([own.ids, *own_, pa.array(np.full(len(mean), n, np.int64)), pa.array(mean), pa.array(m2)], names=["qid", *([by] if by else []), "n", "mean", "m2"])

    keys = ["qid", *([by] if by else [])]
    part = searched(queries, corpus, moments, kinds + "n long, mean double, m2 double", q_id, q_vec, c_id, c_vec, (), (by,) if by else (), block)
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    m2 = F.greatest(F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - m * m / n, F.lit(0.0))
    return part.groupBy(*keys).agg((m / n).alias("mean"), F.sqrt(m2 / n).alias("deviation"))


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, score), a < b: pairs with a cosine of at least `least`; only those leave a task. Exact, so quadratic in time."""
    kind = dict(vectors.dtypes)[id_col]

    def pairs(own: Block, tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
        names = np.asarray(own.ids.to_pylist())
        for s, rows in tiles:
            i, j = np.nonzero((s >= least) & (names[:, None] < np.asarray(rows.column("id").to_pylist())[None, :]))
            yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), rows.column("id").take(pa.array(j)), pa.array(s[i, j])], names=["a", "b", "score"])

    return searched(vectors, vectors, pairs, f"a {kind}, b {kind}, score double", id_col, vec_col, id_col, vec_col, block=block)


def by_dimension(vectors: DataFrame, *keys: str, vec_col: str = "embedding") -> DataFrame:
    """(keys, dim, x) from 0."""
    return vectors.select(*keys, F.posexplode(F.col(vec_col)).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(label, n, centroid): mean vector of each label from 0 up."""
    per = by_dimension(vectors.filter(F.col(label) >= 0), label, vec_col=vec_col).groupBy(label, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return per.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def dispersion(vectors: DataFrame, *keys: str, vec_col: str = "embedding") -> DataFrame:
    """(keys, n, dispersion): mean of 1 - cosine over the pairs of each group, in closed form from the sum of unit vectors."""
    u = vectors.filter(F.col(vec_col).isNotNull()).withColumn("u", unit(F.col(vec_col)))
    sums = by_dimension(u, *keys, vec_col="u").groupBy(*keys, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    n = F.max("n")
    return sums.groupBy(*keys).agg(n.alias("n"), F.when(n > 1, 1 - (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (n * (n - 1))).alias("dispersion"))


def separation(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """One row: within, between (mean distances of pairs of equal and of different labels) and proxy (b - w) / max(b, w)."""
    each = dispersion(vectors.filter(F.col(label) >= 0), label, vec_col=vec_col)
    whole = dispersion(vectors.filter(F.col(label) >= 0), vec_col=vec_col)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    w = each.agg(F.sum(F.coalesce("dispersion", F.lit(0.0)) * pairs).alias("ws"), F.sum(pairs).alias("wn"))
    both = one_row(whole.select((F.col("dispersion") * pairs).alias("s"), pairs.alias("p")), w)
    both = both.select((F.col("ws") / F.col("wn")).alias("within"), ((F.col("s") - F.col("ws")) / (F.col("p") - F.col("wn"))).alias("between"))
    return both.withColumn("proxy", (F.col("between") - F.col("within")) / F.greatest("between", "within"))


def distance_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n) of 1 - score over [0, 2]; the last bin takes what is beyond."""
    b = F.least(F.floor((1 - F.col("score")) / 2 * bins), F.lit(bins - 1))
    return pairs.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def distances_within(vectors: DataFrame, label: str = "label", bins: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(bin, n): distance_histogram() of the pairs of rows of one label. Parts of a label meet in pairs, and a task counts a tile
    of distances at a time: only its counts are sent on. Time is quadratic in a label's rows."""
    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(label).isNotNull()).select(label, F.col(id_col).alias("id"), F.col(vec_col).alias("v"))

    def count(x: pa.Table, y: pa.Table | None) -> pa.Table:
        u = units_of(matrix(x.column("v")))
        v = u if y is None else units_of(matrix(y.column("v")))
        n = np.zeros(bins, np.int64)
        for r in spans(len(u), SIDE):
            for c in spans(len(v), SIDE):
                if y is None and c.start < r.start:
                    continue
                s = np.round(u[r] @ v[c].T, DIGITS)
                s = s[np.triu_indices(len(s), 1)] if y is None and r == c else s.ravel()
                n += np.bincount(np.minimum(np.floor((1 - s) / 2 * bins), bins - 1).astype(np.int64), minlength=bins)
        return pa.table({"bin": np.arange(bins), "n": n})

    parted = in_parts(rows, label, *([block] if block else []))
    return meeting(parted, label, count, "bin long, n long").filter("n > 0").groupBy("bin").agg(F.sum("n").alias("n"))


def variance_ranks(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dim, variance, rk): dimensions by falling population variance."""
    v = by_dimension(vectors, vec_col=vec_col).groupBy("dim").agg(F.round(F.var_pop("x"), DIGITS).alias("variance"))
    return v.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("variance"), "dim")))


def power(x: Column, p: float) -> Column:
    return F.when(x > 0, F.pow(x, F.lit(p))).otherwise(F.lit(0.0))


def sigmoid(x: Column, theta: float | Column, k: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-k * (x - theta)))


def z_scores(rows: DataFrame, group: str | None, value: str, out: str) -> DataFrame:
    """rows with the z-score of value within group (all rows without one), by population deviation; 0 where that is 0."""
    stats = rows.groupBy(*([group] if group else [])).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    both = rows.join(stats, group) if group else one_row(rows, stats)
    return both.withColumn(out, F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))).drop("__m", "__s")


def similarity_rows(pairs: DataFrame) -> DataFrame:
    """(i, j, w) of pairs (a, b, score): both directions of positive cosines; each row's weights sum to 1."""
    both = pairs.filter("score > 0").select(F.col("a").alias("i"), F.col("b").alias("j"), "score").union(pairs.filter("score > 0").select(F.col("b"), F.col("a"), "score"))
    return both.withColumn("w", F.col("score") / F.sum("score").over(Window.partitionBy("i"))).drop("score")


def component_activation(vectors: DataFrame, n_dims: int, share: float = 0.2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(dim, id): for each of the n_dims dimensions of the highest variance, the int(share x N) rows highest on it."""
    top = variance_ranks(vectors, vec_col).filter(F.col("rk") <= n_dims).select("dim")
    rows = by_dimension(vectors, id_col, vec_col=vec_col).join(top, "dim")
    n = vectors.agg(F.floor(F.count("*") * F.lit(share)).alias("most"))
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("x"), id_col)))
    return one_row(ranked, n).filter("rk <= most").select("dim", F.col(id_col).alias("id"))


def density_theta(pairs: DataFrame, n: int, edges: float = 6.5) -> DataFrame:
    """One row, theta: the int(edges x n / 2)-th largest score, which leaves about `edges` edges a node."""
    k = max(1, int(edges * n / 2))
    return pairs.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("theta"))
