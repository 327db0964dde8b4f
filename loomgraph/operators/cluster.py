"""Clustering: density clusters, greedy proximity, residual and whitening transforms, trees, communities, agreement.

Sets of any size: density clusters and trees meet a set's blocks in pairs, each pair a task; greedy proximity, an order by
definition, is one task that holds its centres; transforms are moments of each set, applied a part at a time. Functions of a matrix
(`density_labels`, `greedy_labels`) are for one in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import stored

from .blocks import BLOCK, TILE, in_parts, matrix, meeting, spans, unit
from .corpus import one_row

#: Rows of one set that a task of labelled() takes (n x n distances: 8 bytes each).
MOST = 8_000


def _distance(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows; copies are at 0, whatever their product's last digit."""
    d = 1 - u @ v.T
    d[d < 1e-12] = 0
    return d


def _bounded(n: int, most: int) -> None:
    if n > most:
        raise ValueError(f"a set of {n} rows is beyond the {most} that a dense task takes; split it by a key first")


def density_labels(x: np.ndarray, min_size: int = 3, min_samples: int = 2) -> np.ndarray:
    """HDBSCAN labels under cosine distance (-1: noise): mutual reachability, minimum spanning tree, condensed tree, clusters of
    the highest stability, never the root alone."""
    n = len(x)
    if n < min_size:
        return np.full(n, -1)
    u = unit(x)
    d = _distance(u, u)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    return tree_labels(n, *_prim(reach), min_size)


def _prim(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree (a, b, w) of a whole matrix of distances."""
    n = len(reach)
    best, parent, done = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    done[0] = True
    best[0] = np.inf
    a, b, w = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1)
    for k in range(n - 1):
        j = int(np.argmin(best))
        a[k], b[k], w[k] = parent[j], j, best[j]
        done[j], best[j] = True, np.inf
        closer = ~done & (reach[j] < best)
        best[closer], parent[closer] = reach[j][closer], j
    return a, b, w


def _across(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree (row, column, w) of the distances between two sets."""
    sides = (np.ascontiguousarray(reach), np.ascontiguousarray(reach.T))
    n = reach.shape
    best = [np.full(n[0], np.inf), sides[0][0].copy()]
    parent, done = [np.zeros(n[0], int), np.zeros(n[1], int)], [np.zeros(n[0], bool), np.zeros(n[1], bool)]
    done[0][0] = True
    size = n[0] + n[1] - 1
    out = (np.zeros(size, int), np.zeros(size, int)), np.zeros(size)
    for k in range(size):
        at = [int(best[0].argmin()), int(best[1].argmin())]
        s = 0 if best[0][at[0]] <= best[1][at[1]] else 1
        j, o = at[s], 1 - s
        out[0][s][k], out[0][o][k], out[1][k] = j, parent[s][j], best[s][j]
        done[s][j], best[s][j] = True, np.inf
        d = sides[s][j]
        closer = (d < best[o]) & ~done[o]
        best[o][closer] = d[closer]
        parent[o][closer] = j
    return *out[0], out[1]


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (a, b, w) among nodes under n make the minimum spanning forest; ties of w by a, then b."""
    order = np.lexsort((b, a, w))
    a, b = a[order], b[order]
    root, left, chosen, none = np.arange(n), np.arange(len(a)), [np.zeros(0, int)], len(a)
    while True:
        ra, rb = root[a[left]], root[b[left]]
        out = ra != rb
        left, ra, rb = left[out], ra[out], rb[out]
        if not len(left):
            return order[np.concatenate(chosen)]
        # The first edge of each component: of repeated places the last value is kept.
        first, second = np.full(n, none), np.full(n, none)
        first[ra[::-1]], second[rb[::-1]] = left[::-1], left[::-1]
        first = np.minimum(first, second)
        own = np.flatnonzero(first < none)
        edge = first[own]
        chosen.append(np.unique(edge))
        ends = root[a[edge]], root[b[edge]]
        parent = np.arange(n)
        parent[own] = np.where(ends[0] == own, ends[1], ends[0])
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        root = parent[root]


def tree_labels(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray, min_size: int = 3) -> np.ndarray:
    """Labels of n rows from their minimum spanning tree: condensed tree, clusters of the highest stability, never the root alone."""
    edges = [(w, a, b) for w, a, b in zip(*(x[np.lexsort((right, left, weight))].tolist() for x in (weight, left, right)))]
    # Single linkage: node n + k joins two nodes at a distance.
    top = list(range(2 * n - 1))
    kids: dict[int, tuple[int, int, float]] = {}
    size = [1] * n + [0] * (n - 1)

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    for k, (w, a, b) in enumerate(edges):
        a, b, node = find(a), find(b), n + k
        kids[node] = (a, b, float(w))
        size[node] = size[a] + size[b]
        top[a] = top[b] = node

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x_ = todo.pop()
            if x_ < n:
                out.append(x_)
            else:
                todo += kids[x_][:2]
        return out

    # Condensed tree: (cluster, where it is born, its falls, its child clusters).
    clusters: list[dict] = [{"birth": 0.0, "stability": 0.0, "kids": [], "points": []}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            w, parts, inner = kids[node][2], [], [node]
            while inner:
                # Nodes that meet at one distance are one split, in whatever order they met.
                for s in kids[inner.pop()][:2]:
                    (inner if s >= n and kids[s][2] == w else parts).append(s)
            lam = 1 / w if w > 0 else 1e12
            big = [s for s in parts if size[s] >= min_size]
            for s in parts:
                if size[s] < min_size:
                    clusters[c]["stability"] += (lam - clusters[c]["birth"]) * size[s]
                    clusters[c]["points"] += leaves(s)
            if len(big) > 1:
                clusters[c]["stability"] += (lam - clusters[c]["birth"]) * sum(size[s] for s in big)
                for s in big:
                    clusters.append({"birth": lam, "stability": 0.0, "kids": [], "points": []})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((s, len(clusters) - 1))
            if len(big) != 1:
                break
            node = big[0]
    chosen = [False] * len(clusters)
    value = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(value[k] for k in clusters[c]["kids"])
        if c and (not clusters[c]["kids"] or clusters[c]["stability"] >= below):
            chosen[c], value[c] = True, clusters[c]["stability"]
        else:
            value[c] = below
    label = np.full(n, -1)
    found = 0
    todo2 = [0]
    while todo2:
        c = todo2.pop()
        if chosen[c]:
            inner = [c]
            while inner:
                k = inner.pop()
                label[clusters[k]["points"]] = found
                inner += clusters[k]["kids"]
            found += 1
        else:
            todo2 += clusters[c]["kids"]
    order = {}
    for v in label:
        if v >= 0 and v not in order:
            order[v] = len(order)
    return np.array([order.get(v, -1) for v in label])


def greedy_labels(x: np.ndarray, threshold: float = 0.82) -> np.ndarray:
    """In order, each row to the nearest centre above the threshold (whose mean then moves), or to a new one."""
    return Greedy(threshold).take(np.asarray(x, np.float64))


class Greedy:
    """The centres of greedy proximity; rows are taken in order, a batch at a time."""

    def __init__(self, threshold: float):
        self.threshold, self.n = threshold, 0

    def take(self, x: np.ndarray) -> np.ndarray:
        label = np.zeros(len(x), np.int64)
        for k, (v, u) in enumerate(zip(x, unit(x))):
            c = self.units[: self.n] @ u if self.n else np.zeros(0)
            best = int(np.argmax(c)) if self.n else -1
            if best < 0 or not c[best] > self.threshold:
                best = self.n
                self._room(len(v))
                self.n += 1
            self.sums[best] += v
            self.counts[best] += 1
            self.units[best] = unit((self.sums[best] / self.counts[best])[None])[0]
            label[k] = best
        return label

    def _room(self, dims: int) -> None:
        if not self.n:
            self.sums, self.units, self.counts = np.zeros((64, dims)), np.zeros((64, dims)), np.zeros(64)
        elif self.n == len(self.counts):
            self.sums, self.units = (np.concatenate([m, np.zeros_like(m)]) for m in (self.sums, self.units))
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])


def greedy_clusters(vectors: DataFrame, threshold: float = 0.82, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster) of greedy_labels() over all rows in the order of their ids. Each row depends on those before it, so this is
    one task; it reads a batch of sorted rows at a time and holds the centres alone."""
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Greedy(threshold)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g.take(matrix(b.column(1))))], names=["id", "cluster"])

    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, cluster long")


def _lowest(best: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The least values of each row of best and d, as many as best has."""
    m = best.shape[1]
    return np.minimum(best, d.min(1)[:, None]) if m == 1 else np.partition(np.concatenate([best, d], 1), m - 1, axis=1)[:, :m]


def _cores(parted: DataFrame, group: str, kind: dict[str, str], m: int, tile: int) -> DataFrame:
    """(group, id, core): each row's cosine distance to its m-th nearest other row of the group, or the farthest if there are fewer."""

    def near(x: pa.Table, y: pa.Table | None) -> pa.Table:
        u = unit(matrix(x.column("v")))
        v = u if y is None else unit(matrix(y.column("v")))
        best, theirs = np.full((len(u), m), np.inf), np.full((len(v), m), np.inf)
        for r in spans(len(u), tile):
            for c in spans(len(v), tile):
                d = _distance(u[r], v[c])
                if y is None and r == c:
                    np.fill_diagonal(d, np.inf)
                best[r] = _lowest(best[r], d)
                if y is not None:
                    theirs[c] = _lowest(theirs[c], d.T)
        ids, d = (x.column("id"), best) if y is None else (pa.chunked_array([*x.column("id").chunks, *y.column("id").chunks]), np.concatenate([best, theirs]))
        names = pa.chunked_array([*x.column(group).chunks, *([] if y is None else y.column(group).chunks)])
        place = pa.array(np.repeat(np.arange(len(d)), m))
        return pa.table({group: names.take(place), "id": ids.take(place), "d": pa.array(d.ravel())})

    d = meeting(parted, group, near, f"{group} {kind[group]}, id {kind['id']}, d double").filter("d < double('Infinity')").groupBy(group, "id")
    if m == 1:
        return d.agg(F.min("d").alias("core"))
    low = d.agg(F.sort_array(F.collect_list("d")).alias("d"))
    return low.select(group, "id", F.get("d", F.least(F.size("d"), F.lit(m)) - 1).alias("core"))


def _pruned(t: pa.Table, group: str) -> pa.Table:
    """The minimum spanning forest of the edges (group, a, b, w)."""
    a, b, w = (np.asarray(t.column(c)) for c in ("a", "b", "w"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return t.take(pa.array(forest(at[: len(a)], at[len(a) :], w, len(names)))).select([group, "a", "b", "w"])


def density_clusters(vectors: DataFrame, group: str | None = None, min_size: int = 3, min_samples: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """([group,] id, cluster) of density_labels() over each group's rows (or all), however many.

    Two passes over pairs of a group's blocks: distances to nearest rows, then the minimum spanning trees of mutual reachability
    within a block and between two of them. The tree of all is among their edges: pairs of blocks are thinned out to forests together,
    then a last task of each group orders what is left, n - 1 edges. Distances are never kept; time is quadratic.
    """
    own = group or "__all"
    rows = vectors.filter(F.col(vec_col).isNotNull()).select((F.col(group) if group else F.lit(0)).alias(own), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kind = dict(rows.dtypes)
    parted = stored(in_parts(rows, own, block), "density-rows")
    m = min_samples - 1
    core = stored(_cores(parted, own, kind, m, tile), "density-cores") if m else parted.select(own, "id", F.lit(0.0).alias("core"))
    reached = parted.join(core.withColumnRenamed(own, "__of"), "id").filter(F.col(own).eqNullSafe(F.col("__of"))).drop("__of")

    def trees(x: pa.Table, y: pa.Table | None) -> pa.Table:
        sides = [(unit(matrix(t.column("v"))), np.asarray(t.column("core")), np.asarray(t.column("id"))) for t in (x, y) if t is not None]
        found = []
        for s, r in enumerate(spans(len(x), tile)):
            for k, c in enumerate(spans(len(sides[-1][0]), tile)):
                if y is None and k < s:
                    continue
                d = np.maximum(_distance(sides[0][0][r], sides[-1][0][c]), np.maximum(sides[0][1][r][:, None], sides[-1][1][c][None, :]))
                a, b, w = _prim(d) if y is None and k == s else _across(d)
                found.append((a + r.start, b + c.start, w))
        a, b, w = (np.concatenate([f[k] for f in found]) for k in range(3))
        n = len(x) + (0 if y is None else len(y))
        keep = forest(a, b + (0 if y is None else len(x)), w, n)
        return pa.table({own: x.column(own).take(pa.array(np.zeros(len(keep), int))), "lo": pa.array(np.full(len(keep), x.column("lo")[0].as_py(), np.int32)), "a": sides[0][2][a[keep]], "b": sides[-1][2][b[keep]], "w": w[keep]})

    edge = f"{own} {kind[own]}, a {kind['id']}, b {kind['id']}, w double"
    edges = meeting(reached, own, trees, edge.replace(", a", ", lo int, a", 1)).withColumn("some", F.floor(F.col("lo") / 8))
    few = edges.groupBy(own, "some").applyInArrow(lambda t: _pruned(t, own), edge)

    def label(t: pa.Table) -> pa.Table:
        t = _pruned(t, own)
        a, b, w = (np.asarray(t.column(c)) for c in ("a", "b", "w"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ends = np.sort(at.reshape(2, -1), 0)
        found = tree_labels(len(ids), *ends, w, min_size) if len(ids) >= min_size else np.full(len(ids), -1)
        return pa.table({own: t.column(own).take(pa.array(np.zeros(len(ids), int))), "id": ids, "cluster": found.astype(np.int64)})

    got = few.groupBy(own).applyInArrow(label, f"{own} {kind[own]}, id {kind['id']}, cluster long")
    # A row alone in its group has no edges.
    every = got.union(parted.filter("size = 1").select(own, "id", F.lit(-1).cast("long")))
    return every if group else every.drop(own)


def labelled(vectors: DataFrame, f, group: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", most: int = MOST, **options) -> DataFrame:
    """([group,] id, cluster) of f(matrix, **options) on each group's rows in the order of their ids."""
    kind = dict(vectors.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(pdf), most)
        pdf = pdf.sort_values("id")
        out = pd.DataFrame({"id": pdf["id"], "cluster": f(np.stack(pdf["v"]).astype(np.float64), **options).astype("int64")})
        if group:
            out.insert(0, group, pdf[group].to_numpy())
        return out

    own = F.col(group) if group else F.lit(0)
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(own.alias(group or "__all"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    schema = (f"{group} {kind[group]}, " if group else "") + f"id {kind[id_col]}, cluster long"
    return rows.groupBy(group or "__all").applyInPandas(run, schema)


def residuals(x: np.ndarray) -> np.ndarray:
    return x - x.mean(0)


def principal(x: np.ndarray, most: int = 50) -> np.ndarray:
    """Rows in their first principal components."""
    c = residuals(x)
    _, v = np.linalg.eigh(c.T @ c / max(len(c) - 1, 1))
    return c @ v[:, ::-1][:, : min(most, *c.shape)]


def whitened(x: np.ndarray, ridge: float = 1e-5, most: int = 50) -> np.ndarray:
    """Rows over their `most` dimensions of the highest variance, decorrelated and scaled to unit variance."""
    keep = np.argsort(-x.var(0), kind="stable")[:most]
    c = residuals(x[:, keep])
    w, v = np.linalg.eigh(c.T @ c / max(len(c) - 1, 1) + ridge * np.eye(c.shape[1]))
    return c @ (v / np.sqrt(w)) @ v.T


def _means(rows: DataFrame, group: str) -> DataFrame:
    """(__of, mean) of rows (group, v)."""
    per = rows.select(F.col(group).alias("__of"), F.posexplode("v").alias("dim", "x")).groupBy("__of", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy("__of").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))


def residual_vectors(vectors: DataFrame, group: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(group, id, vector): each row less the mean of its group."""
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(group, F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    both = rows.join(_means(rows, group), F.col(group).eqNullSafe(F.col("__of")))
    return both.select(group, "id", F.zip_with("v", "mean", lambda x, y: x.cast("double") - y).alias("vector"))


def whitened_vectors(vectors: DataFrame, group: str, ridge: float = 1e-5, most: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(group, id, vector) of whitened() on each group's rows, however many: parts of a group send on their sums of products, one
    task of a group makes its matrix of them, and parts are multiplied by it."""
    kind = dict(vectors.dtypes)
    rows = stored(in_parts(residual_vectors(vectors, group, id_col, vec_col), group, block), "whitening-rows")

    def products(t: pa.Table) -> pa.Table:
        c = matrix(t.column("vector"))
        return pa.table({group: t.column(group).slice(0, 1), "n": pa.array([len(c)]), "dims": pa.array([c.shape[1]]), "gram": pa.array([(c.T @ c).tobytes()], pa.binary())})

    def model(t: pa.Table) -> pa.Table:
        d, n = t.column("dims")[0].as_py(), int(np.asarray(t.column("n")).sum())
        gram = sum(np.frombuffer(g.as_py()).reshape(d, d) for g in t.column("gram"))
        keep = np.argsort(-np.diag(gram), kind="stable")[:most]
        w, v = np.linalg.eigh(gram[np.ix_(keep, keep)] / max(n - 1, 1) + ridge * np.eye(len(keep)))
        full = np.zeros((d, len(keep)))
        full[keep] = (v / np.sqrt(w)) @ v.T
        return pa.table({group: t.column(group).slice(0, 1), "m": pa.array([full.tobytes()], pa.binary())})

    own = f"{group} {kind[group]}"
    grams = rows.groupBy(group, "part").applyInArrow(products, f"{own}, n long, dims long, gram binary")
    models = grams.groupBy(group).applyInArrow(model, f"{own}, m binary").withColumnRenamed(group, "__of")
    parts = rows.select(F.col(group).alias("__group"), F.col("part").alias("__part")).distinct()
    models = parts.join(models, F.col("__group").eqNullSafe(F.col("__of"))).select("__group", "__part", "m")

    def multiply(t: pa.Table, model: pa.Table) -> pa.Table:
        c = matrix(t.column("vector"))
        y = c @ np.frombuffer(model.column("m")[0].as_py()).reshape(c.shape[1], -1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        return pa.table({group: t.column(group), "id": t.column("id"), "vector": flat})

    return rows.groupBy(group, "part").cogroup(models.groupBy("__group", "__part")).applyInArrow(multiply, f"{own}, id {kind[id_col]}, vector array<double>")


def concept_tree(vectors: DataFrame, depth: int = 3, min_size: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(node, parent, depth, id): density clusters of the rows, then of each cluster's residuals, to `depth`."""
    base = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.lit("0").alias("node"))
    out = None
    for k in range(depth):
        if k:
            base = residual_vectors(base, "node", "id", "v").select("id", F.col("vector").alias("v"), "node")
        big = base.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("node")
        base = stored(base.join(big, "node"), f"tree-rows{k}")
        label = density_clusters(base, "node", id_col="id", vec_col="v", block=block, tile=tile).filter("cluster >= 0")
        level = stored(base.join(label.withColumnRenamed("node", "parent"), "id").select(F.concat_ws(".", "parent", F.col("cluster").cast("string")).alias("node"), "parent", F.lit(k).alias("depth"), "id", "v"), f"tree{k}")
        rows = level.select("node", "parent", "depth", "id")
        out = rows if out is None else out.union(rows)
        base = level.select("id", "v", "node")
    return out


def communities(edges: DataFrame, steps: int = 10, start: DataFrame | None = None) -> DataFrame:
    """(node, label) by label propagation over (src, dst, prob): a substitute for modularity communities.

    A node takes the label of the largest total weight around it, ties to the smallest label; its own label counts once.
    """
    w = stored(edges.groupBy("src", "dst").agg(F.max("prob").alias("w")), "community-edges")
    label = start or w.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    own = label.select("node", "label", F.lit(1e-6).alias("w"))
    for k in range(steps):
        votes = w.join(label.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", "w").union(own)
        total = votes.groupBy("node", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "label"))
        label = total.withColumn("rk", rank).filter("rk = 1").select("node", "label")
        if k % 3 == 2:
            label = stored(label, f"communities{k}")
        own = label.select("node", "label", F.lit(1e-6).alias("w"))
    return label


def agreement(pairs: DataFrame) -> DataFrame:
    """One row (ari, nmi) of two labellings (x, y) of the same rows, from their contingency table."""
    cell = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    a, b = cell.groupBy("x").agg(F.sum("n").alias("n")), cell.groupBy("y").agg(F.sum("n").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ent = lambda c: F.sum(F.col(c) * F.log(c))
    s = one_row(one_row(cell.agg(two("n").alias("ij"), ent("n").alias("hij"), F.sum("n").alias("t")), a.agg(two("n").alias("i"), ent("n").alias("hi"))), b.agg(two("n").alias("j"), ent("n").alias("hj")))
    t = F.col("t")
    expected = F.col("i") * F.col("j") / (t * (t - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2
    ari = F.when(top != expected, (F.col("ij") - expected) / (top - expected)).otherwise(F.lit(1.0))
    hx, hy = F.log(t) - F.col("hi") / t, F.log(t) - F.col("hj") / t
    mutual = F.log(t) + (F.col("hij") - F.col("hi") - F.col("hj")) / t
    nmi = F.when(hx + hy > 0, 2 * mutual / (hx + hy)).otherwise(F.lit(1.0))
    return s.select(ari.alias("ari"), nmi.alias("nmi"))


def kmeans_pairs(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(a, b, layer) of k = max(2, min(n // 3, 6)) clusters of unit vectors: "member" rows have a cluster's representative and each
    of its members (itself too), "inter" rows, a < b, pairs of representatives.

    Any two members of one representative are a pair of the cluster: these are not written out, as they grow with the square
    of a cluster. The representative is the member of the highest cosine with the centroid, ties by id.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from . import vectors as V

    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), V.norm(F.col(vec_col)).alias("n"))
    rows = stored(rows.select("id", F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))).alias("u")), "kmeans-units")
    features = rows.withColumn("features", array_to_vector("u"))
    n = rows.count()
    k = min(max(2, min(n // 3, 6)), max(n - 1, 1))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    got = stored(model.transform(features).select("id", "u", F.col("cluster").cast("long").alias("cluster")), "kmeans-clusters")
    near = got.join(F.broadcast(V.centroids(got, "cluster", "u")), "cluster").withColumn("score", F.round(V.cosine(F.col("u"), F.col("centroid")), V.DIGITS))
    first = near.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("a"))
    member = got.join(F.broadcast(first), "cluster").select("a", F.col("id").alias("b"), F.lit("member").alias("layer"))
    inter = first.select("a").join(first.select(F.col("a").alias("b")), F.col("a") < F.col("b")).select("a", "b", F.lit("inter").alias("layer"))
    return member.union(inter)
