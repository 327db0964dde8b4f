"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Fingerprints. Each text's word shingles are hashed (XXH64) and summed bit by bit.
2. Keys. Fingerprints are collapsed to distinct ones, which is what bounds groups of exact copies. With the 64 bits cut into
   `blocks` runs, two fingerprints at `bits` differing bits agree on at least blocks - bits runs, so each choice of that many
   runs is a key under which a linked pair meets. A key that more than `most` fingerprints share is split into chunks, and
   its rows go to one task for each pair of chunks, so no task holds a whole hot group and no pair is lost.
3. Index. In a task, the fingerprints of each key are sorted by Gray rank and a hierarchy is put above them: a node holds the
   bits on which all fingerprints below it agree, less those that its parent already holds. A search descends level by level,
   adding up differing bits, and leaves a whole group once the sum passes the limit or once all of it is known to be
   in the searcher's own component.
4. Components. Tasks send spanning edges, at most one per fingerprint and key; the edges are contracted by rounds of
   joins (each node goes to its least neighbour in a random order) until few are left, which the driver unites.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, spread, stored, texts

SEED = 42
WORDS = 3
BITS = 3
BLOCKS = 5
#: Children of an index node, and pairs (searcher, node) that a search holds at a time.
FAN, FRONTIER = 8, 1 << 20
#: Fingerprints under one key beyond which its rows are split into chunks.
MOST = 4096
#: Edges that the driver unites by itself (1 MB of ids): a round of joins takes it more memory, for its jobs and tasks.
FEW = 1 << 16


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of `words` words (A-Z lower-cased, space-joined); of all words if there are fewer; empty if none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    whole = b" ".join(w)
    ends = list(accumulate((len(x) + 1 for x in w)))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    n = len(w) - words + 1
    return np.fromiter((digest(whole[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_udf(words: int = WORDS, seed: int = SEED):
    """An Arrow UDF text -> fingerprint (its 64 bits as a long)."""

    @arrow_udf("long")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array(np.array([fingerprint(shingle_hashes(t, words, seed)) for t in texts(batch)], np.uint64).view(np.int64))

    return of


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def key_masks(bits: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks - bits of the runs that 64 bits are cut into."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(runs, blocks - bits)]


class GrayIndex:
    """The hierarchy above fingerprints that are sorted by (group, Gray rank); no node spans two groups."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        n = len(fps)
        self.fps = fps
        self.start, self.end = [np.arange(n)], [np.arange(n) + 1]  # leaves below each node
        self.ones, self.zeros = [fps], [~fps]
        self.child: list[np.ndarray] = [np.zeros(0, np.int64)]  # node i of level k has children child[k][i] to child[k][i + 1]
        owner = group
        while True:
            change = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            first = np.flatnonzero(change)
            size = np.diff(np.concatenate([first, [len(owner)]]))
            if not len(owner) or size.max() == 1:
                break
            inside = np.arange(len(owner)) - np.repeat(first, size)
            heads = np.flatnonzero(inside % FAN == 0)
            self.child.append(np.concatenate([heads, [len(owner)]]))
            self.start.append(self.start[-1][heads])
            self.end.append(self.end[-1][np.concatenate([heads[1:], [len(owner)]]) - 1])
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], heads))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], heads))
            owner = owner[heads]
        # The bits that a node holds itself: those all below it agree on, less its parent's.
        self.own = [o | z for o, z in zip(self.ones, self.zeros)]
        for k in range(len(self.own) - 1):
            parent = np.repeat(np.arange(len(self.own[k + 1])), np.diff(self.child[k + 1]))
            self.own[k] = self.own[k] & ~(self.ones[k + 1] | self.zeros[k + 1])[parent]

    def links(self, bits: int, far: np.ndarray | None = None) -> np.ndarray:
        """A label for each fingerprint: the least place in its component under links of at most `bits` bits.

        far: only fingerprints of different values there are compared (chunks of a split group), equal ones too where
        it is None.
        """
        n, top = len(self.fps), len(self.own) - 1
        label = np.arange(n)
        root = np.searchsorted(self.start[top], np.arange(n), side="right") - 1
        at, step = 0, 1 << 13
        while at < n:
            block = np.arange(at, min(n, at + step))
            at = block[-1] + 1
            low, high = self._bounds(label, top)
            todo = [(top, block, root[block], np.bitwise_count((self.fps[block] ^ self.ones[top][root[block]]) & self.own[top][root[block]]).astype(np.int16))]
            while todo:
                k, q, node, diff = todo.pop()
                # Only places after the searcher's (a pair is met once), within the limit, and not all in its component.
                keep = (diff <= bits) & (self.end[k][node] > q + 1) & ~((low[k][node] == high[k][node]) & (low[k][node] == label[q]))
                q, node, diff = q[keep], node[keep], diff[keep]
                if not len(q):
                    continue
                if k == 0:
                    ok = (node > q) if far is None else (node > q) & (far[node] != far[q])
                    label = _union(label, q[ok], node[ok])
                    continue
                kids = self.child[k][node + 1] - self.child[k][node]
                for a, b in _parts(kids):
                    c = kids[a:b]
                    who = np.repeat(q[a:b], c)
                    to = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.child[k][node[a:b]], c)
                    d = np.repeat(diff[a:b], c) + np.bitwise_count((self.fps[who] ^ self.ones[k - 1][to]) & self.own[k - 1][to])
                    todo.append((k - 1, who, to, d))
        return label

    def _bounds(self, label: np.ndarray, top: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        low, high = [label], [label]
        for k in range(1, top + 1):
            low.append(np.minimum.reduceat(low[-1], self.child[k][:-1]))
            high.append(np.maximum.reduceat(high[-1], self.child[k][:-1]))
        return low, high


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + FRONTIER, side="right")))
        yield a, b
        a = b


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = label[a], label[b]
        split = x != y
        a, b, x, y = a[split], b[split], x[split], y[split]
        if not len(a):
            break
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


#: Rows that a task takes into one index: those of whole keys, as many as fit, or of one key.
STEP_ROWS = 1 << 18


def _chains(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, tab, key, chunk, pair), sorted by tab, key and pair -> spanning edges (a, b) of their links.

    Keys come one after another, so a task holds STEP_ROWS rows, or the rows of one key and pair of chunks if these are more.
    """
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        t = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab", "key", "pair", "chunk", "fp")])
        held.append(t)
        rows += t.shape[1]
        if rows >= STEP_ROWS:
            t = np.concatenate(held, 1)
            # The last key may go on in the next batch.
            open_ = (t[:3] == t[:3, -1:]).all(0)
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if cut:
                yield from _group_chains(t[:, :cut], bits)
            held, rows = [t[:, cut:]], t.shape[1] - cut
    if rows:
        yield from _group_chains(np.concatenate(held, 1), bits)


def _group_chains(rows: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    tab, key, pair, chunk, fp = rows
    u = np.ascontiguousarray(fp).view(np.uint64)
    order = np.lexsort([gray_rank(u), pair, key, tab])
    tab, pair, key, u, chunk = tab[order], pair[order], key[order], u[order], chunk[order]
    change = np.concatenate([[True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    group = np.cumsum(change)
    # A group of one has no pairs.
    size = np.bincount(group)[group]
    keep = size > 1
    u, group, chunk, pair = u[keep], group[keep], chunk[keep], pair[keep]
    if not len(u):
        return
    # A task of two different chunks compares across them only; those within one have a task of their own.
    across = np.where(pair // 65536 != pair % 65536, chunk, -1 - np.arange(len(u)))
    label = GrayIndex(u, group).links(bits, across)
    linked = label != np.arange(len(u))
    a, b = u[label[linked]].view(np.int64), u[linked].view(np.int64)
    edges = np.unique(np.stack([a, b], 1), axis=0)
    for at in range(0, len(edges), 1 << 16):
        part = edges[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span all links of at most `bits` differing bits."""
    masks = key_masks(bits, blocks)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("tab", "key"))
    hot = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most).withColumn("chunks", F.ceil(F.col("n") / most).cast("int"))
    k, h = keyed.alias("k"), hot.alias("h")
    rows = k.join(h, (F.col("k.tab") == F.col("h.tab")) & (F.col("k.key") == F.col("h.key")), "left").select("k.fp", "k.tab", "k.key", F.coalesce("h.chunks", F.lit(1)).alias("chunks"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, F.col("chunk")).cast("long") * 65536 + F.greatest(j, F.col("chunk")))
    rows = rows.select("fp", "tab", "key", "chunk", F.explode(pairs).alias("pair"))
    return rows.repartition("tab", "key", "pair").sortWithinPartitions("tab", "key", "pair").mapInArrow(lambda b: _chains(b, bits), "a long, b long")


def _united(edges: DataFrame) -> DataFrame:
    """(node, to) of every node of edges (a, b), which the driver holds: the least node of its component."""
    got = edges.select("a", "b").toArrow()
    nodes, at = np.unique(np.concatenate([got.column("a").to_numpy(), got.column("b").to_numpy()]), return_inverse=True)
    label = _union(np.arange(len(nodes)), *at.reshape(2, -1))
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "to": nodes[label]}), "node long, to long")


def components(edges: DataFrame, label: str = "edges", few: int = FEW) -> DataFrame:
    """(node, root) of every node of edges (a, b): one root for each connected component.

    Each round sends a node to its least neighbour in a random order (or leaves it, if it is the least itself), renames the
    edges by that and drops loops and repeats, so the count of nodes falls by a constant factor on average. Once at most `few`
    edges are left, the driver takes them and ends it, in place of as many rounds again.
    """
    e = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    moves, turn = [], 0
    while left := e.count():
        turn += 1
        if left <= few:
            moves.append(stored(_united(e), f"move{turn}"))
            break
        both = e.select("a", "b").union(e.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("x"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("x"))
        move = stored(near.select(F.col("a").alias("node"), F.least("m", own)["x"].alias("to")), f"move{turn}")
        moves.append(move)
        l, r = move.select(F.col("node").alias("a"), F.col("to").alias("ta")), move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = e.join(l, "a").join(r, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        e = stored(e, f"{label}{turn}")
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for m in moves[1:]:
        m = m.select(F.col("node").alias("root"), "to")
        out = out.join(m, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id.

    component_id is the smallest id that can be reached over links of at most `bits` bits, the document's own included; a null
    id stays null but links like any other. Texts without words (null, empty, blank) all have fingerprint 0. Rows with the
    same id each have a row. Other columns are ignored.
    """
    prints = stored(spread(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))).select("doc_id", fingerprint_udf(words, seed)(F.col("text")).alias("fp")), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), bits, blocks, most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = stored(named.filter((F.col("n") > 1) | F.col("root").isNotNull()).select("fp", F.coalesce("root", "fp").alias("root"), "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
