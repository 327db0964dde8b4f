"""Graph operators: seeds, propagation, relations, paths, components, personalized PageRank and knowledge graphs.

The one fact table is chunk_concepts (chunk_id, concept, tf); all adjacency is a join on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import stored

from .blocks import spans
from .corpus import one_row, smooth_idf
from .ranking import top
from .vectors import Best


def lexical_scores(questions: DataFrame, tokens: DataFrame, n: DataFrame) -> DataFrame:
    """(qid, id, score): the idf of the distinct content words that a question (qid, text) shares with a chunk. The questions' words
    are broadcast."""
    q = questions.select("qid", F.explode(T.content_tokens("text")).alias("word"))
    df = tokens.groupBy("word").agg(F.count("*").alias("df"))
    w = one_row(q.join(df, "word"), n).select("qid", "word", F.round(smooth_idf(F.col("n"), F.col("df")), 6).alias("w"))
    return tokens.select("chunk_id", "word").join(F.broadcast(w), "word").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.round(F.sum("w"), 6).alias("score"))


def seeds(scores: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, rk): each question's k best chunks."""
    return top(scores, k).select("qid", "id", "rk")


def seed_concepts(seed: DataFrame, cc: DataFrame) -> DataFrame:
    return seed.join(cc.withColumnRenamed("chunk_id", "id"), "id").select("qid", "concept").distinct()


def propagate(weighted: DataFrame, m: DataFrame, seed: DataFrame, value: str = "w") -> DataFrame:
    """(qid, id, score): the sum over a question's concepts (qid, concept[, weight]) of weight x m, without its seeds."""
    w = F.col("weight") if "weight" in weighted.columns else F.lit(1.0)
    hit = weighted.join(m.withColumnRenamed("chunk_id", "id"), "concept").groupBy("qid", "id").agg(F.sum(w * F.col(value)).alias("score"))
    return hit.join(seed.select("qid", "id"), ["qid", "id"], "left_anti")


def relation_weights(own: DataFrame, adjacent: DataFrame, weight: float, hops: int = 1) -> DataFrame:
    """(qid, concept, weight): own concepts at 1, those first reached in hop h over (src, dst) at weight ** h."""
    reached = own.select("qid", "concept").withColumn("weight", F.lit(1.0))
    if weight <= 0:
        return reached
    front = own.select("qid", "concept")
    for h in range(1, hops + 1):
        front = front.join(adjacent, F.col("concept") == F.col("src")).select("qid", F.col("dst").alias("concept")).distinct()
        front = front.join(reached.select("qid", "concept"), ["qid", "concept"], "left_anti")
        reached = reached.union(front.withColumn("weight", F.lit(float(weight) ** h)))
    return reached


def reached(own: DataFrame, adjacent: DataFrame, place: DataFrame, hops: int) -> DataFrame:
    """(concept, block, h0, h1, ..): which questions (place: qid, block, bit) reach a concept first in which hop over (src, dst), a bit
    each. A hop sends a block's bits over each edge once, however many questions they stand for."""
    bit = F.expr("shiftleft(1L, bit)")
    front = own.select("qid", "concept").join(F.broadcast(place), "qid").groupBy("concept", "block").agg(F.bit_or(bit).alias("bits"))
    found = stored(front.withColumnRenamed("bits", "h0"), "reached0")
    for h in range(1, hops + 1):
        seen = [f"h{k}" for k in range(h)]
        step = found.select(F.col("concept").alias("src"), "block", F.col(seen[-1]).alias("bits")).filter("bits <> 0").join(adjacent.select("src", "dst"), "src").groupBy(F.col("dst").alias("concept"), "block").agg(F.bit_or("bits").alias("bits"))
        both = found.join(step, ["concept", "block"], "full").fillna(0, ["bits", *seen])
        old = F.lit(0).cast("long")
        for c in seen:
            old = old.bitwiseOR(F.col(c))
        found = stored(both.select("concept", "block", *seen, F.col("bits").bitwiseAND(F.bitwise_not(old)).alias(f"h{h}")), f"reached{h}")
    return found


def relation_best(own: DataFrame, adjacent: DataFrame, m: DataFrame, seed: DataFrame, weight: float, hops: int, k: int, digits: int = 6) -> DataFrame:
    """(qid, id, score, rk): the k best of propagate(relation_weights(own, adjacent, weight, hops), m, seed), scores rounded.

    All questions pass the tables together, as bits of a concept's row: a chunk's row has its concepts' weights and bits, and a task
    adds them up for all questions at once, keeping k chunks of each.
    """
    spark = m.sparkSession
    kind = dict(own.dtypes)["qid"]
    hops = hops if weight > 0 else 0
    qids = sorted(r[0] for r in own.select("qid").distinct().collect())
    if not qids:
        return spark.createDataFrame([], f"qid {kind}, id string, score double, rk int")
    place = spark.createDataFrame([(q, i // 64, i % 64) for i, q in enumerate(qids)], f"qid {kind}, block int, bit int")
    blocks, levels = -(-len(qids) // 64), [f"h{h}" for h in range(hops + 1)]
    bits = reached(own, adjacent, place, hops)
    bits = bits.groupBy("concept").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", F.array(*levels).alias("h")))), lambda s: F.concat(F.array(s["block"].cast("long")), s["h"]))).alias("bits"))
    rows = m.join(bits, "concept").groupBy(F.col("chunk_id").alias("id")).agg(F.collect_list("w").alias("w"), F.collect_list(F.col("bits")).alias("bits"))
    seeds_of: dict = {}
    index = {q: i for i, q in enumerate(qids)}
    for r in seed.select("qid", "id").collect():
        if r[0] in index:
            seeds_of.setdefault(r[1], []).append(index[r[0]])
    held = spark.sparkContext.broadcast((pa.array(qids), seeds_of))
    decay = [float(weight) ** h for h in range(hops + 1)]
    width = 1 + len(levels)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seeds_ = held.value
        found = Best(len(names), k)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                w = np.asarray(b.column("w").flatten())
                each = np.diff(np.asarray(b.column("w").offsets))
                inner = b.column("bits").flatten()
                per = np.diff(np.asarray(inner.offsets)) // width
                parts = np.asarray(inner.flatten()).reshape(-1, width)
                got = np.zeros((len(w), len(levels), blocks), "<u8")
                got[np.repeat(np.arange(len(w)), per), :, parts[:, 0]] = parts[:, 1:].view("<u8")
                flags = np.unpackbits(got.view(np.uint8), axis=2, bitorder="little")[:, :, : len(names)]
                value = np.einsum("rhq,h->rq", flags.astype(np.float64), np.asarray(decay)) * w[:, None]
                start = np.cumsum(each) - each
                s, any_ = np.add.reduceat(value, start, axis=0), np.add.reduceat(flags.any(1).astype(np.int32), start, axis=0) > 0
                ids = b.column("id").to_pylist()
                s = np.where(any_, np.round(s, digits), -np.inf)
                for i, x in enumerate(ids):
                    if x in seeds_:
                        s[i, seeds_[x]] = -np.inf
                found.add(np.ascontiguousarray(s.T), np.asarray(ids))
        if (out := found.cut()) is not None:
            i, s, ids = out
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(ids.tolist(), pa.string()), pa.array(s)], names=["qid", "id", "score"])

    return top(rows.mapInArrow(best, f"qid {kind}, id string, score double"), k)


def merge_ranking(seed: DataFrame, scored: DataFrame, dense: DataFrame, k: int = 10, keep: int = 5) -> DataFrame:
    """(qid, id, rk): up to `keep` seeds, then scored rows by score, then dense rows by rank, each once."""
    tiers = (
        seed.filter(F.col("rk") <= keep).select("qid", "id", F.lit(0).alias("tier"), F.col("rk").cast("double").alias("o"))
        .union(scored.select("qid", "id", F.lit(1), -F.col("score")))
        .union(dense.select("qid", "id", F.lit(2), F.col("rk").cast("double")))
    )
    first = tiers.groupBy("qid", "id").agg(F.min(F.struct("tier", "o")).alias("t"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("t.tier", "t.o", "id"))
    return first.withColumn("rk", rank).filter(F.col("rk") <= k).select("qid", "id", "rk")


def pair_counts(cc: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, context), a < b: concepts on common chunks, how many, and the first of these."""
    x, y = cc.select("chunk_id", F.col("concept").alias("a")), cc.select("chunk_id", F.col("concept").alias("b"))
    return x.join(y, "chunk_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("chunk_id").alias("context")).filter(F.col("n") >= least)


def relations(cc: DataFrame, least: int = 2) -> DataFrame:
    """pair_counts() with prob: the count over the largest one."""
    p = pair_counts(cc, least)
    return one_row(p, p.agg(F.max("n").alias("most"))).withColumn("prob", F.col("n") / F.col("most")).drop("most")


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", *keep: str) -> DataFrame:
    """(src, dst, keep...) in both directions."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *keep).union(edges.select(F.col(b), F.col(a), *keep))


def entity_edges(members: DataFrame, most: int = 15, least: int = 2, limit: int = 20_000) -> DataFrame:
    """(a, b, n, prob): pairs among each chunk's `most` entities of the highest corpus frequency; the `limit` most frequent pairs."""
    freq = members.groupBy("name").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("f"), "name"))
    few = members.join(freq, "name").withColumn("rk", rank).filter(F.col("rk") <= most).select("chunk_id", F.col("name").alias("concept"))
    pairs = pair_counts(few, least).orderBy(F.desc("n"), "a", "b").limit(limit)
    return one_row(pairs, pairs.agg(F.max("n").alias("most"))).select("a", "b", "n", (F.col("n") / F.col("most")).alias("prob"))


def cross_edges(members: DataFrame, cc: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, prob): entity a and concept b on `least` chunks or more."""
    pairs = members.join(cc, "chunk_id").groupBy(F.col("name").alias("a"), F.col("concept").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return one_row(pairs, pairs.agg(F.max("n").alias("most"))).select("a", "b", "n", (F.col("n") / F.col("most")).alias("prob"))


def dual_level(entity_hits: DataFrame, relation_hits: DataFrame, adjacent: DataFrame, members: DataFrame, decay: float = 0.5) -> DataFrame:
    """(qid, id, score): hit entities (qid, name, score), both ends of hit relations (qid, a, b, score x prob), their
    neighbours at decay; the largest weight of an entity, then of a chunk's entities."""
    ends = relation_hits.select("qid", F.explode(F.array("a", "b")).alias("name"), "score")
    base = entity_hits.select("qid", "name", "score").union(ends).groupBy("qid", "name").agg(F.max("score").alias("score"))
    near = base.join(adjacent, F.col("name") == F.col("src")).select("qid", F.col("dst").alias("name"), (F.col("score") * decay).alias("score"))
    every = base.union(near).groupBy("qid", "name").agg(F.max("score").alias("score"))
    return every.join(members, "name").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score"))


def two_hop(edges: DataFrame) -> DataFrame:
    """(a, b, c): paths a - b - c over (src, dst), a < c."""
    x, y = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), edges.select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    return x.join(y, "b").filter("a < c").select("a", "b", "c")


def strongest_path(edges: DataFrame) -> DataFrame:
    """(a, b, c): each node b with at least two neighbours between its two strongest ones (src, dst, prob)."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("prob"), "dst"))
    two = edges.withColumn("rk", rank).filter("rk <= 2").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("ends")).filter(F.size("ends") == 2)
    return two.select(F.col("ends")[0].alias("a"), F.col("src").alias("b"), F.col("ends")[1].alias("c"))


def squared(edges: DataFrame) -> DataFrame:
    """(a, c, w): the sum over b of W[a, b] W[b, c], a < c; W is the largest prob of (src, dst)."""
    w = edges.groupBy("src", "dst").agg(F.max("prob").alias("w"))
    x, y = w.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1")), w.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w2"))
    return x.join(y, "b").filter("a < c").groupBy("a", "c").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))


def tensor(rows: DataFrame, bucket: Column) -> DataFrame:
    """(a, bucket, b, v): the largest prob of each pair and bucket of relations (a, b, prob), in both directions."""
    both = rows.withColumn("bucket", bucket)
    flat = both.select("a", "bucket", "b", "prob").union(both.select("b", "bucket", "a", "prob"))
    return flat.filter("a <> b").groupBy("a", "bucket", "b").agg(F.max("prob").alias("v"))


# Relation words (stemmed) and their buckets.
BUCKETS = {
    "therapeutic": "treat", "treat": "treat", "treated": "treat", "surgical": "treat", "procedural": "treat",
    "performed": "treat", "guided": "treat", "protect": "treat", "assessed": "treat", "diagnostic": "treat",
    "causal": "causal", "regulated": "causal", "regulatory": "causal", "influenced": "causal", "mediated": "causal",
    "determined": "causal", "genetic": "causal", "inherit": "causal", "metabolism": "causal", "agini": "causal",
    "anatom": "structural", "integral": "structural", "contained": "structural", "inclusive": "structural",
    "inclu": "structural", "singular": "structural", "plural": "structural", "aternity": "structural",
    "inté": "structural", "impse": "structural", "errated": "structural", "complex": "structural",
    "intricate": "structural", "iplinary": "structural", "reflected": "structural",
    "critical": "importance", "crucial": "importance", "vital": "importance", "significant": "importance",
    "essential": "importance", "minimal": "importance", "rarely": "importance", "evident": "importance",
    "closely": "importance",
    "indirect": "assoc", "indirectly": "assoc", "often": "assoc", "alink": "assoc", "unrelated": "assoc",
    "inverse": "assoc", "sequential": "assoc",
}


def relation_bucket(word: Column, rules: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (rules or BUCKETS).items() for x in kv])
    return F.coalesce(F.try_element_at(table, T.stem(F.btrim(word))), F.lit("other"))


def pair_context(pairs: DataFrame, cc: DataFrame, chunks: DataFrame) -> DataFrame:
    """(a, b, strategy, context): the shortest common chunk; else the shortest chunk of each; else none.

    Common chunks are those of the pairs that a chunk's own concepts make, as in pair_counts(): no pair meets all chunks of a concept.
    """
    sized = stored(cc.join(chunks.select("chunk_id", F.length("text").alias("size")), "chunk_id").select("chunk_id", "concept", "size"), "sized-concepts")
    best = F.min(F.struct("size", "chunk_id"))["chunk_id"]
    x, y = sized.select("chunk_id", "size", F.col("concept").alias("__a")), sized.select("chunk_id", F.col("concept").alias("__b"))
    common = x.join(y, "chunk_id").filter("__a <= __b").groupBy("__a", "__b").agg(best.alias("both"))
    one = sized.groupBy("concept").agg(best.alias("own"))
    rows = pairs.join(common, (F.least("a", "b") == F.col("__a")) & (F.greatest("a", "b") == F.col("__b")), "left").drop("__a", "__b")
    rows = rows.join(one.select(F.col("concept").alias("a"), F.col("own").alias("oa")), "a", "left").join(one.select(F.col("concept").alias("b"), F.col("own").alias("ob")), "b", "left")
    strategy = F.when(F.col("both").isNotNull(), "common").when(F.col("oa").isNotNull() & F.col("ob").isNotNull(), "joined").otherwise("missing")
    return rows.select("a", "b", strategy.alias("strategy"), F.coalesce("both", F.when(strategy == "joined", F.concat_ws("+", "oa", "ob"))).alias("context"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node of each connected component of (a, b).

    Each round a node takes the least label of itself, its neighbours and its label's label; label tables are written between rounds.
    """
    both = stored(both_ways(edges.filter("a <> b")).distinct(), "component-edges")
    label = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")), "labels")
    for k in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = label.join(near, "node").join(jump, "root", "left").select("node", F.least("root", "near", F.coalesce("far", "root")).alias("next"), "root")
        nxt = stored(nxt, f"labels{k}")
        moved = nxt.filter("next <> root").limit(1).count()
        label = nxt.select("node", F.col("next").alias("root"))
        if not moved:
            return label
    return label


#: Bytes of ranks that a task of page_rank() holds, edges that it follows at a time, and nodes of a block of its results.
MOST_BYTES, STEP, NODES = 1 << 28, 1 << 17, 4096


def page_rank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, steps: int = 20) -> DataFrame:
    """(qid, node, p) after `steps` steps of p <- d T p + (1 - d) s over edges (src, dst, w); duplicates add up.

    reset: (qid, node, s), scaled to 1 for each qid. Columns of T sum to 1; the mass of nodes without edges is not passed on.
    A task walks for up to 16 questions; T is broadcast, 12 bytes an edge. Ranks are sent on as blocks of numbers and named there.
    """
    w = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("out"))
    t = stored(w.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("t")), "transition")
    total = reset.groupBy("qid").agg(F.sum("s").alias("total")).filter("total > 0")
    s = stored(reset.join(total, "qid").groupBy("qid", "node").agg(F.sum(F.col("s") / F.col("total")).alias("p")), "reset")
    nodes = numbered(t.select(F.explode(F.array("src", "dst")).alias("node")).union(s.select("node")).distinct())
    at = lambda c, i: nodes.select(F.col("node").alias(c), F.col("i").alias(i))
    coded = t.join(at("src", "i"), "src").join(at("dst", "j"), "dst").select(F.col("i").cast("int"), F.col("j").cast("int"), "t").toArrow()
    n, (i, j, share) = nodes.count(), (np.asarray(coded.column(c)) for c in "ijt")
    order = np.argsort(j, kind="stable")
    held = t.sparkSession.sparkContext.broadcast((n, i[order], np.searchsorted(j[order], np.arange(n + 1)).astype(np.int32), share[order]))
    del coded, i, j, share, order
    wide = int(max(1, min(16, MOST_BYTES // (24 * max(n, 1)))))
    kind = dict(reset.dtypes)["qid"]
    qids = s.select("qid").distinct()
    batches = max(1, -(-qids.count() // wide))
    dealt = qids.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("qid")) - 1) / wide).cast("int"))
    first = s.join(F.broadcast(dealt), "qid").join(nodes, "node").select("batch", "qid", "i", "p").repartition(4 * batches, "batch")

    def walk(rows: pa.Table) -> pa.Table:
        n, src, start, t_ = held.value
        names, q = np.unique(np.asarray(rows.column("qid")), return_inverse=True)
        s_ = np.zeros((n, len(names)))
        s_[np.asarray(rows.column("i")), q] = np.asarray(rows.column("p"))
        p, blocks = s_, spans(n, max(1, STEP * n // max(len(src), 1)))
        for _ in range(steps):
            new = (1 - damping) * s_
            for b in blocks:
                lo, hi = start[b.start], start[b.stop]
                own = np.flatnonzero(np.diff(start[b.start : b.stop + 1]))
                if hi > lo:
                    new[b.start + own] += damping * np.add.reduceat(p[src[lo:hi]] * t_[lo:hi, None], start[b.start + own] - lo, axis=0)
            p = new
        p = np.ascontiguousarray(p.T)
        out = [(k, names[q], p[q, b].tobytes()) for q in range(len(names)) for k, b in enumerate(spans(n, NODES)) if p[q, b].any()]
        return pa.table({"block": pa.array([k for k, *_ in out], pa.int64()), "qid": pa.array([q for _, q, _ in out], rows.column("qid").type), "p": pa.array([x for *_, x in out], pa.binary())})

    ranks = first.groupBy("batch").applyInArrow(walk, f"block long, qid {kind}, p binary")
    names = nodes.select("node", "i", F.floor(F.col("i") / NODES).alias("part"))

    def named(ranks_: pa.Table, names_: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(names_.column("i")))
        node = names_.column("node").take(pa.array(order))
        p = np.stack([np.frombuffer(x.as_py()) for x in ranks_.column("p")]) if len(ranks_) else np.zeros((0, len(node)))
        q, k = np.nonzero(p)
        return pa.table({"qid": ranks_.column("qid").take(pa.array(q)), "node": node.take(pa.array(k)), "p": p[q, k]})

    return ranks.groupBy("block").cogroup(names.groupBy("part")).applyInArrow(named, f"qid {kind}, node {dict(nodes.dtypes)['node']}, p double")


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, i): nodes with places from 0 up, without gaps. Only the sizes of partitions meet."""
    rows = stored(nodes.select("node", F.monotonically_increasing_id().alias("i")), "nodes")
    part = F.shiftrightunsigned("i", 33)
    size = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), part == F.col("part")).select("node", (F.col("before") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"))


def phrase_seeds(facts: DataFrame, df: DataFrame, k: int = 5, digits: int = 12) -> DataFrame:
    """(qid, node, s) of kept facts (qid, a, b, score): the mean of score / df over a phrase's occurrences, those of at
    least the k-th largest."""
    ends = facts.select("qid", F.explode(F.array("a", "b")).alias("node"), "score").join(df, "node")
    mean = ends.groupBy("qid", "node").agg(F.round(F.avg(F.col("score") / F.col("df")), digits).alias("s"))
    return mean.withColumn("rk", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("s")))).filter(F.col("rk") <= k).drop("rk")


def min_max(scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """(qid, id, s): scores of each qid scaled to [0, weight]; 0 where all are equal."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.select("qid", "id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo) * weight).otherwise(F.lit(0.0)).alias("s"))


def graph_stats(cc: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: chunks, concepts, memberships, their averages, edges and degrees."""
    a = cc.agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("concept").alias("concepts"), F.count("*").alias("memberships"))
    e = edges.agg(F.count("*").alias("edges"), F.avg("prob").alias("weight_mean"), F.stddev_pop("prob").alias("weight_std"))
    deg = both_ways(edges).groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d").alias("degree_max"), F.avg("d").alias("degree_mean"))
    return one_row(one_row(a, e), deg).withColumn("concepts_per_chunk", F.col("memberships") / F.col("chunks"))


def depth_profiles(readout: DataFrame, corpus_words: DataFrame, stop: tuple[str, ...] = T.STOP, least_layers: int = 3, onset: int = 10) -> DataFrame:
    """(chunk_id, word, com, first, last, span, n_layers, total, in_corpus) of readouts (chunk_id, layer, token, prob)."""
    w = F.lower("token")
    rows = readout.withColumn("word", w).filter(T.is_ascii(w) & ~w.isin(*stop))
    p = rows.groupBy("chunk_id", "word").agg(
        (F.sum(F.col("layer") * F.col("prob")) / F.sum("prob")).alias("com"), F.min("layer").alias("first"), F.max("layer").alias("last"),
        F.countDistinct("layer").alias("n_layers"), F.sum("prob").alias("total"),
    )
    p = p.filter((F.col("n_layers") >= least_layers) & (F.col("last") >= onset) & (F.col("total") > 0)).withColumn("span", F.col("last") - F.col("first"))
    known = corpus_words.select("word", F.lit(True).alias("in_corpus")).distinct()
    return p.join(known, "word", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def gap_split(profiles: DataFrame, least_gap: float = 2.0, verified: int = 2) -> DataFrame:
    """profiles with role: meta below the largest gap of centres (the median where no gap is large), sub from it on; noise for
    words that the corpus lacks, where it has enough others."""
    enough = F.sum(F.col("in_corpus").cast("int")).over(Window.partitionBy("chunk_id")) >= verified
    rows = profiles.withColumn("used", F.col("in_corpus") | ~enough)
    order = Window.partitionBy("chunk_id", "used").orderBy("com", "word")
    rows = rows.withColumn("gap", F.coalesce(F.round(F.col("com") - F.lag("com").over(order), 9), F.lit(0.0))).withColumn("i", F.row_number().over(order))
    whole = Window.partitionBy("chunk_id", "used")
    n = F.count("*").over(whole)
    best = F.max(F.struct("gap", (-F.col("i")).alias("i"), "com")).over(whole)
    middle = F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("com"))).over(whole)
    rows = rows.withColumn("n", n).withColumn("cut", F.when(best["gap"] >= least_gap, best["com"]).otherwise(middle))
    role = F.when(~F.col("used"), "noise").when(F.col("n") <= 1, "meta").when(F.col("com") < F.col("cut"), "meta").otherwise("sub")
    return rows.withColumn("role", role).drop("used", "gap", "i", "n", "cut")


def onset(readout: DataFrame, least: int = 2) -> DataFrame:
    """(chunk_id, onset): the first layer with `least` words."""
    per = readout.groupBy("chunk_id", "layer").agg(F.countDistinct("token").alias("n"))
    return per.groupBy("chunk_id").agg(F.min(F.when(F.col("n") >= least, F.col("layer"))).alias("onset"))


def compare_layers(first: DataFrame, second: DataFrame) -> DataFrame:
    """(layer, both, only_first, only_second): words of two readouts (layer, token)."""
    a, b = (r.groupBy("layer").agg(F.collect_set("token").alias(n)) for r, n in ((first, "a"), (second, "b")))
    rows = a.join(b, "layer", "full").select("layer", *[F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in "ab"])
    return rows.select("layer", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_first"), F.size(F.array_except("b", "a")).alias("only_second"))


def compare_layers_of(readout: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second, layer, both, only_first, only_second): compare_layers() of the readouts (chunk_id, layer, token) of each pair."""
    sets = readout.groupBy("chunk_id", "layer").agg(F.collect_set("token").alias("words"))
    a, b = (pairs.join(sets, F.col(c) == F.col("chunk_id")).select("first", "second", "layer", F.col("words").alias(n)) for c, n in (("first", "a"), ("second", "b")))
    rows = a.join(b, ["first", "second", "layer"], "full").select("first", "second", "layer", *[F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in "ab"])
    return rows.select("first", "second", "layer", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_first"), F.size(F.array_except("b", "a")).alias("only_second"))


def trace(steps: DataFrame, least_prob: float = 0.05, domain: DataFrame | None = None, share: float = 0.3) -> DataFrame:
    """(run, word, n_steps, best, best_step) of words in two steps or more of (run, step, word, prob), best at least least_prob."""
    rows = steps.groupBy("run", "word").agg(F.countDistinct("step").alias("n_steps"), F.max("prob").alias("best"), F.min_by("step", F.struct(-F.col("prob"), F.col("step"))).alias("best_step"))
    return rows.filter((F.col("n_steps") >= 2) & (F.col("best") >= least_prob))


def disambiguate(first: Column, second: Column) -> Column:
    """same, near or diff by the stems that two word lists share."""
    a, b = F.array_distinct(F.transform(first, T.stem)), F.array_distinct(F.transform(second, T.stem))
    n = F.size(F.array_intersect(a, b))
    return F.when(n >= 2, "same").when(n == 1, "near").otherwise("diff")


def disambiguated(pairs: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(a, b, verdict) of disambiguate() on the neighbours (src, dst) of both, for pairs that have some. The stems of the one with
    fewer are looked up among the other's, so a node of many neighbours is not read for each of its pairs."""
    stems = stored(adjacent.select(F.col("src").alias("node"), T.stem("dst").alias("stem")).distinct(), "neighbour-stems")
    n = stems.groupBy("node").agg(F.count("*").alias("n"))
    sized = pairs.select("a", "b").join(n.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    few = F.col("na") <= F.col("nb")
    ends = stored(sized.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("other")), "pair-ends")
    shared = ends.join(stems, "node").select("a", "b", F.col("other").alias("node"), "stem").join(stems, ["node", "stem"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    verdict = F.when(F.col("n") >= 2, "same").when(F.col("n") == 1, "near").otherwise("diff")
    return ends.select("a", "b").join(shared, ["a", "b"], "left").select("a", "b", verdict.alias("verdict"))


def by_cosine(c: Column, same: float = 0.8, near: float = 0.55) -> Column:
    return F.when(c >= same, "same").when(c >= near, "near").otherwise("diff")


def code_graph(files: DataFrame, symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """(source, relation, target): DEFINES of (file, symbol), REFERENCES from (file, word) to the last file that defines the word."""
    defines = symbols.select(F.col("file").alias("source"), F.lit("DEFINES").alias("relation"), F.concat_ws("::", "file", "symbol").alias("target")).distinct()
    owner = symbols.groupBy("symbol").agg(F.max("file").alias("owner"))
    refs = uses.join(owner, uses["word"] == owner["symbol"]).filter("file <> owner")
    return defines.union(refs.select("file", F.lit("REFERENCES"), F.concat_ws("::", "owner", "symbol")).distinct())


def appearance_graph(rows: DataFrame, least: int = 2) -> DataFrame:
    """(source, relation, target, weight) of (name, chapter): APPEARS_IN of names in `least` chapters, INTERACTS_WITH of
    names that share `least`, weighted by how many."""
    r = rows.select("name", "chapter").distinct()
    often = r.join(r.groupBy("name").agg(F.count("*").alias("c")).filter(F.col("c") >= least), "name").select("name", "chapter")
    meets = pair_counts(often.select(F.col("chapter").alias("chunk_id"), F.col("name").alias("concept")), least)
    appears = often.select(F.col("name").alias("source"), F.lit("APPEARS_IN").alias("relation"), F.col("chapter").cast("string").alias("target"), F.lit(None).cast("long").alias("weight"))
    return appears.union(meets.select("a", F.lit("INTERACTS_WITH"), "b", "n"))


def graph_questions(edges: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """(source, relation, question, answers): one question for each source and relation with least to most answers."""
    g = edges.groupBy("source", "relation").agg(F.array_sort(F.collect_set("target")).alias("answers")).filter(F.size("answers").between(least, most))
    return g.select("source", "relation", F.concat(F.lit("What does "), "source", F.lit(" "), F.lower(F.replace(F.col("relation"), F.lit("_"), F.lit(" "))), F.lit("?")).alias("question"), "answers")
