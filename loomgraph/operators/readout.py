"""What follows a model's readout: decoding of layers and relations, fallbacks, role words, traces, tree reports, source outlines.

The model itself is outside: its results are tables (chunk_id, layer, rank, token, prob), whatever wrote them.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomgraph.functions import text as T
from loomgraph.session import stored

from .concepts import attributes, role_words_ok
from .corpus import one_row
from .vectors import cosine


def decode_layers(readout: DataFrame, n: int = 5, least: int = 4, stop: tuple[str, ...] = T.STOP) -> DataFrame:
    """(chunk_id, layer, word, prob, rk): each layer's n first content words: letters only, cased lower, Title or as ALL CAPS of five
    or more, no stop words, each once."""
    shape = F.col("token").rlike(rf"^([a-z]{{{least},}}|[A-Z][a-z]{{{least - 1},}}|[A-Z]{{5,}})$")
    w = F.lower("token")
    rows = readout.filter(shape & ~w.isin(*stop)).withColumn("word", w)
    one = rows.groupBy("chunk_id", "layer", "word").agg(F.min("rank").alias("rank"), F.max("prob").alias("prob"))
    rank = F.row_number().over(Window.partitionBy("chunk_id", "layer").orderBy("rank", "word"))
    return one.withColumn("rk", rank).filter(F.col("rk") <= n).select("chunk_id", "layer", "word", "prob", "rk")


def decode_relation(readout: DataFrame, types: DataFrame, top: int = 10) -> DataFrame:
    """(a, b, relation, prob, known) of (a, b, rank, token, prob): the first of the top words that is a relation type (word), else the
    first word."""
    known = types.select(F.col("word").alias("__w"), F.lit(True).alias("known")).distinct()
    rows = readout.filter(F.col("rank") <= top).join(known, F.lower("token") == F.col("__w"), "left")
    best = F.min_by(F.struct(F.lower("token").alias("relation"), "prob", F.coalesce("known", F.lit(False)).alias("known")), F.struct(F.col("known").isNull(), F.col("rank")))
    return rows.groupBy("a", "b").agg(best.alias("r")).select("a", "b", "r.*")


def relation_report(relations: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, known_share, mean_prob) of relations (.., prob, known)."""
    return relations.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("known").cast("int")).alias("known_share"), F.avg("prob").alias("mean_prob"))


def with_fallbacks(strict: DataFrame, relaxed: DataFrame, single: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """(chunk_id, word, tier, rk): strict words where a chunk has `least` of them, else relaxed ones, else single-layer ones;
    each word once, `most` at most. Inputs: (chunk_id, word, score)."""
    tiers = [df.select("chunk_id", "word", "score", F.lit(i).alias("tier")) for i, df in enumerate((strict, relaxed, single))]
    rows = tiers[0].union(tiers[1]).union(tiers[2])
    counts = rows.groupBy("chunk_id", "tier").agg(F.countDistinct("word").alias("c"))
    first = counts.groupBy("chunk_id").agg(F.coalesce(F.min(F.when(F.col("c") >= least, F.col("tier"))), F.lit(2)).alias("until"))
    rows = rows.join(first, "chunk_id").filter(F.col("tier") <= F.col("until"))
    one = rows.groupBy("chunk_id", "word").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("t"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("t.tier", "t.s", "word"))
    return one.withColumn("rk", rank).filter(F.col("rk") <= most).select("chunk_id", "word", F.col("t.tier").alias("tier"), "rk")


def role_words(readout: DataFrame, siblings: DataFrame, corpus_words: DataFrame, n: int = 5) -> DataFrame:
    """(chunk_id, concept, word, rk) of (chunk_id, concept, token, prob): words of the corpus that are no form of the concept, of
    another concept (chunk_id, concept) of the chunk or of a better word."""
    stems = siblings.select("chunk_id", T.stem("concept").alias("stem")).distinct()
    rows = readout.select("chunk_id", "concept", F.lower("token").alias("word"), "prob").withColumn("stem", T.stem("word"))
    rows = rows.join(stems, ["chunk_id", "stem"], "left_anti").join(corpus_words.select("word").distinct(), "word", "left_semi")
    rows = rows.select(F.struct("chunk_id", "concept").alias("key"), F.col("concept").alias("own"), "word", F.col("prob").alias("score"))
    return attributes(rows, "key", n).select("key.*", "word", "rk")


def concept_role_words(adjacent: DataFrame, members: DataFrame, corpus_words: DataFrame, n: int = 5) -> DataFrame:
    """role_words() where a concept's words (src, dst, prob) are the same on all its chunks (members: chunk_id, concept).

    What depends on the concept alone is done once a concept. A chunk can only take out words by stem: of s stems of a chunk, the n
    best forms that are left are among the concept's first n + s forms, each by one of its first s + 1 stems. So a chunk meets a short
    list of each of its concepts, and not all its neighbours.
    """
    stems = members.select("chunk_id", "concept", T.stem("concept").alias("stem"))
    near = stored(stems.join(stems.groupBy("chunk_id").agg(F.collect_set("stem").alias("stems")), "chunk_id").select("chunk_id", "concept", "stems"), "chunk-stems")
    s = near.agg(F.max(F.size("stems"))).first()[0] or 0
    rows = adjacent.select(F.col("src").alias("concept"), F.lower("dst").alias("word"), F.col("prob").alias("score"))
    rows = rows.filter(role_words_ok("word") & (T.stem("word") != T.stem("concept"))).join(corpus_words.select("word").distinct(), "word", "left_semi")
    rows = rows.withColumn("stem", T.stem("word")).withColumn("form", T.dedupe_stem("word"))
    order = [F.desc("score"), F.col("word")]
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("concept", "stem").orderBy(*order))).filter("i = 1")
    in_form = Window.partitionBy("concept", "form").orderBy(*order)
    rows = rows.withColumn("i", F.row_number().over(in_form)).withColumn("first", F.first(F.struct((-F.col("score")).alias("s"), "word")).over(in_form)).filter(F.col("i") <= s + 1)
    rows = rows.withColumn("rk", F.dense_rank().over(Window.partitionBy("concept").orderBy("first"))).filter(F.col("rk") <= n + s)
    lists = rows.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "word", "stem", "form"))).alias("words"))
    none = F.struct(F.expr("cast(array() as array<string>)").alias("forms"), F.expr("cast(array() as array<string>)").alias("words"))

    def take(a: Column, w: Column) -> Column:
        skip = (F.size(a["words"]) >= n) | F.array_contains(F.col("stems"), w["stem"]) | F.array_contains(a["forms"], w["form"])
        return F.when(skip, a).otherwise(F.struct(F.array_append(a["forms"], w["form"]).alias("forms"), F.array_append(a["words"], w["word"]).alias("words")))

    got = near.join(lists, "concept").select("chunk_id", "concept", F.posexplode(F.aggregate("words", none, take, lambda a: a["words"])).alias("rk", "word"))
    return got.select("chunk_id", "concept", "word", (F.col("rk") + 1).alias("rk"))


def mean_vectors(rows: DataFrame, key: str = "concept", vec_col: str = "vector") -> DataFrame:
    """(key, vector, count): the mean of a concept's vectors over its occurrences."""
    dims = rows.select(key, F.posexplode(vec_col).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").alias("count"))


def trace_overlap(positions: DataFrame, keywords: DataFrame) -> DataFrame:
    """(run, best, at): the most keywords (word) that one position (run, position, word) has, and where first."""
    hits = positions.join(keywords.select("word").distinct(), "word", "left_semi").groupBy("run", "position").agg(F.countDistinct("word").alias("n"))
    got = hits.groupBy("run").agg(F.max("n").alias("best"), F.min_by("position", F.struct(-F.col("n"), F.col("position"))).alias("at"))
    return positions.select("run").distinct().join(got, "run", "left").select("run", F.coalesce("best", F.lit(0)).alias("best"), "at")


def single_entities(spans: DataFrame, surfaces: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spans (chunk_id, span) of several words, and single ones (surfaces: span, caps, inner_caps) that are ALL CAPS, have a
    capital inside sentences twice, or once and are in no dictionary (word)."""
    known = dictionary.select(F.col("word").alias("span"), F.lit(True).alias("known")).distinct()
    rows = spans.join(surfaces, "span", "left").join(known, "span", "left")
    ok = F.contains("span", F.lit(" ")) | F.coalesce("caps", F.lit(False)) | (F.coalesce("inner_caps", F.lit(0)) >= 2) | ((F.coalesce("inner_caps", F.lit(0)) >= 1) & F.col("known").isNull())
    return rows.filter(ok).select("chunk_id", "span")


def prefix_offsets(pairs: DataFrame, base: str, other: str, *keys: str) -> DataFrame:
    """(keys, offset): the mean of 1 - cosine of two vector columns, such as a text's with and without a prefix."""
    return pairs.groupBy(*keys).agg(F.avg(1 - cosine(F.col(base), F.col(other))).alias("offset"))


def best_shift(pairs: DataFrame, base: str, direction: str, target: str, steps: int = 30, step: float = 0.1) -> DataFrame:
    """One row (alpha, cosine): the alpha of 0, step, 2 step, .. at which base - alpha x direction is nearest to target on average."""
    rows = pairs.select(base, direction, target, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).withColumn("alpha", F.col("k") * step)
    moved = F.zip_with(F.col(base), F.col(direction), lambda x, y: x - F.col("alpha") * y)
    means = rows.groupBy("k").agg(F.avg(cosine(moved, F.col(target))).alias("cosine"))
    return means.agg(F.max_by("k", F.struct(F.round("cosine", 9), -F.col("k"))).alias("k"), F.max("cosine").alias("cosine")).select((F.col("k") * step).alias("alpha"), "cosine")


def tree_report(nodes: DataFrame) -> DataFrame:
    """One row of a tree (node, parent, stop_reason): nodes, depth, leaves; depths by following parents down from the roots."""
    level = nodes.filter("parent is null").select("node", F.lit(0).alias("depth"))
    every = level
    while not level.isEmpty():
        level = nodes.select("node", "parent").join(level.select(F.col("node").alias("parent"), "depth"), "parent").select("node", (F.col("depth") + 1).alias("depth"))
        every = every.union(level)
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").agg(F.count("*").alias("leaves"))
    return one_row(every.agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")), leaves)


def outline(source: str, comments: str = "docstring") -> str:
    """A Python source's classes and functions, a line each with depth, signature and first line of the docstring; '' if it
    doesn't parse. comments: none or docstring."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return ""
    out: list[str] = []

    def walk(node: ast.AST, depth: int) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                inner = ", ".join(ast.unparse(b) for b in x.bases) if kind == "class" else ast.unparse(x.args)
                doc = (ast.get_docstring(x) or "").split("\n")[0] if comments == "docstring" else ""
                out.append("  " * depth + f"{kind} {x.name}({inner})" + (f": {doc}" if doc else ""))
                walk(x, depth + 1)

    walk(tree, 0)
    return "\n".join(out)


def outlines(files: DataFrame, text: str = "text", comments: str = "docstring") -> DataFrame:
    """files with the column outline; another language's parser is a plug-in (a Model over the text)."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([outline(t or "", comments) for t in batch.to_pylist()], pa.string())

    return files.withColumn("outline", arrow_udf(run, "string")(F.col(text)))
