"""Mixing sources to target weights by systematic sampling.

Each source has a target of words. A document's expected copies are target / size of its source. The documents of a
source are laid in one order, their expected copies are prefix-summed, one random offset is added, and a document
is emitted once for each integer boundary that its step crosses. The order is by falling size, so that the difference of
taken words from the target telescopes: it stays below the size of the source's largest document.

The prefix sum is distributed. Rows are range-partitioned by (source, size, id), so a hot source lies in as many
partitions as its rows need; each partition knows its rows' positions, and the counts per (partition, source) give the
positions at which the partitions start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, every, free, spread, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names (code points; null last), repeating.
CYCLE = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = CYCLE, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, docs, source_size, target.

    `share` of all sizes is shared out by weight. A target above `cap` times its source's size stops there and its excess
    is reshared by weight among the others: with the sources in order of cap / weight, that is the level at which the
    shares of those not yet stopped use up what the stopped ones leave. Rows here are sources, not documents.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(wheel, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # The ties share a cap / weight ratio and stop together; the name decides their order alone.
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    # The first source that its own level doesn't stop fixes the level of all that follow.
    per = per.withColumn("at", F.row_number().over(by_ratio))
    per = per.withColumn("final", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))).over(whole)["level"])
    open_ = F.col("final").isNotNull() & (F.col("final") * F.col("weight") < F.col("most"))
    return per.select("source", "docs", "source_size", F.when(open_, F.col("final") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1), the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ranked(sized: DataFrame, source: str, size: str, key: str, at: str, place: str) -> DataFrame:
    """sized with `place`: the position from 1 in its source, by falling size, then id (column key), then the row's digest in
    column at; rows that agree in all of these come in the order in which they are read."""
    s, k = F.col(source), F.col(key)
    order = [s.isNull(), s, F.col(size).desc(), k.isNull(), k, F.col(at), F.monotonically_increasing_id()]
    rows = sized.repartitionByRange(*order).sortWithinPartitions(*order[:-1]).withColumn(at, F.monotonically_increasing_id())
    rows = stored(rows, "ranked")
    part = F.shiftright(at, 33)
    starts = rows.groupBy(F.col(source).alias("source"), part.alias("part")).agg(F.count("*").alias("here"), F.min(at).alias("first"))
    starts = starts.withColumn("before", F.coalesce(F.sum("here").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(F.struct("source", "part", "before", "first").alias(place))
    p = F.col(place)
    both = rows.join(starts, (part == p["part"]) & F.col(source).eqNullSafe(p["source"]))
    return both.withColumn(place, p["before"] + F.col(at) - p["first"] + 1).drop(at)


def with_copies(docs: DataFrame, keep: list[Column], id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """(rows of a stored table with the columns `keep` and those of the mix, the latter's names); names differ from all of docs."""
    n = {c: free(docs, c) for c in ("source", "size", "id", "at", "place", "target", "copies")}
    digest = F.xxhash64(F.coalesce(col(text_col), F.lit(""))) if keep else F.lit(0).cast("long")
    sized = spread(docs).select(*keep, col(id_col).alias(n["id"]), col(source_col).alias(n["source"]), word_count(col(text_col)).alias(n["size"]), digest.alias(n["at"]))
    rows = ranked(sized, n["source"], n["size"], n["id"], n["at"], n["place"])
    targets = source_targets(rows.select(F.col(n["source"]).alias("source"), F.col(n["size"]).alias("size")), weights, share, cap).select(F.struct("source", "source_size", "target").alias(n["target"]))
    t = F.col(n["target"])
    both = rows.join(targets, F.col(n["source"]).eqNullSafe(t["source"]))
    rate = F.when(t["source_size"] > 0, t["target"] / t["source_size"]).otherwise(F.lit(0.0))
    u, place = offset(F.col(n["source"]), seed), F.col(n["place"])
    copies = (F.floor(rate * place + u) - F.floor(rate * (place - 1) + u)).cast("long")
    return both.withColumn(n["copies"], F.least(copies, F.lit(int(cap)))), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = CYCLE, share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (copies * size).

    A null text is of size 0; null is a source of its own, after all others. Documents of equal size are laid out by id;
    rows with the same id count each. A source without words has the target 0 and takes nothing. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    rows, n = with_copies(docs, [], id_col, text_col, source_col, weights, share, cap, seed)
    size, copies, t = F.col(n["size"]), F.col(n["copies"]), F.col(n["target"])
    return rows.select(F.col(n["id"]).alias("id"), F.col(n["source"]).alias("source"), size.alias("size"), t["source_size"].alias("source_size"), t["target"].alias("target"), copies.alias("copies"), (copies * size).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = CYCLE, share: float = 1.5, cap: float = 2.0, seed: int = 42, out: str = "copy") -> DataFrame:
    """The mixed corpus: docs' rows, each as often as the mix takes it, with its copy's number (from 0) in `out`.

    Every row carries its own count of copies, repeated rows too, so the emitted words are those that mix() takes. All columns
    stay, whatever their names; where docs has one named `out`, the number's column gets underscores after its name.
    Nulls, empty texts and empty tables as in mix().
    """
    rows, n = with_copies(docs, every(docs), id_col, text_col, source_col, weights, share, cap, seed)
    number = F.explode(F.sequence(F.lit(0), (F.col(n["copies"]) - 1).cast("int")))
    return rows.filter(F.col(n["copies"]) > 0).select(*every(docs), number.alias(free(docs, out)))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
            row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS pos FROM weighed
), fixed AS (
  SELECT *, (SELECT level FROM levels WHERE level <= most / weight ORDER BY pos LIMIT 1) AS final FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN final IS NOT NULL AND final * weight < most THEN final * weight ELSE most END AS target FROM fixed
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS LAST) AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('42:' || coalesce(s.source, '')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * least(2, CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT)) AS taken FROM placed
"""
