"""Near-duplicate removal at a set similarity of word shingles, for the corpus pipeline.

At a Jaccard similarity of 0.8, two texts' SimHash fingerprints differ by about ten bits of 64, and no index finds such pairs in
a large corpus. So the fingerprints of five-word shingles and their Gray-order index (see simhash) bring the closest texts
together, and bands of min-wise hashes of the same shingles the others; both only say which texts may be related. Texts that are
related over any number of steps are a family. Each text goes to its family's task once (to one task for each pair of chunks, if
the family is large), where the shingle sets themselves decide all links at the similarity; spanning edges of these leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, every, free, spread, stored, texts
from .simhash import _union, components, fingerprint, links, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bands of ROWS min-wise hashes each: a pair at 0.8 meets in none of them with a probability of 0.0001, one at 0.3 in any with 0.01.
BANDS, ROWS = 40, 7
#: Texts in a chunk of a family that is split: four times the root of the family's size, within these.
LEAST_CHUNK, MOST_CHUNK = 128, 4096

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the min-wise hashes of a set; equal in a band only if all its hashes are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1))
    least ^= least >> np.uint64(32)
    keys = (least.reshape(BANDS, ROWS) * _BAND_MIX).sum(1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _marks(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in column:
        fps, bands = [], [np.zeros(0, np.uint64)]
        for t in texts(batch):
            h = shingle_hashes(t, WORDS)
            fps.append(fingerprint(h))
            bands.append(band_keys(np.unique(h)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands).view(np.int64)))
        yield pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["fp", "bands"])


def linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """A label for each set (its elements sorted and distinct): the least place in its component under a Jaccard
    similarity of `least`; two empty sets are equal.

    Elements of one set alone only count for its size; the others are columns of a bit matrix. Every set outside the largest
    component so far is compared with all outside its own, so no two components stay apart unseen.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    bits = np.zeros((n, int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        largest = np.bincount(label, minlength=n).argmax()
        todo = np.flatnonzero(~done & (label != largest))
        if not len(todo):
            return label
        i = int(todo[0])
        done[i] = True
        fits = (label != label[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]))
        j = np.flatnonzero(fits)
        both = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
        every = size[j] + size[i] - both
        j = j[(both >= least * every - 1e-9) | (every == 0)]
        label = _union(label, np.full(len(j), i), j)


def _family_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (family, pair, id, text), sorted by family and pair -> spanning edges (a, b)."""

    def done(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        if len(ids) < 2:
            return None
        label = linked(sets, least)
        b = np.flatnonzero(label != np.arange(len(ids)))
        own = np.array(ids)
        return pa.RecordBatch.from_arrays([pa.array(own[label[b]]), pa.array(own[b])], names=["a", "b"]) if len(b) else None

    key, ids, sets = None, [], []
    for batch in batches:
        for k, i, t in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), texts(batch.column(3))):
            if k != key:
                out = done(ids, sets)
                if out is not None:
                    yield out
                key, ids, sets = k, [], []
            ids.append(i)
            sets.append(np.unique(shingle_hashes(t, WORDS)))
    out = done(ids, sets)
    if out is not None:
        yield out


def related(marks: DataFrame) -> DataFrame:
    """(a, b): edges between texts (id, fp, bands) that share a band's key or whose fingerprints link; each key's
    texts meet in its first one, so a key of any size has as many edges as texts."""
    banded = marks.select("id", F.explode("bands").alias("key"))
    met = banded.groupBy("key").agg(F.min("id").alias("other"), F.count("*").alias("m")).filter("m > 1").select("key", "other")
    pairs = banded.join(met, "key").select("id", "other").filter("id <> other").distinct()
    first = stored(marks.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    same = marks.select("fp", "id").join(first, "fp").filter("id <> first").select("id", F.col("first").alias("other"))
    close = links(first.select("fp"))
    close = close.join(first.select(F.col("fp").alias("a"), F.col("first").alias("other")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("id")), "b").select("id", "other")
    return pairs.union(same).union(close).select(F.col("id").alias("a"), F.col("other").alias("b"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id (a null one only if all are null).

    Exact copies are near duplicates, also of texts without words (null, empty, blank), which are all alike. Of rows that share
    the smallest id and its text, the first by the order of their columns' JSON stays, so reruns agree. An empty table stays
    empty. All columns of docs stay, whatever their names. Texts without relatives are not moved again once that is known.
    """
    of, no, fam = free(docs, "of"), free(docs, "no"), free(docs, "family")
    key = F.sha2(F.coalesce(col(text_col), F.lit("")), 256)
    rows = spread(docs.select(key.alias("of"), col(text_col).alias("text"))).select("of", arrow_udf(_marks, "struct<fp:long,bands:array<long>>")("text").alias("s"))
    marks = rows.groupBy("of").agg(F.first("s").alias("s"), F.count("*").alias("n")).select("of", "n", "s.*")
    marks = stored(marks.withColumn("id", F.monotonically_increasing_id()), "marks")
    family = components(related(marks), "related").select(F.col("node").alias("id"), F.col("root").alias("family"))
    known = marks.select("of", "id", "n").join(family, "id", "left").filter("n > 1 or family is not null").select(F.col("of").alias(of), F.col("id").alias(no), F.col("family").alias(fam))
    tagged = stored(docs.withColumn(of, key).join(known, of, "left"), "tagged")
    alone, some = tagged.filter(F.col(no).isNull()), tagged.filter(F.col(no).isNotNull())
    # Each text of a family once, in as many tasks as its family has chunks.
    n = F.count("*")
    chunks = F.ceil(n / F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), 4 * F.sqrt(n)))).cast("int")
    size = stored(family.groupBy("family").agg(chunks.alias("chunks")).filter("chunks > 1"), "families")
    once = some.filter(F.col(fam).isNotNull()).select(F.col(fam).alias("family"), F.col(no).alias("id"), col(text_col).alias("text")).dropDuplicates(["id"])
    once = once.join(size, "family", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, chunk).cast("long") * 65536 + F.greatest(j, chunk))
    once = once.select("family", F.explode(pairs).alias("pair"), "id", "text")
    edges = once.repartition("family", "pair").sortWithinPartitions("family", "pair", "id").mapInArrow(lambda b: _family_edges(b, least), "a long, b long")
    roots = components(edges, "linked").select(F.col("node").alias("no"), "root")
    named = some.select(col(id_col).alias("d"), F.col(no).alias("no"), F.col(of).alias("of")).join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    order = F.struct(F.col("d").isNull().alias("none"), F.col("d").alias("d"), F.col("of").alias("of"))
    stays = named.groupBy("root").agg(F.min(order).alias("s")).select(F.col("s").alias(fam))
    s = F.col(fam)
    kept = some.drop(fam).join(stays, (F.col(of) == s["of"]) & col(id_col).eqNullSafe(s["d"]))
    row = F.struct(*every(docs))
    kept = kept.groupBy(F.col(of).alias(of), s["d"].alias(no)).agg(F.min_by(row, F.to_json(row)).alias(fam)).select(F.col(fam))
    return alone.select(*every(docs)).union(kept.select(*[F.col(fam).getField(c).alias(c) for c in docs.columns]))
