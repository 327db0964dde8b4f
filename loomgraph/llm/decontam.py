"""Benchmark decontamination with suffix arrays over the training text.

Each shard of training documents (a slice of an Arrow batch, whole documents) is turned into a sequence of word numbers in
the benchmark's vocabulary, with 0 for every other word and between documents. No match runs through a 0, so only
suffixes that start a long enough run of non-zero words enter the shard's suffix array, which is sorted by prefix
doubling. Every suffix of every benchmark item is then binary-searched in every shard: its range narrows word by word until it
is empty, which gives the longest verbatim match, and the range at the window's length gives all locations. Locations of an item's
successive suffixes that follow each other are one match, with its place in the item and in the document and its whole length.
Benchmark items reach the executors in blocks of a fixed size, of which a worker holds one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import blocks, col, every, free, spread, utf8

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Benchmark words in one block: what is held in each Python worker at a time.
BLOCK_WORDS = 2_000_000

#: Bytes of words after A-Z are lower-cased: 0-9, a-z and all of a character beyond ASCII; 0 elsewhere.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_BASE, _MOD = 0x9E3779B97F4A7C15, 1 << 64
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, _MOD))):
                out = np.ones(size, np.uint64)
                have = 1
                while have < size:
                    step = np.uint64(pow(base, have, _MOD))
                    more = min(have, size - have)
                    np.multiply(out[:more], step, out=out[have : have + more])
                    have += more
                setattr(cls, name, out)
        return cls.up[:n], cls.down[:n]


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its document's number, words per document) of concatenated UTF-8 texts."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    low = _LOWER[data]
    inside = low != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _Powers.get(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(low * up[: len(data)], out=total[1:], dtype=np.uint64)
    h = (total[e] - total[s]) * down[s]
    h = (h ^ (h >> np.uint64(29))) * _MIX + (e - s).astype(np.uint64)
    doc = np.searchsorted(offsets, s, side="right") - 1
    return h, doc, np.bincount(doc, minlength=n_docs)


@dataclass
class Benchmark:
    """A block of items and those of their suffixes that start a window."""

    vocab: np.ndarray  # sorted hashes of words; a word's number is its place + 1
    maybe: np.ndarray  # by the upper 20 bits of a hash: whether any word of the vocabulary has them
    words: np.ndarray  # the items' words by number, item after item
    starts: np.ndarray  # of each suffix in words
    lengths: np.ndarray  # words from there to the item's end
    needs: np.ndarray  # words of the item's windows
    offsets: np.ndarray  # of each suffix in its item
    items: np.ndarray  # of each suffix, a number into ids
    ids: list[str | None]

    @property
    def least(self) -> int:
        return int(self.needs.min()) if len(self.needs) else 0


def benchmark_block(rows: list[tuple], window: int = WINDOW) -> Benchmark:
    """Numbers a block's items (id, text)."""
    arr = pa.array([r[1] for r in rows], pa.string())
    h, doc, counts = words_of(*utf8(arr))
    vocab, number = np.unique(h, return_inverse=True)
    number = number.astype(np.int64) + 1
    plain = [w for t in arr.to_pylist() for w in re.findall(WORD, _lower(t or ""))]
    by_hash: dict[int, str] = {}
    for x, w in zip(h.tolist(), plain, strict=True):
        if by_hash.setdefault(x, w) != w:
            raise ValueError(f"two benchmark words share a hash: {w!r} and {by_hash[x]!r}")
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocab >> np.uint64(44)).astype(np.int64)] = True
    needs = np.minimum(counts, window)
    suffixes = np.where(counts > 0, counts - needs + 1, 0)
    item = np.repeat(np.arange(len(counts)), suffixes)
    offsets = np.arange(suffixes.sum()) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    starts = (np.cumsum(counts) - counts)[item] + offsets
    return Benchmark(vocab, maybe, number, starts, counts[item] - offsets, needs[item], offsets, item, [None if r[0] is None else str(r[0]) for r in rows])


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` of seq in the order of their suffixes, as far as `depth` words; a suffix ends at its first 0."""
    rank = seq.copy()
    step, order = 1, at[np.argsort(rank[at], kind="stable")]
    live = np.flatnonzero(rank)
    while step < depth and len(at):
        second = np.zeros(len(live), np.int64)
        ok = live + step < len(rank)
        second[ok] = rank[live[ok] + step]
        key = rank[live] * (int(rank.max()) + 1) + second
        fresh = np.zeros_like(rank)
        fresh[live] = np.unique(key, return_inverse=True)[1] + 1
        rank = fresh
        step *= 2
        own = np.sort(rank[at])
        if (own[1:] != own[:-1]).all():
            break  # all are told apart
    return at[np.argsort(rank[at], kind="stable")] if len(at) else order


def search(seq: np.ndarray, sa: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, the `lengths` words at `starts` of words: [lo, hi) of the suffixes that start with its first `needs` words
    (empty if none does), and the words of its longest match."""
    n = len(starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest = np.zeros(n, np.int64)
    live = np.arange(n) if len(sa) else np.zeros(0, np.int64)
    d = 0
    while len(live):
        word = words[starts[live] + d]
        ends = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                pos = sa[np.minimum(mid, len(sa) - 1)] + d
                x = np.where(pos < len(seq), seq[np.minimum(pos, len(seq) - 1)], 0)
                less = (x <= word if right else x < word) & open_
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            ends.append(a)
        lo[live], hi[live] = ends
        d += 1
        live = live[ends[0] < ends[1]]
        longest[live] = d
        whole = live[needs[live] == d]
        first[whole], last[whole] = lo[whole], hi[whole]
        live = live[lengths[live] > d]
    return first, last, longest


def shard_matches(h: np.ndarray, doc: np.ndarray, counts: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Maximal verbatim matches of a window or more in a shard, given its words' hashes and documents: rows of
    (document, item number, first word in the item, first word in the shard, words)."""
    none = np.zeros((0, 5), np.int64)
    if not len(h) or not len(bench.starts):
        return none
    seq = np.zeros(len(h), np.int64)
    some = np.flatnonzero(bench.maybe[(h >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(bench.vocab, h[some]), len(bench.vocab) - 1)
    ok = bench.vocab[place] == h[some]
    seq[some[ok]] = place[ok] + 1
    # A 0 between documents: positions move by their document's number.
    spread = np.zeros(len(h) + len(counts), np.int64)
    spread[np.arange(len(h)) + doc] = seq
    zeros = np.flatnonzero(np.concatenate([spread, [0]]) == 0)
    known = np.flatnonzero(spread)
    run = np.searchsorted(zeros, known)
    # Runs too short for any window are left out altogether.
    long = np.bincount(run, minlength=len(zeros) + 1)[run] >= bench.least
    spread[known[~long]] = 0
    known, run = known[long], run[long]
    at = known[zeros[run] - known >= bench.least]
    if not len(at):
        return none
    sa = suffix_array(spread, at, int(min((zeros[run] - known).max(), bench.lengths.max())))
    lo, hi, _ = search(spread, sa, bench.words, bench.starts, bench.lengths, bench.needs)
    n = hi - lo
    if not n.sum():
        return none
    q = np.repeat(np.arange(len(n)), n)
    p = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    # A match is a run of windows on one diagonal of (item, document); the 0 between documents keeps these apart.
    order = np.lexsort([p, p - bench.offsets[q], bench.items[q]])
    q, p = q[order], p[order]
    item, diagonal = bench.items[q], p - bench.offsets[q]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    of = np.zeros(len(spread), np.int64)
    of[np.arange(len(h)) + doc] = doc
    d = of[p[first]]
    return np.stack([d, item[first], bench.offsets[q[first]], p[first] - d, p[last] - p[first] + bench.needs[q[first]]], 1)


HITS = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:int,end:int>>,matches:array<struct<item:string,item_start:int,start:int,words:int>>>"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hits_of(tokens: list[tuple], found: list[list[tuple[np.ndarray, list]]]) -> Iterator[dict]:
    """HITS of each document of the shards `tokens`; found: by shard, the matches in each benchmark block and its ids."""
    for (h, _, counts), per in zip(tokens, found):
        first = np.cumsum(counts) - counts
        edge = np.zeros(len(h) + 1, np.int64)
        own: dict[int, list[dict]] = {}
        for m, ids in per:
            np.add.at(edge, m[:, 3], 1)
            np.add.at(edge, m[:, 3] + m[:, 4], -1)
            for d, item, offset, at, words in m.tolist():
                own.setdefault(d, []).append({"item": ids[item], "item_start": offset, "start": at - int(first[d]), "words": words})
        hit = np.cumsum(edge[:-1]) > 0
        for d, n in enumerate(counts.tolist()):
            if d not in own:
                yield {"n_words": n, "n_hit": 0, "items": [], "spans": [], "matches": []}
                continue
            a, b = _runs(hit[first[d] : first[d] + n])
            spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
            rows = sorted(own[d], key=lambda x: (x["start"], x["item"] is None, x["item"] or "", x["item_start"]))
            yield {"n_words": n, "n_hit": int((b - a).sum()), "items": sorted({x["item"] for x in rows if x["item"] is not None}), "spans": spans, "matches": rows}


def hits_udf(held: list):
    """An Arrow UDF text -> HITS; held: broadcast variables of Benchmarks. A batch is split into words once for all of them."""
    match = pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span)), ("matches", pa.list_(match))])

    @arrow_udf(HITS)
    def hits(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            tokens = [words_of(*utf8(part)) for part in blocks(batch)]
            found: list[list] = [[] for _ in tokens]
            for b in held:
                bench = b.value
                for t, per in zip(tokens, found):
                    m = shard_matches(*t, bench)
                    if len(m):
                        per.append((m, bench.ids))
                if len(held) > 1:
                    b.__dict__.pop("_value", None)  # one block in memory at a time; the next batch loads it again
            yield pa.array(_hits_of(tokens, found), kind)

    return hits


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Benchmark]:
    """Items in blocks of at most block_words words (a longer item is a block of its own), one block on the driver at a time."""
    rows, size = [], 0
    for r in benchmark.select(col(id_col).cast("string"), col(text_col)).toLocalIterator():
        n = len(r[1] or "") // 2 + 1
        if rows and size + n > block_words:
            yield benchmark_block(rows, window)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield benchmark_block(rows, window)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, out: str = "hits") -> DataFrame:
    """docs with a column `out`: struct of n_words, n_hit, items (sorted ids of items that occur, as strings), spans of hit words,
    and matches: (item, its first word, the document's first word, words) of every maximal verbatim match of a window or more.

    A null or empty text has no words and no hits; one of any length is searched whole. An item without words has no window;
    ids may be of any type; a null one marks words and is not listed among items; repeated items count once. No documents
    or no benchmark at all: no rows, or nothing hit. Columns of docs stay, whatever their names; one that is already
    named `out` is replaced. The benchmark goes through the driver in blocks of `block_words` and lies on each executor's disk.
    """
    spark = docs.sparkSession
    held = []
    for b in _benchmark_blocks(benchmark, item_col, item_text, window, block_words):
        held.append(spark.sparkContext.broadcast(b))
        held[-1].unpersist()
        b = None
    return docs.withColumn(out, hits_udf(held)(col(text_col)))


def contaminated(hits, share: int = 20):
    """n_hit > 0 and share * n_hit >= n_words."""
    return (hits["n_hit"] > 0) & (hits["n_hit"] * share >= hits["n_words"])


def affected(hits, window: int = WINDOW, share: int = 20):
    """A verbatim match of `window` words or more, however long the document; of items shorter than that, whose few words may
    stand anywhere by chance, only so much that the document is contaminated."""
    return F.exists(hits["matches"], lambda m: m["words"] >= window) | contaminated(hits, share)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document with counts and a digest of its hits; repeated rows each have a row, ids may be null."""
    rows = with_hits(spread(docs.select(col(id_col).alias("doc_id"), F.col("text"))), benchmark, **options)
    h = F.col("hits")
    return rows.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), contaminated(h).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs without those that are affected(): every document with a verbatim match of `window` words goes.

    Null, empty and blank texts have no match and stay. Of repeated rows all stay or all go. An empty table of documents stays
    empty, an empty benchmark removes nothing. All columns stay, whatever their names.
    """
    out = free(docs, "hits")
    return with_hits(docs, benchmark, window=window, out=out, **options).filter(~affected(F.col(out), window)).select(*every(docs))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r
)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
