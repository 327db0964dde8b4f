"""Shared pieces of the training-data operators: table access, scratch tables and UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import scratch_path, ship, spread, stored  # noqa: F401 - the operators take them from here

#: UTF-8 bytes that one numpy step handles at a time (a longer text is still one whole step).
BLOCK_BYTES = 1 << 20


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    """All columns of df."""
    return [col(c) for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, nulls as empty texts; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if not len(arr) or offs is None:
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(arr: pa.Array, most: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of arr, each of whole texts with about `most` bytes."""
    if not len(arr):
        return
    offsets, _ = utf8(arr)
    at = 0
    while at < len(arr):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield arr.slice(at, end - at)
        at = end


def texts(arr: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes, null as empty."""
    offsets, data = utf8(arr)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


#: Labels are learned from documents outside this fold only.
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id):
    """crc32 of the id as text mod 5 is 0; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def bounded(ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows, the first by a hash of doc_id: the same ones in each run, spread over all sources.

    A count comes first. Rows whose hash is beyond what 1.5 times `most` rows need, and 200 more, are dropped where they are, so
    the one task that takes the least ones gets about that many, however many partitions there are; if they turn out to be too few
    (equal ids hash alike), the cut doubles.
    """
    total = ids.count()
    keyed = ids.withColumn("__h", F.xxhash64("doc_id", F.lit(seed)))
    share = min(1.0, (1.5 * most + 200) / max(total, 1))
    while share < 1.0:
        below = keyed.filter(F.col("__h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
        if below.count() >= most:
            keyed = below
            break
        share *= 2
    return keyed.orderBy("__h", *ids.columns).limit(most).drop("__h")
