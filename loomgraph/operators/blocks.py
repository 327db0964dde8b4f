"""Rows in blocks: a set's parts met in pairs, matrices of Arrow columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of a set, two of which meet in a task, and of the tiles that the task takes them in.
BLOCK, TILE = 16_384, 2_048


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spans(n: int, step: int) -> list[slice]:
    return [slice(k, min(k + step, n)) for k in range(0, n, step)]


def in_parts(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """rows (group, id, ..) with part, one of the `parts` of about `block` rows of their group of `size`, by a hash of their ids."""
    n = rows.groupBy(F.col(group).alias("__of")).agg(F.count("*").alias("size"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return rows.join(n, F.col(group).eqNullSafe(F.col("__of"))).drop("__of").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def meeting(parted: DataFrame, group: str, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f(rows, rows) of any two parts of each group of in_parts(), each pair of parts one task; of a part with itself, f(rows, None).
    A row is sent to as many tasks as its group has parts."""
    other = parted.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = other.withColumn("lo", F.least("part", "__other")).withColumn("hi", F.greatest("part", "__other")).drop("__other")

    def run(t: pa.Table) -> pa.Table:
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        own = np.asarray(t.column("part")) == lo
        return f(t, None) if lo == hi else f(t.filter(pa.array(own)), t.filter(pa.array(~own)))

    return rows.groupBy(group, "lo", "hi").applyInArrow(run, schema)
