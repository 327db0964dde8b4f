"""The session that the library wants, and tables written to the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: What a session needs beyond a cluster's own settings.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "loomgraph", **settings: str) -> SparkSession:
    """The running session, or a new one with SETTINGS and settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where that is unset, a temporary one if all runs in this
    process (local mode, as in tests); on a cluster, whose executors would not see that, an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.match(r"local(\[|$)", sc.master):
            base = tempfile.mkdtemp(prefix="loomgraph-")
            sc.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/loomgraph/{uuid.uuid4().hex}/{label}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df as a written table in the scratch folder, with its lineage cut: what follows rereads it, whichever executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, a table as it is read, dealt out anew where it comes in fewer partitions than there are cores (a few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors, once a context, so that they need no copy of it of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="loomgraph-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._loomgraph_shipped = True
    return spark


_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, path: str, make: Callable[[], T]) -> T:
    """What make() returns, made once a Spark application for each name and path of input: an index over written tables that later
    queries on the same input share. clear_scratch() forgets it."""
    key = (spark.sparkContext.applicationId, name, path)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables that stored() has written; results that still read them must have been saved."""
    _KEPT.clear()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/loomgraph")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
