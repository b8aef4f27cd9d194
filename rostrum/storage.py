"""The shared folder, cut lineage and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What holds for queries that run to their end here: shuffle files go when a query ends, not when the driver happens to
#: collect garbage, and a batch for Python holds few bytes, however long the texts are.
EAGER = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only where the driver is the one executor, a temporary one does."""
    own = "rostrum.shared.dir"
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(own, None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        where = "file://" + tempfile.mkdtemp(prefix="rostrum-")
        spark.conf.set(own, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextlib.contextmanager
def eager(spark: SparkSession) -> Iterator[None]:
    """EAGER holds inside."""
    old = {k: spark.conf.get(k, None) for k in EAGER}
    for k, v in EAGER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that a lost executor never replays what made it."""
    path = new_path(df.sparkSession, label)
    with eager(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `cut` wrote for `df`, which isn't read any more."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, entries: Column | None = None) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows (counted), else as it is: then Spark shuffles.

    `entries`: what a row holds besides, as the length of an array; those are counted as well.
    """
    if entries is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(1 + entries)).first()[0] or 0) <= rows else df
