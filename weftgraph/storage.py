"""Shared storage: cutting lineage, dense numbering, and text files in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of our own only where none is set
    and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses."""
    return f"{shared_folder(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, column: str, first: int = 0) -> DataFrame:
    """``df`` with dense ids from ``first`` on, in its own order.

    Rows get their place within their partition in the JVM; only one row for each partition is summed up, so no task
    sees all rows.
    """
    placed = durable(df.withColumn("_place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND((1 << 33) - 1)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each partition
    return joined.select(*df.columns, (F.lit(first) + F.col("_start") + inside).cast("long").alias(column))


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, the youngest first."""
    at, system = _file(spark, path)
    if not system.exists(at):
        return []
    found = sorted(((f.getModificationTime(), f.getPath().getName()) for f in system.listStatus(at)), reverse=True)
    return [name for _, name in found]


def delete(spark: SparkSession, path: str) -> None:
    at, system = _file(spark, path)
    system.delete(at, True)


def joined_text(spark: SparkSession, path: str, pieces: Iterable[str | tuple[str]]) -> None:
    """One file of text pieces and, for each (folder,), the files that Spark wrote there, in their order; those go."""
    jvm = spark.sparkContext._jvm
    at, system = _file(spark, path)
    out = system.create(at, True)
    try:
        for p in pieces:
            if isinstance(p, str):
                out.write(bytearray(p.encode()))
                continue
            for name in sorted(n for n in listed(spark, p[0]) if n.startswith("part-")):
                part, store = _file(spark, f"{p[0]}/{name}")
                source = store.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, _BLOCK, False)
                finally:
                    source.close()
            delete(spark, p[0])
    finally:
        out.close()
