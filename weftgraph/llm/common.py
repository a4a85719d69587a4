"""Session helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is set only where the session has none and driver and executors are one process (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="weftgraph-checkpoints-")
    spark.sparkContext.setCheckpointDir(local)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, AttributeError, OSError):  # the session has already ended; its folder goes with it
        return


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: this cuts the lineage,
    survives lost executors and keeps column pruning. The files go when Python exits."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: texts may be long, and JVM and worker both hold a batch.
BATCH_ROWS, _BATCH_CONF, _BATCH_DEFAULT = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a context; smaller Arrow batches where the session has Spark's own number."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="weftgraph-zip-"), "weftgraph_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(target)
    sc._weftgraph_shipped = True
