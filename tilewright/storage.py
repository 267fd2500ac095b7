"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
#: Spark's setting by which a query's shuffle files go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local session gets a temporary folder, as in tests; on
    a cluster it is an error, as executors would write to disks of their own.
    """
    named = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.conf.get(_CHECKPOINT, None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT} must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tilewright-')}"
        spark.conf.set(_CHECKPOINT, named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread.

    This cuts the lineage with a copy that outlives any executor, and keeps a
    table that is used twice from being computed twice. The shuffle files of the
    writing go with its end instead of waiting for the driver to collect garbage.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {file.rsplit("/", 2)[-2] for file in df.inputFiles()}:
            if not re.search("-[0-9a-f]{32}$", name):
                raise ValueError(f"{name} is no written table")
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows times bytes a row under which a side may be broadcast.
BROADCAST_BYTES = 48 << 20


def small_enough(rows: int, row_bytes: int) -> bool:
    """Whether a counted table may be broadcast; beyond it, callers join by a shuffle."""
    return rows * row_bytes <= BROADCAST_BYTES
